"""Token-id files coded by a static range asymmetric numeral system.

Method: the ids' frequencies over the whole corpus make one shared table;
independent blocks of whole documents are coded with interleaved lanes
(``rans``), carry checkpoints inside and a checksum, and are decoded in
parallel, block by block or checkpoint by checkpoint.

File format, a folder of two tables that Spark writes and commits:
``table`` (freq: binary, u32 for each id) and ``blocks`` (part, pos: the
block's place in document order; doc_ids and n_tokens of its documents,
payload, payload_crc32). Blocks hold about ``block_ids`` ids; a document is
never split, so a longer one makes a longer block.

Scale. One range exchange of the texts by document id; each text is
encoded once and its ids are kept as a written table for the two passes
over them (count, code). Counts are summed by id in Spark: as many rows as
the vocabulary has. Places in the corpus come from the blocks' sizes,
summed in order inside a part and then over the parts.

Defined cases. Documents are ordered by id, nulls first, then by text hash.
A null or empty text is the end id alone. Repeated rows stay, one after the
other. No documents, no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import stored, table, text_hash, work_path
from .packing import tokenizer_path
from .tokens import with_end


def id_type(path: str) -> str:
    """The narrowest little-endian type for the ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


def token_rows(docs: DataFrame, path: str, kind: str, end_id: int = 2) -> DataFrame:
    """(doc_id, n, ids as bytes of ``kind``, part, pos) in document order, stored."""
    size = int(kind[-1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for rows, ids, n in with_end(batches, path, end_id):
            edge = pa.array(np.concatenate(([0], size * np.cumsum(n))).astype(np.int32))
            raw = pa.Array.from_buffers(pa.binary(), len(n),
                                        [None, edge.buffers()[1], pa.py_buffer(ids.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), raw, pa.array(np.full(len(n), part, np.int32)),
                 pa.array(np.arange(pos, pos + len(n)))], ["doc_id", "n", "ids", "part", "pos"])
            pos += len(n)

    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    run = docs.select("doc_id", text_hash(docs["text"]).alias("th"), "text") \
        .repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    return stored(run.mapInArrow(encode, f"doc_id {doc_kind}, n long, ids binary, part int, pos long"), "ids")


def _counts(ids: DataFrame, kind: str) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            if len(n) > len(total):
                total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
            total[:len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    got = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, block_ids: int = 1 << 19) -> None:
    """Encode all texts and write the coded files to ``folder``."""
    width = id_type(path)
    ids = token_rows(docs, path, width, end_id)
    freq = rans.Table.of_counts(_counts(ids, width))
    spark = docs.sparkSession
    spark.createDataFrame([(freq.freq.tobytes(),)], "freq binary").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq.freq.tobytes())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rans.Table(np.frombuffer(shared.value, "<u4"))

        def block(rows):
            payload = rans.encode(np.frombuffer(b"".join(r[2] for r in rows), width), own)
            return pa.RecordBatch.from_arrays([
                pa.array([rows[0][3]], pa.int32()), pa.array([rows[0][4]], pa.int64()),
                pa.array([[r[0] for r in rows]], pa.list_(kind)),
                pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([payload]),
                pa.array([zlib.crc32(payload)], pa.int64())],
                ["part", "pos", "doc_ids", "n_tokens", "payload", "payload_crc32"])

        rows, size, kind = [], 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if rows and (size >= block_ids or (r[3], r[4]) != (rows[-1][3], rows[-1][4] + 1)):
                    yield block(rows)
                    rows, size = [], 0
                rows.append(r)
                size += r[1]
        if rows:
            yield block(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids.mapInArrow(code, f"part int, pos long, doc_ids array<{kind}>, n_tokens array<long>, payload binary, "
                   "payload_crc32 long").write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files of ``folder``."""
    freq = bytes(spark.read.parquet(f"{folder}/table").first()["freq"])
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{folder}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rans.Table(np.frombuffer(shared.value, "<u4"))
        for b in batches:
            for part, pos, docs, n, payload, crc in zip(*(c.to_pylist() for c in b.columns)):
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"block {part}/{pos} is damaged")
                raw = memoryview(rans.decode(payload, own).astype("<u4").tobytes())
                ends = np.cumsum(n)
                spans = list(zip((4 * (ends - n)).tolist(), (4 * ends).tolist()))
                cols = [pa.array([part] * len(n), pa.int32()), pa.array([pos] * len(n), pa.int64()),
                        pa.array(docs, b.schema.field(2).type.value_type), pa.array(ends - n), pa.array(n, pa.int64()),
                        pa.array([zlib.crc32(raw[a:z]) for a, z in spans], pa.int64())]
                names = ["part", "pos", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(raw[a:z], "<u4").astype(np.int64) for a, z in spans],
                                         pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = blocks.select("part", "pos", "doc_ids", "n_tokens", "payload", "payload_crc32").mapInArrow(
        decode, f"part int, pos long, doc_id {kind}, inside long, n_tokens long, ids_crc32 long"
        + ", ids array<long>" * with_ids)
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.select("part", "pos", size.alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("part_start"))
    sizes = sizes.select("part", "pos", F.coalesce(
        F.sum("n").over(earlier.partitionBy("part").orderBy("pos")), F.lit(0)).alias("block_start"))
    places = sizes.join(parts, "part").select(
        "part", "pos", (F.col("part_start") + F.col("block_start")).alias("before"))
    return rows.join(places, ["part", "pos"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_tokens(spark, folder)
