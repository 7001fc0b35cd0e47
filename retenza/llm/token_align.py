"""Alignment of two tokenizers over a corpus, with external counting of id pairs.

Method. Tokens of A (byte-level BPE on a blank and the text) and of B (sentencepiece
on the text, to which it adds the blank) cover the same bytes. Where both end a
token they cut them into groups; two tokens are linked if their byte ranges
overlap, and each stretch between neighbouring token ends of either side
is one such link. A pair of ids counts the documents that hold it linked.

Counting is external. A task collects (pair, document) records in chunks of
``most`` records, sorts a chunk by A id, B id and document, and writes it, cut
into radix partitions by A id, as zstd runs. The runs of a partition are merged
by a k-way heap, which counts each pair; as all pairs of an A id come together
(A-major order), its highest count is known when the next A id begins. The runs
are then streamed once more past these counts, and each gives its
documents' contributions back to the chunk they came from.

Scale. Records never leave their run except as sums. A partition with much data,
such as that of an A id which a third of all records hold, is split by salt into
pieces of about ``piece_bytes`` of runs; each piece is merged on its own (so copies
are summed before anything meets), and merged pieces are merged again, ``FAN`` at a
time, until one is left for each partition. A task holds the open frames of its
runs while it merges, and one partition's counts and one run while it
streams. Runs are tables in the shared folder; a lost task reads them again.

Defined cases. Texts that are null, empty, or whose joined A or B bytes
differ from a blank and the text have no tokens: all numbers are 0 and
``groups_sha256`` is ''. Null ids, repeated ids and repeated rows are documents like
any other. No documents, no rows. Ids are under 2**20 on both sides.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, text_groups
from .packing import tokenizer_path
from .tokens import TokenBytes, byte_level_bytes, piece_bytes, piece_tokenizer, tokenizer

SIDE_BITS, DOC_BITS, RADIX_BITS = 20, 24, 6
FRAME, FAN = 4096, 32
_SIDE, _DOC = (1 << SIDE_BITS) - 1, (1 << DOC_BITS) - 1
#: Spreads A ids over the partitions; odd, so that it can be undone.
_SPREAD = 0x9E375
_UNSPREAD = pow(_SPREAD, -1, 1 << SIDE_BITS)

DOC_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
OUT_COLUMNS = (*DOC_COLUMNS, "n_best", "count_sum")


# ---------------------------------------------------------------- alignment of texts
def _grouped_ids(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
    """Each id in decimal with the sign after it, A's of a group before B's, group after group."""
    names_a, names_b = _names(int(a.max()) + 1, b"|"), _names(int(b.max()) + 1, b";")
    in_a, in_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last           # groups before
    a_ends, b_ends = np.flatnonzero(a_last) + 1, np.concatenate(([0], np.flatnonzero(b_last) + 1))
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + b_ends[in_a]] = names_a[a_last.astype(np.int8), a]
    out[np.arange(len(b)) + a_ends[in_b]] = names_b[b_last.astype(np.int8), b]
    return out


_NAMES: dict[bytes, np.ndarray] = {}


def _names(n: int, last: bytes) -> np.ndarray:
    """Ids in decimal, with a comma ([0]) or with ``last`` ([1]); one table for each side."""
    known = _NAMES.get(last)
    if known is None or known.shape[1] < n:
        known = np.empty((2, max(n, 1 << 15)), object)
        for k, sign in enumerate((b",", last)):
            known[k] = [b"%d%b" % (i, sign) for i in range(known.shape[1])]
        _NAMES[last] = known
    return known


def _true_docs(raws: list[bytes], ids: np.ndarray, n: np.ndarray, names: TokenBytes) -> np.ndarray:
    """Of which documents the tokens' bytes, joined, are the text."""
    size = names.size[ids]
    sums = np.concatenate(([0], np.cumsum(size)))
    ends = np.cumsum(n)
    own = sums[ends] - sums[ends - n]
    joined = names.joined(ids, size).tobytes()
    at = sums[ends - n].tolist()
    return np.array([len(r) == k and joined[p:p + k] == r for r, k, p in zip(raws, own.tolist(), at)], bool)


class Aligner:
    """Aligns groups of texts by two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokenizer(path_a, True), piece_tokenizer(path_b)
        self.bytes_a, self.bytes_b = byte_level_bytes(path_a), piece_bytes(path_b)
        if max(len(self.bytes_a.size), len(self.bytes_b.size)) > _SIDE:
            raise ValueError(f"a vocabulary has more than {_SIDE} ids")

    def __call__(self, texts: list[str | None]):
        """``DOC_COLUMNS`` and hashes of all texts, and of each link the document, the A id, the B id."""
        spaced = [" " + t if t else "" for t in texts]
        raws = [t.encode() for t in spaced]
        a, na = self.a.encode(spaced)
        b, nb = self.b.encode(spaced)
        good = _true_docs(raws, a, na, self.bytes_a) & _true_docs(raws, b, nb, self.bytes_b)
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        counts, sha = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
        counts[0], counts[1] = na, nb
        if not len(a):
            return counts, sha, (a.astype(np.int64),) * 3
        ends_a, ends_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))]
        ia, ib = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = (ends_a[ia] == ends) & (ends_b[ib] == ends)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[ia[both]] = b_last[ib[both]] = True
        doc = np.repeat(np.arange(len(texts)), na)[ia]
        counts[2] = np.bincount(doc[both], minlength=len(texts))
        counts[3] = np.bincount(doc, minlength=len(texts))
        items, at = _grouped_ids(a, b, a_last, b_last).tolist(), 0
        for i, k in enumerate((na + nb).tolist()):
            if k:
                sha[i] = hashlib.sha256(b"".join(items[at:at + k])[:-1]).hexdigest()
                at += k
        return counts, sha, (doc, a[ia].astype(np.int64), b[ib].astype(np.int64))


# ---------------------------------------------------------------- runs
def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, in zstd."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(columns[0])) + b"".join(planes))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for kind in map(np.dtype, kinds):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def frames(keys: np.ndarray, n: np.ndarray, *more: np.ndarray) -> bytes:
    """A sorted run of keys with numbers, in frames that can be read one after the other."""
    out = []
    for i in range(0, len(keys), FRAME):
        part = slice(i, i + FRAME)
        blob = pack(np.diff(keys[part], prepend=np.uint64(0)), n[part], *[m[part] for m in more])
        out += [struct.pack("<I", len(blob)), blob]
    return b"".join(out)


def read_frames(run: bytes, *kinds) -> Iterator[list[np.ndarray]]:
    at = 0
    while at < len(run):
        size = struct.unpack_from("<I", run, at)[0]
        columns = unpack(run[at + 4:at + 4 + size], np.uint64, *kinds)
        yield [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]
        at += 4 + size


def chunk_runs(keys: list[np.ndarray], times: list[np.ndarray]):
    """(radix, run of pairs and their documents, run of documents and links) of a chunk's
    records: pair and document in one number, and how many links the record stands for."""
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order].astype(np.uint32)
    pair, doc = key >> np.uint64(DOC_BITS), (key & np.uint64(_DOC)).astype(np.uint32)
    edges = np.searchsorted(pair, np.arange((1 << RADIX_BITS) + 1, dtype=np.uint64)
                            << np.uint64(2 * SIDE_BITS - RADIX_BITS))
    for r, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if i < j:
            own = pair[i:j]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            held = np.diff(np.append(first, len(own))).astype(np.uint64)
            yield r, frames(own[first], held), pack(np.diff(doc[i:j], prepend=np.uint32(0)), n[i:j])


ALIGNED = ("part int, chunk int, no int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "r int, bytes long, pairs binary, docs binary")


def aligned_docs(docs: DataFrame, path_a: str, path_b: str, most: int = 2_000_000, group: int = 1 << 20) -> DataFrame:
    """doc_id and ``ALIGNED``: rows of documents (r is null) and rows of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, part, chunk, no, size = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0, 0, 0
        keys, times, kind, types = [], [], None, None

        def batch(ids, **columns) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]],
                ["doc_id", *types])

        def flush() -> Iterator[pa.RecordBatch]:
            for r, pairs, held in chunk_runs(keys, times) if size else ():
                yield batch(pa.nulls(1, kind), part=[part], chunk=[chunk], r=[r], bytes=[len(pairs) + len(held)],
                            pairs=[pairs], docs=[held])

        wide = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = {c.split()[0]: wide[c.split()[1]] for c in ALIGNED.split(", ")}
        for b in batches:
            kind = b.schema.field(0).type
            for i, texts in text_groups(b.column(1), group):
                j = i + len(texts)
                counts, sha, (doc, a, other) = align(texts)
                pair = (a * _SPREAD & _SIDE) << SIDE_BITS | other
                key, n = np.unique(pair.astype(np.uint64) << np.uint64(DOC_BITS) | (doc + no).astype(np.uint64),
                                   return_counts=True)
                keys.append(key)
                times.append(n)
                size += len(key)
                yield batch(b.column(0).slice(i, j - i), part=np.full(j - i, part, np.int32),
                            chunk=np.full(j - i, chunk, np.int32), no=np.arange(no, no + j - i, dtype=np.int32),
                            groups_sha256=sha, **dict(zip(DOC_COLUMNS, counts)))
                no += j - i
                if size >= most or no > _DOC >> 1:
                    yield from flush()
                    keys, times, chunk, no, size = [], [], chunk + 1, 0, 0
        if types is not None:
            yield from flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ALIGNED}")


# ---------------------------------------------------------------- counting
def _stream(runs: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, number) of runs that follow one another, frame by frame."""
    for run in runs:
        for keys, n in read_frames(run, np.uint64):
            yield from zip(keys.tolist(), n.tolist())


def _summed(streams: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """The sorted streams as one, equal pairs added up, by a heap of their heads."""
    last, total = -1, 0
    for key, n in heapq.merge(*streams):
        if key == last:
            total += n
        else:
            if last >= 0:
                yield last, total
            last, total = key, n
    if last >= 0:
        yield last, total


def _with_best(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """Whether a pair has the highest number of its A id (the pairs come in A-major order)."""
    for _, own in itertools.groupby(pairs, lambda p: p[0] >> SIDE_BITS):
        own = list(own)                                     # one A id's B ids
        top = max(n for _, n in own)
        yield from ((key, n, n == top) for key, n in own)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _blocks(items: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while block := list(itertools.islice(items, size)):
        yield block


def merge_pass(runs: DataFrame, final: bool, block: int = 1 << 18) -> DataFrame:
    """(r, s, seq, run) from rows (r, s, source, seq, run): the runs of all sources with one r and s,
    merged. In the final pass, with one s for each r, runs also tell the best pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r, s), rows in itertools.groupby(_rows(batches), lambda x: x[:2]):
            runs = [[x[4] for x in own] for _, own in itertools.groupby(rows, lambda x: x[2])]   # still compressed
            merged = _summed([_stream(x) for x in runs])
            for seq, items in enumerate(_blocks(_with_best(merged) if final else merged, block)):
                keys, n, *best = zip(*items)
                blob = frames(np.array(keys, np.uint64), np.array(n, np.uint64), *[np.array(x, np.uint8) for x in best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([seq], pa.int32()),
                     pa.array([blob], pa.binary())], ["r", "s", "seq", "run"])

    return runs.select("r", "s", "source", "seq", "run").repartition("r", "s") \
        .sortWithinPartitions("r", "s", "source", "seq").mapInArrow(run, "r int, s int, seq int, run binary")


def salted(runs: DataFrame, piece_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """The runs with a salt ``s``, (r, pieces) and the most pieces of a partition."""
    pieces = stored(runs.groupBy("r").agg(F.ceil(F.sum("bytes") / piece_bytes).cast("int").alias("pieces")),
                    "align-pieces")                         # a row for each radix partition at most
    most = pieces.agg(F.max("pieces").alias("m")).first()["m"] or 0
    own = runs.join(F.broadcast(pieces), "r") \
        .withColumn("s", F.pmod(F.xxhash64("part", "chunk"), F.col("pieces")).cast("int"))
    return own, pieces, most


def count_pairs(runs: DataFrame, most: int) -> DataFrame:
    """(r, seq, run) with runs of (pair, documents, best) over all salted runs."""
    level = runs.select("r", "s", F.struct("part", "chunk").alias("source"), F.lit(0).alias("seq"),
                        F.col("pairs").alias("run"))
    while most > 1:
        level = stored(merge_pass(level, False), "align-merged")
        most = -(-most // FAN)
        level = level.select("r", (F.col("s") / FAN).cast("int").alias("s"),
                             F.struct(F.col("s").alias("part"), F.lit(0).alias("chunk")).alias("source"), "seq", "run")
    return stored(merge_pass(level, True).drop("s"), "align-counts")


def pair_counts(counts: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents hold a pair of ids linked, and whether no
    other pair of the A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (blob,) in _rows(batches):
            for keys, n, best in read_frames(blob, np.uint64, np.uint8):
                keys = keys.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((keys >> SIDE_BITS) * _UNSPREAD & _SIDE).astype(np.int32)),
                     pa.array((keys & _SIDE).astype(np.int32)), pa.array(n.astype(np.int64)),
                     pa.array(best.astype(bool))], ["a", "b", "documents", "best"])

    return counts.select("run").mapInArrow(run, "a int, b int, documents long, best boolean")


def contributions(runs: DataFrame, counts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(part, chunk, given): for each run, what its documents get from the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, table_ = None, [], None
        for r, s, seq, part, chunk, pairs, docs in _rows(batches):
            if (r, s) != place:
                place, held, table_ = (r, s), [], None
            if docs is None:                                # counts sort before runs
                held += read_frames(pairs, np.uint64, np.uint8)
                continue
            table_ = table_ or [np.concatenate(c) for c in zip(*held)]
            own = [np.concatenate(c) for c in zip(*read_frames(pairs, np.uint64))]
            at = np.repeat(np.searchsorted(table_[0], own[0]), own[1].astype(np.int64))
            step, times = unpack(docs, np.uint32, np.uint32)
            no, back = np.unique(np.cumsum(step, dtype=np.uint32), return_inverse=True)
            best, total = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
            np.add.at(best, back, np.where(table_[2][at] > 0, times, 0).astype(np.int64))
            np.add.at(total, back, table_[1][at].astype(np.int64) * times)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([pack(no, best, total)])],
                ["part", "chunk", "given"])

    none = F.lit(None)
    told = counts.join(F.broadcast(pieces), "r").select(
        "r", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("s"), "seq",
        none.cast("int").alias("part"), none.cast("int").alias("chunk"), F.col("run").alias("pairs"),
        none.cast("binary").alias("docs"))
    rows = told.unionByName(runs.select("r", "s", F.lit(None).cast("int").alias("seq"), "part", "chunk", "pairs", "docs"))
    return rows.repartition("r", "s") \
        .sortWithinPartitions("r", "s", F.col("docs").isNotNull(), "seq", "part", "chunk") \
        .mapInArrow(run, "part int, chunk int, given binary")


def with_contributions(rows: DataFrame, given: DataFrame) -> DataFrame:
    """The documents' rows with n_best and count_sum, chunk by chunk."""
    names = ["doc_id", *DOC_COLUMNS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums = None, None
        for b in batches:
            parts, chunks = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero((parts[1:] != parts[:-1]) | (chunks[1:] != chunks[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                if i == j:
                    continue
                if (parts[i], chunks[i]) != place:
                    place, sums = (parts[i], chunks[i]), np.zeros((2, 1), np.int64)
                own = b.slice(i, j - i)
                blobs = own.column(2).drop_null().to_pylist()          # they sort before the documents
                for no, best, total in (unpack(x, np.uint32, np.int64, np.int64) for x in blobs):
                    if no[-1] >= sums.shape[1]:
                        more = max(int(no[-1]) + 1, 2 * sums.shape[1]) - sums.shape[1]
                        sums = np.concatenate((sums, np.zeros((2, more), np.int64)), 1)
                    sums[0, no] += best
                    sums[1, no] += total
                own = own.slice(len(blobs))
                if own.num_rows:
                    no = own.column(3).to_numpy()
                    got = np.where(no < sums.shape[1], sums[:, np.minimum(no, sums.shape[1] - 1)], 0)
                    yield pa.RecordBatch.from_arrays(
                        [own.column(4), *own.columns[5:9], pa.array(got[0]), pa.array(got[1]), own.column(9)], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["part", "chunk", "given", "no", "doc_id", *DOC_COLUMNS, "groups_sha256"]
    both = rows.withColumn("given", F.lit(None).cast("binary")).select(*columns) \
        .unionByName(given, allowMissingColumns=True).select(*columns)
    return both.repartition("part", "chunk").sortWithinPartitions("part", "chunk", F.col("given").isNull(), "no") \
        .mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in OUT_COLUMNS) + ", groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str, most: int = 2_000_000,
          piece_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """One row per document (doc_id, ``OUT_COLUMNS``, groups_sha256), and the ``pair_counts``."""
    rows = stored(aligned_docs(docs, path_a, path_b, most), "aligned", "lz4")
    runs, pieces, deepest = salted(rows.filter(F.col("r").isNotNull()), piece_bytes)
    counts = count_pairs(runs, deepest)
    given = contributions(runs, counts, pieces)
    return with_contributions(rows.filter(F.col("r").isNull()), given), pair_counts(counts)


def op13_token_align(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                 tokenizer_path("piece_bpe_32k.model"))[0]
