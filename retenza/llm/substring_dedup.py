"""Removal of repeated passages by prefix-partitioned suffix trees.

Contract. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is 13 words
of one document; a word goes if a window over it also starts in a document
with a smaller id. Windows are judged on the input.

Method. The word suffixes of all documents would be as many as the words,
each with its path. Two steps keep that small without losing a window:

1. Anchors. Of the six 8-word prefixes inside a window the one with the
   smallest hash is its anchor; equal windows have equal anchors, and a
   document has about one for four words. Only windows whose anchor is found
   in two documents can repeat; only their suffixes are kept.
2. Suffix trees, cut at depth 13. A suffix's path is its first 8 and last 5
   words (64 bits each). Suffixes are dealt out by prefix: prefixes of 8
   words share groups; a group that outgrows ``group_rows`` is split by the
   whole 13. Inside a group, suffixes in
   path order are the leaves of its subtree, in which equal neighbours form
   the internal nodes; a node of depth 13 is a repeat, and each of its
   leaves with a larger id than its smallest is removed. Overlapping removed
   windows of a document join to its maximal repeated passages.

Scale. Before each shuffle a task combines what it has: of an anchor or path
that many documents of a batch share, one row goes on, so a passage in a
third of all documents sends one row per batch. Subtrees are walked in sort
order, in constant memory. Copies of a whole text drop out after the
anchors. Texts are shuffled only for documents with a shared anchor; these
are picked by a broadcast of row numbers up to ``broadcast_rows`` of them, and
by a plain join beyond.

Defined cases. A null text has no words; documents under 13 words have no
window. Documents with a null id are left alone and don't count as
earlier. Rows with equal ids don't count as earlier to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table, text_hash
from .near_dup import _mix, _Q

WINDOW, PREFIX = 13, 8


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHash()


def _ngrams(w: np.ndarray, size: int) -> np.ndarray:
    h = np.full(max(0, len(w) - size + 1), size, np.uint64)
    for j in range(size):
        h = _mix(h * _Q + w[j:len(w) - size + 1 + j])
    return h


def _numbers(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > 400_000:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_anchors(prefixes: np.ndarray) -> np.ndarray:
    """The smallest of the ``WINDOW - PREFIX + 1`` prefix hashes in each window."""
    low, have, want = prefixes, 1, WINDOW - PREFIX + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    kind = pa.int64() if values.dtype == np.uint64 else pa.int32()
    flat = _signed(values) if values.dtype == np.uint64 else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), flat)


def document_rows(docs: DataFrame) -> DataFrame:
    """(row, id, th, fp, n, sha, solo, sent, local): the anchors of each document. ``local``:
    also in another document of the batch; ``sent``: those of them it speaks for; ``solo``: the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, fps, sizes, shas = [], [], [], []
            for doc_id, text in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                words = text.encode().split() if text else []
                joined = b" ".join(words)
                fps.append(hashlib.blake2b(joined, digest_size=16).digest() if words else None)
                shas.append(hashlib.sha256(joined).hexdigest())
                sizes.append(len(words))
                own.append(np.unique(window_anchors(_ngrams(_numbers(words), PREFIX)))
                           if len(words) >= WINDOW and doc_id is not None else np.zeros(0, np.uint64))
            anchor = np.concatenate(own) if own else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(own)), [len(a) for a in own])
            order = np.argsort(anchor, kind="stable")
            a = anchor[order]
            first = np.concatenate(([True], a[1:] != a[:-1]))[:len(a)]
            more = np.concatenate((~first[1:], [False]))[:len(a)]
            flags = np.zeros((3, len(a)), bool)              # solo, sent, local in document order
            flags[0, order] = first & ~more
            flags[1, order] = first & more
            flags[2, order] = more | ~first
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas),
                 *[_lists(anchor[f], np.bincount(doc[f], minlength=len(own)).tolist()) for f in flags]],
                ["row", "id", "th", "fp", "n", "sha", "solo", "sent", "local"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id(), "doc_id", text_hash(docs["text"]), "text").mapInArrow(
        run, f"row long, id {kind}, th long, fp binary, n long, sha string, solo array<long>, "
        "sent array<long>, local array<long>")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(row, far): the solo anchors of a document that other batches have too. Rows of one
    anchor come one after the other; a row goes on if it has a neighbour."""
    one = rows.select(F.explode("solo").alias("anchor"), (F.col("row") * 2).alias("code"))
    many = rows.select(F.explode("sent").alias("anchor"), (F.col("row") * 2 + 1).alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, code, done = None, 0, True                  # the last row so far, and if it went on
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (b.column(i).to_numpy() for i in (0, 1))
            like_next = np.concatenate((a[1:] == a[:-1], [False]))
            like_last = np.concatenate(([anchor == a[0]], a[1:] == a[:-1]))
            go = like_next | like_last
            out_a, out_c = a[go], c[go]
            if like_last[0] and not done:
                out_a, out_c = np.append(out_a, anchor), np.append(out_c, code)
            anchor, code, done = a[-1], c[-1], bool(go[-1])
            solo = out_c % 2 == 0
            yield pa.RecordBatch.from_arrays([pa.array(out_c[solo] >> 1), pa.array(out_a[solo])], ["row", "anchor"])

    runs = one.unionAll(many).repartition("anchor").sortWithinPartitions("anchor")
    return runs.mapInArrow(run, "row long, anchor long").groupBy("row").agg(F.collect_list("anchor").alias("far"))


def live_suffixes(texts: DataFrame) -> DataFrame:
    """From (row, id, text, anchors): the text with its windows over shared anchors. ``gone``:
    starts that repeat one of a smaller id in the batch; p, e, pos: path and start of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            p, e, pos = [], [], []
            for text, anchors in zip(b.column(2).to_pylist(), b.column(3)):
                w = _numbers(text.encode().split())
                prefix, rest = _ngrams(w, PREFIX), _ngrams(w, WINDOW - PREFIX)
                known = np.unique(anchors.values.to_numpy().view(np.uint64))
                low = window_anchors(prefix)
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low)
                p.append(prefix[at])
                e.append(rest[at + PREFIX])
                pos.append(at.astype(np.int32))
            doc = np.repeat(np.arange(len(p)), [len(x) for x in p])
            p, e, pos = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (p, e, pos))
            own, path = ids[doc], _mix(p * _Q + e)
            order = np.lexsort((own, path))
            s = path[order]
            node = np.cumsum(np.concatenate(([0], s[1:] != s[:-1]))[:len(s)])
            least = own[order][np.searchsorted(node, node)]
            gone = np.zeros(len(s), bool)
            gone[order] = own[order] > least

            def lists(values, mask):
                return _lists(values[mask], np.bincount(doc[mask], minlength=b.num_rows).tolist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], lists(pos.astype(np.int32), gone), lists(p, ~gone), lists(e, ~gone),
                 lists(pos.astype(np.int32), ~gone)], ["row", "id", "text", "gone", "p", "e", "pos"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("row", "id", "text", "anchors").mapInArrow(
        run, f"row long, id {kind}, text string, gone array<int>, p array<long>, e array<long>, pos array<int>")


def prefix_groups(suffixes: DataFrame, group_rows: int) -> DataFrame:
    """``suffixes`` with ``part``, the group of its prefix: hashed 8-word prefixes, and in
    groups over ``group_rows`` all 13 words. Counts are per group, not per prefix."""
    total = suffixes.count()
    groups = 1 << min(20, max(10, (4 * total // group_rows).bit_length()))
    out = suffixes.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(groups)))
    large = stored(out.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
                   .filter(F.col("c") > group_rows).select("part", F.lit(True).alias("large")), "large-groups")
    if large.isEmpty():
        return out
    return out.join(large, "part", "left").withColumn(
        "part", F.when(F.col("large"), F.xxhash64("p", "e")).otherwise(F.col("part"))).drop("large")


def repeated_leaves(suffixes: DataFrame, group_rows: int) -> DataFrame:
    """(row, far): starts of the suffixes under a node of depth 13 that a smaller id is under too."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, least = None, None
        for b in batches:
            if not b.num_rows:
                continue
            p, e, own = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            new = np.concatenate(([node != (p[0], e[0])], (p[1:] != p[:-1]) | (e[1:] != e[:-1])))
            start = np.maximum.accumulate(np.where(new, np.arange(len(p)), -1))
            low = own[np.maximum(start, 0)]
            if start[0] < 0:
                low = np.where(start < 0, least, low)
            node, least = (p[-1], e[-1]), low[-1]
            yield b.select([3, 4]).filter(pa.array(own > low))

    rows = prefix_groups(suffixes, group_rows).repartition("part") \
        .sortWithinPartitions("part", "p", "e", "id").select("p", "e", "id", "row", "pos")
    return rows.mapInArrow(walk, "row long, pos int").groupBy("row").agg(F.collect_list("pos").alias("far"))


def cut(texts: DataFrame) -> DataFrame:
    """From (row, text, gone, far): removed spans of words, kept text and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, gone, far in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int32)
                starts = np.unique(np.array([*(gone or ()), *(far or ())], np.int64))
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + WINDOW, -1)
                hit = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                kept = b" ".join([w for w, h in zip(words, hit.tolist()) if not h])
                cols[0].append(int(hit.sum()))
                cols[1].append([{"first": x, "end": y} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist())])
                cols[2].append(kept.decode())
                cols[3].append(hashlib.sha256(kept).hexdigest())
            span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], span), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.string())], ["row", "removed", "spans", "kept_text", "kept_sha"])

    return texts.select("row", "text", "gone", "far").mapInArrow(
        run, "row long, removed long, spans array<struct<first:int,end:int>>, kept_text string, kept_sha string")


def substring_dedup(docs: DataFrame, group_rows: int = 1_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed words, from first to
    before end), kept_text (null: all words stay), kept_sha256 (of the kept words, by blanks)."""
    rows = stored(document_rows(docs), "anchors")
    firsts = rows.filter((F.col("n") >= WINDOW) & F.col("id").isNotNull()) \
        .groupBy("fp").agg(F.min("id").alias("first"))
    light = rows.select("row", "id", "th", "fp", "n", "sha").join(firsts, "fp", "left") \
        .withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("fp", "first")
    light = stored(light, "rows")
    far = shared_anchors(rows)
    live = rows.select("row", "local").join(far, "row", "left") \
        .withColumn("anchors", F.concat("local", F.coalesce("far", F.array().cast("array<long>")))) \
        .filter(F.size("anchors") > 0).select("row", "anchors")
    live = stored(live.join(light.filter(~F.col("copy")).select("row", "id", "th"), "row"), "live")
    discard(rows)
    texts = docs.select(docs["doc_id"].alias("id"), text_hash(docs["text"]).alias("th"), "text")
    if live.count() <= broadcast_rows:
        texts = texts.join(F.broadcast(live.select("id", "th").distinct()), ["id", "th"], "left_semi")
    texts = live.join(texts, ["id", "th"]).select("row", "id", "text", "anchors")
    leaves = stored(live_suffixes(texts), "suffixes")
    paths = leaves.select("row", "id", F.inline(F.arrays_zip("p", "e", "pos")))
    found = repeated_leaves(paths, group_rows)
    near = leaves.filter(F.size("gone") > 0).select("row", "gone").dropDuplicates(["row"])
    hits = stored(near.join(found, "row", "full_outer"), "repeats")
    texts = leaves.select("row", "text")
    if hits.count() <= broadcast_rows:
        texts = texts.join(F.broadcast(hits.select("row")), "row", "left_semi")
    done = cut(hits.join(texts, "row")).dropDuplicates(["row"])
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n").cast("int").alias("end")))
    return light.join(done, "row", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast(
            "array<struct<first:int,end:int>>"))).alias("spans"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13)),
r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS least FROM w)
  WHERE least < doc_id),
c AS (SELECT doc_id, count(DISTINCT q) AS n, list(DISTINCT q) AS qs
      FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM r) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_removed,
       sha256(CASE WHEN c.n IS NULL THEN array_to_string(ws, ' ')
              WHEN c.n = len(ws) THEN ''
              ELSE array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(qs, i)], ' ')
              END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
