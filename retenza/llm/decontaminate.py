"""Benchmark decontamination: find test-set windows in training documents.

Method: the benchmark's normalised ``n``-word windows form a broadcast hash
set; each task hashes the words of its texts, scans all token windows against
the set, verifies every hit byte for byte, and documents or spans are removed.
A document never leaves its task, so there is no shuffle and no skew.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. An
item with fewer than ``n`` words, but not none, is one window.

Size. A set is a few flat arrays: sorted window hashes, a filter of their
leading bits, the items of each window, and the benchmark's words for the
verification, about 60 bytes a word of the benchmark. The benchmark is cut into blocks whose sets
take at most ``block_bytes`` (a longer item makes a block of its own). One
block, the usual case, is one pass over the texts. More blocks are more passes:
each keeps the hits of its block in a table and gives its broadcast up before
the next one is made, so a worker never holds more than one set, however large
the benchmark is.

Defined cases. Null and empty texts have no words and are never
contaminated. Null or wordless items have no window. An item without an id
marks words but isn't listed. Items with one id, or equal items, are
listed once per id. Extra columns of documents pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, text_groups, text_hash, word_bytes, word_hashes

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a set for each word of its items, and besides these, as measured in tests/llm.
WORD_COST = 60


def split_words(text: str | None) -> list[bytes]:
    return word_bytes(text).split()


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row."""
    h = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        h = h * _STEP + words[j:len(words) - size + 1 + j]
    return h ^ (h >> np.uint64(29))


class _Windows:
    """The windows of one length: sorted hashes, each with its first word and its items."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        self.hashes, self.words = hashes[first], words[order[first]].astype(np.uint32)
        keep = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])))
        self.items = items[keep]
        self.edges = np.append(np.searchsorted(np.flatnonzero(keep), first), len(self.items)).astype(np.uint32)
        bits = max(10, min(26, int(4 * len(first)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.leading = np.zeros(1 << bits, bool)
        self.leading[(self.hashes * _STEP) >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are here, and where."""
        maybe = np.flatnonzero(self.leading[(hashes * _STEP) >> self.shift])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[maybe]
        return maybe[same], at[same]


class WindowSet:
    """The windows of some benchmark items, by length, with their items."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        normal = [b" ".join(split_words(text)) for _, text in items]
        items, normal = [i for (i, _), t in zip(items, normal) if t], [t for t in normal if t]
        names = {None: -1} | {x: k for k, x in enumerate(sorted({str(i) for i in items if i is not None}))}
        self.names = list(names)[1:]
        self.text = b" ".join(normal)
        starts, words = word_hashes(self.text)
        edges = np.cumsum([0, *(len(t) + 1 for t in normal)])
        first = np.searchsorted(starts, edges)
        self.starts = np.append(starts, len(self.text) + 1).astype(np.uint32)
        count, number = np.diff(first), np.array([names[None if i is None else str(i)] for i in items], np.int32)
        owner = np.repeat(np.arange(len(items)), count)
        left = np.repeat(first[1:], count) - np.arange(len(words))
        self.tables: list[tuple[int, _Windows]] = []
        for size in sorted(set(np.minimum(count, n).tolist())):
            at = np.flatnonzero((np.minimum(count, n)[owner] == size) & (left >= size))
            hashes = _window_hashes(words, size)[at]
            while len(at):                                   # another turn only if two windows share a hash
                own = _Windows(hashes, at, number[owner[at]])
                self.tables.append((size, own))
                lead = own.words[np.searchsorted(own.hashes, hashes)]
                apart = np.array([self.window(int(a), size) != self.window(int(b), size) if a != b else False
                                  for a, b in zip(at, lead)], bool)
                if apart.any():
                    self.tables[-1] = (size, _Windows(hashes[~apart], at[~apart], number[owner[at[~apart]]]))
                at, hashes = at[apart], hashes[apart]

    def window(self, word: int, size: int) -> bytes:
        return self.text[self.starts[word]:self.starts[word + size] - 1]

    def size(self) -> int:
        """Bytes held."""
        return len(self.text) + self.starts.nbytes + sum(map(len, self.names)) + sum(
            x.nbytes for _, t in self.tables for x in (t.hashes, t.words, t.items, t.edges, t.leading))

    def hits(self, raw: bytes, starts: np.ndarray, words: np.ndarray,
             ends: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of every verified window in ``raw``; ``ends``: for each
        word the number of the word after its document."""
        for size, own in self.tables:
            if len(words) < size:
                continue
            found, at = own.find(_window_hashes(words, size))
            inside = found + size <= ends[found] if len(found) else np.zeros(0, bool)
            for s, k in zip(found[inside].tolist(), at[inside].tolist()):
                stop = int(starts[s + size]) if s + size < len(starts) else len(raw)
                if b" ".join(raw[starts[s]:stop].split()) == self.window(int(own.words[k]), size):
                    yield s, size, [self.names[i] for i in own.items[own.edges[k]:own.edges[k + 1]].tolist() if i >= 0]


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[WindowSet]:
    items, words = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        items.append((r["item_id"], r["text"]))
        words += len(split_words(r["text"])) + 1
        if words * WORD_COST >= block_bytes:
            yield WindowSet(items, n)
            items, words = [], 0
    if items:
        yield WindowSet(items, n)


def _scan(column: pa.Array, windows: WindowSet | None, most: int = 1 << 20):
    """For each text: number of words, covered mask, items."""
    for _, texts in text_groups(column, most):
        raws = [word_bytes(t) for t in texts]
        raw = b" ".join(raws)
        starts, words = word_hashes(raw)
        edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        cover = np.zeros(len(words) + 1, np.int32)
        items: dict[int, set[str]] = {}
        if windows is not None:
            for s, k, found in windows.hits(raw, starts, words, np.repeat(edges[1:], np.diff(edges))):
                cover[s] += 1
                cover[s + k] -= 1
                items.setdefault(int(np.searchsorted(edges, s, "right")) - 1, set()).update(found)
        hit = np.cumsum(cover) > 0
        for d, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            yield j - i, hit[i:j], items.get(d, set())


def contaminated(n_words: int, n_hit: int, one_in: int) -> bool:
    return n_hit > 0 and one_in * n_hit >= n_words


RESULT = "n_words long, n_hit long, items array<string>, contaminated boolean"


def _rows(column: pa.Array, windows: WindowSet | None, one_in: int) -> list[pa.Array]:
    rows = [(k, int(hit.sum()), sorted(items)) for k, hit, items in _scan(column, windows)]
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.list_(pa.string())),
            pa.array([contaminated(r[0], r[1], one_in) for r in rows], pa.bool_())]


def _hits_by_block(docs: DataFrame, blocks: Iterator[WindowSet]) -> DataFrame:
    """(id, th, n_words, hit, items) of every text with a hit, merged over all blocks; ``hit`` has
    a bit for each word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, np.packbits(hit).tobytes(), sorted(items)) for i, (k, hit, items) in
                    enumerate(_scan(b.column(2), shared.value)) if hit.any()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
                ["id", "th", "n_words", "hit", "items"])

    spark, kind, parts = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), []
    keyed = docs.select(F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("th"), "text")
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        found = keyed.mapInArrow(scan, f"id {kind}, th long, n_words long, hit binary, items array<string>")
        parts.append(stored(found.dropDuplicates(["id", "th"]), "block-hits"))
        shared.destroy()                                     # workers let go of it
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)

    def merge(rows: pa.Table) -> pa.Table:                   # a row for each block at most
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows.column("hit").to_pylist()])
        items = sorted({x for own in rows.column("items").to_pylist() for x in own})
        return pa.table({"id": rows.column("id").slice(0, 1), "th": rows.column("th").slice(0, 1),
                         "n_words": rows.column("n_words").slice(0, 1), "hit": pa.array([bits.tobytes()]),
                         "items": pa.array([items], pa.list_(pa.string()))})

    return stored(both.groupBy("id", "th").applyInArrow(merge, both.schema), "merged-hits")


def _hit_words(hit: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(hit, np.uint8), count=n).astype(bool)


def _one_or_more(benchmark: DataFrame, n: int, block_bytes: int):
    """(the only block, or None if there are no windows; all blocks if there are several)."""
    made = _blocks(benchmark, n, block_bytes)
    first, second = next(made, None), next(made, None)
    if second is None:
        return first, None

    def rest():
        yield first
        yield second
        yield from made
    return None, rest()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20,
                  block_bytes: int = 128 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids of the
    items found), contaminated (at least one word in ``one_in`` is hit)."""
    only, several = _one_or_more(benchmark, n, block_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_rows(b.column(b.num_columns - 1), shared.value, one_in)],
                                             [*b.schema.names[:-1], *(c.split()[0] for c in RESULT.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    if several is None:
        return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {RESULT}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [0 if h is None else int(_hit_words(h, k).sum())
                    for h, k in zip(b.column(3).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hits, pa.int64()),
                 pa.array([x or [] for x in b.column(2).to_pylist()], pa.list_(pa.string())),
                 pa.array([contaminated(k, h, one_in) for k, h in zip(b.column(1).to_pylist(), hits)], pa.bool_())],
                ["doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    found = _hits_by_block(docs, several)
    rows = docs.select(F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("th"), "text") \
        .mapInArrow(scan, f"id {kind}, th long, {RESULT}")
    return rows.join(found, rows["id"].eqNullSafe(found["id"]) & rows["th"].eqNullSafe(found["th"]), "left").select(
        rows["id"], rows["n_words"], found["items"], "hit").mapInArrow(count, f"doc_id {kind}, {RESULT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 13,
                  one_in: int = 20, block_bytes: int = 128 << 20) -> DataFrame:
    """The documents, all columns, without the contaminated ones, or, with
    ``remove="spans"``, all documents without the hit spans of contaminated ones."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    only, several = _one_or_more(benchmark, n, block_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(only)
    names = docs.columns
    place = names.index("text")

    def cleaned(b: pa.RecordBatch, found: list[np.ndarray | None]) -> pa.RecordBatch:
        """``found``: for each row the hit words if it is contaminated."""
        if remove == "documents":
            return b.filter(pa.array([f is None for f in found], pa.bool_()))
        if all(f is None for f in found):
            return b
        texts = [t if f is None else without_words(t, f) for t, f in zip(b.column(place).to_pylist(), found)]
        return b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield cleaned(b, [hit if contaminated(k, int(hit.sum()), one_in) else None
                              for k, hit, _ in _scan(b.column(place), shared.value)])

    if several is None:
        return docs.mapInArrow(scan, docs.schema)

    def from_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [None if h is None else _hit_words(h, k)
                    for h, k in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            found = [f if f is not None and contaminated(len(f), int(f.sum()), one_in) else None for f in hits]
            yield cleaned(pa.RecordBatch.from_arrays(b.columns[:-2], names), found)

    hits = _hits_by_block(docs, several).select("id", "th", "hit", F.col("n_words").alias("k"))
    rows = docs.join(hits, docs["doc_id"].eqNullSafe(hits["id"])
                     & text_hash(docs["text"]).eqNullSafe(hits["th"]), "left")
    return rows.select(*[docs[c] for c in docs.columns], hits["hit"], hits["k"]).mapInArrow(from_hits, docs.schema)


def without_words(text: str, hit: np.ndarray) -> str:
    """``text`` without each hit run, from its first word to its last."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.lower())]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(raw[at:spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, ws, least(13, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM (
    SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM i)),
dw AS (
  SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
    FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
