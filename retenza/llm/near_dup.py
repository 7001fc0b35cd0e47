"""Near-duplicate documents by Order MinHash and banded alignment.

Method. A text is the sequence of its five-word shingles (the k-mers), each
labelled with how often it occurred before, so that all are different.
A sketch takes the shingles with the smallest values of one hash function
and keeps them in text order; texts with an equal sketch become
candidates. Candidates are verified by aligning the two shingle sequences
inside the diagonal band that the threshold leaves open: with L aligned
shingles of n and m, the similarity is L / (n + m - L), and 0.8 or more
makes a link. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z; a text with one to four words is one shingle.

Sketches. 24 sketches of 5 shingles; a pair at 0.8 shares none with a chance
of about 1e-4 and pairs at 0.2 rarely meet. Texts of up to 40 shingles
have 32 sketches of 4, texts of 32 and more the 24 of 5, so two texts
that can reach 0.8 always have one kind in common.

Classes are the connected components of the links. Texts with equal word
sequences are one node from the start. In each bucket of candidates the
member that meets most others leads; it is compared with all members, which
joins the copies of a text in about one comparison each. What is still
apart may be linked to other members: a bound on what two members can
share, from what each shares with their leader, leaves few pairs, and these
are compared too. So every pair of a bucket is linked by the leader, ruled
out by the bound, or compared.

Scale. Leaders come from a grouped maximum; buckets are joined to their
leaders with plain equi-joins that AQE splits where they are skewed. Only
texts in buckets are shuffled. The members of a leader are held against
each other in blocks of fixed size and only pairs within the bound are
emitted. Links, classes and sketches stay in tables.

Defined cases. Texts without words (null, empty, only signs) are each a
class of their own. Null ids never name a class that has another id. Repeated
rows are copies; of rows equal in id and text one is kept.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same, stored, table, text_groups, text_hash, word_bytes, word_hashes
from .decontaminate import split_words

SHINGLE = 5
_A_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
LONG_SKETCHES, LONG_SIZE, LONG_FROM = 24, 5, 32
SHORT_SKETCHES, SHORT_SIZE, SHORT_TO = 32, 4, 40
_MULTIPLY = np.random.default_rng(20).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    return h ^ (h >> np.uint64(29))


def shingles(words: list[bytes] | np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of words (or of their hashes), in text
    order; all different."""
    w = words if isinstance(words, np.ndarray) else word_hashes(b" ".join(words))[1]
    if not len(w):
        return np.zeros(0, np.uint64)
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = _mix(h * _Q + w[j:len(w) - size + 1 + j])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    if not new.all():
        at = np.arange(len(s))
        label = np.empty(len(s), np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        h = _mix(h + label * _Q)
    return h


def sketches(h: np.ndarray, count: int, size: int, salt: int) -> list[int]:
    """``count`` keys, each of the ``size`` smallest shingles of one hash, in text order."""
    if len(h) <= size:
        chosen = np.broadcast_to(np.arange(len(h)), (count, len(h)))
    else:
        step = max(1, (1 << 22) // len(h))
        chosen = np.concatenate([
            np.sort(np.argpartition(h[None] * _MULTIPLY[salt + i:salt + min(i + step, count), None], size - 1,
                                    axis=1)[:, :size], axis=1) for i in range(0, count, step)])
    key = np.arange(salt + 1, salt + 1 + count).astype(np.uint64)
    for j in range(chosen.shape[1]):
        key = _mix(key * _Q + h[chosen[:, j]])
    return key.view(np.int64).tolist()


def shingled(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """The words of each text, apart by blanks, and its shingles."""
    for _, texts in text_groups(column):
        raws = [word_bytes(t) for t in texts]
        starts, words = word_hashes(b" ".join(raws))
        edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).tolist()
        for raw, i, j in zip(raws, edges, edges[1:]):
            yield raw, shingles(words[i:j])


def sketch_rows(docs: DataFrame) -> DataFrame:
    """(id, th, fp, n, keys): fp stands for the sequence of words, n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, keys = [], [], []
            for raw, h in shingled(b.column(2)):
                fps.append(hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest() if len(h) else None)
                sizes.append(len(h))
                own = []
                if 0 < len(h) <= SHORT_TO:
                    own += sketches(h, SHORT_SKETCHES, SHORT_SIZE, LONG_SKETCHES)
                if len(h) >= LONG_FROM:
                    own += sketches(h, LONG_SKETCHES, LONG_SIZE, 0)
                keys.append(own)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "th", "fp", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(docs["text"]).alias("th"), "text") \
        .mapInArrow(run, f"id {kind}, th long, fp binary, n long, keys array<long>")


def aligned(a: np.ndarray, b: np.ndarray, need: float) -> int:
    """The most shingles of ``a`` and ``b`` that align in order, 0 if under ``need``.
    All shingles of a text differ, so the best alignment is a longest increasing
    run of positions; matches further off the diagonal than
    n + m - 2 * need can't be part of one that is long enough."""
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    there = order[at]
    here = np.flatnonzero(b[there] == a)
    there = there[here]
    there = there[np.abs(here - there) <= len(a) + len(b) - 2 * need]
    if len(there) < need:
        return 0
    if (np.diff(there) > 0).all():
        return len(there)
    tails: list[int] = []
    for p in there.tolist():
        i = bisect_left(tails, p)
        if i == len(tails):
            tails.append(p)
        else:
            tails[i] = p
    return len(tails) if len(tails) >= need else 0


def similar(a: np.ndarray, b: np.ndarray, threshold: float = 0.8) -> bool:
    need = threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9
    return min(len(a), len(b)) > 0 and aligned(a, b, need) > 0


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of fps with both texts."""
    one = texts.select(F.col("fp").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("fp").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "ta", "tb")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """For each pair: ``similar``, the size ``n`` of b, which of a's shingles b has too
    (``held``, one bit each in a's order), and b's other shingles, hashed to at
    least four bits for each shingle of a (``extra``)."""

    def has(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
        return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, order, width = None, None, None, 0
        for batch in batches:
            good, sizes, held, extra = [], [], [], []
            for i, (fp, (_, other)) in enumerate(zip(batch.column(0).to_pylist(), shingled(batch.column(3)))):
                if fp != last:
                    last, own = fp, shingles(split_words(batch.column(2)[i].as_py()))
                    order, width = np.sort(own), 1 << min(17, max(9, (4 * len(own)).bit_length()))
                good.append(similar(own, other, threshold))
                sizes.append(len(other))
                held.append(np.packbits(has(np.sort(other), own)).tobytes())
                bits = np.zeros(width, bool)
                bits[(other[~has(order, other)] & np.uint64(width - 1)).astype(np.int64)] = True
                extra.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(good, pa.bool_()), pa.array(sizes, pa.int64()),
                 pa.array(held, pa.binary()), pa.array(extra, pa.binary())],
                ["a", "b", "similar", "n", "held", "extra"])

    return _with_texts(pairs, texts).mapInArrow(
        run, "a binary, b binary, similar boolean, n long, held binary, extra binary")


def possible_pairs(seen: DataFrame, labels: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Pairs (a, b) of a leader's members that may be similar though no link joins them yet.

    ``seen``: what ``verify`` tells of each leader and member. Two members share the
    leader's shingles that both hold, and of their other shingles at most the
    bits that both have set and as many more as share a bit; only pairs for
    which that reaches the threshold are kept, so texts that have a passage in
    common, or are each too far from one original, fall away without a
    comparison. At least one of a pair is in another class than the leader.
    Groups are compared block by block, ``block`` members at a time.
    """
    of = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    to = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    rows = seen.join(of, "b", "left").join(to, "a", "left").select(
        "a", "b", "n", "held", "extra", F.coalesce("lb", "b").alias("label"),
        (F.coalesce("lb", "b") != F.coalesce("la", "a")).alias("apart"))
    sizes = rows.groupBy("a").agg(F.count(F.lit(1)).alias("members"), F.count_if("apart").alias("others")) \
        .filter("members > 1 and others > 0") \
        .select("a", *[F.ceil(F.col(c) / block).cast("int").alias(d) for c, d in (("members", "y"), ("others", "x"))])
    rows = rows.join(sizes, "a")
    place = F.xxhash64("b")
    left = rows.filter("apart").withColumn("i", F.pmod(place, "x").cast("int")) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("y") - 1))).withColumn("left", F.lit(True))
    right = rows.withColumn("j", F.pmod(place, "y").cast("int")) \
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("x") - 1))).withColumn("left", F.lit(False))
    cells = left.unionByName(right).select("a", "i", "j", "left", "b", "n", "held", "extra", "label")

    def common(column: list[bytes], us: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits that rows us and xs both have, and the number of bits of each row."""
        raw = [np.frombuffer(h, np.uint8) for h in column]
        both, own = np.zeros((len(us), len(xs)), np.float32), np.zeros(len(raw))
        for at in range(0, max(map(len, raw)), 512):             # 4096 bits at a time
            part = np.unpackbits(np.array([x[at:at + 512] for x in raw]), axis=1).astype(np.float32)
            both += part[us] @ part[xs].T
            own += part.sum(1)
        return both, own

    def compare(cell: pa.Table) -> pa.Table:
        side = cell.column("left").to_numpy(zero_copy_only=False).astype(bool)
        fp, label = (np.array(cell.column(c).to_pylist(), object) for c in ("b", "label"))
        n = cell.column("n").to_numpy()
        us, xs = np.flatnonzero(side), np.flatnonzero(~side)

        def least(values):
            return np.minimum(values[us][:, None], values[xs][None])
        both, own = common(cell.column("held").to_pylist(), us, xs)
        other, bits = common(cell.column("extra").to_pylist(), us, xs)
        need = threshold * (n[us][:, None] + n[xs][None]) / (1 + threshold) - 1e-6
        fits = both + np.minimum(least(n - own), other + least(n - own - bits)) >= need
        fits &= np.minimum(n[us][:, None], n[xs][None]) >= need
        i, j = np.nonzero(fits)
        i, j = us[i], xs[j]
        keep = label[i] != label[j]
        low, high = np.minimum(fp[i][keep], fp[j][keep]), np.maximum(fp[i][keep], fp[j][keep])
        return pa.table({"a": pa.array(low.tolist(), pa.binary()), "b": pa.array(high.tolist(), pa.binary())})

    # dealt by cell: else all cells of a leader would share the task of the join by leader
    return cells.repartition("a", "i", "j").groupBy("a", "i", "j") \
        .applyInArrow(compare, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of links (a, b)."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).distinct()
                    .select("node", F.col("node").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy("a").agg(F.min("label").alias("other"))
        step = labels.join(near, labels["node"] == near["a"]) \
            .select("node", "label", F.least("label", "other").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = stored(step.join(jump, "low").select(
            "node", F.least("low", "lower").alias("label"),
            (F.least("low", "lower") != F.col("label")).alias("moved")), "labels")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels


def classes(docs: DataFrame, threshold: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, th, fp, n, class_id, label): one row per document; class_id is the smallest id of
    its class. ``label``, the smallest fp, is the class itself, null without words: classes
    share a class_id if an id is repeated, and have none if they hold null ids only.

    The texts of candidates are picked by a broadcast of up to ``broadcast_rows``
    row keys, and by a plain join beyond."""
    rows = stored(sketch_rows(docs), "sketches")
    nodes = rows.filter("n > 0").groupBy("fp").agg(
        F.min("id").alias("id"), F.min(F.struct("id", "th")).alias("first"), F.first("n").alias("n"),
        F.first("keys").alias("keys"))
    nodes = stored(nodes, "nodes")
    slots = nodes.select("fp", "n", F.explode("keys").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(slots.join(shared, "bucket"), "members")
    wanted = stored(members.groupBy("fp").agg(F.sum("size").alias("degree"))
                    .join(nodes.select("fp", "first"), "fp").select("fp", "degree", "first.id", "first.th"), "wanted")
    texts = docs.select(docs["doc_id"].alias("id"), text_hash(docs["text"]).alias("th"), "text")
    few = wanted.count() <= broadcast_rows
    texts = (F.broadcast(wanted) if few else wanted).join(texts, same(wanted, texts, "id", "th")) \
        .select("fp", "text").dropDuplicates(["fp"])
    texts = stored(texts, "candidate-texts")
    ranked = members.join(wanted.select("fp", "degree"), "fp").select("bucket", "degree", "fp")
    lead = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "fp")).alias("l")).select(
        "bucket", F.col("l.fp").alias("a"))
    pairs = members.join(lead, "bucket").filter(F.col("fp") != F.col("a")).select(
        "a", F.col("fp").alias("b")).distinct()
    seen = stored(verify(pairs, texts, threshold), "seen")
    links = seen.filter("similar").select("a", "b")
    labels = components(links)
    rest = possible_pairs(seen, labels, threshold)
    for a, b in (("a", "b"), ("b", "a")):
        rest = rest.join(seen.select(F.col("a").alias(a), F.col("b").alias(b)), ["a", "b"], "left_anti")
    more = stored(verify(rest, texts, threshold).filter("similar").select("a", "b"), "more-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    own = nodes.select("fp", "id").join(labels.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("label", F.coalesce("label", "fp"))
    least = own.groupBy("label").agg(F.min("id").alias("class_id"))
    named = own.join(least, "label").select("fp", "class_id", "label")
    return rows.drop("keys").join(named, "fp", "left").select(
        "id", "th", "fp", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        "label")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id, n_shingles."""
    return classes(docs, threshold).select(F.col("id").alias("doc_id"), "class_id", F.col("n").alias("n_shingles"))


def drop_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns."""
    found = stored(classes(docs, threshold), "classes")
    groups = found.filter("n > 0").groupBy("label") \
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("k"))
    keep = groups.select("k.id", "k.th").union(found.filter("n = 0").select("id", "th").distinct())
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"),
                        text_hash(docs["text"]).alias("th"),
                        F.coalesce(F.regexp_like(docs["text"], F.lit(_A_WORD)), F.lit(False)).alias("worded"))
    out = keyed.join(keep, same(keyed, keep, "id", "th"), "left_semi")
    repeated = found.filter("n > 0").groupBy("id", "th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not repeated.isEmpty():
        out = out.filter("worded").dropDuplicates(["id", "th"]).unionByName(out.filter("not worded"))
    return out.select("row.*")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
