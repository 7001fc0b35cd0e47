"""Decontamination, repeated passages, near-duplicates and language identification."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_cases import clashing, docs_of, edge, edge_rows, rows, small_batches, words  # noqa: F401

from retenza.llm import decontaminate, language_id, near_dup, substring_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bench_rows():
    base = edge_rows()[26][1].split()
    return [(1, " ".join(base[60:100])), (2, " ".join(base[10:15]).upper() + "!"), (10, "one, two"), (3, None), (4, ""),
            (5, "?!"), (1, "three four"), (None, "日本語 x"), (6, " ".join(base[62:90])), (6, " ".join(base[62:90]))]


def brute_hits(docs, items, n=13):
    wins = defaultdict(set)
    for item, text in items:
        ws = WORD.findall((text or "").translate(LOWER))
        k = min(n, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            wins[tuple(ws[i:i + k])] |= {item} - {None}
    for d in docs:
        ws = WORD.findall((d["text"] or "").translate(LOWER))
        hit, found = set(), set()
        for k in {len(w) for w in wins}:
            for i in range(len(ws) - k + 1):
                if tuple(ws[i:i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[tuple(ws[i:i + k])]
        yield d["doc_id"], len(ws), len(hit), tuple(sorted(map(str, found))), len(hit) > 0 and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("block_bytes", [1, 1 << 24])
def test_contamination_equals_brute_force(spark, edge, clashing, rows, small_batches, block_bytes):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    want = Counter(brute_hits(edge.collect(), bench_rows()))
    for df in (edge, clashing):
        out = decontaminate.contamination(df, bench, block_bytes=block_bytes)
        got = Counter((*r[:3], tuple(r[3]), r[4]) for r in
                      rows(out, "doc_id", "n_words", "n_hit", "items", "contaminated"))
        assert got == want
    assert sum(r[-1] for r in want) >= 4
    free = decontaminate.decontaminate(clashing, bench)
    assert free.columns == clashing.columns
    assert Counter(r[0] for r in rows(free, "doc_id")) == Counter(r[0] for r in want.elements() if not r[-1])


@pytest.mark.parametrize("block_bytes", [1, 1 << 24])
def test_spans_are_cut(spark, docs_of, rows, block_bytes):
    bench = spark.createDataFrame([(1, "bad words here"), (2, "other")], "item_id long, text string")
    docs = docs_of([(1, "Keep this, BAD words; here! and that", "en", "a", 1), (2, "bad words", "en", "a", 1)])
    out = decontaminate.decontaminate(docs, bench, remove="spans", block_bytes=block_bytes)
    assert rows(out, "doc_id", "text") == [(1, "Keep this, ! and that"), (2, "bad words")]
    none = docs.limit(0)
    assert decontaminate.contamination(none, bench, block_bytes=block_bytes).count() == 0
    assert decontaminate.decontaminate(none, bench, block_bytes=block_bytes).count() == 0
    assert not any(r[0] for r in rows(decontaminate.contamination(docs, bench.limit(0)), "contaminated"))


def test_window_sets_stay_within_their_cost():
    """Bytes of a built set by word of the benchmark, at a few megabytes of text."""
    rng = random.Random(6)
    vocabulary = words(rng, 30_000)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 300)))) for i in range(3000)]
    own = decontaminate.WindowSet(items, 13)
    n = sum(len(t.split()) for _, t in items)
    assert own.size() <= decontaminate.WORD_COST * n + (1 << 16)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of few values all windows collide; the verification and the items still hold."""
    real = decontaminate._window_hashes
    monkeypatch.setattr(decontaminate, "_window_hashes", lambda w, k: real(w, k) & np.uint64(3))
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, 40))) for i in range(12)]
    own = decontaminate.WindowSet(items, 13)
    import pyarrow as pa

    texts = [t for _, t in items] + [" ".join(words(rng, 50)), None]
    got = list(decontaminate._scan(pa.array(texts), own))
    assert [(k, int(h.sum()), s) for k, h, s in got] == \
        [(40, 40, {str(i)}) for i, _ in items] + [(50, 0, set()), (0, 0, set())]


def brute_passages(docs, k=13):
    first = {}
    split = [(d["doc_id"], (d["text"] or "").encode().split()) for d in docs]
    for i, ws in split:
        if i is not None:
            for p in range(len(ws) - k + 1):
                w = tuple(ws[p:p + k])
                first[w] = min(first.get(w, i), i)
    for i, ws in split:
        hit = set()
        if i is not None:
            for p in range(len(ws) - k + 1):
                if first[tuple(ws[p:p + k])] < i:
                    hit |= set(range(p, p + k))
        kept = b" ".join(w for j, w in enumerate(ws) if j not in hit)
        yield i, len(ws), len(hit), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("group_rows,broadcast_rows", [(1_000_000, 1_000_000), (20, 0)])
def test_passages_equal_brute_force(edge, clashing, rows, small_batches, group_rows, broadcast_rows):
    want = Counter(brute_passages(edge.collect()))
    for df in (edge, clashing):
        out = substring_dedup.substring_dedup(df, group_rows, broadcast_rows)
        assert Counter(rows(out, "doc_id", "n_words", "n_removed", "kept_sha256")) == want
    assert sum(r[2] > 0 for r in want) >= 3
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    for r in out.filter("n_removed > 0").collect():
        ws = texts[r["doc_id"]].split()
        gone = {j for s in r["spans"] for j in range(s["first"], s["end"])}
        assert len(gone) == r["n_removed"]
        assert r["kept_text"] == " ".join(w for j, w in enumerate(ws) if j not in gone)


def test_passages_of_many_documents_and_none(docs_of, rows, small_batches):
    rng = random.Random(1)
    hot = words(rng, 60)
    docs = docs_of([(i, " ".join([*words(rng, 20), *hot, *words(rng, 20)]), "en", "a", 1) for i in range(60)], 9)
    got = rows(substring_dedup.substring_dedup(docs, 10), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(got) == Counter(brute_passages(docs.collect()))
    assert all(r[2] >= 60 for r in got if r[0])
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def brute_classes(docs, threshold=0.8):
    sh = [near_dup.shingles(near_dup.split_words(d["text"])) for d in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = [set(s.tolist()) for s in sh]
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 1.8 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9:
                if near_dup.similar(sh[i], sh[j], threshold):
                    up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, d in enumerate(docs):
        groups[top(i)].append(d["doc_id"])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((d["doc_id"], least[top(i)]) for i, d in enumerate(docs))


def near_copies(seed, size, group, edits):
    rng = random.Random(seed)
    base = words(rng, size)
    out = []
    for _ in range(group):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            p = rng.randrange(len(own))
            rng.choice([lambda: own.pop(p), lambda: own.insert(p, "new"), lambda: own.__setitem__(p, "other")])()
        out.append(" ".join(own))
    return out


def test_classes_equal_brute_force(edge, clashing, rows, small_batches):
    want = brute_classes(edge.collect())
    for df in (edge, clashing.drop("class_id")):
        assert Counter(rows(near_dup.near_duplicates(df), "doc_id", "class_id")) == want
    out = near_dup.drop_copies(clashing)
    assert out.columns == clashing.columns
    kept = Counter(r["doc_id"] for r in out.collect())
    wordless = Counter(d["doc_id"] for d in edge.collect() if not near_dup.split_words(d["text"]))
    assert kept - wordless == Counter({c for (_, c) in want if c is not None}) - wordless
    assert all(kept[k] >= n for k, n in wordless.items())


@pytest.mark.parametrize("size,group,edits", [(9, 12, 1), (30, 25, 3), (36, 25, 4), (200, 40, 9), (400, 60, 9)])
def test_groups_of_near_copies(docs_of, rows, size, group, edits):
    texts = near_copies(size, size, group, edits) + near_copies(size + 1, size, 5, edits)
    docs = docs_of([(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    assert Counter(rows(near_dup.near_duplicates(docs), "doc_id", "class_id")) == brute_classes(docs.collect())


def test_drop_copies_of_repeated_and_null_ids(docs_of, rows):
    """One id on texts of two classes, and classes of null ids only: a row of each class stays."""
    texts = [near_copies(20 + i, 200, 4, 2) for i in range(4)]
    ids = [(5, 6, 7, 8), (5, 9, 10, 11), (None,) * 4, (None,) * 4]
    group = {t: g for g, own in enumerate(texts) for t in own}
    docs = docs_of([(i, t, "en", "a", 1) for own, ts in zip(ids, texts) for i, t in zip(own, ts)])
    kept = rows(near_dup.drop_copies(docs), "doc_id", "text")
    assert sorted((group[t], i) for i, t in kept[2:]) == [(0, 5), (1, 5)]
    assert sorted(group[t] for i, t in kept[:2] if i is None) == [2, 3] and len(kept) == 4


@pytest.mark.parametrize("block", [3, 1000])
def test_bound_keeps_every_similar_pair(spark, block):
    """All members of a leader, in small blocks, none linked yet."""
    rng = random.Random(8)
    passage = words(rng, 120)
    texts = near_copies(7, 150, 14, 12) + [" ".join(words(rng, 40) + passage + words(rng, 40)) for _ in range(6)]
    texts += near_copies(9, 200, 6, 6)
    fps = [f"{i:016d}".encode() for i in range(len(texts))]
    table = spark.createDataFrame(list(zip(fps, texts)), "fp binary, text string")
    pairs = spark.createDataFrame([(fps[0], f) for f in fps[1:]], "a binary, b binary")
    seen = near_dup.verify(pairs, table, 0.8)
    sh = [near_dup.shingles(near_dup.split_words(t)) for t in texts]
    assert {bytes(r["b"]): r["similar"] for r in seen.collect()} == {
        f: near_dup.similar(sh[0], s) for f, s in zip(fps[1:], sh[1:])}
    labels = spark.createDataFrame([], "node binary, label binary")
    got = {(bytes(r["a"]), bytes(r["b"])) for r in near_dup.possible_pairs(seen, labels, 0.8, block).collect()}
    want = {(fps[i], fps[j]) for j in range(2, len(texts)) for i in range(1, j) if near_dup.similar(sh[i], sh[j])}
    assert want <= got and len(want) > 10
    apart = {(fps[i], fps[j]) for j in range(2, 20) for i in range(1, j) if j >= 14}
    assert len(got & apart) < 0.1 * len(apart)


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.permutation(40).astype(np.uint64)
        b = np.where(rng.random(40) < 0.2, rng.integers(100, 200, 40).astype(np.uint64), a)
        b = np.unique(b, return_index=True)[1]
        b = a[np.sort(b)] if rng.random() < 0.5 else np.roll(a, int(rng.integers(0, 4)))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        need = 0.8 * (len(a) + len(b)) / 1.8
        assert near_dup.aligned(a, b, need) == (t[-1, -1] if t[-1, -1] >= need else 0)


def test_order_matters():
    a = near_dup.shingles([b"%d" % i for i in range(100)])
    b = near_dup.shingles([b"%d" % i for i in [*range(50, 100), *range(50)]])
    assert not near_dup.similar(a, b) and near_dup.similar(a, a)


def test_near_duplicates_of_no_document(docs_of):
    none = docs_of([])
    assert near_dup.near_duplicates(none).count() == near_dup.drop_copies(none).count() == 0


SYLLABLES = {"xx": "ka lo mi".split(), "yy": "str gri ent".split(), "zz": "ää ño çu".split(), "vv": "ba be bi".split(),
             "uu": "oth ith ath".split(), "tt": "zur dur mur".split()}


def language_rows(langs, n):
    rng = random.Random(2)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[x], k=3)) for _ in range(25)), x, "s", 1)
            for i, x in enumerate(langs * n)]


@pytest.mark.parametrize("count", [2, 4, 6])
def test_held_out_languages(docs_of, spark, count):
    from pyspark.sql import functions as F

    langs = list(SYLLABLES)[:count]
    docs = docs_of(language_rows(langs, 40)).withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.train(docs.filter("not held_out"))
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)
    mixed = " ".join(x * 3 for _ in range(10) for x in (SYLLABLES[langs[0]][0], SYLLABLES[langs[1]][0]))
    odd = docs_of([(1, mixed, None, None, None), (2, None, None, None, None), (3, "12 !", "xx", "s", 1),
                   (4, "", "xx", "s", 1), (None, "kalomi", None, None, None), (5, "½", "xx", "s", 1),
                   (6, "² ①", "xx", "s", 1), (7, "Ⅷ _", "xx", "s", 1), (8, "ª", "xx", "s", 1)]) \
        .withColumn("held_out", F.lit(True))
    by = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["ambiguous"]) == ("und", 0, False) for i in (2, 3, 4, 5, 6, 7))
    assert by[8]["lang_pred"] in langs
    assert by[1]["lang_pred"] in langs[:2] and by[None]["lang_pred"] in langs


def test_languages_without_training_rows(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of(language_rows(["xx"], 5)).withColumn("held_out", F.lit(False))
    none = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    one = language_id.train(docs)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs, one).collect()} == {("xx", 1.0)}
    assert language_id.identify(docs.limit(0), one).count() == 0


def test_codewords_differ():
    for k in (2, 3, 5, 6, 7, 40):
        code = language_id.codewords(k)
        assert len({tuple(c) for c in code.tolist()}) == k and (abs(code.sum(0)) < k).all()
        splits = {frozenset((tuple(np.flatnonzero(c > 0)), tuple(np.flatnonzero(c < 0)))) for c in code.T}
        assert len(splits) == code.shape[1]


def test_decoding_equals_brute_force(docs_of):
    """Counts, log-odds, margins and the loss-weighted choice, trigram by trigram."""
    from math import exp, log, log1p, sqrt

    from pyspark.sql import functions as F

    bits, langs = 10, list(SYLLABLES)[:4]
    rows_ = language_rows(langs, 6) + [(900, "ka", "xx", "s", 1), (901, "str ä ka", None, "s", 1), (902, "zz", "yy", "s", 1)]
    docs = docs_of(rows_).withColumn("held_out", F.col("doc_id") % 5 == 0)

    def grams(t):
        raw = b"  " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode()) + b"  "
        raw += b"  "                    # the blanks that follow every text
        return [(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) % 2 ** 32) >> (32 - bits)
                for i in range(len(raw) - 2)]
    names = sorted({r[2] for r in rows_ if r[2] and r[0] % 5})
    code = language_id.codewords(len(names))
    n = {x: Counter(g for r in rows_ if r[2] == x and r[0] % 5 for g in grams(r[1])) for x in names}
    sides = [{s: sum((n[x] for x, c in zip(names, code[:, j]) if c == s), Counter()) for s in (1, -1)}
             for j in range(code.shape[1])]

    def weight(side, g):
        return log((side[1][g] + 1) / (sum(side[1].values()) + 2 ** bits)) \
            - log((side[-1][g] + 1) / (sum(side[-1].values()) + 2 ** bits))
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs.filter("not held_out"), bits),
                                                        bits).collect()}
    close = 0
    for i, t, *_ in rows_:
        own = grams(t)
        m = [sum(weight(s, g) for g in own) / len(own) * min(sqrt(len(own)), 4) for s in sides]
        loss = [sum(log1p(exp(-x * c)) for x, c in zip(m, code[k])) for k in range(len(names))]
        p = [exp(min(loss) - x) for x in loss]
        best = max(p) / sum(p)
        if abs(got[i]["score"] - best) < 0.02:
            close += 1
        if sorted(p)[-2] < 0.8 * max(p):
            assert got[i]["lang_pred"] == names[p.index(max(p))]
    assert close >= 0.95 * len(rows_)
