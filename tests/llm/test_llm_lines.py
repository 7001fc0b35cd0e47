"""Line quality rules and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from corpus_cases import clashing, docs_of, edge, rows, words  # noqa: F401

from retenza.llm import line_dedup, line_quality

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def brute_dedup(docs, min_docs):
    found = Counter()
    for d in docs:
        found.update({key(x) for x in (d["text"] or "").split("\n")} - {""})
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [x for x in lines if not key(x) or found[key(x)] < min_docs]
        yield (d["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept))


def brute_base(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    wins = defaultdict(list)
    for i in range(len(ws) - 7):
        wins[tuple(ws[i:i + 8])].append(i)
    covered = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


def brute_removed(docs, min_docs=20, one_in=10):
    """Each text without the lines above its host's limits."""
    hosts, seen = defaultdict(set), defaultdict(set)
    for d in docs:
        if d["text"] is not None:
            hosts[d["source"]].add(d["text"])
            for x in d["text"].split("\n"):
                seen[d["source"], key(x)].add(d["text"])
    for d in docs:
        top = max(min_docs, -(-len(hosts[d["source"]]) // one_in))
        yield None if d["text"] is None else "\n".join(
            x for x in d["text"].split("\n") if not key(x) or len(seen[d["source"], key(x)]) < top)


def brute_quality(docs, min_docs=20, one_in=10, max_percent=70):
    hosts, seen = defaultdict(set), defaultdict(set)
    for d in docs:
        if d["text"] is not None:
            hosts[d["source"]].add(d["text"])
            for x in d["text"].split("\n"):
                if key(x):
                    seen[d["source"], key(x)].add(d["text"])
    for d in docs:
        top = max(min_docs, -(-len(hosts[d["source"]]) // one_in))
        base = brute_base(d["text"])
        removed = sum(len(re.sub(r"[\x20\x09-\x0D]", "", key(x))) for x in (d["text"] or "").split("\n")
                      if key(x) and len(seen[d["source"], key(x)]) >= top)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        depleted = 100 * removed > max_percent * base[1]
        yield (d["doc_id"], *base, removed, failed, depleted, not failed and not depleted)


QUALITY = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars",
           "base_failed", "depleted", "kept")


def test_line_dedup_equals_brute_force(edge, clashing, rows):
    docs = edge.collect()
    for df in (edge, clashing):
        got = rows(line_dedup.line_dedup(df).selectExpr("row.doc_id", "n_lines", "n_dropped", "kept_text"), "*")
        assert Counter(got) == Counter(brute_dedup(docs, 10))
    assert any(r[2] for r in got)


def test_line_dedup_keeps_columns_and_texts(clashing):
    out = line_dedup.line_dedup(clashing).select("row.*")
    assert out.columns == clashing.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, clashing.collect()))


def test_line_dedup_threshold_is_inclusive(docs_of, rows):
    same = [(i, f"Own {i}\n  SHARED line ", "en", "a", 1) for i in range(10)]
    assert all(r[2] == 1 for r in rows(line_dedup.line_dedup(docs_of(same)), "row", "n_lines", "n_dropped"))
    assert all(r[2] == 0 for r in rows(line_dedup.line_dedup(docs_of(same[:9])), "row", "n_lines", "n_dropped"))
    twice = [(i, "only here\nonly here", "en", "a", 1) for i in range(9)]
    assert all(r[2] == 0 for r in rows(line_dedup.line_dedup(docs_of(twice)), "row", "n_lines", "n_dropped"))


def test_quality_equals_brute_force(edge, clashing, rows):
    docs = edge.collect()
    for limits in ((3, 1000, 70), (20, 10, 70), (2, 2, 5)):
        args = dict(zip(("min_docs", "one_in", "max_percent"), limits))
        want = Counter(brute_quality(docs, *limits))
        assert Counter(rows(line_quality.line_quality(edge, **args), *QUALITY)) == want
    assert Counter(rows(line_quality.line_quality(clashing.drop("host"), **args), *QUALITY)) == want


def test_quality_counts_copies_once_and_rejects_depleted(docs_of, rows):
    rng = random.Random(3)
    body = "\n".join(" ".join(words(rng, 9)) for _ in range(6))
    own = [(i, f"{body}\nown text {i}", "en", "shop", 1) for i in range(30)]
    page = "\n".join(" ".join(words(rng, 9)) for _ in range(5))
    copies = [(100 + i, page, "en", "news", 1) for i in range(40)]
    kept = {r[0]: r[1] for r in rows(line_quality.line_quality(docs_of(own + copies)), "doc_id", "kept")}
    assert not any(kept[i] for i in range(30)) and all(kept[100 + i] for i in range(40))


def test_drop_rejected_takes_the_lines_out(clashing, edge, rows):
    """Kept rows, with all columns, without lines above the limits; n_chars follows the text."""
    docs = edge.collect()
    for args in ({}, {"min_docs": 3, "one_in": 1000}):
        out = line_quality.drop_rejected(clashing, length="n_chars", **args)
        assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
        want = [(d["doc_id"], t, d["n_chars"] if t == d["text"] else len(t)) for d, t, q in
                zip(docs, brute_removed(docs, **args), brute_quality(docs, **args)) if q[-1]]
        assert Counter(rows(out, "doc_id", "text", "n_chars")) == Counter(want)
        assert {r[0] for r in rows(out, "kept")} == {"x-kept"}
    assert any(n != d["n_chars"] for (_, _, n), d in zip(want, docs))
    plain = line_quality.drop_rejected(edge, min_docs=3, one_in=1000)
    assert Counter(r[0] for r in rows(plain, "text")) == Counter(t for _, t, _ in want)


def test_footers_of_a_host_go(docs_of, rows):
    rng = random.Random(5)
    docs = [(i, "\n".join(" ".join(words(rng, 12)) for _ in range(4)) + "\n\n Subscribe NOW to our letter ", "en", "shop", 0)
            for i in range(60)] + [(100, " ".join(words(rng, 40)) + "\nsubscribe now to our letter", "en", "blog", 0)]
    out = dict(rows(line_quality.drop_rejected(docs_of(docs)), "doc_id", "text"))
    assert len(out) == 61 and all(out[d[0]] == "\n".join(d[1].split("\n")[:-1]) for d in docs[:60])
    assert out[100] == docs[60][1]


def test_empty_table(docs_of):
    none = docs_of([])
    assert line_dedup.line_dedup(none).count() == line_quality.line_quality(none).count() == 0
    assert line_quality.drop_rejected(none).count() == 0


def test_native_plans_hold_no_python(edge):
    for df in (line_dedup.line_dedup(edge), line_quality.line_quality(edge)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_hash_of_kept_text(edge):
    from pyspark.sql import functions as F

    for r in line_dedup.line_dedup(edge).select("kept_text", F.sha2("kept_text", 256).alias("s")).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["s"]


def test_line_dedup_sorts_no_texts(spark):
    """The dropped positions are hashed; the texts of a partition are not sorted, so not held."""
    from retenza.llm.line_dedup import line_dedup
    shared = "\n".join(f"line {i}" for i in range(3))
    docs = spark.createDataFrame([(i, f"{shared}\nown {i}") for i in range(12)] + [(None, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and plan.index("ShuffledHashJoin") < plan.find("SortMergeJoin") % (len(plan) + 1)
        rows = {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", before[0] or "64MB")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert rows == {None: (1, 0, ""), **{i: (4, 3, f"own {i}") for i in range(12)}}
