"""Vector search against brute force, BM25 basics, and model properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retenza.operators import features as FT
from retenza.operators import model as ML
from retenza.operators import search as SR
from retenza.schemas import FEATURE_COLUMNS
from retenza.sources import keyed as KT


def test_knn_grid_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    cat = rng.normal(size=(120, 8))
    qs = rng.normal(size=(15, 8))
    cdf = spark.createDataFrame([(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(cat)],
                                "_id string, vec array<double>")
    qdf = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(qs)],
                                "query_id string, qvec array<double>")
    k = 7
    grid = SR.knn(qdf, cdf, k, q_blocks=3, c_blocks=4).collect()
    single = SR.knn(qdf, cdf, k, q_blocks=1, c_blocks=1).collect()
    norm = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = norm(qs) @ norm(cat).T
    expect = {(f"q{i}", f"c{j:03d}") for i in range(len(qs)) for j in np.argsort(-sims[i])[:k]}
    assert {(r["query_id"], r["_id"]) for r in grid} == expect
    assert {(r["query_id"], r["_id"], r["rank"]) for r in grid} == \
        {(r["query_id"], r["_id"], r["rank"]) for r in single}


def test_vector_search_facets_after_cut_and_paging(spark):
    prods = spark.createDataFrame(
        [(f"p{i}", f"n{i}", "B1" if i % 2 else "B2", "M", [1.0, float(i)]) for i in range(10)],
        "_id string, name string, brand string, masterCategory string, vai_text_embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 9.0])], "query_id string, qvec array<float>")
    top = SR.vector_search(prods, q, k=4, brands=["B1"], page=None).collect()
    assert len(top) <= 4 and all(r["brand"] == "B1" for r in top)
    assert {r["totalItems"] for r in top} == {len(top)}


def test_text_search_ranks_matching_doc_first(spark):
    prods = spark.createDataFrame([("1", "red ring", "Ring", "size-1", "B"),
                                   ("2", "blue bolt", "Bolt", "size-2", "B")],
                                  "_id string, name string, articleType string, subCategory string, brand string")
    q = spark.createDataFrame([("q1", "red rings ring"), ("q2", "red ring")],
                              "query_id string, text string")
    out = {(r["query_id"], r["rank"]): r["_id"] for r in SR.text_search(prods, q, 1).collect()}
    assert out == {("q1", 1): "1", ("q2", 1): "1"}


def _features(spark, n=30, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        total = int(rng.integers(1, 20))
        exits = int(rng.integers(0, total + 1))
        nb = int(rng.integers(0, 5))
        red = int(rng.integers(0, nb + 1))
        rows.append((f"u{i}", total, exits, 0, total - exits, 1, nb, red, exits / total,
                     red / nb if nb else 0.0, float(total)))
    schema = "uid string, " + ", ".join(
        f"{c} {'long' if i < 7 else 'double'}" for i, c in enumerate(FEATURE_COLUMNS))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def model_and_feats(spark):
    f = FT.churn_label(_features(spark))
    return ML.train_churn_model(f, trees=10, folds=3), f


def test_model_probabilities_and_accuracy(spark, model_and_feats):
    (model, acc, std), f = model_and_feats
    assert acc is not None and acc >= 0.5 and 0 <= std <= 1
    scored = ML.score_users(f.drop("churned"), model).collect()
    assert all(0.0 <= r["churn_probability"] <= 1.0 for r in scored)
    assert all(r["top_risk_factor"] in FEATURE_COLUMNS for r in scored)
    imp = ML.feature_importance(model, spark).collect()
    assert len(imp) == 10 and abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6


def test_model_save_load_same_scores(spark, model_and_feats, tmp_path):
    (model, _, _), f = model_and_feats
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_model(str(tmp_path / "m"))
    a = {r["uid"]: r["churn_probability"] for r in ML.score_users(f, model).collect()}
    b = {r["uid"]: r["churn_probability"] for r in ML.score_users(f, again).collect()}
    assert a == b


def test_one_class_training_gives_zero(spark):
    f = _features(spark, 8).withColumn("churned", F.lit(0))
    model, _, _ = ML.train_churn_model(f, trees=5, folds=2)
    probs = {r["churn_probability"] for r in ML.score_users(f.drop("churned"), model).collect()}
    assert probs == {0.0}


def test_score_on_demand_unknown_user(spark, model_and_feats, tmp_path):
    (model, _, _), _ = model_and_feats
    sig = spark.createDataFrame([("u1", "s1", "exit-risk")], "uid string, sid string, signal string")
    nb = spark.createDataFrame([("u1", False)], "uid string, redeemed boolean")
    uids = spark.createDataFrame([("u1",), ("ghost",)], "uid string")
    path = str(tmp_path / "scores")
    out = {r["uid"]: r for r in ML.score_on_demand(uids, sig, nb, model, path=path).collect()}
    assert {r["uid"] for r in KT.read_scores(spark, path).collect()} == {"u1"}
    assert not any(r["written"] for r in ML.score_on_demand(uids, sig, nb, model).collect())
    assert out["ghost"]["churn_probability"] == 0.0 and out["ghost"]["churn_risk_tier"] == "Low"
    assert out["ghost"]["top_risk_factor"] is None and out["ghost"]["written"] is False
    assert out["u1"]["written"] is True


def test_knn_ties_and_cell_size(spark, monkeypatch):
    """Slices smaller than the data, many equal scores: order by id, nothing lost."""
    monkeypatch.setattr(SR, "SLICE", 7)
    monkeypatch.setattr(SR, "QUERY_ROWS", 3)
    seen = []
    real = np.partition
    monkeypatch.setattr(SR.np, "partition", lambda a, *x, **y: seen.append(a.size) or real(a, *x, **y))
    q = pd.DataFrame({"query_id": [f"q{i}" for i in range(5)], "qvec": [[1.0, 0.0]] * 5})
    c = pd.DataFrame({"_id": [f"{i:03d}" for i in range(50)][::-1],
                      "vec": [[1.0, 0.0] if i % 2 else [0.0, 1.0] for i in range(50)]})
    out = SR._topk_cell(4, False)(q, c)
    want = sorted(c[c["vec"].map(lambda v: v[0] == 1.0)]["_id"])[:4]
    assert out.groupby("query_id")["_id"].apply(list).tolist() == [want] * 5
    assert max(seen) <= 3 * (7 + 4)


def test_candidate_knn_recall(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    vec = centre[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    cat = spark.createDataFrame([(f"{i:03d}", [float(x) for x in v]) for i, v in enumerate(vec)],
                                "_id string, vec array<double>")
    q = cat.limit(60).select(F.col("_id").alias("query_id"), F.col("vec").alias("qvec"))
    exact = {(r["query_id"], r["_id"]) for r in SR.knn(q, cat, 10).collect()}
    near = {(r["query_id"], r["_id"]) for r in SR.candidate_knn(q, cat, 10, lists=24, probes=6).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert SR.candidate_knn(q, cat.limit(0), 3).count() == 0


def test_browse_counts_all_matches(spark):
    cat = spark.range(5000).select(F.col("id").cast("string").alias("_id"), F.col("id").alias("pkey"),
                                   F.lit("b").alias("brand"), F.lit("c").alias("masterCategory"))
    rows = SR.browse_page(cat, ["b"], page=249).collect()
    assert [r["position"] for r in rows] == list(range(4981, 5001)) and rows[0]["totalItems"] == 5000
    past = SR.browse_page(cat, ["b"], page=250).collect()
    assert [(r["totalItems"], r["_id"]) for r in past] == [(5000, None)]
    assert SR.browse_page(cat, ["x"]).collect()[0]["totalItems"] == 0


def test_text_search_scores_bags_once(spark):
    """A term in all products: the output follows the distinct texts, the order is by id."""
    prods = spark.range(3000).select(
        F.format_string("%04d", "id").alias("_id"), F.concat(F.lit("size n"), (F.col("id") % 5).cast("string")).alias("name"),
        F.lit(None).cast("string").alias("articleType"), F.lit(None).cast("string").alias("subCategory"),
        F.lit(None).cast("string").alias("brand"))
    q = spark.createDataFrame([("a", "size"), ("b", "size n3")], "query_id string, text string")
    df = SR.text_search(prods, q, 3)
    got = sorted((r["query_id"], r["rank"], r["_id"]) for r in df.collect())
    assert got == [("a", 1, "0000"), ("a", 2, "0001"), ("a", 3, "0002"),
                   ("b", 1, "0003"), ("b", 2, "0008"), ("b", 3, "0013")]


def test_folds_are_stratified(spark):
    """5 % positives, fewer positives than folds, one class: counts differ by one at most."""
    from collections import Counter

    for n, positives, folds in ((400, 20, 5), (50, 3, 5), (7, 2, 5), (40, 0, 5)):
        data = spark.createDataFrame([(f"u{i}", float(i < positives)) for i in range(n)], "uid string, label double") \
            .repartition(6)
        rows = ML.stratified_folds(data, folds).collect()
        assert sorted(r["uid"] for r in rows) == sorted(f"u{i}" for i in range(n))
        for label in (0.0, 1.0):
            own = Counter(r["fold"] for r in rows if r["label"] == label)
            counts = [own[f] for f in range(folds)]
            assert max(counts) - min(counts) <= 1
        sizes = Counter(r["fold"] for r in rows)
        assert set(sizes) == set(range(folds)) and max(sizes.values()) - min(sizes.values()) <= 1
        assert {r["fold"] for r in ML.stratified_folds(data, folds).collect()} == set(range(folds))


@pytest.mark.parametrize("shape", ["plain", "equal", "zero"])
def test_topk_cell_equals_brute_force(shape, monkeypatch):
    """Small slices, so that most pairs are judged in single precision; ids repeat and are null."""
    monkeypatch.setattr(SR, "SLICE", 64)
    monkeypatch.setattr(SR, "QUERY_ROWS", 50)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 6))
    v = {"plain": v, "equal": v[rng.integers(0, 5, 900)], "zero": v * (rng.random((900, 1)) > .2)}[shape]
    ids = np.array([None if i % 300 == 7 else str(i // 2) for i in range(900)], object)
    cat = pd.DataFrame({"_id": ids, "vec": list(v)})
    q = pd.DataFrame({"query_id": [str(i) for i in range(0, 440, 4)], "qvec": list(v[:880:8])})
    got = SR._topk_cell(6, True)(q, cat)
    with np.errstate(invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for qid, w in zip(q["query_id"], u[:880:8]):
        s = np.round(u @ w, 9)
        want = sorted((-s[i], ids[i] is None, ids[i] or "") for i in range(900) if ids[i] != qid and np.isfinite(s[i]))[:6]
        own = got[got["query_id"] == qid]
        mine = sorted((-round(x, 9), pd.isna(i), "" if pd.isna(i) else i) for x, i in zip(own["score"], own["_id"]))
        assert [x[1:] for x in mine] == [x[1:] for x in want]
        assert [x[0] for x in mine] == pytest.approx([x[0] for x in want], abs=1e-8)


def test_topk_cell_scores_few_pairs_in_full(monkeypatch):
    """Ranking looks at the first slice and then at the few pairs that may come in."""
    seen = []
    monkeypatch.setattr(SR, "SLICE", 500)
    whole = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *x, **y: (seen.append(a.size), whole(a, *x, **y))[1])
    v = np.random.default_rng(5).normal(size=(10_000, 16))
    cat = pd.DataFrame({"_id": [str(i) for i in range(10_000)], "vec": list(v)})
    SR._topk_cell(6, True)(pd.DataFrame({"query_id": cat["_id"][:200], "qvec": cat["vec"][:200]}), cat)
    assert sum(seen) < 0.25 * 200 * 10_000
