"""The stored text index: the rows of text_search, with far fewer scored."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from retenza.operators import search as SR
from retenza.operators import text_index as TX

PRODUCT = "_id string, name string, articleType string, subCategory string, brand string"


def catalogue(spark, rows):
    return spark.createDataFrame(rows, PRODUCT)


def texts_of(spark, texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["_id"], round(r["score"], 8)) for r in df.collect())


def some_products(n, seed=1, vocabulary=60):
    rng, words = random.Random(seed), [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        name = " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(vocabulary)], k=rng.randint(1, 8)))
        rows.append((f"p{i}", name, rng.choice(["Shoe", "Shirt", None]), "common", rng.choice(["x", "", "y z"])))
    return rows


@pytest.mark.parametrize("k, head", [(1, 128), (3, 128), (7, 7), (20, 20)])
def test_rows_equal_text_search(spark, tmp_path, monkeypatch, k, head):
    monkeypatch.setattr(TX, "HEAD", head)
    products = catalogue(spark, [*some_products(500), *some_products(40, 1), ("dup", None, None, None, None)])
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(70)], k=rng.randint(1, 5))) for _ in range(40)]
    texts += ["common", "common w0", "COMMON, w0 w1 shoe", "none such", "", "w3 w3", "shirt x y z"]
    queries = texts_of(spark, [*texts, texts[0]])
    index = TX.build_text_index(products, str(tmp_path / "ix"))
    assert ranked(TX.index_search(index, queries, k)) == ranked(SR.text_search(products, queries, k))


def test_a_term_of_all_products_is_not_scored_through(spark, tmp_path):
    """'common' is in all 4,000 products: almost none are scored for it."""
    rows = [(f"p{i}", f"name{i} kind{i % 400}", "Shoe", "common", "b") for i in range(4000)]
    index = TX.build_text_index(catalogue(spark, rows), str(tmp_path / "ix"))
    queries = texts_of(spark, [f"common kind{i}" for i in range(50)] + ["common", "common shoe b"])
    seeds, more = TX.candidates(index, queries, 3)
    scored, full = seeds.count() + more.count(), 52 * 4000
    assert scored < 0.1 * full
    assert ranked(TX.index_search(index, queries, 3)) == ranked(SR.text_search(catalogue(spark, rows), queries, 3))


def test_terms_are_read_by_bucket(spark, tmp_path):
    index = TX.build_text_index(catalogue(spark, some_products(200)), str(tmp_path / "ix"))
    plan = index.postings(spark.createDataFrame([("w1",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(b#" in plan
    assert TX.index_search(index, texts_of(spark, []), 3).count() == 0
    with pytest.raises(ValueError):
        TX.index_search(index, texts_of(spark, ["a"]), TX.HEAD + 1)


def test_index_of_no_products(spark, tmp_path):
    index = TX.build_text_index(catalogue(spark, []), str(tmp_path / "ix"))
    assert TX.index_search(index, texts_of(spark, ["a b"]), 3).count() == 0


def test_impact_groups_are_few(spark, tmp_path):
    """Postings of one count and length share an impact, so groups don't grow with the products."""
    rows = [(f"p{i}", "same words here", "A", "B", f"brand{i}") for i in range(1000)]
    index = TX.build_text_index(catalogue(spark, rows), str(tmp_path / "ix"))
    groups = index.all_postings().filter(F.col("term") == "words").select(F.round("impact", 9)).distinct()
    assert groups.count() == 1
