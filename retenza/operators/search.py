"""Catalogue search: facets, browse paging, vector (cosine) and text search.

Vector search is exact. Queries and catalogue are cut into a grid of
blocks; each grid cell is one ``cogroup().applyInPandas`` group that scores
its query block against its catalogue block slice by slice and keeps only
the running top k per query. The per-query merge then sees at most
k x (catalogue blocks) rows. Block counts follow the row counts and the
slices are of fixed size, so a cell's memory stays bounded as the data
grows. ``candidate_knn`` is the cheaper form that looks at near lists only.

Text search is BM25 over tokenised fields, written as joins and
aggregates on (term, document) postings.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PAGE_SIZE, VECTOR_LIMIT

BLOCKS = 8            # catalogue blocks of the smallest grid
BLOCK_ROWS = 65_536   # vectors in a block
QUERY_ROWS = 1_024    # a cell scores so many queries at once
SLICE = 4_096         # against so many vectors
SCORE_DIGITS = 9   # ranking uses scores rounded here, so float noise never reorders ties


def facet_filter(products: DataFrame, brands=(), categories=()) -> DataFrame:
    """brand IN brands and masterCategory IN categories; empty list = no filter."""
    if brands:
        products = products.filter(F.col("brand").isin(list(brands)))
    if categories:
        products = products.filter(F.col("masterCategory").isin(list(categories)))
    return products


def exists_filter(products: DataFrame, embeddings: DataFrame, key: str = "_id") -> DataFrame:
    """Products without an embedding (anti join against the embedding store)."""
    return products.join(embeddings.select(key), key, "left_anti")


def embedding_backlog(products: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Products still to embed, with the text to embed."""
    from ..functions.commerce import embedding_text
    return exists_filter(products, embeddings).select(
        "_id", embedding_text().alias("text"))


def browse_page(products: DataFrame, brands=(), categories=(), page: int = 0,
                size: int = PAGE_SIZE, cap: int | None = None, order_key: str = "pkey") -> DataFrame:
    """Facet filter, then page ``page`` of ``size`` rows, each with the total.

    Pages are in product key order. The total is a one-row aggregate and the
    page a top-n with an offset, so no task sees more than the rows up to
    the page's end. A page past the end (or of no match) is one row with
    the total and nulls. ``cap`` limits both, if given.
    """
    found = facet_filter(products, brands, categories)
    if cap is not None:
        found = found.orderBy(order_key).limit(cap)
    total = found.agg(F.count(F.lit(1)).alias("totalItems")).withColumn("_one", F.lit(1))
    rows = found.orderBy(order_key).offset(page * size).limit(size)
    w = Window.partitionBy("_one").orderBy(order_key)          # over the page's rows only
    rows = rows.withColumn("_one", F.lit(1)).withColumn(
        "position", (F.row_number().over(w) + page * size).cast("long"))
    return total.join(rows, "_one", "left").drop("_one")


# ------------------------------------------------------------------ vectors
def _topk_cell(k: int, exclude_self: bool):
    """Top k of a query block in a catalogue block. The catalogue is walked in
    slices of ``SLICE`` rows with a running top k, so no array is larger than
    ``QUERY_ROWS`` x (``SLICE`` + k) numbers, whatever the block sizes.

    Cosines in single precision tell which pairs can beat a query's k-th best so
    far; these few alone are scored in double precision and ranked. Where they
    aren't few (the first slice, or many equal vectors) the whole slice is."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype=str), "_id": pd.Series(dtype=str),
                          "score": pd.Series(dtype=float)})

    def unit(column: pd.Series) -> np.ndarray:
        m = np.vstack(column.to_numpy()).astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(scores: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each row by rounded score, then by column (= id order)."""
        key = -np.round(scores, SCORE_DIGITS)
        kk = min(k, key.shape[1])
        cut = np.partition(key, kk - 1, axis=1)[:, kk - 1:kk]
        at, col = np.nonzero(key <= cut)                  # k and those equal to the last
        order = np.lexsort((cols[at, col], key[at, col], at))
        first = np.searchsorted(at[order], np.arange(len(key)))
        take = order[(first[:, None] + np.arange(kk)).reshape(-1)]
        return scores[at[take], col[take]].reshape(-1, kk), cols[at[take], col[take]].reshape(-1, kk)

    def better(q, c, score, a, own) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, place in the slice at ``a``) of the pairs that may come into the best; None: too many."""
        dim = q.shape[1]
        if score.shape[1] < k or not np.isfinite(score).all() or np.isinf(q).any() or np.isinf(c).any():
            return None
        least = np.round(score.min(axis=1), SCORE_DIGITS) - (dim + 8) * 2.0 ** -23     # what single precision may miss
        near = q.astype(np.float32) @ c.astype(np.float32).T
        flat = np.flatnonzero(near >= least.astype(np.float32)[:, None])     # NaN: a vector without a direction
        if len(flat) > QUERY_ROWS * SLICE // (dim + 16):
            return None
        at, col = np.divmod(flat, len(c))
        if exclude_self:
            stay = (col + a < own[0][at]) | (col + a >= own[1][at])
            at, col = at[stay], col[stay]
        return at, col

    def same_id(ids, qids) -> tuple[np.ndarray, np.ndarray]:
        """From where to where the sorted ``ids`` (nulls last) equal each query's id."""
        known, null = len(ids) - int(pd.isna(ids).sum()), pd.isna(qids)
        first, end = np.full(len(qids), known), np.full(len(qids), len(ids))
        first[~null] = np.searchsorted(ids[:known], qids[~null], "left")
        end[~null] = np.searchsorted(ids[:known], qids[~null], "right")
        return first, end

    def merge(score, col, at, place, found) -> tuple[np.ndarray, np.ndarray]:
        """``best`` of the running top k and some single pairs."""
        rows, n = np.unique(at, return_counts=True)
        wide_s = np.full((len(rows), n.max()), -np.inf)
        wide_c = np.full(wide_s.shape, np.iinfo(np.int64).max)
        r = np.repeat(np.arange(len(rows)), n)
        i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        wide_s[r, i], wide_c[r, i] = found, place
        score[rows], col[rows] = best(np.hstack([score[rows], wide_s]), np.hstack([col[rows], wide_c]))
        return score, col

    def run(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or cpdf.empty:
            return empty
        cpdf = cpdf.sort_values("_id", kind="stable")
        ids, vecs, out = cpdf["_id"].to_numpy(), unit(cpdf["vec"]), [empty]
        for lo in range(0, len(qpdf), QUERY_ROWS):
            part = qpdf.iloc[lo:lo + QUERY_ROWS]
            q, qids = unit(part["qvec"]), part["query_id"].to_numpy()
            own = same_id(ids, qids) if exclude_self else None
            score, col = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
            for a in range(0, len(ids), SLICE):
                c = vecs[a:a + SLICE]
                few = better(q, c, score, a, own)
                if few is not None:
                    at, place = few
                    if len(at):
                        score, col = merge(score, col, at, place + a, np.einsum("ij,ij->i", q[at], c[place]))
                    continue
                s = np.nan_to_num(q @ c.T, nan=-np.inf)
                for i in np.flatnonzero((own[1] > a) & (own[0] < a + len(c))) if exclude_self else ():
                    s[i, max(own[0][i] - a, 0):own[1][i] - a] = -np.inf
                here = np.broadcast_to(np.arange(a, a + len(c)), s.shape)
                score, col = best(np.hstack([score, s]), np.hstack([col, here]))
            kk = score.shape[1]
            out.append(pd.DataFrame({"query_id": np.repeat(qids, kk), "_id": ids[col.reshape(-1)],
                                     "score": score.reshape(-1)}))
        out = pd.concat(out)
        return out[np.isfinite(out["score"])]
    return run


def _rank(part: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("score", SCORE_DIGITS)), F.asc("_id"))
    return part.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _inputs(queries: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (queries.select(F.col("query_id").cast("string"), F.col("qvec").cast("array<double>")),
            catalog.select(F.col("_id").cast("string"), F.col("vec").cast("array<double>")))


def knn(queries: DataFrame, catalog: DataFrame, k: int, exclude_self: bool = False,
        q_blocks: int | None = None, c_blocks: int | None = None) -> DataFrame:
    """Exact top-k cosine neighbours.

    queries: (query_id string, qvec array<float|double>)
    catalog: (_id string, vec array<float|double>)
    -> (query_id, _id, score, rank), rank 1..k by score desc then _id.

    The grid has ``BLOCKS`` catalogue blocks from the start and more beyond
    ``BLOCK_ROWS`` rows each; a cell's memory is bounded by ``_topk_cell``.
    """
    queries, catalog = _inputs(queries, catalog)
    if q_blocks is None or c_blocks is None:
        # Grid size from the real row counts (Catalyst's estimates multiply
        # across joins and are useless here). Both inputs are written once
        # as reliable checkpoints, so counting does not recompute them and
        # the grid job reads stable, lineage-free inputs.
        from ..session import cut_lineage
        queries, catalog = cut_lineage(queries), cut_lineage(catalog)
        q_blocks = q_blocks or math.ceil(max(1, queries.count()) / BLOCK_ROWS)
        c_blocks = c_blocks or max(BLOCKS, math.ceil(catalog.count() / BLOCK_ROWS))
    qb, cb = q_blocks, c_blocks
    q = (queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))))
    c = (catalog.withColumn("cb", F.pmod(F.xxhash64("_id"), F.lit(cb)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
    part = (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInPandas(_topk_cell(k, exclude_self),
                           "query_id string, _id string, score double"))
    return _rank(part, k)


def candidate_knn(queries: DataFrame, catalog: DataFrame, k: int, lists: int = 64, probes: int = 8,
                  exclude_self: bool = False) -> DataFrame:
    """Like ``knn`` over candidates only: every catalogue vector goes to the nearest
    of ``lists`` pivots (catalogue vectors, taken by hash), a query looks into
    the ``probes`` lists whose pivots are nearest to it, and candidates are
    scored exactly. Lists over ``BLOCK_ROWS`` rows are cut into blocks. All of
    the catalogue is indexed; what a query may miss is measured in the tests.
    Only the pivots (``lists`` vectors) reach the driver."""
    from ..session import cut_lineage
    queries, catalog = _inputs(queries, catalog)
    catalog = cut_lineage(catalog)
    rows = catalog.filter(F.size("vec") > 0).orderBy(F.xxhash64("_id"), "_id").limit(lists).collect()
    if not rows:
        return _rank(queries.sparkSession.createDataFrame([], "query_id string, _id string, score double"), k)
    pivots = np.array([r["vec"] for r in rows], np.float64)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def nearest(n: int):
        @F.pandas_udf("array<int>")
        def run(vec: pd.Series) -> pd.Series:
            s = np.vstack(vec.to_numpy()).astype(np.float64) @ pivots.T
            return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)))
        return run

    c = catalog.filter(F.size("vec") > 0).withColumn("qb", F.explode(nearest(1)("vec")))
    c = cut_lineage(c)
    sizes = c.groupBy("qb").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    c = c.join(sizes, "qb").withColumn("cb", F.pmod(F.xxhash64("_id"), "blocks").cast("int")).drop("blocks")
    q = queries.filter(F.size("qvec") > 0).withColumn("qb", F.explode(nearest(probes)("qvec")))
    q = q.join(sizes, "qb").withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    part = (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInPandas(_topk_cell(k, exclude_self), "query_id string, _id string, score double"))
    return _rank(part, k)


def search_score(cosine: Column) -> Column:
    """Cosine on the scale of a search score, 0 to 1."""
    return (1 + cosine) / 2


def vector_search(products: DataFrame, queries: DataFrame, k: int = VECTOR_LIMIT,
                  brands=(), categories=(), page: int | None = 0,
                  size: int = PAGE_SIZE, probes: int | None = None) -> DataFrame:
    """Top k by cosine, facets applied **after** the cut (so fewer than k may
    remain), score (1 + cosine) / 2, then paged by ``size`` (``page=None``:
    all). Exact, or over candidates if ``probes`` is given."""
    cat = products.filter(F.col("vai_text_embedding").isNotNull()).select(
        F.col("_id"), F.col("vai_text_embedding").alias("vec"))
    top = knn(queries, cat, k) if probes is None else candidate_knn(queries, cat, k, probes=probes)
    top = top.withColumn("score", search_score(F.col("score")))
    facets = facet_filter(products.select("_id", "name", "brand", "masterCategory"),
                          brands, categories)
    hits = top.join(facets, "_id", "inner")
    w = Window.partitionBy("query_id").orderBy(F.col("rank"))
    hits = hits.withColumn("position", F.row_number().over(w).cast("long"))
    hits = hits.withColumn("totalItems", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    if page is not None:
        lo = page * size
        hits = hits.filter((F.col("position") > lo) & (F.col("position") <= lo + size))
    return hits


def receipt_recommendations(lines: DataFrame, products: DataFrame, k: int = 6) -> DataFrame:
    """Per order: its dearest product (first line on a price tie) -> the k
    most similar other products. Queries are deduplicated by product before
    the search and joined back to the orders."""
    dear = lines.groupBy("order_id").agg(
        F.max_by("product_id", F.struct(F.col("unit_price"), -F.col("pos"))).alias("product_id"))
    emb = products.filter(F.col("vai_text_embedding").isNotNull()).select(
        "_id", F.col("vai_text_embedding").alias("vec"))
    qs = dear.select(F.col("product_id").alias("_id")).distinct().join(emb, "_id") \
        .select(F.col("_id").alias("query_id"), F.col("vec").alias("qvec"))
    top = knn(qs, emb, k, exclude_self=True).withColumn("score", search_score(F.col("score")))
    return dear.join(top.withColumnRenamed("query_id", "product_id")
                     .withColumnRenamed("_id", "rec_id"), "product_id")


# ------------------------------------------------------------------ text
def tokens(text: Column) -> Column:
    """Lower-case alphanumeric terms."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != F.lit(""))


def text_search(products: DataFrame, queries: DataFrame, k: int = 3,
                fields=("name", "articleType", "subCategory", "brand"),
                k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 relevance of ``queries`` (query_id, text) over the product fields;
    top k per query by score desc, then _id.

    Identical query texts are scored once and joined back to their ids, and
    so are products with equal bags of tokens: a text's k best bags (by score,
    then by their lowest _id) hold its k best products, and of a bag only the
    k lowest ids can be among them. A term that all products share thus makes
    texts x bags rows, not texts x products.
    Postings (term, doc, tf) and document frequencies are aggregates; the
    collection size and mean length are one global row, folded into the
    per-term idf and per-document length norm (broadcast by a constant
    key: its size is one row whatever the data), so the large
    (query term x posting) join carries only precomputed factors.
    """
    doc_text = F.concat_ws(" ", *[F.col(f) for f in fields])
    docs = products.select("_id", F.array_sort(tokens(doc_text)).alias("toks"))
    docs = docs.withColumn("bag", F.sha2(F.array_join("toks", " "), 256))
    bags = docs.groupBy("bag").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("low"),
                                   F.first("toks").alias("toks"))
    post = (bags.select("bag", "copies", F.explode("toks").alias("term"))
            .groupBy("term", "bag").agg(F.count(F.lit(1)).alias("tf"), F.first("copies").alias("copies")))
    stats = F.broadcast(docs.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("toks")).alias("avgdl"))
                        .withColumn("_c", F.lit(1)))
    idf = (post.groupBy("term").agg(F.sum("copies").alias("df"))
           .withColumn("_c", F.lit(1)).join(stats, "_c")
           .select("term", F.log(F.lit(1.0) + (F.col("N") - F.col("df") + 0.5)
                                 / (F.col("df") + 0.5)).alias("idf")))
    norm = (bags.select("bag", "low", F.size("toks").alias("dl"), F.lit(1).alias("_c")).join(stats, "_c")
            .select("bag", "low", (k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))).alias("lnorm")))
    texts = queries.select(F.col("text")).distinct()
    qt = texts.select("text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    j = qt.join(idf, "term").join(post, "term").join(norm, "bag")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("lnorm"))
    scored = j.groupBy("text", "bag").agg(F.sum(part).alias("score"), F.first("low").alias("low"))
    best = Window.partitionBy("text").orderBy(F.desc(F.round("score", SCORE_DIGITS)), F.asc("low"))
    scored = scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    lowest = Window.partitionBy("bag").orderBy("_id")
    held = docs.select("bag", "_id").withColumn("r", F.row_number().over(lowest)) \
        .filter(F.col("r") <= k).drop("r")
    hits = scored.select("text", "bag", "score").join(held, "bag")
    w = Window.partitionBy("text").orderBy(F.desc(F.round("score", SCORE_DIGITS)), F.asc("_id"))
    top = hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    ids = queries.select(F.col("query_id").cast("string"), "text").distinct()
    return ids.join(top, "text").select("query_id", "_id", "score", "rank")


def product_recommendation(intents: DataFrame, products: DataFrame, k: int = 1, index=None) -> DataFrame:
    """Top product for each signal's intent text (signal_id, intentSummary); from a stored
    ``text_index`` of the products if one is given, else by ``text_search``."""
    q = intents.filter(F.col("intentSummary").isNotNull()).select(
        F.col("signal_id").alias("query_id"), F.col("intentSummary").alias("text"))
    if index is None:
        top = text_search(products, q, k)
    else:
        from .text_index import index_search
        top = index_search(index, q, k)
    info = products.select("_id", "name", F.col("image.url").alias("imageUrl"))
    return top.join(info, "_id").select(
        F.col("query_id").alias("signal_id"), "rank",
        F.col("_id").alias("rec_productId"), F.col("name").alias("rec_name"),
        F.col("imageUrl").alias("rec_imageUrl"), "score") \
        .join(intents.select("signal_id", "intentSummary"), "signal_id")
