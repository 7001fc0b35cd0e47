"""A stored BM25 index, and a top-k search that prunes.

The index is written once and read by term. Products with equal bags of tokens are one
entry, and a term's share of an entry's score, its impact, is known when the index is
built: it depends on the term, its count and the entry's length only. So a term's
postings fall into groups of equal impact (as many as there are different counts
and lengths, however many products there are), and the impact is the group's upper bound::

    entries    bag, low (its lowest id), impact by term     one row per bag
    held       bag, _id                                     the ``HEAD`` lowest ids of a bag
    heads      term, impact, low, bag                       the ``HEAD`` best postings of a term
    terms      term, top                                    the highest impact of a term
    postings   term, impact, bag                            by a hash of the term, sorted by term and impact

Search. The heads of a text's terms are scored in full; the k-th best score is a
threshold that no lost entry may reach. Terms whose highest impacts together stay below it
can't make a hit alone, so only the other (essential) terms give further candidates, and
of those only postings whose impact, with all other terms at their best, reaches the
threshold. The groups below are never read. What is left is scored in full. Results
are those of ``search.text_search``; a text of one term is answered from the heads alone.

Defined cases: texts without a known term have no rows; ties go to the lower id; k is at most
``HEAD``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import SCORE_DIGITS, tokens

HEAD = 128
BUCKETS = 64
FIELDS = ("name", "articleType", "subCategory", "brand")
#: Scores are compared to ``SCORE_DIGITS`` places; what may round up to the threshold stays.
_SLACK = 10.0 ** -SCORE_DIGITS


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """The tables of an index under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def all_postings(self) -> DataFrame:
        """With their types given, as without any product there is no file to tell them."""
        low = self.table("held").schema["_id"].dataType.simpleString()
        return self.spark.read.schema(f"term string, impact double, bag binary, low {low}, b int").parquet(
            f"{self.path}/postings")

    def postings(self, terms: DataFrame) -> DataFrame:
        """The postings in the buckets of some terms."""
        own = [r["b"] for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect()]   # ``BUCKETS`` at most
        return self.all_postings().filter(F.col("b").isin(own)).drop("b")


def build_text_index(products: DataFrame, path: str, fields=FIELDS, k1: float = 1.2, b: float = 0.75) -> TextIndex:
    """Write the index of ``products`` (_id and ``fields``) to a new folder."""
    spark, index = products.sparkSession, TextIndex(products.sparkSession, path)
    docs = products.select("_id", F.array_sort(tokens(F.concat_ws(" ", *[F.col(f) for f in fields]))).alias("toks"))
    docs = docs.withColumn("bag", F.unhex(F.sha2(F.array_join("toks", " "), 256)))
    by_id = Window.partitionBy("bag").orderBy("_id")
    docs.select("bag", "_id").withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= HEAD).drop("r") \
        .write.parquet(f"{path}/held")
    bags = docs.groupBy("bag").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("low"), F.first("toks").alias("toks"))
    bags.write.parquet(f"{path}/bags")
    bags = spark.read.parquet(f"{path}/bags")
    n, length = bags.agg(F.sum("copies"), F.sum(F.col("copies") * F.size("toks")) / F.sum("copies")).first()  # two numbers
    lnorm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.size("toks") / F.lit(float(length or 1.0)))
    post = bags.select("bag", "low", "copies", lnorm.alias("lnorm"), F.explode("toks").alias("term")) \
        .groupBy("term", "bag").agg(F.count(F.lit(1)).alias("tf"), F.first("low").alias("low"),
                                    F.first("copies").alias("copies"), F.first("lnorm").alias("lnorm"))
    df = F.col("df")
    idf = post.groupBy("term").agg(F.sum("copies").alias("df")).select(
        "term", F.log(F.lit(1.0) + (F.lit(int(n or 0)) - df + 0.5) / (df + 0.5)).alias("idf"))
    impact = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("lnorm"))
    post = post.join(idf, "term").select("term", impact.alias("impact"), "bag", "low", _bucket(F.col("term")).alias("b"))
    # ranges, not hashes, of (term, impact): the postings of a common term are split
    post.repartitionByRange("b", "term", F.desc("impact")).sortWithinPartitions("b", "term", F.desc("impact")) \
        .write.partitionBy("b").parquet(f"{path}/postings")
    post = index.all_postings()
    best = Window.partitionBy("term").orderBy(F.desc(F.round("impact", SCORE_DIGITS)), "low")
    post.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= HEAD).select("term", "impact", "low", "bag") \
        .write.parquet(f"{path}/heads")
    post.groupBy("term").agg(F.max("impact").alias("top")).write.parquet(f"{path}/terms")
    post.groupBy("bag").agg(F.first("low").alias("low"), F.map_from_entries(
        F.collect_list(F.struct("term", "impact"))).alias("impacts")).write.parquet(f"{path}/entries")
    return index


def _scored(index: TextIndex, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, bag, low, score) in full of pairs (text, bag)."""
    full = pairs.join(index.table("entries"), "bag").join(texts.select("text", "all"), "text")
    score = F.aggregate(F.transform("all", lambda t: F.coalesce(F.element_at(F.col("impacts"), t), F.lit(0.0))),
                        F.lit(0.0), lambda a, x: a + x)
    return full.select("text", "bag", "low", score.alias("score"))


def candidates(index: TextIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(text, bag, low, score) of the heads, and (text, bag) of what else may be among the best k."""
    texts = queries.select("text").distinct().withColumn("all", F.array_distinct(tokens(F.col("text"))))
    qt = texts.select("text", F.explode("all").alias("term")).join(index.table("terms"), "term")
    seeds = qt.select("text", "term").join(index.table("heads"), "term").select("text", "bag").distinct()
    seeds = _scored(index, seeds, texts)
    order = Window.partitionBy("text").orderBy(F.desc("score"))
    limit = seeds.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k) \
        .select("text", (F.col("score") - _SLACK).alias("limit"))
    known = qt.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("top", "term"))).alias("ts"),
                                   F.sum("top").alias("sum"))
    known = known.filter(F.size("ts") > 1).join(limit, "text", "left").withColumn("limit", F.coalesce("limit", F.lit(0.0)))
    below = F.transform("ts", lambda x, i: F.struct(                # terms ascending by their highest impact
        x["term"].alias("term"), x["top"].alias("top"), F.aggregate(
            F.slice("ts", 1, i + 1), F.lit(0.0), lambda a, y: a + y["top"]).alias("upto")))
    essential = known.select("text", "sum", "limit", F.explode(below).alias("t")).filter(F.col("t.upto") >= F.col("limit")) \
        .select("text", "t.term", (F.col("limit") - F.col("sum") + F.col("t.top")).alias("least"))
    more = essential.join(index.postings(essential.select("term")), "term").filter(F.col("impact") >= F.col("least")) \
        .select("text", "bag").distinct()
    return seeds, more.join(seeds.select("text", "bag"), ["text", "bag"], "left_anti")


def index_search(index: TextIndex, queries: DataFrame, k: int = 3) -> DataFrame:
    """``search.text_search`` on a stored index: (query_id, _id, score, rank)."""
    if not 1 <= k <= HEAD:
        raise ValueError(f"k is from 1 to {HEAD}")
    seeds, more = candidates(index, queries, k)
    texts = queries.select("text").distinct().withColumn("all", F.array_distinct(tokens(F.col("text"))))
    scored = seeds.unionByName(_scored(index, more, texts)).withColumn("s", F.round("score", SCORE_DIGITS))
    best = Window.partitionBy("text").orderBy(F.desc("s"), "low")
    top = scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("text", "bag", "score", "s")
    hits = top.join(index.table("held"), "bag")
    rank = Window.partitionBy("text").orderBy(F.desc("s"), "_id")
    hits = hits.withColumn("rank", F.row_number().over(rank).cast("long")).filter(F.col("rank") <= k)
    ids = queries.select(F.col("query_id").cast("string"), "text").distinct()
    return ids.join(hits, "text").select("query_id", "_id", "score", "rank")
