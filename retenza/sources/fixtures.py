"""Adapter from the driver's tables to the retail data model.

The driver ships TPC-H-like tables plus a flat ``events`` table; the
library works on retail events, products, orders and carts. This module
is the fixed mapping (documented in FIXTURES.md §4). It is ours, not a
reference operator. Every output is a lazy DataFrame over the parquet
scans, so all downstream work grows with the input tables.
"""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import sized_join
from ..schemas import BOPIS_LABEL, BOPIS_STEPS, HOME_LABEL, HOME_STEPS

# --- fixed values of the adapter -------------------------------------------
EVENT_TYPE_MAP = {"view": "view-product", "click": "search",
                  "purchase": "add-to-cart", "error": "exit-risk"}
PRODUCT_EVENTS = ["search", "view-product", "add-to-cart"]
EXIT_METHOD = "logout-hover"
STORE_ADDRESS = "1 Market Square, Springfield 10001, US"
CURRENCY = "USD"
STEP_MS = 3_600_000          # one hour between order status steps
# ---------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def mapped_event(event_type: Column, k: Column) -> Column:
    expr = None
    for src, dst in EVENT_TYPE_MAP.items():
        expr = F.when(event_type == src, F.lit(dst)) if expr is None \
            else expr.when(event_type == src, F.lit(dst))
    return (expr.when((event_type == "signup") & (k % 2 == 0), F.lit("view-cart"))
                .when(event_type == "signup", F.lit("heartbeat")))


def article_type(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def sub_category(size: Column) -> Column:
    return F.concat(F.lit("size-"), F.floor(size / 10).cast("long").cast("string"))


def session_of(user: Column, ts: Column) -> Column:
    """``user-<ISO week start>``: one session per user and calendar week."""
    return F.concat_ws("-", user, F.date_trunc("week", ts).cast("date").cast("string"))


def raw_events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The driver's ``events`` table as a file stream (fixed schema)."""
    schema = read(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def retail_events(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Driver ``events`` -> retail events (nested tags/metadata schema).

    ``raw`` may be a streaming DataFrame of the driver's events; the product
    lookup is then a stream-static join.
    """
    raw = raw if raw is not None else read(spark, sf_dir, "events")
    ev = (raw
          .select("event_id", "ts", "user_id", "event_type", "props")
          .withColumn("k", _k(F.col("props")))
          .withColumn("event", mapped_event(F.col("event_type"), F.col("k")))
          .withColumn("timestamp", F.col("ts").cast("timestamp")))
    dims = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    joined = sized_join(ev, dims, (F.col("k") == F.col("p_partkey"))
                        & F.col("event").isin(*PRODUCT_EVENTS), "left")
    is_prod = F.col("event").isin(*PRODUCT_EVENTS)
    uid = F.col("user_id").cast("string")
    return joined.select(
        "event_id",
        F.struct(uid.alias("userId"),
                 session_of(uid, F.col("timestamp")).alias("sessionId"),
                 F.col("event").alias("event")).alias("tags"),
        "timestamp",
        F.struct(
            F.when(is_prod, F.col("k").cast("string")).alias("productId"),
            article_type(F.col("p_name")).alias("articleType"),
            sub_category(F.col("p_size")).alias("subCategory"),
            F.col("p_brand").alias("brand"),
            F.when(F.col("event") == "search", F.col("p_name")).alias("query"),
            F.when(F.col("event") == "view-cart", F.col("k") % 4 + 1).cast("int").alias("itemCount"),
            F.when(F.col("event") == "exit-risk", F.lit(EXIT_METHOD)).alias("exitMethod"),
        ).alias("metadata"),
    )


def products(spark: SparkSession, sf_dir: str, with_embedding: bool = True) -> DataFrame:
    """``part`` (+ ``embeddings`` by ``vec_id = p_partkey``) -> products."""
    p = read(spark, sf_dir, "part")
    out = p.select(
        F.col("p_partkey").cast("string").alias("_id"),
        F.col("p_partkey").alias("pkey"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"),
        F.lit(None).cast("string").alias("gender"),
        F.col("p_type").alias("masterCategory"),
        sub_category(F.col("p_size")).alias("subCategory"),
        article_type(F.col("p_name")).alias("articleType"),
        F.element_at(F.split(F.col("p_name"), " "), 1).alias("baseColour"),
        F.col("p_brand").alias("brand"),
        F.lit(None).cast("string").alias("description"),
        F.struct(F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"),
                          F.lit(".jpg")).alias("url")).alias("image"),
        F.struct(F.col("p_retailprice").alias("amount"),
                 F.lit(CURRENCY).alias("currency")).alias("price"),
    )
    if with_embedding:
        emb = read(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("pkey"), F.col("embedding").alias("vai_text_embedding"))
        out = out.join(emb, "pkey", "left")
    return out


def product_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separate embedding store (for the backlog / exists test)."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("_id"), F.col("embedding"))


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part's name and brand, as read."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_returnflag")
    dims = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return sized_join(li, dims, li.l_partkey == dims.p_partkey, "left")


def _lines(rows: DataFrame) -> DataFrame:
    """``_line_rows`` -> order lines."""
    return rows.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").cast("string").alias("_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"),
        F.col("l_quantity").cast("int").alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_returnflag").alias("returnflag"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: order id, line number, product fields."""
    return _lines(_line_rows(spark, sf_dir))


def order_type(okey: Column) -> Column:
    return F.when(okey % 2 == 1, F.lit(HOME_LABEL)).otherwise(F.lit(BOPIS_LABEL))


def status_history(okey: Column, status: Column, orderdate: Column) -> Column:
    """O: first step; P: two steps; F: all steps of the order's method."""
    home = okey % 2 == 1
    start = F.unix_millis(orderdate.cast("timestamp"))
    # one array of plain expressions: a lambda per step would be interpreted for every order
    steps = F.array(*[F.struct(F.when(home, F.lit(h)).otherwise(F.lit(b)).alias("status"),
                               (start + F.lit(i * STEP_MS)).alias("timestamp"))
                      for i, (h, b) in enumerate(zip_longest(HOME_STEPS, BOPIS_STEPS))])
    n = (F.when(status == "O", F.lit(1)).when(status == "P", F.lit(2))
          .when(home, F.lit(len(HOME_STEPS))).otherwise(F.lit(len(BOPIS_STEPS))))
    return F.slice(steps, 1, n)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's name and nation, as read."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return sized_join(o, c, o.o_custkey == c.c_custkey, "left")


def _header(rows: DataFrame, *more: str) -> DataFrame:
    """``_order_rows`` -> order documents without the product array (and the columns ``more``)."""
    user_addr = F.concat_ws(", ", F.col("c_name"),
                            F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.col("o_orderkey").alias("okey"),
        F.col("o_custkey").cast("string").alias("user"),
        order_type(F.col("o_orderkey")).alias("type"),
        F.col("o_orderstatus").alias("o_status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("orderdate"),
        user_addr.alias("user_address"),
        F.lit(STORE_ADDRESS).alias("store_address"),
        status_history(F.col("o_orderkey"), F.col("o_orderstatus"),
                       F.col("o_orderdate")).alias("status_history"),
        *more,
    )


def orders_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order documents without the product array (one row per order)."""
    return _header(_order_rows(spark, sf_dir))


def orders_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full order documents (products array ordered by line number).

    An order's lines are few (bounded by the order size), so gathering
    them per order is safe; work that does not need the document shape
    uses ``order_lines`` directly. The lines of an order are scattered over
    the table, so gathering before the shuffle merges next to nothing and only
    makes the rows wider: lines and orders are shuffled as read, and what is
    constant or follows from other columns is made behind the shuffles.
    """
    from ..functions.commerce import order_address
    product = F.struct(
        "_id", "name", F.lit(None).cast("string").alias("description"), "brand", "code", "amount",
        F.struct(F.col("unit_price").alias("amount"), F.lit(CURRENCY).alias("currency")).alias("price"))
    lines = _lines(_line_rows(spark, sf_dir).repartition("l_orderkey")) \
        .select(F.col("okey").alias("line_okey"), F.struct("pos", product.alias("product")).alias("p"))
    prod = lines.groupBy("line_okey").agg(F.sort_array(F.collect_list("p")).alias("p"))
    rows = _order_rows(spark, sf_dir)
    h = _header(rows.join(prod, rows.o_orderkey == prod.line_okey, "left"), "p")
    return h.select(
        "_id", "okey", "user", "type",
        order_address(F.col("type"), F.col("user_address"), F.col("store_address"))
        .alias("shipping_address"),
        F.coalesce(F.col("p.product"), F.array()).alias("products"),
        "status_history", "orderdate")


def cart_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart edit log per customer, from the lines of open (O) orders.

    push: every line (seq = orderkey*16 + line); pull: a line with return
    flag R removes that product right after (seq + 8, still within the
    order); clear: an order of priority 1-URGENT empties the cart first
    (seq = orderkey*16).
    """
    o = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O") \
        .select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = order_lines(spark, sf_dir)
    j = lines.join(o, lines.okey == o.o_orderkey, "inner")
    product = F.struct(F.col("_id"), F.col("name"), F.col("brand"), F.col("code"),
                       F.col("amount"),
                       F.struct(F.col("unit_price").alias("amount"),
                                F.lit(CURRENCY).alias("currency")).alias("price"))
    user = F.col("o_custkey").cast("string")
    push = j.select(user.alias("user"), (F.col("okey") * 16 + F.col("pos")).alias("seq"),
                    F.lit("push").alias("op"), product.alias("product"))
    pull = j.filter(F.col("returnflag") == "R").select(
        user.alias("user"), (F.col("okey") * 16 + F.col("pos") + 8).alias("seq"),
        F.lit("pull").alias("op"), product.alias("product"))
    clear = o.filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").cast("string").alias("user"),
        (F.col("o_orderkey") * 16).alias("seq"), F.lit("clear").alias("op"),
        F.lit(None).cast(push.schema["product"].dataType).alias("product"))
    return push.unionByName(pull).unionByName(clear)


def redemption_log(signals: DataFrame, events: DataFrame, horizon_ms: int = 86_400_000) -> DataFrame:
    """Fixture rule for ``redeemed``: the signal's user buys (add-to-cart) in
    ``[ts, ts + horizon)``.

    Purchases are first reduced to (uid, bucket) -> (min ts, max ts), so
    the join never pairs a signal with every purchase of a hot user. A
    horizon-long range touches the signal's bucket b (needs max >= ts) and
    bucket b+1 (needs min < ts + horizon): two equi-joins, exact.
    """
    bucket = lambda c: F.floor(F.unix_millis(c) / F.lit(horizon_ms)).cast("long")
    buys = (events.filter(F.col("tags.event") == "add-to-cart")
            .groupBy(F.col("tags.userId").alias("uid"), bucket(F.col("timestamp")).alias("b"))
            .agg(F.min("timestamp").alias("first_buy"), F.max("timestamp").alias("last_buy")))
    s = signals.select(F.col("_id").alias("signal_id"), "uid", "ts",
                       bucket(F.col("ts")).alias("b"))
    same = buys.select("uid", "b", "last_buy")
    nxt = buys.select("uid", (F.col("b") - 1).alias("b"), "first_buy")
    j = s.join(same, ["uid", "b"], "left").join(nxt, ["uid", "b"], "left")
    hit = ((F.col("last_buy") >= F.col("ts"))
           | (F.col("first_buy") < F.col("ts") + F.expr(f"make_dt_interval(0, 0, 0, {horizon_ms // 1000})")))
    return j.filter(F.coalesce(hit, F.lit(False))).select("signal_id")
