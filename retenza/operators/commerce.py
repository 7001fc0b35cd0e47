"""Orders and carts: totals, status, summaries, edit-log folding.

Line-level work runs on one row per order/cart line (``explode_lines``
turns the reference's nested documents into lines), so totals are
algebraic sums and never depend on the size of one customer's history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commerce import pretty_date, price_label, shipping_method


def explode_lines(docs: DataFrame, key: str = "_id", user: str | None = "user") -> DataFrame:
    """Nested ``products`` array -> one row per line with its position."""
    keep = [key] + ([user] if user and user in docs.columns else [])
    return docs.select(*keep, F.posexplode("products").alias("pos", "p")).select(
        *keep, "pos", F.col("p._id").alias("product_id"), F.col("p.name").alias("name"),
        F.col("p.brand").alias("brand"), F.col("p.code").alias("code"),
        F.col("p.amount").alias("amount"), F.col("p.price.amount").alias("unit_price"))


def cart_totals(lines: DataFrame, carts: DataFrame | None = None, key: str = "user") -> DataFrame:
    """Per cart: sum(price x amount) and sum(amount); an empty cart gives 0.

    ``carts`` (one row per cart key) keeps carts that have no line left.
    """
    tot = lines.groupBy(key).agg(
        F.sum(F.col("unit_price") * F.col("amount")).alias("totalPrice"),
        F.sum("amount").cast("long").alias("totalAmount"))
    if carts is not None:
        tot = carts.select(key).distinct().join(tot, key, "left")
    return tot.fillna({"totalPrice": 0.0, "totalAmount": 0})


def order_totals(lines: DataFrame, key: str = "order_id") -> DataFrame:
    """Per order: the same sums with a null or zero amount counted as 1."""
    amt = F.when(F.coalesce(F.col("amount"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("amount"))
    return lines.groupBy(key).agg(
        F.sum(F.col("unit_price") * amt).alias("totalPrice"),
        F.sum(amt).cast("long").alias("totalAmount"))


def latest_order_status(orders: DataFrame) -> DataFrame:
    """Last element of ``status_history``: status, its time, cancelled flag
    and whether a store pickup is ready."""
    last = F.element_at("status_history", -1)
    status = last.getField("status")
    return orders.select(
        "_id", "user", "type",
        status.alias("status"),
        F.timestamp_millis(last.getField("timestamp")).alias("status_ts"),
        F.coalesce(F.lower(status).contains("cancel"), F.lit(False)).alias("isCanceled"),
        ((shipping_method(F.col("type")) == "bopis")
         & F.coalesce(F.lower(status).contains("ready"), F.lit(False))).alias("packageIsInTheStore"))


def order_summary(orders: DataFrame) -> DataFrame:
    """Order projected to id, user, address, status, pretty date, type and
    a product list with '$' prices."""
    last = F.element_at("status_history", -1)
    return orders.select(
        F.col("_id").alias("id"), "user", "shipping_address",
        last.getField("status").alias("status"),
        pretty_date(F.timestamp_millis(last.getField("timestamp"))).alias("status_date"),
        "type",
        F.transform("products", lambda p: F.struct(
            p.getField("_id").alias("id"), p.getField("name").alias("name"),
            p.getField("description").alias("description"),
            p.getField("code").alias("code"), p.getField("brand").alias("brand"),
            price_label(p.getField("price").getField("amount")).alias("price"))).alias("products"))


def orders_newest_first(orders: DataFrame, user: str | None = None,
                        order_key: str = "okey") -> DataFrame:
    """A user's orders (or everyone's) by id descending: a range-partitioned
    global sort, so one user's many orders spread over several tasks."""
    if user is not None:
        orders = orders.filter(F.col("user") == F.lit(user))
    return orders.orderBy("user", F.desc(order_key))


def last_bought_products(lines: DataFrame, n: int, order_key: str = "okey") -> DataFrame:
    """First ``n`` products over each user's newest orders, flattened.

    ``row_number() <= n`` is planned with a per-partition group limit
    before the shuffle, so each map task forwards at most n rows per user.
    """
    tie = [F.asc("product_id")] if "product_id" in lines.columns else []
    w = Window.partitionBy("user").orderBy(F.desc(order_key), F.asc("pos"), *tie)
    return (lines.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= n))


def latest_by_key(feed: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key from an insert/update/replace feed (``max_by`` is
    a partial aggregate: no full sort of a hot key). Rows of one version are
    told apart by a hash of their values, so the choice is always the same."""
    cols = [c for c in feed.columns if c != key]
    rank = F.struct(F.col(version), F.xxhash64(*cols))
    return feed.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_r")).select(key, "_r.*")


def product_notifications(nbas: DataFrame, removals: DataFrame | None = None,
                          version: str = "ts") -> DataFrame:
    """Per product the newest embedded message; removed products drop out."""
    emb = nbas.filter(F.col("embedInProduct").isNotNull()).select(
        F.col("embedInProduct.productId").alias("productId"),
        F.col("embedInProduct.message").alias("message"), F.col(version).alias("version"),
        "signal_id")
    out = emb.groupBy("productId").agg(
        F.max_by(F.struct("message", "signal_id"), F.struct("version", "signal_id")).alias("m"),
        F.max("version").alias("version")).select("productId", "m.message", "m.signal_id",
                                                  "version")
    if removals is not None:
        out = out.join(removals.select("productId"), "productId", "left_anti")
    return out


def cart_state(edits: DataFrame) -> DataFrame:
    """Fold a cart edit log (user, seq, op push|pull|clear, product) into the
    final cart lines: a push survives when it is after the user's last
    clear and after the last pull of its product. Two aggregates and two
    joins; no per-user list is ever gathered."""
    pushes = edits.filter(F.col("op") == "push").select(
        "user", "seq", F.col("product._id").alias("product_id"), "product")
    clears = edits.filter(F.col("op") == "clear").groupBy("user") \
        .agg(F.max("seq").alias("last_clear"))
    pulls = edits.filter(F.col("op") == "pull").groupBy(
        "user", F.col("product._id").alias("product_id")).agg(F.max("seq").alias("last_pull"))
    j = pushes.join(clears, "user", "left").join(pulls, ["user", "product_id"], "left")
    keep = ((F.col("seq") > F.coalesce(F.col("last_clear"), F.lit(-1)))
            & (F.col("seq") > F.coalesce(F.col("last_pull"), F.lit(-1))))
    return j.filter(keep).select(
        "user", F.col("seq").alias("pos"), "product_id",
        F.col("product.name").alias("name"), F.col("product.brand").alias("brand"),
        F.col("product.amount").alias("amount"),
        F.col("product.price.amount").alias("unit_price"))


def array_push(carts: DataFrame, items: DataFrame, order: str = "seq") -> DataFrame:
    """Append items (user, ``order``, product struct) to each cart's products array, in
    the order of the edits; edits of one order value by the product's fields."""
    edit = F.struct(F.col(order).alias("at"), "product")
    add = items.groupBy("user").agg(F.array_sort(F.collect_list(edit)).alias("_add"))
    return carts.join(add, "user", "left").withColumn(
        "products", F.concat(F.coalesce("products", F.array()), F.coalesce(
            F.transform("_add", lambda x: x.getField("product")), F.array()))).drop("_add")


def array_pull(carts: DataFrame, product_id: str) -> DataFrame:
    """Remove every line of one product id; lines without an id stay."""
    return carts.withColumn("products", F.filter(
        "products", lambda p: ~p.getField("_id").eqNullSafe(F.lit(product_id))))


def array_clear(carts: DataFrame) -> DataFrame:
    return carts.withColumn("products", F.filter("products", lambda p: F.lit(False)))


def random_sample_products(products: DataFrame, n: int, seed: int = 42,
                           key: str = "_id") -> DataFrame:
    """Seeded sample of n rows: order by a keyed hash, take n (a top-n: each
    partition keeps n candidates, the driver merges at most n per task)."""
    return products.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
