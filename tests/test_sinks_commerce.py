"""Idempotent sinks, order and cart operators."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from retenza.functions import commerce as FC
from retenza.operators import commerce as CM
from retenza.sources import keyed as KT
from retenza.sources import keyed as KT
from retenza.sources import sinks as SK


def test_insert_if_absent_keeps_existing_and_dedups(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v int")
    b = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "_id string, v int")
    out = {r["_id"]: r["v"] for r in SK.merge_insert_if_absent(t, b).collect()}
    assert out["a"] == 1 and out["b"] == 2 and out["c"] in (3, 4) and len(out) == 3


def test_insert_to_path_replay_is_noop(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="retenza-test-"), "t")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "_id string, v int")
    SK.insert_if_absent_to(spark, b, path)
    SK.insert_if_absent_to(spark, b, path)                      # replayed batch
    assert spark.read.parquet(path).count() == 2


def test_upsert_scores(spark):
    t = spark.createDataFrame([("u1", 0.1, "Low"), ("u2", 0.9, "High")],
                              "uid string, p double, tier string")
    b = spark.createDataFrame([("u2", 0.5), ("u3", 0.7)], "uid string, p double")
    out = {r["uid"]: (r["p"], r["tier"]) for r in SK.upsert_scores(t, b).collect()}
    assert out == {"u1": (0.1, "Low"), "u2": (0.5, "High"), "u3": (0.7, None)}


def test_merge_session_state_replay(spark):
    rows = spark.createDataFrame([("s1", 1)], "sessionId string, n int").withColumn(
        "window", F.struct(F.current_timestamp().alias("start")))
    first = SK.merge_session_state(None, rows)
    again = SK.merge_session_state(first, rows)
    assert first.count() == 1 and again.count() == 0


def _line(pid, amount, price):
    return (pid, f"n{pid}", "b", f"P{pid}", amount, (price, "USD"))


def test_cart_fold_push_pull_clear(spark):
    schema = ("user string, seq long, op string, product struct<_id:string,name:string,"
              "brand:string,code:string,amount:int,price:struct<amount:double,currency:string>>")
    edits = spark.createDataFrame([
        ("u", 1, "push", _line("a", 1, 2.0)), ("u", 2, "push", _line("b", 2, 3.0)),
        ("u", 3, "pull", _line("a", 1, 2.0)), ("u", 4, "push", _line("a", 5, 1.0)),
        ("v", 1, "push", _line("c", 1, 9.0)), ("v", 2, "clear", None)], schema)
    lines = CM.cart_state(edits)
    got = sorted((r["user"], r["product_id"], r["amount"]) for r in lines.collect())
    assert got == [("u", "a", 5), ("u", "b", 2)]
    tot = {r["user"]: (r["totalPrice"], r["totalAmount"])
           for r in CM.cart_totals(lines, carts=edits).collect()}
    assert tot == {"u": (11.0, 7), "v": (0.0, 0)}


def test_order_totals_amount_default(spark):
    lines = spark.createDataFrame([("o", 2.0, None), ("o", 3.0, 0), ("o", 1.0, 4)],
                                  "order_id string, unit_price double, amount int")
    r = CM.order_totals(lines).collect()[0]
    assert (r["totalPrice"], r["totalAmount"]) == (9.0, 6)


def test_order_scalars(spark):
    df = spark.createDataFrame([("Buy Online, Pick up in Store",), ("Buy Online, Get Delivery at Home",),
                                (None,)], "type string")
    out = df.select(FC.norm_order_type(F.col("type")).alias("n"),
                    FC.shipping_method(F.col("type")).alias("m"),
                    FC.order_address(F.col("type"), F.lit("home addr"), F.lit("store addr")).alias("a")
                    ).collect()
    assert out[0]["n"] == "BUYONLINE,PICKUPINSTORE" and out[0]["m"] == "bopis"
    assert out[0]["a"] == "store addr" and out[1]["a"] == "home addr"
    assert out[2]["a"] == "Unknown address"
    ts = spark.createDataFrame([(946684800000,)], "ms long").select(
        FC.pretty_date(FC.epoch_ms_to_ts(F.col("ms"))).alias("d")).collect()[0]["d"]
    assert ts == "Jan 1, 2000 at 12:00:00 AM"
    labels = [r["l"] for r in spark.createDataFrame([(900.0,), (12.5,)], "a double")
              .select(FC.price_label(F.col("a")).alias("l")).collect()]
    assert labels == ["$900", "$12.5"]


def test_latest_status_and_last_bought(spark):
    orders = spark.createDataFrame(
        [("1", "u", "Buy Online, Pick up in Store", [("In Process", 1), ("Ready for pickup", 2)])],
        "_id string, user string, type string, status_history array<struct<status:string,timestamp:long>>")
    r = CM.latest_order_status(orders).collect()[0]
    assert r["status"] == "Ready for pickup" and r["packageIsInTheStore"] and not r["isCanceled"]
    lines = spark.createDataFrame([("u", 1, 1, "a"), ("u", 2, 1, "b"), ("u", 2, 2, "c")],
                                  "user string, okey long, pos int, product_id string")
    got = [r["product_id"] for r in CM.last_bought_products(lines, 2).orderBy("rank").collect()]
    assert got == ["b", "c"]


def test_latest_by_key(spark):
    feed = spark.createDataFrame([("k", "old", 1), ("k", "new", 5), ("j", "x", 2)],
                                 "key string, v string, ver long")
    out = {r["key"]: r["v"] for r in CM.latest_by_key(feed, "key", "ver").collect()}
    assert out == {"k": "new", "j": "x"}


def test_upsert_null_replaces_and_last_wins(spark):
    t = spark.createDataFrame([("u1", 0.9, "exit_risk_ratio")], "uid string, p double, factor string")
    b = spark.createDataFrame([("u1", 0.5, "x", 1), ("u1", 0.1, None, 2), ("u2", 0.2, "y", 5), ("u2", 0.3, "z", 4)],
                              "uid string, p double, factor string, scored_at int")
    out = {r["uid"]: (r["p"], r["factor"]) for r in SK.upsert_scores(t, b).collect()}
    assert out == {"u1": (0.1, None), "u2": (0.2, "y")}


def test_upsert_scores_to_keeps_versions_and_replays(spark, tmp_path):
    path = str(tmp_path / "scores")
    schema = "uid string, p double"
    one = spark.createDataFrame([("a", 0.1), ("b", 0.2)], schema)
    two = spark.createDataFrame([("b", 0.5), ("c", 0.6)], schema)
    KT.upsert_scores_to(spark, one, path, stream="s", batch_id=0)
    for _ in range(2):                                          # the second is a replay
        KT.upsert_scores_to(spark, two, path, stream="s", batch_id=1)
    KT.upsert_scores_to(spark, spark.createDataFrame([("a", 0.9)], schema), path)
    got = {r["uid"]: r["p"] for r in KT.read_scores(spark, path).collect()}
    assert got == {"a": 0.9, "b": 0.5, "c": 0.6}
    assert KT.KeyedTable(spark, path, "uid").versions() == [1, 2]


def test_redeem_to_updates_known_ids(spark, tmp_path):
    path = str(tmp_path / "nbas")
    KT.KeyedTable(spark, path, "signal_id", 4).merge(spark.createDataFrame(
        [("1", "u", False), ("2", "v", False)], "signal_id string, uid string, redeemed boolean"))
    log = spark.createDataFrame([("2",), ("2",), ("9",), (None,)], "signal_id string")
    for _ in range(2):
        out = KT.redeem_to(spark, log, path, stream="log", batch_id=0)
        assert sorted(map(tuple, out.collect())) == [("1", "u", False), ("2", "v", True)]


def test_append_keeps_the_tables_schema(spark, tmp_path):
    """Reordered, missing, narrower and unknown columns; every file has the table's schema."""
    import pytest

    path = str(tmp_path / "t")
    SK.append_table(spark.createDataFrame([("a", 1, True)], "uid string, n long, old boolean"), path)
    SK.append_table(spark.createDataFrame([(2, "b")], "n int, UID string"), path)
    more = spark.createDataFrame([("c", 3, 0.5)], "uid string, n long, p double")
    with pytest.raises(ValueError):
        SK.append_table(more, path)
    rows = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert rows == [("a", 1, True), ("b", 2, None)]
    kinds = {spark.read.parquet(os.path.join(path, f)).schema.simpleString()
             for f in os.listdir(path) if f.endswith(".parquet")}
    assert kinds == {"struct<uid:string,n:bigint,old:boolean>"}
    SK.append_table(more, path, new_columns=True)
    SK.append_table(spark.createDataFrame([("d",)], "uid string"), path)
    got = SK.read_if_exists(spark, path)
    assert sorted(map(tuple, got.select("uid", "n", "old", "p").collect())) == [
        ("a", 1, True, None), ("b", 2, None, None), ("c", 3, None, 0.5), ("d", None, None, None)]


def test_push_keeps_the_order_of_edits_and_pull_keeps_lines_without_id(spark):
    kind = "user string, products array<struct<_id:string,amount:int>>"
    carts = spark.createDataFrame([("u", [("p", 1), (None, 2)]), ("v", None)], kind)
    items = spark.createDataFrame([("u", i, (f"p{i}", i)) for i in (5, 1, 9, 3)] + [("v", 1, ("p", 7))],
                                  "user string, seq int, product struct<_id:string,amount:int>").repartition(4)
    out = {r["user"]: [p["_id"] for p in r["products"]] for r in CM.array_push(carts, items).collect()}
    assert out == {"u": ["p", None, "p1", "p3", "p5", "p9"], "v": ["p"]}
    pulled = {r["user"]: r["products"] for r in CM.array_pull(carts, "p").collect()}
    assert [p["_id"] for p in pulled["u"]] == [None] and pulled["v"] is None


def test_replay_without_marker_and_after_a_half_written_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "_id string, v int")
    key = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(key, "false")
    try:
        name = SK.batch_name("ck", 0)
        b.limit(1).write.parquet(f"{path}/{SK.BATCH}={name}")  # what a failed attempt left
        for _ in range(2):
            SK.insert_if_absent_to(spark, b, path, batch_id=name)
        SK.insert_if_absent_to(spark, b, path, batch_id=SK.batch_name("ck", 1))
        SK.insert_if_absent_to(spark, b, path, batch_id=SK.batch_name("other", 0))
        SK.insert_if_absent_to(spark, b, path)
    finally:
        conf.unset(key)
    table = SK.read_if_exists(spark, path)
    assert table.columns == ["_id", "v"] and table.count() == 2
    assert SK.read_if_exists(spark, str(tmp_path / "none")) is None


def test_latest_by_key_breaks_ties_alike(spark):
    rows = [("k", 1, "a"), ("k", 1, "b"), ("l", 2, "c")]
    got = [sorted(map(tuple, CM.latest_by_key(spark.createDataFrame(r, "key string, v int, x string"), "key", "v")
                      .collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 2


def test_checkpoint_folder_is_refused_on_a_cluster(monkeypatch):
    import types

    import pytest

    from retenza import session

    fake = types.SimpleNamespace(
        sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None),
        conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)


def test_sized_join_counts_decoded_bytes(spark, tmp_path):
    from retenza.plans import joins

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    raw = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert joins.estimated_bytes(df) == joins.DECODED * raw
    assert joins.fits_broadcast(df, joins.DECODED * raw) and not joins.fits_broadcast(df, raw)


def _rows_scanned(df):
    """Rows that the Parquet scan of a collected query gave on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, found = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def test_lookup_layout_skips_row_groups(spark, tmp_path):
    """Few rows are read for a key that is there, none or few for one that isn't."""
    import random

    from pyspark.sql import functions as F

    from retenza.sources import tables as TB

    keys = list(range(0, 120_000, 2))
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("v", F.sha2(F.col("k").cast("string"), 256))
    plain, path = str(tmp_path / "plain"), str(tmp_path / "sorted")
    SK.overwrite_table(rows, plain)
    SK.overwrite_table(rows, path, lookup_key="k", row_group_bytes=64 << 10)
    for key, n in ((60_000, 1), (60_001, 0), (-5, 0)):
        found = TB.lookup_by_key(spark.read.parquet(path), "k", key)
        assert found.count() == n
        assert _rows_scanned(TB.lookup_by_key(spark.read.parquet(path), "k", key)) <= 0.1 * len(keys)
    assert _rows_scanned(TB.lookup_by_key(spark.read.parquet(plain), "k", 60_000)) >= 0.5 * len(keys)
    assert sorted(r["k"] for r in spark.read.parquet(path).select("k").collect()) == sorted(keys)


def test_counts_come_from_footers(spark, tmp_path):
    from retenza.sources import tables as TB

    paths = {n: str(tmp_path / n) for n in ("a", "b", "none")}
    for (name, path), n in zip(paths.items(), (1234, 7, 0)):
        spark.range(n).withColumnRenamed("id", "x").repartition(3).write.parquet(path)
    assert dict(map(tuple, TB.footer_counts(spark, paths).collect())) == {"a": 1234, "b": 7, "none": 0}
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = TB.count_of_footers(own, paths["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(1)]" in plan or "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def _order_tables(spark, path):
    """Five orders: one twice, one of no customer and no date, one without a line; lines of equal position."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))

    day = dt.datetime(1998, 2, 6)
    put("customer", [(7, "Ann", 3), (8, None, None)], "c_custkey long, c_name string, c_nationkey int")
    put("orders", [(1, 7, "F", day, "1-URGENT"), (1, 7, "P", day, "5-LOW"), (2, 8, "F", day, "5-LOW"),
                   (3, None, None, None, "5-LOW"), (4, 7, "O", day, "5-LOW")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string")
    put("part", [(10, "red bolt", "Brand#1"), (11, "hot ring", None)], "p_partkey long, p_name string, p_brand string")
    put("lineitem", [(1, 2, 11, 2.0, 9.0, "N"), (1, 1, 10, 1.0, 900.0, "R"), (1, 2, 10, 4.0, 10.0, "N"),
                     (1, None, 99, 1.0, None, "N"), (3, 1, None, 1.0, 5.0, "N"), (2, 1, 11, 3.0, 37.5, "N"), (None, 1, 10, 1.0, 1.0, "N")],
        "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string")
    return str(path)


def test_order_docs_of_odd_rows(spark, tmp_path):
    from retenza.sources import fixtures as X

    docs = X.orders_docs(spark, _order_tables(spark, tmp_path)).collect()
    assert sorted(d["_id"] for d in docs) == ["1", "1", "2", "3", "4"]
    by = {d["_id"]: d for d in docs}
    ids = [["99", "10", "10", "11"]] * 2                # a null position first, ties by product id
    assert [[p["_id"] for p in d["products"]] for d in docs if d["_id"] == "1"] == ids
    assert by["4"]["products"] == [] and by["3"]["products"][0]["code"] is None
    assert by["2"]["products"][0].asDict(True) == {
        "_id": "11", "name": "hot ring", "description": None, "brand": None, "code": "P11", "amount": 3,
        "price": {"amount": 12.5, "currency": X.CURRENCY}}
    assert sorted(len(d["status_history"]) for d in docs if d["_id"] == "1") == [2, len(X.HOME_STEPS)]
    assert [h["status"] for h in by["2"]["status_history"]] == X.BOPIS_STEPS
    assert {h["timestamp"] for h in by["3"]["status_history"]} == {None} and len(by["3"]["status_history"]) == len(X.HOME_STEPS)
    s = {r["id"]: r for r in CM.order_summary(X.orders_docs(spark, str(tmp_path))).collect()}
    assert s["4"]["status_date"] == "Feb 6, 1998 at 12:00:00 AM" and s["3"]["status_date"] is None
    assert s["2"]["products"][0]["price"] == "$12.5"


def test_order_docs_shuffle_flat_rows(spark, tmp_path):
    """Lines and orders are shuffled as read: no gathered buffers, histories or documents."""
    from retenza.sources import fixtures as X

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CM.order_summary(X.orders_docs(spark, _order_tables(spark, tmp_path)))._jdf.queryExecution().executedPlan()
        todo, carried = [plan], []
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
                continue
            if node.nodeName() == "Exchange":
                carried.append(node.schema().simpleString())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(carried) == 2
    assert not [c for c in carried if "array<" in c or "binary" in c or c.count("struct<") > 1], carried
