"""The keyed table: bounded writes, ordered versions, replays, crashes."""

from __future__ import annotations

import os
import random

import pytest

from retenza.sources import keyed as K

SCORES = "uid string, p double, tier string"


def table_of(df):
    return {r["uid"]: (r["p"], r["tier"]) for r in df.collect()}


def data_bytes(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path + "/data")
            for f in names if f.endswith(".parquet")}


@pytest.fixture
def scores(spark, tmp_path):
    return K.KeyedTable(spark, str(tmp_path / "scores"), "uid", buckets=32)


def rows(n, p=0.1):
    return [(f"u{i}", p, "Low") for i in range(n)]


def test_merges_equal_a_dictionary(spark, scores):
    rng, want = random.Random(1), {}
    for step in range(5):
        batch = [(f"u{rng.randrange(60)}", round(rng.random(), 3), rng.choice(["Low", None])) for _ in range(25)]
        batch = list({r[0]: r for r in batch}.values())
        how = ("upsert", "update", "insert")[step % 3]
        for u, p, t in batch:
            if how == "upsert" or (how == "update") == (u in want):
                want[u] = (p, t)
        assert scores.merge(spark.createDataFrame([*batch, (None, 1.0, "x")], SCORES), how) == step
        assert table_of(scores.read()) == want
    assert table_of(scores.lookup("u1", "u2", "none")) == {u: want[u] for u in ("u1", "u2") if u in want}


def test_a_batch_writes_only_its_buckets(spark, scores):
    scores.merge(spark.createDataFrame(rows(20_000), SCORES))
    before = data_bytes(scores.path)
    scores.merge(spark.createDataFrame([("u7", 0.9, "High")], SCORES))
    new = {f: n for f, n in data_bytes(scores.path).items() if f not in before}
    assert sum(new.values()) < 0.1 * sum(before.values())
    manifest = scores.manifest()
    assert len(set(manifest["files"].values())) == 2 and scores.read().count() == 20_000
    plan = scores.lookup("u7")._jdf.queryExecution().toString()
    assert table_of(scores.lookup("u7")) == {"u7": (0.9, "High")} and "1 paths" in plan


def test_columns_and_types_of_a_batch(spark, scores):
    """A batch may lack columns, add some, and have narrower types."""
    scores.merge(spark.createDataFrame(rows(50), SCORES))
    scores.merge(spark.createDataFrame([("u1", 1, "x")], "uid string, p int, more string"))
    got = {r["uid"]: tuple(r) for r in scores.read().select("uid", "p", "tier", "more").collect()}
    assert got["u1"] == ("u1", 1.0, "Low", "x") and got["u2"] == ("u2", 0.1, "Low", None) and len(got) == 50


def test_streams_replays_and_new_checkpoints(spark, scores):
    """A replay changes nothing; the first batch of another stream comes after all versions."""
    for i in range(4):
        scores.merge(spark.createDataFrame([("a", i / 10, "Low")], SCORES), stream="one", batch_id=i)
    assert scores.merge(spark.createDataFrame([("a", 0.0, "Low")], SCORES), stream="one", batch_id=0) == 3
    assert table_of(scores.read()) == {"a": (0.3, "Low")}
    assert scores.merge(spark.createDataFrame([("a", 0.9, "High")], SCORES), stream="two", batch_id=0) == 4
    assert table_of(scores.read()) == {"a": (0.9, "High")}
    assert scores.versions() == [3, 4] and table_of(scores.read(3)) == {"a": (0.3, "Low")}
    kept = {f.split("/data/")[1].split("/")[0] for f in data_bytes(scores.path)}
    assert kept == {"one-3-0", "two-0-0"}


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, scores, monkeypatch):
    scores.merge(spark.createDataFrame(rows(5), SCORES), stream="s", batch_id=0)

    def dies(*a):
        raise OSError("lost")
    monkeypatch.setattr(scores, "_commit", dies)
    with pytest.raises(OSError):
        scores.merge(spark.createDataFrame([("u1", 0.9, "High"), ("v", 0.5, "Low")], SCORES), stream="s", batch_id=1)
    monkeypatch.undo()
    assert table_of(scores.read()) == table_of(spark.createDataFrame(rows(5), SCORES))
    again = K.KeyedTable(spark, scores.path, "uid")               # a new process replays the batch
    again.merge(spark.createDataFrame([("u1", 0.9, "High"), ("v", 0.5, "Low")], SCORES), stream="s", batch_id=1)
    assert table_of(again.read())["u1"] == (0.9, "High") and again.read().count() == 6
    assert not os.listdir(scores.path + "/staging")


def test_two_writers_do_not_lose_rows(spark, scores, monkeypatch):
    """A second writer commits between the first one's write and its commit."""
    scores.merge(spark.createDataFrame(rows(3), SCORES))
    real, other = K.KeyedTable._commit, K.KeyedTable(spark, scores.path, "uid")

    def late(self, made):
        monkeypatch.setattr(K.KeyedTable, "_commit", real)
        other.merge(spark.createDataFrame([("x", 0.7, "High"), ("u0", 0.7, "High")], SCORES))
        return real(self, made)
    monkeypatch.setattr(K.KeyedTable, "_commit", late)
    assert scores.merge(spark.createDataFrame([("u0", 0.2, "Low"), ("y", 0.2, "Low")], SCORES)) == 2
    assert table_of(scores.read()) == {"u0": (0.2, "Low"), "u1": (0.1, "Low"), "u2": (0.1, "Low"), "x": (0.7, "High"),
                                       "y": (0.2, "Low")}


def test_latest_rebucket_and_nothing(spark, scores):
    assert scores.read() is None and scores.manifest() is None and scores.lookup("a") is None
    feed = "uid string, v int, x string"
    scores.merge(spark.createDataFrame([], feed), "latest", "v")
    assert scores.read().count() == 0
    scores.merge(spark.createDataFrame([("a", 1, "p"), ("b", 5, "q"), ("a", 0, "o")], feed), "latest", "v")
    scores.merge(spark.createDataFrame([("a", 3, "r"), ("b", 4, "s")], feed), "latest", "v")
    want = [("a", 3, "r"), ("b", 5, "q")]
    assert sorted(map(tuple, scores.read().collect())) == want
    scores.rebucket(3)
    assert sorted(map(tuple, scores.read().collect())) == want and scores.manifest()["buckets"] == 3
    scores.merge(spark.createDataFrame([("c", 1, "t")], feed), "latest", "v")
    assert scores.read().count() == 3
    with pytest.raises(ValueError):
        scores.merge(spark.createDataFrame([], feed), "replace")


def test_a_checkpoint_used_again_is_another_stream(spark, tmp_path):
    ck = tmp_path / "ck"
    ck.mkdir()
    plain = K.stream_name(spark, str(ck))
    names = {plain}
    for i in ("aaaaaaaa-1", "bbbbbbbb-2"):
        (ck / "metadata").write_text('{"id":"%s"}' % i)
        names.add(K.stream_name(spark, str(ck)))
    assert len(names) == 3 and all(n.startswith(plain) for n in names)
