"""Shared Spark session and event builders for the tests."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retenza.schemas import EVENTS  # noqa: E402
from retenza.session import get_spark  # noqa: E402

BASE = dt.datetime(2026, 4, 21, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", shuffle_partitions=4)
    yield s


def ev(eid, secs, event, uid="user-1", sid="sess-1", pid=None, at=None, sc=None, brand=None,
       query=None, items=None, exit_method=None, base=BASE):
    """One event row in the EVENTS schema (timestamps are UTC)."""
    ts = base + dt.timedelta(seconds=secs)
    return (eid, (uid, sid, event), ts, (pid, at, sc, brand, query, items, exit_method))


def events_df(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def seven_events():
    """The reference's shape-test session: three 10 s windows."""
    return [
        ev(1, 0, "heartbeat"),
        ev(2, 3, "search", pid="p1", at="Shoes", sc="Footwear", brand="b", query="running shoes"),
        ev(3, 8, "view-product", pid="p1", at="Shoes", sc="Footwear", brand="b"),
        ev(4, 12, "heartbeat"),
        ev(5, 15, "view-product", pid="p2", at="Shoes", sc="Footwear", brand="b"),
        ev(6, 22, "add-to-cart", pid="p1", at="Shoes", sc="Footwear", brand="b"),
        ev(7, 28, "exit-risk", exit_method="logout-hover"),
    ]
