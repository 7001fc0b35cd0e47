"""Documents with everything the contracts call an edge case."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = ("id", "th", "row", "n", "part", "pos", "key", "host", "b", "kept", "fp", "label", "class_id", "body",
           "shard", "slot", "curve", "size", "text_crc32", "held_out", "drop", "lines", "_th", "anchors", "items")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    base = words(rng, 300)
    near = [*base[:40], "changed", *base[41:200], *base[202:]]
    line = "The Same  boilerplate line."
    long = " ".join(words(rng, 30_000))
    rows = [(i, " ".join(words(rng, 60)) + f"\n {line}\t\n" + " ".join(words(rng, 30)), "en", "a", 1)
            for i in range(100, 126)]
    rows += [(1, " ".join(base), "en", "a", 5), (2, " ".join(near), "de", "a", 5), (3, " ".join(base), None, "b", 5),
             (3, " ".join(base), None, "b", 5), (4, None, "en", "a", None), (5, "", "fr", None, 0),
             (6, " \t\n\r\x0b\x0c ", None, None, 7), (None, " ".join(base), "en", "a", 1), (None, None, None, None, None),
             (7, long, "en", "c", len(long)), (8, "one two three four five six seven eight\n" * 12, "en", "a", 9),
             (9, "É ß x y 日本語 😀 foo<|endoftext|>bar. #*$%&|<>", "en", "a", 3), (10, "word", "en", "a", 4),
             (11, "Word!", "en", "a", 4), (12, " ".join([*words(rng, 50), *base[50:120], *words(rng, 50)]), "en", "c", 9),
             (13, "\n\nx\n\n" + line.upper() + "\n", "en", "a", 2), (-5, " ".join(base[:12]), "en", "a", 2),
             (14, "a a a a a a a a a a a a a a a a", "en", "d", 2), (15, "12 34 !? ..", "en", "d", 2)]
    return rows


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, parts: int = 5):
        return spark.createDataFrame(rows, DOCUMENTS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def edge(docs_of):
    return docs_of(edge_rows()).cache()


@pytest.fixture(scope="session")
def clashing(spark, edge):
    """The edge rows with further columns of inner names."""
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "4")
    yield
    spark.conf.set(key, old)


def rows_of(df, *names):
    """Rows as a sorted list of tuples, nulls first."""
    got = [tuple(r) for r in df.select(*names).collect()]
    return sorted(got, key=lambda r: [(x is not None, x) if not isinstance(x, (list, tuple)) else (True, str(x))
                                      for x in r])


@pytest.fixture(scope="session")
def rows():
    return rows_of
