"""Events in overlapping windows against all pairs, and stores by name."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from tessera.operators.intervals import covering, window_totals
from tessera.sources import stores


def test_covering_by_all_pairs(spark):
    r = random.Random(1)
    events = [(k, r.randrange(-500, 3000)) for k in range(400)] + [(400, None)]
    windows = [(s := r.randrange(-300, 2500), s + r.choice([0, 1, 7, 300, 900]), f"w{k}") for k in range(30)] + [(10, None, "open"), (50, 40, "back")]
    for width in (1, 100, 10_000):
        got = covering(spark.createDataFrame(events, "id long, at long"), spark.createDataFrame(windows, "start long, end long, strategy string"), width)
        want = []
        for i, at in events:
            names = [n for s, e, n in windows if at is not None and e is not None and s <= at < e]
            want += [(i, n) for n in names or ["unknown"]]
        assert sorted((x["id"], x["strategy"]) for x in got.collect()) == sorted(want)


def test_totals_by_all_pairs(spark):
    r = random.Random(2)
    events = [(r.randrange(-500, 3000), r.choice(["a", "b", "c", None]), r.random() < 0.5) for _ in range(300)] + [(None, "z", True)]
    windows = [(s := r.randrange(-600, 2500), s + r.choice([0, 1, 7, 300, 900]), f"w{k % 25}") for k in range(30)] + [(10, None, "open"), (50, 40, "back"), (0, 20, None), (8000, 8100, "empty")]
    by = {}
    for at, item, good in events:
        for n in [n for s, e, n in windows if at is not None and e is not None and s <= at < e] or [None]:
            by.setdefault(n or "unknown", []).append((item, good))
    want = sorted((n, len(x), sum(g for _, g in x), len({i for i, _ in x if i})) for n, x in by.items())
    e, w = spark.createDataFrame(events, "at long, item string, good boolean"), spark.createDataFrame(windows, "start long, end long, strategy string")
    for width in (1, 100, 10_000):
        assert sorted(map(tuple, window_totals(e, w, width, {"good": F.col("good")}).collect())) == want


def test_totals_make_no_pairs(spark):
    """Twenty thousand windows over as many events: 150 million pairs, which a join would make."""
    n, long = 20_000, 10_000
    e = spark.range(n).selectExpr("id AS at", "'a' AS item")
    w = spark.range(n).selectExpr("id AS start", f"id + {long} AS end", "'w' || id AS strategy")
    got = window_totals(e, w, 100_000, {}).collect()
    assert len(got) == n and sum(x["total"] for x in got) == sum(min(long, n - k) for k in range(n)) and {x["items"] for x in got} == {1}


def test_unknown_store(spark):
    known = {"a": spark.range(1), "b": spark.range(2)}
    assert stores.dispatch(known, "b").count() == 2
    with pytest.raises(KeyError, match="unknown store 'c'; there are a, b"):
        stores.dispatch(known, "c")
