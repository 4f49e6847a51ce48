"""Items that share keys, against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G


def sample(keys):
    r = random.Random(3)
    rows = [(f"i{r.randrange(60)}", f"k{r.randrange(keys)}") for _ in range(600)]
    return rows + rows[:50] + [("bare", None), (None, "k1"), ("i1", None), ("lone", "only"), ("twin", "k1"), ("Twin", "k1"), ("tWin", "k1"), ("é", "k1"), ("twIn", "k1")]


@pytest.mark.parametrize("keys", [20, 61, 200])
def test_shared_keys_by_all_pairs(spark, keys, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    rows = sample(keys)
    df = spark.createDataFrame(rows, "item string, key string")
    of = {}
    for i, k in rows:
        if i is not None:
            of.setdefault(i, set()).add(k)
    shared = {(a, b): len((of[a] & of[b]) - {None}) for a in of for b in of if a != b}
    edges = {(a, b): (n, n / (len(of[a]) + len(of[b]) - n)) for (a, b), n in shared.items() if a < b and n}
    assert {(x["a"], x["b"]): (x["shared"], x["weight"]) for x in G.jaccard_edges(df, "item", "key").collect()} == edges
    want = []
    for a in of:
        near = sorted((-n, b) for (x, b), n in shared.items() if x == a and n)
        want += [(a, b, -n) for n, b in near[:3]]
    assert sorted(map(tuple, G.most_shared(df, "item", "key", 3).collect())) == sorted(want)


def test_many_items_with_few_keys(spark):
    """Six thousand items that share twenty keys: 18 million pairs, of which the nearest keep no more than their sets."""
    df = spark.range(6000 * 12).selectExpr("'i' || id % 6000 AS item", "'k' || (id % 6000 * 7 + id div 6000 * (id % 6000 % 19 + 1)) % 20 AS key")
    near = Counter(x["a"] for x in G.most_shared(df, "item", "key", 3).collect())
    assert len(near) == 6000 and set(near.values()) == {3}
    plan = G.jaccard_edges(df, "item", "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and plan.count("Join") == 1  # pairs are made once, and neither dealt nor grouped


def test_items_meet_in_blocks(spark, monkeypatch):
    """Two thousand items in blocks of about a hundred: every pair is met once, and no task has all items, as it had by a broadcast."""
    monkeypatch.setattr(G, "BLOCK", 100)
    df = spark.range(2000 * 3).selectExpr("'i' || id % 2000 AS item", "'k' || (id % 2000 + id div 2000 * (id % 2000 % 7 + 1)) % 20 AS key")
    keys = {}
    for x in df.collect():
        keys[x["item"]] = keys.get(x["item"], 0) | 1 << int(x["key"][1:])
    names = sorted(keys)
    bits = np.array([keys[x] for x in names])
    shared = np.triu(np.bitwise_count(bits[:, None] & bits), 1).astype(int)
    edges = G.jaccard_edges(df, "item", "key")
    got = {x["a"]: (x["n"], x["shared"]) for x in edges.groupBy("a").agg(F.count("*").alias("n"), F.sum("shared").alias("shared")).collect()}
    assert got == {x: (int((row > 0).sum()), int(row.sum())) for x, row in zip(names, shared) if row.any()}
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    most = edges.groupBy(F.spark_partition_id()).agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"), F.count("*").alias("n")).agg(F.max(F.least("a", "b")), F.max("n")).first()
    assert most[0] < 1500 and most[1] < (shared > 0).sum() / 20


def nodes(plan):
    """A plan's nodes as they ran; what a plan uses again comes once."""
    name = plan.getClass().getSimpleName()
    if name == "ReusedExchangeExec":
        return
    yield name, plan
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))


@pytest.mark.parametrize("few, many, tasks", [(16, 1000, 10_000), (16, 64, 20), (1000, 1000, 1000)])
def test_dealt_rows_grow_with_items(spark, monkeypatch, few, many, tasks):
    """Six hundred items in small blocks: every pair once, and no more rows dealt than items, where each item was dealt to all blocks."""
    for name, value in {"BLOCK": 16, "FEW": few, "MANY": many, "TASKS": tasks}.items():
        monkeypatch.setattr(G, name, value, raising=False)
    df = spark.range(600 * 5).selectExpr("'i' || id % 600 AS item", "'k' || (id % 600 % 40 + id div 600 * (id % 600 % 7 + 1)) % 20 AS key")
    keys = {}
    for x in df.collect():
        keys.setdefault(x["item"], set()).add(x["key"])
    want = sorted((a, b, len(keys[a] & keys[b]), len(keys[a] & keys[b]) / len(keys[a] | keys[b])) for a in keys for b in keys if a < b and keys[a] & keys[b])
    edges = G.jaccard_edges(df, "item", "key")
    assert sorted(map(tuple, edges.collect())) == want
    dealt = [x.metrics().apply("shuffleRecordsWritten").value() for name, x in nodes(edges._jdf.queryExecution().executedPlan()) if name == "ShuffleExchangeExec"]
    assert dealt and 0 < sum(dealt) <= 600


def test_written_pairs_are_small(spark, tmp_path):
    """Items of twenty sets: rows of an item and of equal sets follow each other, so a pair takes less than a byte; it took over two."""
    df = spark.range(2000 * 5).selectExpr("'item-' || id % 2000 AS item", "'k' || (id % 2000 % 20 + id div 2000 * (id % 2000 % 20 % 7 + 1)) % 20 AS key")
    edges = G.jaccard_edges(df, "item", "key")
    edges.write.parquet(f"{tmp_path}/edges")
    rows = spark.read.parquet(f"{tmp_path}/edges").count()
    assert rows > 1_000_000 and sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < rows
