"""The graph store's merges and the fleet's log."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from tessera.operators.graph import shared_folder
from tessera.sources.fleet import fleet_outcomes, ingest_fleet
from tessera.sources.graph_store import ROW, GraphStore, document_key


def fresh(spark):
    return f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}"


def content(store, collection=None):
    return sorted(map(tuple, store.read(collection).collect()))


def test_merges_by_key(spark):
    r = random.Random(2)
    batches = [[(r.choice("ab"), f"k{r.randrange(40)}", r.randrange(6), f"d{r.randrange(9)}") for _ in range(60)] for _ in range(4)]
    batches.append([("a", None, 1, "x"), ("a", "k1", 0, "older")])
    want = {}
    store = GraphStore(spark, fresh(spark), buckets=4)
    assert content(store) == []
    for b in batches:
        for c, k, seq, doc in b:
            if k is not None:
                want[c, k] = max(want.get((c, k), (-1, "")), (seq, doc))
        store.merge(spark.createDataFrame(b, ROW))
        store.merge(spark.createDataFrame(b[:20], ROW))
    rows = sorted((*k, *v) for k, v in want.items())
    assert content(store) == rows and content(store, "a") == [x for x in rows if x[0] == "a"]
    # any order of the same batches gives the same store
    other = GraphStore(spark, fresh(spark), buckets=4)
    for b in reversed(batches):
        other.merge(spark.createDataFrame(b, ROW))
    assert content(other) == rows
    other.merge(spark.createDataFrame([], ROW))
    assert content(other) == rows


def test_only_touched_buckets_are_written(spark):
    store = GraphStore(spark, fresh(spark), buckets=8)
    store.merge(spark.createDataFrame([("a", f"k{i}", 0, "x") for i in range(100)] + [("b", "k", 0, "x")], ROW))
    files = lambda: set(spark.read.parquet(store.rows_at).inputFiles())
    before = files()
    store.merge(spark.createDataFrame([("a", "k1", 1, "y")], ROW))
    assert len(before - files()) == 1 and len(files()) == len(before)


def test_a_merge_that_was_cut_off_is_finished(spark):
    store = GraphStore(spark, fresh(spark), buckets=2)
    store.merge(spark.createDataFrame([("a", "k1", 0, "x"), ("a", "k2", 0, "x")], ROW))
    # all rows lie aside, but a bucket was removed and never replaced
    merged = store._placed(spark.createDataFrame([("a", "k1", 1, "y"), ("a", "k2", 1, "y")], ROW))
    merged.write.parquet(store.aside)
    at, fs = store._file(f"{store.rows_at}/collection=a")
    fs.delete(at, True)
    store.merge(spark.createDataFrame([("a", "k3", 0, "z")], ROW))
    assert content(store) == [("a", "k1", 1, "y"), ("a", "k2", 1, "y"), ("a", "k3", 0, "z")]
    # rows aside that weren't written to their end don't count
    spark.createDataFrame([("a", "k9", 1, "no", 0)], ROW + ", bucket int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(store.aside)
    store.merge(spark.createDataFrame([], ROW))
    assert "k9" not in {x[1] for x in content(store)}


def test_a_batch_that_comes_again_is_not_written(spark):
    store = GraphStore(spark, fresh(spark), buckets=4)
    first = spark.createDataFrame([("a", f"k{i}", 0, "x") for i in range(50)], ROW)
    store.merge(first)
    store.merge(spark.createDataFrame([("a", "k1", 1, "y"), ("a", "k1", 1, "y")], ROW))
    files = lambda: set(spark.read.parquet(store.rows_at).inputFiles())
    before = files()
    store.merge(first)
    assert files() == before and ("a", "k1", 1, "y") in content(store) and len(content(store)) == 50
    # other rows of a known number are merged
    store.merge(spark.createDataFrame([("a", f"k{i}", 0, "z") for i in range(50)], ROW))
    assert {x[3] for x in content(store)} == {"y", "z"}


def test_buckets_aside_are_finished(spark):
    """A merge that was cut off between two buckets' renames."""
    store = GraphStore(spark, fresh(spark), buckets=2)
    store.merge(spark.createDataFrame([("a", f"k{i}", 0, "x") for i in range(20)], ROW))
    store._placed(spark.createDataFrame([("a", f"k{i}", 1, "y") for i in range(20)], ROW)).write.partitionBy("collection", "bucket").parquet(store.aside)
    at, fs = store._file(f"{store.rows_at}/collection=a/bucket=1")
    fs.delete(at, True)
    store.merge(spark.createDataFrame([], ROW))
    assert content(store) == sorted(("a", f"k{i}", 1, "y") for i in range(20))


def test_document_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("a", "a")], "x string, y string")
    keys = [r[0] for r in df.select(document_key(F.lit("p"), "x", "y")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and all(k.startswith("p_") for k in keys)


LINES = [
    '{"pattern":"p1","repo":"r","file":"f","outcome":"success","bot":"other","timestamp":"2024-01-01T00:00:00"}',
    '{"pattern":"p1","repo":"r","file":"f","outcome":"success","bot":"other","timestamp":"2024-01-01T00:00:00"}',
    '{"pattern":"p2","outcome":"odd","timestamp":"2024-01-01T00:00:01"}',
    '{"pattern":"p3","bot":"self","outcome":"success"}',
    '{"outcome":"false_positive","bot":"x"}',
    "{}",
    "[1]",
    "7",
    "",
    "{broken",
]
WANT = [("p1", "r", "f", "success", "other"), ("p2", "unknown", "unknown", "failure", None), ("unknown", "unknown", "unknown", "failure", None), ("unknown", "unknown", "unknown", "false_positive", "x")]


def test_fleet_records(spark):
    lines = spark.createDataFrame([(x,) for x in [*LINES, None]], "value string")
    got = [tuple(r)[:5] for r in fleet_outcomes(lines, "self").collect()]
    assert sorted(got, key=repr) == sorted(WANT, key=repr)


def test_fleet_calls_add_nothing_twice(spark):
    log, mark, sink = (fresh(spark) for _ in range(3))
    counts = []
    for k, part in enumerate((LINES[:4], LINES, [])):
        if part:
            spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.text(f"{log}/{k}")
        ingest_fleet(spark, log, "self", mark, sink, "1 day")
        counts.append(spark.read.parquet(sink).count())
    assert counts == [2, 4, 4]
