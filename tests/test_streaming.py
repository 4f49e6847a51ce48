"""Streams against their batch twins on the same rows, whole rows, brought in any order."""

from __future__ import annotations

import datetime
import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates
from tessera.operators.chains import greedy, nearest
from tessera.operators.graph import written
from tessera.plans import gates as gate_plans
from tessera.plans import watch as watch_plans
from tessera.sources import views
from tessera.streaming import machines as M
from tessera.streaming import watch
from tessera.streaming import windows as S


LATER = 10**9


@pytest.fixture(scope="module")
def feed(spark, sf):
    """Events in four files in order of time, each shuffled within; and late ones that move the watermark past all others."""
    folder = tempfile.mkdtemp(prefix="spark-")
    e = views.table(spark, sf, "events")
    cut = e.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    for k, (a, b) in enumerate(zip([-1, *cut], [*cut, 1e18], strict=True)):
        e.where((F.col("event_id") > a) & (F.col("event_id") <= b)).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    # of every type, as each branch of a query has a watermark of its own
    end = e.dropDuplicates(["event_type"]).withColumns({"event_id": F.lit(LATER) + F.xxhash64("event_type") % 1000, "user_id": F.lit(10**6).cast(e.schema["user_id"].dataType), "ts": F.lit(datetime.datetime(2124, 1, 1)).cast(e.schema["ts"].dataType)})
    end.coalesce(1).write.parquet(f"{folder}/9")
    yield e.schema, folder
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set(*M.STORE)
    yield
    spark.conf.unset(M.STORE[0])


def run(spark, feed, transform, name, mode="append"):
    schema, folder = feed
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def rows(df, *names):
    return sorted(map(tuple, df.select(*(names or sorted(df.columns))).collect()), key=repr)


def outcomes(events):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "false_positive").otherwise("success")
    return events.select("event_id", "ts", F.concat(F.lit("recipe-"), F.get_json_object("props", "$.k").cast("long") % 20).alias("recipe_id"), F.concat(F.lit("bot-"), F.col("event_id") % 5).alias("bot"), kind.alias("outcome"))


@pytest.fixture(scope="module")
def events(spark, sf):
    return views.table(spark, sf, "events")


def test_counts(spark, feed, events):
    got = run(spark, feed, lambda s: S.tumbling_counts(s.where(f"event_id < {LATER - 1000}"), "1 hour", "60 days"), "counts", "complete")
    assert rows(got) == rows(S.tumbling_counts(events, "1 hour"))


def test_streaks(spark, feed, events):
    got = run(spark, feed, lambda s: S.failure_streaks_stream(outcomes(s)), "streaks").where(f"event_id < {LATER - 1000}")
    want = S.failure_streaks(outcomes(events))
    assert rows(got) == rows(want.select(got.columns)) and want.count() == events.count()


def test_annealing(spark, feed, events):
    got = run(spark, feed, lambda s: S.annealing_stream(outcomes(s)), "heat").where(f"event_id < {LATER - 1000}")
    near = lambda df: rows(df.withColumn("temperature", F.round("temperature", 9)))
    assert near(got) == near(S.annealing(outcomes(events)).select(got.columns))


def test_gate(spark, feed, events):
    known = gate_plans.directives(events)
    got = run(spark, feed, lambda s: gates.review(gate_plans.messages(s), known), "gate").where(f"id < {LATER - 1000}")
    want = gates.review(gate_plans.messages(events), known)
    assert rows(got) == rows(want) and want.count() == events.count()
    assert {r[0] for r in want.select("verdict").distinct().collect()} >= {"approve", "defer", "hold-confidence", "hold-stale", "reject-conflict", "released"}


def test_alerts(spark, feed, events):
    """All rules, told once or always, and alerts of peers: stream and table row by row."""
    got = run(spark, feed, lambda s: watch.alerts(watch_plans.telemetry(s)), "alerts").where(f"id < {LATER - 1000}")
    want = watch.alerts(watch_plans.telemetry(events), written)
    assert rows(got) == rows(want.select(got.columns))
    ruled = watch.ruled(watch_plans.telemetry(events))
    assert want.where("peer IS NULL AND rule <> 'events_dropped'").count() < ruled.where("peer IS NULL").count()
    assert rows(want.where("peer IS NOT NULL").select("id")) == rows(ruled.where("peer IS NOT NULL").select("id"))
    assert watch.ring(want).where("place > 100").isEmpty()


def test_rolling_anomaly(spark, feed, events):
    """Timers on a stream, a walk over a table, and windows with a chain all find the same minutes."""
    names = ("key", "at", "recent", "baseline", "sigma")
    near = lambda df: rows(df.select("key", "at", *[F.round(c, 9) for c in names[2:]]))
    walked = near(watch.anomalies_walked(watch_plans.watched(events)))
    assert walked and walked == near(watch.rolling_anomalies(watch_plans.watched(events), written))
    got = run(spark, feed, lambda s: watch.rolling_anomalies(watch_plans.watched(s)), "anomalies")
    assert near(got) == walked


def test_state_that_is_not_needed_leaves(spark):
    """After its silence a key has no state, and an alert after it is told."""
    once, state = watch.Once(), {}
    state = once.start()
    event = dict.fromkeys(once.inputs, "x")
    told = [at for at in (0, 299, 300, 599, 600, 5000) if once.step(state, at * watch.SECOND, at, event)]
    assert told == [0, 300, 600, 5000]


def random_events(seed, n, keys, span):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", r.randrange(span), i) for i in range(n)]


@pytest.mark.parametrize("keys, span, width", [(1, 400, 7), (3, 5000, 50), (5, 100, 1000)])
def test_nearest(spark, keys, span, width):
    a, b = random_events(1, 200, keys, span), random_events(2, 150, keys, span)
    b = b + [x for x in a[:40]]
    probes = spark.createDataFrame([(*x, f"p{x[2]}") for x in a], "key string, at long, id long, load string")
    points = spark.createDataFrame([(*x, x[1] * 10) for x in b], "key string, at long, id long, load long")
    for ahead in (False, True):
        for equal in (False, True):
            got = {r["id"]: (r["load"], tuple(r["point"]) if r["point"] else None) for r in nearest(probes, points, ["key"], width, ahead, equal).collect()}
            assert len(got) == len(a)
            for key, at, i in a:
                there = [(t, j, t * 10) for k, t, j in b if k == key and (((t, j) >= (at, i)) if ahead else ((t, j) <= (at, i))) and (equal or (t, j) != (at, i))]
                assert got[i] == (f"p{i}", (min if ahead else max)(there) if there else None)


@pytest.mark.parametrize("n, keys, span", [(300, 2, 2000), (400, 1, 400), (50, 4, 9), (0, 1, 5)])
def test_greedy_chain(spark, n, keys, span):
    rows_ = random_events(n, n, keys, span)
    df = spark.createDataFrame(rows_, "key string, at long, id long")
    got = sorted(r["id"] for r in greedy(df, ["key"], F.col("at") + 20, written, 20).collect())
    want, last = [], {}
    for key, at, i in sorted(rows_, key=lambda x: (x[1], x[2])):
        if key not in last or at >= last[key] + 20:
            last[key] = at
            want.append(i)
    assert got == sorted(want)


def test_leases_by_replay(spark):
    r = random.Random(4)
    reqs = [(f"r{r.randrange(3)}", f"h{r.randrange(3)}", r.randrange(60_000), i, r.random() < 0.1) for i in range(400)]
    reqs += [("r0", "h0", 70_000, 500, False), ("r0", "h1", 70_000, 501, False), ("r0", "h0", 73_600, 502, False), ("r9", "h0", 5, 503, True)]
    df = spark.createDataFrame(reqs, "repo string, holder string, at long, id long, refused boolean")
    got = {x["id"]: (x["answer"], x["lease"]) for x in gates.lease_answers(df, written).collect()}
    held, want = {}, {}
    for repo, holder, at, i, refused in sorted(reqs, key=lambda x: (x[2], x[3])):
        owner, until, lease = held.get(repo, (None, -1, None))
        if refused:
            want[i] = ("refused", None)
        elif until > at and owner == holder:
            held[repo] = (owner, at + 3600, lease)
            want[i] = ("renewed", lease)
        elif until > at:
            want[i] = ("conflict", lease)
        else:
            held[repo] = (holder, at + 3600, i)
            want[i] = ("minted", i)
    assert got == want and {a for a, _ in got.values()} == {"minted", "renewed", "conflict", "refused"}


def test_merge_slot(spark):
    """The first armed one of a cycle that gets the lease; refused ones don't use the slot up."""
    pulls = [("a", "c", 1, 1, "arm_auto", True), ("a", "c", 2, 1, "arm_auto", False), ("a", "c", 3, 2, "arm_auto", False), ("a", "c", 4, 2, "arm_auto", True), ("a", "c", 5, 0, "review", False), ("b", "c", 6, 0, "arm_auto", False), ("b", "d", 7, 0, "arm_auto", False)]
    df = spark.createDataFrame(pulls, "repo string, cycle string, pr long, ts long, safety string, meta boolean")
    leases = spark.createDataFrame([("b", "c", "farm")], "repo string, cycle string, lease_holder string")
    got = {r["pr"]: (r["gate"], r["entry"], r["reason"]) for r in gates.merge_plan(df, leases).collect()}
    late, armed = ("deferred", "flag", "same-repo-this-cycle"), ("armed", "arm_auto", None)
    assert got == {1: ("blocked", "flag", "gate-refused:meta:owner-unauthorized"), 2: armed, 3: late, 4: late, 5: ("no_gate", "review", None), 6: ("deferred", "flag", "lease-held:farm"), 7: armed}
