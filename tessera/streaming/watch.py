"""Alert rules of watchers and the rolling anomaly of outcomes, on tables and on streams.

A watcher's telemetry is (watcher, ts, at, id, name, subject, detail, concurs, depth, dropped, recent, baseline, sigma,
peer, rule, severity, summary); at is in microseconds, and name one of quarantine, violation, anomaly, snapshot and
federated.  Quarantines, anomalies and deep queues are told once in five minutes by subject; violations and dropped
events always.  An alert of a peer is kept with the peer's name and never told again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.operators.chains import greedy, nearest
from tessera.streaming.machines import Machine, run_stream, run_table

SECOND = 1_000_000
# Microseconds of silence after an alert, depth of a queue, alerts of a ring
SILENCE, DEEP, RING = 300 * SECOND, 100, 100
# Outcomes of the window, of its recent part, at least for an alert; sigmas; microseconds of a tick
WINDOW, RECENT, LEAST, SIGMAS, TICK = 200, 30, 35, 2.0, 60 * SECOND
ALERT = ("watcher", "at", "id", "rule", "severity", "summary", "peer")
_TOLD = ("watcher", "rule", "severity", "summary", "peer")


def ruled(telemetry: DataFrame) -> DataFrame:
    """Telemetry that a rule turns into an alert, with its key for telling once; the counter of dropped events is not among it."""
    name, detail = F.col("name"), F.col("detail")
    drift = lambda way: F.lit(f"Neural anomaly: ESN reports {way} drift in success-rate forecast")
    measured = F.concat(F.lit("Statistical anomaly: recent rate "), F.format_string("%.2f", "recent"), F.lit(" vs baseline "), F.format_string("%.2f", "baseline"), F.lit(" ("), F.format_string("%.1f", "sigma"), F.lit("σ)"), F.when(F.col("concurs"), " — ESN drift concurs").otherwise(""))
    esn = detail.isin("esn_drift_rising_drift", "esn_drift_falling_drift")
    queue = (name == "snapshot") & (F.col("depth") > DEEP)
    rule = F.when(name == "quarantine", "quarantine_triggered").when(name == "violation", "soundness_violation").when(name == "anomaly", "anomaly_detected").when(queue, "queue_depth_high").when(name == "federated", F.col("rule"))
    severity = F.when(name == "federated", F.col("severity")).when(name == "violation", "critical").when((name == "anomaly") & ~esn & F.col("concurs"), "critical").otherwise("high")
    summary = F.when(name == "quarantine", F.concat(F.lit("Recipe/bot auto-quarantined: "), detail, F.lit("/"), "subject")).when(name == "violation", F.concat(F.lit("Soundness gate violation: "), detail, F.lit("/"), "subject"))
    summary = summary.when(name == "anomaly", F.when(detail == "esn_drift_rising_drift", drift("rising")).when(detail == "esn_drift_falling_drift", drift("falling")).otherwise(measured))
    summary = summary.when(queue, F.concat(F.lit("GenServer queue depth "), "depth", F.lit(f" > {DEEP} for "), "subject")).otherwise(F.col("summary"))
    once = F.when(name == "quarantine", F.concat_ws(":", F.lit("quarantine"), detail, "subject")).when(name == "anomaly", F.concat_ws(":", F.lit("anomaly"), detail)).when(queue, F.concat_ws(":", F.lit("queue_depth"), "subject"))
    out = telemetry.withColumns({"rule": rule, "severity": severity, "summary": summary, "key": F.concat_ws("|", "watcher", once)})
    return out.withColumn("once", once.isNotNull()).where("rule IS NOT NULL").select("key", "once", "ts", *ALERT)


class Once(Machine):
    """Alerts of one key, unless one was told less than five minutes before."""

    inputs = _TOLD
    outputs = T.StructType([T.StructField(c, T.StringType()) for c in _TOLD])
    keeps = SILENCE

    def start(self) -> dict:
        return {"told": None}

    def step(self, state: dict, at: int, ident: int, event: dict) -> tuple | None:
        if state["told"] is not None and at - state["told"] < SILENCE:
            return None
        state["told"] = at
        return tuple(event[c] for c in self.inputs)


class Drops(Machine):
    """Rises of a watcher's counter of dropped events; a counter that falls starts again from there."""

    inputs = ("dropped",)
    outputs = T.StructType([T.StructField("rise", T.LongType())])

    def start(self) -> dict:
        return {"last": 0}

    def step(self, state: dict, at: int, ident: int, event: dict) -> tuple | None:
        rise, state["last"] = event["dropped"] - state["last"], event["dropped"]
        return (rise,) if rise > 0 else None


def _dropped(rises: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Watcher dropped "), "rise", F.lit(" telemetry event(s) under back-pressure"))
    return rises.select(F.col("key").alias("watcher"), "at", "id", F.lit("events_dropped").alias("rule"), F.lit("medium").alias("severity"), text.alias("summary"), F.lit(None).cast("string").alias("peer"))


def alerts(telemetry: DataFrame, stage=None) -> DataFrame:
    """(watcher, at, id, rule, severity, summary, peer) of all alerts told, and of those that peers told.

    A table finds the ones told once by ``greedy`` chains, which ``stage`` writes; a stream by a timed state for each key.
    """
    found = ruled(telemetry)
    plain = found.where("NOT once").select(*ALERT)
    once = found.where("once")
    counted = telemetry.where("name = 'snapshot'").withColumn("key", F.col("watcher")).select("key", "ts", "at", "id", "dropped")
    if telemetry.isStreaming:
        told, rises = run_stream(once, Once()).select(*ALERT), run_stream(counted, Drops())
    else:
        told = greedy(once.select("key", *ALERT), ["key"], F.col("at") + SILENCE, stage, SILENCE).select(*ALERT)
        points = counted.select("key", "at", "id", "dropped")
        rises = nearest(points, points, ["key"], 16 * SILENCE, equal=False).withColumn("rise", F.col("dropped") - F.coalesce("point.dropped", F.lit(0))).where("rise > 0")
    return plain.unionByName(told).unionByName(_dropped(rises))


def ring(told: DataFrame, size: int = RING) -> DataFrame:
    """The last alerts of each watcher, newest first, as ``place``."""
    newest = Window.partitionBy("watcher").orderBy(F.col("at").desc(), F.col("id").desc(), "rule")
    return told.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= size)


class Anomaly(Machine):
    """A minute's tick after new outcomes compares the last 30 of 200 with those before; told once in five minutes.

    A tick without new outcomes could only repeat the last alert, so there is none.
    """

    inputs = ("good",)
    outputs = T.StructType([T.StructField(c, T.DoubleType()) for c in ("recent", "baseline", "sigma")])

    def start(self) -> dict:
        return {"outcomes": "", "tick": None, "told": None}

    def step(self, state: dict, at: int, ident: int, event: dict) -> None:
        state["outcomes"] = (state["outcomes"] + ("1" if event["good"] else "0"))[-WINDOW:]
        state["tick"] = (at // TICK + 1) * TICK

    def alarm(self, state: dict) -> int | None:
        return state["tick"]

    def ring(self, state: dict, at: int) -> tuple | None:
        state["tick"] = None
        seen = state["outcomes"]
        if len(seen) < LEAST:
            return None
        new, old = seen[-RECENT:], seen[:-RECENT]
        recent, baseline = new.count("1") / len(new), old.count("1") / len(old)
        sigma = (baseline - recent) / math.sqrt(max(baseline * (1 - baseline) / len(old), 0.0001))
        if sigma <= SIGMAS or (state["told"] is not None and at - state["told"] < SILENCE):
            return None
        state["told"] = at
        return recent, baseline, sigma


def rolling_anomalies(outcomes: DataFrame, stage=None) -> DataFrame:
    """(key, at, recent, baseline, sigma) of outcomes (key, ts, at, id unique, good): when success rates fell.

    A table does it with windows over rows, the last state before each tick, and a chain of what is told.
    """
    if outcomes.isStreaming:
        return run_stream(outcomes, Anomaly()).select("key", "at", "recent", "baseline", "sigma")
    order = Window.partitionBy("key").orderBy("at", "id")
    good = F.col("good").cast("int")
    rows = outcomes.select("key", "at", "id", F.row_number().over(order).alias("n"), F.sum(good).over(order.rowsBetween(1 - RECENT, 0)).alias("new"), F.sum(good).over(order.rowsBetween(1 - WINDOW, -RECENT)).alias("old"))
    ticks = rows.groupBy("key", ((F.expr(f"at div {TICK}") + 1) * TICK).alias("tick")).agg(F.max(F.struct("at", "id", "n", "new", "old")).alias("x"))
    size = F.least(F.col("x.n"), F.lit(WINDOW)) - RECENT
    rated = ticks.where(F.col("x.n") >= LEAST).select("key", F.col("tick").alias("at"), "x.id", (F.col("x.new") / float(RECENT)).alias("recent"), (F.col("x.old") / size).alias("baseline"), size.alias("size"))
    spread = F.sqrt(F.greatest(F.col("baseline") * (1 - F.col("baseline")) / F.col("size"), F.lit(0.0001)))
    low = rated.withColumn("sigma", (F.col("baseline") - F.col("recent")) / spread).where(F.col("sigma") > SIGMAS)
    return greedy(low.drop("size"), ["key"], F.col("at") + SILENCE, stage, SILENCE).select("key", "at", "recent", "baseline", "sigma")


def anomalies_walked(outcomes: DataFrame) -> DataFrame:
    """``rolling_anomalies`` of a table by the machine that streams use."""
    return run_table(outcomes, Anomaly()).select("key", "at", "recent", "baseline", "sigma")
