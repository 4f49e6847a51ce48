"""Windowed counts and per-key state machines on streams, each with a batch twin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.streaming.machines import Machine, run_stream, timed

RECENT, REHEAT_FAILURES = 10, 3
STREAK = 5


def tumbling_counts(events: DataFrame, width: str = "5 seconds", late: str = "5 minutes") -> DataFrame:
    """(event_type, start, n) of events by tumbling window; works on streams and tables alike."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    return e.groupBy("event_type", F.window("at", width).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


class Streak(Machine):
    """Failures of a bot in a row; five quarantine it."""

    inputs = ("outcome",)
    outputs = T.StructType([T.StructField("streak", T.LongType()), T.StructField("quarantined", T.BooleanType())])

    def start(self) -> dict:
        return {"streak": 0}

    def step(self, state: dict, at: int, ident: int, event: dict) -> tuple:
        state["streak"] = state["streak"] + 1 if event["outcome"] == "failure" else 0
        return state["streak"], state["streak"] >= STREAK


def failure_streaks_stream(outcomes: DataFrame) -> DataFrame:
    """The failure streak of each bot after each outcome; five in a row quarantine it."""
    out = run_stream(timed(outcomes, "bot", "ts", "event_id"), Streak())
    return out.select(F.col("key").alias("bot"), F.col("id").alias("event_id"), "streak", "quarantined")


def failure_streaks(outcomes: DataFrame) -> DataFrame:
    """Batch twin of ``failure_streaks_stream``: failures since the last other outcome."""
    w = Window.partitionBy("bot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.col("outcome") == "failure"
    runs = outcomes.withColumn("run", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    inside = Window.partitionBy("bot", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(F.when(failed, 1).otherwise(0)).over(inside)
    return runs.select("bot", "event_id", streak.alias("streak"), (streak >= STREAK).alias("quarantined"))


class Anneal(Machine):
    """The temperature of a recipe by its outcomes; three bad ones of the last ten reheat it."""

    inputs = ("outcome",)
    outputs = T.StructType([T.StructField("n", T.LongType()), T.StructField("recent_bad", T.LongType()), T.StructField("temperature", T.DoubleType())])

    def start(self) -> dict:
        return {"n": 0, "recent": ""}

    def step(self, state: dict, at: int, ident: int, event: dict) -> tuple:
        state["n"] += 1
        state["recent"] = (state["recent"] + ("." if event["outcome"] == "success" else "x"))[-RECENT:]
        bad = state["recent"].count("x")
        base = max(math.exp(-0.05 * state["n"]), 0.01)
        return state["n"], bad, min(3 * base, 1.0) if bad >= REHEAT_FAILURES else base


def annealing_stream(outcomes: DataFrame) -> DataFrame:
    """Temperature of each recipe after each outcome."""
    out = run_stream(timed(outcomes, "recipe_id", "ts", "event_id"), Anneal())
    return out.select(F.col("key").alias("recipe_id"), F.col("id").alias("event_id"), "n", "recent_bad", "temperature")


def annealing(outcomes: DataFrame) -> DataFrame:
    """Batch twin of ``annealing_stream``."""
    order = Window.partitionBy("recipe_id").orderBy("ts", "event_id")
    bad = F.sum(F.when(F.col("outcome") == "success", 0).otherwise(1)).over(order.rowsBetween(1 - RECENT, 0))
    base = F.greatest(F.exp(-0.05 * F.col("n")), F.lit(0.01))
    heat = F.when(F.col("recent_bad") >= REHEAT_FAILURES, F.least(3 * base, F.lit(1.0))).otherwise(base)
    rows = outcomes.withColumn("n", F.row_number().over(order).cast("long")).withColumn("recent_bad", bad)
    return rows.select("recipe_id", "event_id", "n", "recent_bad", heat.alias("temperature"))
