"""Nearest events of a key, and greedy chains over them, without walking a key in one task.

Events are ordered by (at, id) within their key; at is a long, id breaks ties.
A key's timeline is cut into buckets of at.  Windows run inside one (key,
bucket) alone; what a bucket inherits from its neighbours is found on a table
with one row for each bucket that holds a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(probes: DataFrame, points: DataFrame, key: list[str], width: int, ahead: bool = False, equal: bool = True) -> DataFrame:
    """``probes`` (key, at, id, ...) with ``point``, the struct of the last of ``points`` (key, at, id, ...) not after each probe.

    With ``ahead``, the first not before it.  Without ``equal``, a point of the probe's own (at, id) doesn't
    count.  Null where there is none.  ``width`` is the length of a bucket; only time depends on it.
    """
    bucket = F.floor(F.col("at") / width).cast("long").alias("bucket")
    others = [F.col(c) for c in points.columns if c not in key]
    carried = [F.col(c) for c in probes.columns if c not in (*key, "at", "id")]
    probe_type = probes.select(F.struct(F.lit(True).alias("is"), *carried).alias("p")).schema["p"].dataType
    point_type = points.select(F.struct(*others).alias("q")).schema["q"].dataType
    one = probes.select(*key, "at", "id", bucket, F.lit(True).alias("asks"), F.struct(F.lit(True).alias("is"), *carried).cast(probe_type).alias("p"), F.lit(None).cast(point_type).alias("q"))
    two = points.select(*key, "at", "id", bucket, F.lit(False).alias("asks"), F.lit(None).cast(probe_type).alias("p"), F.struct(*others).cast(point_type).alias("q"))
    turn = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    # at one place, points that count stand before probes
    last = F.col("asks").asc() if equal else F.col("asks").desc()
    inside = Window.partitionBy(*key, "bucket").orderBy(turn("at"), turn("id"), last).rowsBetween(Window.unboundedPreceding, 0)
    seen = one.unionByName(two).withColumn("point", F.last("q", True).over(inside)).where("asks")
    edge = (F.min if ahead else F.max)(F.struct("at", "id", F.struct(*others).alias("q")))
    ends = points.select("*", bucket).groupBy(*key, "bucket").agg(edge.alias("edge"))
    steps = ends.select(*key, "bucket", F.col("edge.q").alias("edge")).unionByName(seen.select(*key, "bucket").distinct().withColumn("edge", F.lit(None).cast(point_type)))
    steps = steps.groupBy(*key, "bucket").agg(F.max("edge").alias("edge"))
    before = Window.partitionBy(*key).orderBy(turn("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*key, "bucket", F.last("edge", True).over(before).alias("inherited"))
    found = seen.join(steps, [*key, "bucket"])
    return found.select(*key, "at", "id", *[F.col("p").getField(c).alias(c) for c in probes.columns if c not in (*key, "at", "id")], F.coalesce("point", "inherited").alias("point"))


def reached(nodes: DataFrame, longest: int, stage) -> DataFrame:
    """Ids of the nodes (id, next, root) that following ``next`` from the roots meets, by pointer doubling.

    After k rounds a pointer spans 2^k steps and all nodes within 2^k - 1 steps of a root are found.
    ``longest`` bounds the steps of a chain; ``stage`` writes a table and reads it again.
    """
    jump = stage(nodes.where("next IS NOT NULL").select("id", "next"))
    found = stage(nodes.where("root").select("id"))
    span = 1
    while span <= longest:
        there = found.join(jump, "id").select(F.col("next").alias("id"))
        found = stage(found.unionByName(there).distinct())
        span *= 2
        if span <= longest:
            far = jump.select(F.col("id").alias("next"), F.col("next").alias("far"))
            jump = stage(jump.join(far, "next").select("id", F.col("far").alias("next")))
    return found


def greedy(events: DataFrame, key: list[str], end: Column, stage, gap: int, width: int | None = None) -> DataFrame:
    """The events (key, at, id unique, ...) that a greedy pass takes: the first, then always the first at or after the ``end`` of the last one taken.

    An end is at least ``gap`` after its event.  An event with no other in the ``gap`` before it is taken whatever
    came earlier, so no end may lie further than ``gap`` after the last event before such a pause.
    """
    width = width or 16 * gap
    events = stage(events.withColumn("end", end))
    points = events.select(*key, "at", "id")
    before = nearest(events, points, key, width, equal=False)
    root = F.col("point").isNull() | (F.col("at") - F.col("point.at") >= gap)
    started = stage(before.withColumn("root", root).drop("point"))
    # from an event's end, the first event at it or later
    asks = started.select(*key, F.col("end").alias("at"), F.lit(-(1 << 62)).alias("id"), F.col("id").alias("of"))
    onward = nearest(asks, points, key, width, ahead=True).select(F.col("of").alias("id"), F.col("point.id").alias("next"))
    nodes = stage(started.select("id", "root", *key, "at").join(onward, "id", "left"))
    # every step takes a gap at least, so the time from a root to the next bounds a chain
    starts = nodes.where("root").select(*key, "at", "id")
    runs = nearest(nodes.select(*key, "at", "id"), starts, key, width).agg(F.max(F.expr(f"(at - point.at) div {gap}")).alias("steps"))
    longest = runs.first()[0] or 0
    taken = reached(nodes, longest, stage)
    return events.join(taken, "id", "left_semi").drop("end")
