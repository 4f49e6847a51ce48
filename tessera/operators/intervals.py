"""Events joined to intervals that may overlap, by the buckets of time that an interval touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covering(events: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """``events`` (at in seconds, ...) with each of ``windows`` (start, end, strategy) that covers them, start inclusive, end exclusive.

    An event that none covers has one row with the strategy "unknown".  A window has a row for each bucket of ``width``
    seconds that it touches, so a bucket meets its own windows only; windows without length or with null ends cover nothing.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    spread = windows.where("start < end").withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
    met = events.withColumn("bucket", bucket(F.col("at"))).join(spread, "bucket", "left")
    hit = met.withColumn("covers", F.coalesce((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")), F.lit(False)))
    names = F.sort_array(F.collect_list(F.when(F.col("covers"), F.col("strategy"))))
    by = hit.groupBy(*[F.col(f"`{c}`") for c in events.columns]).agg(names.alias("names"))
    return by.withColumn("strategy", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("unknown"))))).drop("names")


def window_totals(events: DataFrame, windows: DataFrame, width: int, counts: dict[str, Column]) -> DataFrame:
    """(strategy, total, *counts, items): what ``covering`` gives, counted by strategy, with the number of distinct items.

    ``events`` are (at in seconds, item, ...); a null item counts as an event only.  No event meets a window: both are sorted
    within a bucket of ``width`` seconds, and a window's counts are the differences of running ones at its ends.  Windows are
    cut at the buckets' ends.  An item falls into a window if its first event at or after the start comes before the end.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    names = ["total", *counts]
    e = events.groupBy("at", "item").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("bucket", bucket(F.col("at")))
    w = windows.where("start < end").withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
    w = w.select("bucket", "strategy", F.greatest("start", F.col("bucket") * width).alias("start"), F.least("end", (F.col("bucket") + 1) * width).alias("end"))
    # ends stand before the events of their second
    bound = lambda at, sign: F.struct(F.col(at).cast("long").alias("at"), F.lit(sign).alias("sign"))
    ends = w.select("bucket", "strategy", F.explode(F.array(bound("start", 1), bound("end", -1))).alias("x")).select("bucket", "x.at", F.lit(0).alias("kind"), "x.sign", "strategy", F.lit(None).cast("string").alias("item"), *[F.lit(0).cast("long").alias(n) for n in names])
    seen = e.select("bucket", F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("sign"), F.lit(None).cast("string").alias("strategy"), "item", *names)
    upto = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.unionByName(seen).withColumns({"open": F.sum("sign").over(upto), **{f"_{n}": F.sum(n).over(upto) for n in names}})
    # a window's start takes the running count off, its end adds it; an event outside all windows adds its own
    free = (F.col("kind") == 1) & (F.col("open") == 0)
    strategy = F.when(F.col("kind") == 1, "unknown").otherwise(F.coalesce("strategy", F.lit("unknown"))).alias("strategy")
    kept = swept.where((F.col("kind") == 0) | (F.col("open") == 0))
    added = [F.sum(F.when(free, F.col(n)).otherwise(-F.col("sign") * F.col(f"_{n}"))).alias(n) for n in names]
    g = kept.groupBy(strategy, F.when(free, F.col("item")).alias("item")).agg(*added, F.max(free & F.col("item").isNotNull()).alias("has"))
    sums = g.groupBy("strategy").agg(*[F.sum(n).alias(n) for n in names]).where("total > 0")
    # items of the windows: the next event of the item, from each start
    held = e.where("item IS NOT NULL")
    starts = w.join(held.select("bucket", "item").distinct(), "bucket").select("bucket", "item", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("end"), F.coalesce("strategy", F.lit("unknown")).alias("strategy"))
    nexts = held.select("bucket", "item", F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("strategy"))
    back = Window.partitionBy("bucket", "item").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    hits = starts.unionByName(nexts).withColumn("next", F.last(F.when(F.col("kind") == 1, F.col("at")), True).over(back)).where("kind = 0 AND next < end").select("strategy", "item")
    found = hits.unionByName(g.where("has").select("strategy", "item")).distinct().groupBy("strategy").agg(F.count("*").alias("items"))
    return sums.join(found, "strategy", "left").select("strategy", *names, F.coalesce("items", F.lit(0).cast("long")).alias("items"))
