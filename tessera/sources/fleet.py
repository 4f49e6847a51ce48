"""Outcomes that other bots of a fleet have logged, taken in once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "pattern string, repo string, file string, outcome string, bot string, timestamp timestamp"
OUTCOMES = ("success", "failure", "false_positive")


def fleet_outcomes(lines: DataFrame, own: str, late: str = "7 days") -> DataFrame:
    """(recipe_id, repo, file, outcome, bot, ts, mark) of JSON lines (value), each record once; works on tables and on streams (value, arrived).

    Text that isn't a JSON object is left out, and so are records of the ``own`` bot; a record without a bot
    is another's.  Missing names are "unknown", and an outcome that isn't known is a failure.  A stream goes by
    the time that lines arrived at, so old records aren't late; one that comes again more than ``late`` afterwards may be taken twice.
    """
    arrived = ["arrived"] if lines.isStreaming else []
    read = lines.select(*arrived, F.from_json(F.when(F.substring(F.ltrim("value"), 1, 1) == "{", F.col("value")), RECORD).alias("r"), F.md5(F.trim("value")).alias("mark"), F.try_parse_json("value").isNotNull().alias("ok"))
    read = read.where("ok AND r IS NOT NULL").select(*arrived, "r.*", "mark").where(F.coalesce(F.col("bot") != own, F.lit(True)))
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("failure")
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    rows = read.select(*arrived, unknown("pattern").alias("recipe_id"), unknown("repo").alias("repo"), unknown("file").alias("file"), known.alias("outcome"), "bot", F.col("timestamp").alias("ts"), "mark")
    if not rows.isStreaming:
        return rows.dropDuplicates(["mark"])
    return rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["mark"]).drop("arrived")


def ingest_fleet(spark: SparkSession, folder: str, own: str, checkpoint: str, sink: str, late: str = "7 days") -> None:
    """Takes what files under ``folder`` have brought since the last call; a call without new files adds nothing."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(folder)
    lines = lines.select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    writer = fleet_outcomes(lines, own, late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
