"""Review comments of a change as one summary, grouped by severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Severities in their order, and their marks
MARKS = {"critical": ":red_circle:", "high": ":orange_circle:", "medium": ":yellow_circle:", "low": ":blue_circle:", "info": ":white_circle:"}


def review_summaries(changes: DataFrame, comments: DataFrame, title: str) -> DataFrame:
    """(change, summary) of every change (change) by its comments (change, place, severity, path, line or null, body, rule).

    Comments stand by severity and then by place; one of an unknown severity counts but isn't shown.  A change without
    comments has a summary that says so.  A summary is as long as its change has comments.
    """
    at = F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    shown = F.concat(F.lit("- **`"), at, F.lit("`** -- "), "body", F.lit(" (`"), "rule", F.lit("`)"))
    rank = F.array_position(F.array(*map(F.lit, MARKS)), F.col("severity"))
    rows = comments.select("change", "severity", rank.alias("rank"), F.struct("place", shown.alias("text")).alias("c"))
    blocks = rows.groupBy("change", "severity", "rank").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("c")).alias("cs"))
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("severity"))
    head = F.concat(F.lit("### "), mark, F.lit(" "), F.initcap("severity"), F.lit(" ("), "n", F.lit(")\n"))
    lines = F.concat(F.array(head), F.transform("cs", lambda c: c["text"]), F.array(F.lit("")))
    block = F.struct("rank", F.array_join(lines, "\n").alias("text"))
    by = blocks.groupBy("change").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("rank") > 0, block))).alias("bs"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit(f"> **{title}** -- "), "n", F.lit(" finding(s)\n")), F.lit("---\n")), F.transform("bs", lambda b: b["text"])), "\n")
    none = F.lit(f"> **{title}**: No issues found. :white_check_mark:")
    return changes.select("change").distinct().join(by, "change", "left").select("change", F.coalesce(text, none).alias("summary"))
