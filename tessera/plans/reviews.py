"""Registered queries of review summaries and of the web scan of any content."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import content as T
from tessera.operators.reviews import review_summaries
from tessera.plans.content import _SOURCES, _pattern_sql, source_files
from tessera.plans.queries import query
from tessera.sources import views as V
from tessera.sources.views import with_views

_TITLE = "Review"


@query(
    "a35_review_summaries",
    f"""{with_views('weak_points')}, c AS (SELECT l_orderkey AS change, l_linenumber AS place, lower(severity) AS severity, location AS path, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber * 10 END AS line, description AS body, category AS rule FROM weak_points WHERE NOT suppressed AND l_partkey % 2 = 0),
m(severity, mark, title, rank) AS (VALUES ('critical', ':red_circle:', 'Critical', 1), ('high', ':orange_circle:', 'High', 2), ('medium', ':yellow_circle:', 'Medium', 3), ('low', ':blue_circle:', 'Low', 4)),
b AS (SELECT change, rank, count(*) AS n, '### ' || any_value(mark) || ' ' || any_value(title) || ' (' || count(*) || ')' || chr(10) || chr(10) || string_agg(told, chr(10) ORDER BY place, told) || chr(10) AS text FROM (SELECT *, '- **`' || path || coalesce(':' || line, '') || '`** -- ' || body || ' (`' || rule || '`)' AS told FROM c) JOIN m USING (severity) GROUP BY change, rank),
s AS (SELECT change, '> **{_TITLE}** -- ' || sum(n)::BIGINT || ' finding(s)' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY rank) AS summary FROM b GROUP BY change)
SELECT o_orderkey AS change, coalesce(summary, '> **{_TITLE}**: No issues found. :white_check_mark:') AS summary FROM orders LEFT JOIN s ON change = o_orderkey""",
)
def a35_review_summaries(spark, d):
    """One summary for every order taken as a change; its unsuppressed weak points are the comments."""
    w = V.weak_points(spark, d).where("NOT suppressed AND l_partkey % 2 = 0")
    line = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") * 10)
    comments = w.select(F.col("l_orderkey").alias("change"), F.col("l_linenumber").alias("place"), F.lower("severity").alias("severity"), F.col("location").alias("path"), line.alias("line"), F.col("description").alias("body"), F.col("category").alias("rule"))
    changes = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("change"))
    return review_summaries(changes, comments, _TITLE)


#: The patterns for scripts of the web, whatever file they stand in.
WEB = tuple(p._replace(languages=()) for p in T.PATTERNS if "javascript" in p.languages)


@query("x05_web_scan", f"WITH {_SOURCES.replace('AS language', 'AS written', 1).replace('AS content', 'AS content, NULL::VARCHAR AS language', 1)}{_pattern_sql(WEB)}")
def x05_web_scan(spark, d):
    """Insecure web code in any text, comments included."""
    return T.pattern_findings(source_files(spark, d).withColumn("language", F.lit(None).cast("string")), WEB)
