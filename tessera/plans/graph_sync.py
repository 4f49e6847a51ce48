"""Registered queries of the graph store and of the fleet's log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.queries import query
from tessera.plans.stores import _fresh
from tessera.sources import views as V
from tessera.sources.fleet import ingest_fleet
from tessera.sources.graph_store import GraphStore, as_rows, document_key
from tessera.sources.views import with_views

_FINDING = ("category", "description", "severity", "location", "suppressed")
_PARTS = 3


def _scans(spark, d):
    """Weak points, dealt to three scans of each repository by their order."""
    return V.weak_points(spark, d).withColumn("scan", F.col("l_orderkey") % _PARTS)


def _scan_rows(scans):
    at = F.date_format("ts", "yyyy-MM-dd")
    repos = scans.groupBy("repo", "scan").agg(F.count("*").alias("finding_count"), F.max(at).alias("last_scanned")).withColumn("status", F.lit("active"))
    repos = as_rows(repos, "repos", F.col("repo"), F.col("scan"), "repo", "finding_count", "last_scanned", "status")
    findings = scans.withColumn("status", F.lit("open"))
    return repos.unionByName(as_rows(findings, "findings", document_key(F.col("repo"), *_FINDING), F.col("scan"), "repo", *_FINDING, "status"))


def _synced(spark, d) -> GraphStore:
    """Scans come as three files of a stream; the second is merged again afterwards, as after a failure."""
    store = GraphStore(spark, _fresh(spark, "graph"))
    feed, mark = _fresh(spark, "feed"), _fresh(spark, "positions")
    scans = _scans(spark, d)
    for k in range(_PARTS):
        rows = _scan_rows(scans.where(F.col("scan") == k))
        rows.write.mode("append").option("compression", "zstd").parquet(f"{feed}/{k}")
        stream = spark.readStream.schema("collection string, key string, seq long, doc string").option("recursiveFileLookup", "true").parquet(feed)
        store.sync(stream, mark)
    store.merge(_scan_rows(scans.where("scan = 1")))
    o = V.outcomes(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))
    outcomes = as_rows(o, "outcomes", document_key(F.lit("outcome"), "recipe_id", "repo", "outcome", "ts"), F.lit(0), "recipe_id", "repo", "outcome", "ts")
    recipes = as_rows(V.recipes(spark, d), "recipes", F.col("id"), F.lit(0), "id", "confidence", "target_category")
    for _ in range(2):
        store.merge(outcomes.unionByName(recipes))
    return store


_SQL = f"""{with_views('weak_points', 'outcomes', 'recipes')}, w AS (SELECT *, l_orderkey % 3 AS scan FROM weak_points),
r AS (SELECT repo, scan, count(*) AS n, max(strftime(ts, '%Y-%m-%d')) AS seen FROM w GROUP BY 1, 2),
g AS (SELECT 'repos' AS collection, repo AS key, max(scan) AS seq, repo AS about, arg_max(n, scan) AS n, arg_max(seen, scan) AS seen FROM r GROUP BY repo
UNION ALL SELECT 'findings', repo || '_' || md5(category || chr(31) || description || chr(31) || severity || chr(31) || location || chr(31) || suppressed), max(scan), repo, NULL, NULL FROM w GROUP BY repo, category, description, severity, location, suppressed
UNION ALL SELECT DISTINCT 'outcomes', 'outcome_' || md5(recipe_id || chr(31) || repo || chr(31) || outcome || chr(31) || strftime(ts, '%Y-%m-%d')), 0, repo, NULL::BIGINT, NULL::VARCHAR FROM outcomes
UNION ALL SELECT 'recipes', id, 0, NULL, NULL, NULL FROM recipes)"""


@query("s16_graph_sync", f"{_SQL} SELECT collection, key, seq, about, coalesce(n, -1) AS n, seen FROM g")
def s16_graph_sync(spark, d):
    """Scans, outcomes and recipes merged by key; merging a batch again changes nothing."""
    field = lambda name, kind="string": F.get_json_object("doc", f"$.{name}").cast(kind)
    return _synced(spark, d).read().select("collection", "key", "seq", field("repo").alias("about"), F.coalesce(field("finding_count", "long"), F.lit(-1).cast("long")).alias("n"), field("last_scanned").alias("seen"))


@query("s16_graph_counts", f"{_SQL} SELECT collection, count(*) AS n FROM g GROUP BY collection")
def s16_graph_counts(spark, d):
    return _synced(spark, d).read().groupBy("collection").agg(F.count("*").alias("n"))


@query("s11_fleet_ingest", """WITH e AS (SELECT event_id, event_id % 6 AS b, CASE WHEN event_id % 11 > 0 THEN 'recipe-' || (event_id % 20) END AS pattern, 'repo-' || user_id AS repo, event_type AS t FROM events)
SELECT coalesce(pattern, 'unknown') AS recipe_id, repo, CASE t WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'false_positive' ELSE 'failure' END AS outcome, count(*) AS n FROM e WHERE b > 0 GROUP BY 1, 2, 3""")
def s11_fleet_ingest(spark, d):
    """A log of all bots in two parts, a third of it told in both, with lines that are no JSON; the second call finds nothing new."""
    log, mark, sink = _fresh(spark, "fleet"), _fresh(spark, "positions"), _fresh(spark, "ingested")
    n, kind = F.col("event_id"), F.col("event_type")
    bot = F.when(n % 6 == 0, "self").when(n % 6 < 5, F.concat(F.lit("bot-"), n % 6))
    said = F.when(kind == "purchase", "success").when(kind == "signup", "false_positive").when(kind == "view", "failure").when(kind == "click", "timeout")
    record = F.struct(n.alias("n"), F.when(n % 11 > 0, F.concat(F.lit("recipe-"), n % 20)).alias("pattern"), F.concat(F.lit("repo-"), "user_id").alias("repo"), said.alias("outcome"), bot.alias("bot"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    lines = V.table(spark, d, "events").select(n.alias("n"), F.to_json(record).alias("value"))
    broken = lines.where("n % 50 = 0").select("n", F.concat(F.lit("{cut off "), F.substring("value", 1, 20)).alias("value"))
    for part in ("n % 3 < 2", "n % 3 > 0"):
        lines.unionByName(broken).where(part).select("value").write.mode("append").text(f"{log}/{part[-3] + part[-1]}")
        for _ in range(2):
            ingest_fleet(spark, log, "self", mark, sink)
    return spark.read.parquet(sink).groupBy("recipe_id", "repo", "outcome").agg(F.count("*").alias("n"))
