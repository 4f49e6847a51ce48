"""Registered queries of sources and sinks: what they write is read again and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import content as T
from tessera.operators.graph import shared_folder
from tessera.plans.content import _WORKFLOWS, _check_sql, workflow_files
from tessera.plans.queries import query
from tessera.sources import stores as S
from tessera.sources import views as V
from tessera.sources.views import with_views


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _field(name: str, kind: str = "string"):
    return F.get_json_object("doc", f"$.{name}").cast(kind).alias(name)


@query("s02_document", "SELECT DISTINCT p_type AS category, count(*) OVER (PARTITION BY p_type) AS parts FROM part")
def s02_document(spark, d):
    """A registry written as one array (S15) and read by its elements; its six entries are the categories."""
    path = _fresh(spark, "registry")
    entry = F.struct(F.col("p_type").alias("category"), "parts")
    whole = V.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("parts")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    whole.write.text(path)
    return S.json_document(spark, path).select(_field("category"), _field("parts", "long"))


@query("s13_outcome_log", f"{with_views('outcomes')} SELECT event_id, recipe_id, outcome, strftime(ts, '%Y-%m') AS month FROM outcomes")
def s13_outcome_log(spark, d):
    """Outcomes appended as monthly JSON lines, and read back without a schema."""
    path = _fresh(spark, "outcomes")
    o = V.outcomes(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM"))
    S.append_log(o, path)
    return S.json_lines(spark, path).select(_field("event_id", "long"), _field("recipe_id"), _field("outcome"), _field("month"))


@query("s14_manifest_sink", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1")
def s14_manifest_sink(spark, d):
    """The pending manifest is replaced by its next version; the archive keeps both."""
    path, kept = _fresh(spark, "pending"), _fresh(spark, "archive")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    S.replace_table(o.where("o_orderkey % 2 = 0"), path, kept)
    S.replace_table(o.where("o_orderkey % 2 = 1"), path, kept)
    return S.json_lines(spark, path).groupBy(_field("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


def _stores(spark, d) -> dict:
    doc = lambda df: df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("doc"))
    return {"scans": doc(V.weak_points(spark, d).select("repo", "category")), "patterns": doc(V.patterns(spark, d)), "recipes": doc(V.recipes(spark, d)), "outcomes": doc(V.outcomes(spark, d).select("repo", "outcome"))}


@query("s05_all_stores", f"{with_views('patterns', 'recipes', 'outcomes')} SELECT 'scans' AS store, count(*) AS n FROM weak_points UNION ALL SELECT 'patterns', count(*) FROM patterns UNION ALL SELECT 'recipes', count(*) FROM recipes UNION ALL SELECT 'outcomes', count(*) FROM outcomes")
def s05_all_stores(spark, d):
    """A path whose first segment names no store reads all four."""
    return S.federation(_stores(spark, d), "unknown").groupBy("store").agg(F.count("*").alias("n"))


@query("s06_first_hit", f"{with_views('recipes', 'outcomes')} SELECT 'recipe-3' AS id, confidence FROM recipes WHERE id = 'recipe-3'")
def s06_first_hit(spark, d):
    """Stores in their order; the first that has the id answers."""
    found = _stores(spark, d)
    return S.lookup([found["scans"], found["recipes"], found["outcomes"]], "id", "recipe-3").select(_field("id"), _field("confidence", "double"))


@query("s08_remote_stores", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def s08_remote_stores(spark, d):
    """Two roots and one that isn't there."""
    a, b = _fresh(spark, "a"), _fresh(spark, "b")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    o.where("o_orderkey % 3 = 0").write.json(a)
    o.where("o_orderkey % 3 <> 0").write.json(b)
    return S.remote_stores(spark, [a, _fresh(spark, "missing"), b], S.json_lines).groupBy(_field("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("s10_tail_ingest", f"{with_views('outcomes')} SELECT recipe_id, count(*) AS n FROM outcomes GROUP BY 1")
def s10_tail_ingest(spark, d):
    """A log that grows between two calls: each takes the new files only."""
    log, mark, sink = _fresh(spark, "log"), _fresh(spark, "positions"), _fresh(spark, "ingested")
    o = V.outcomes(spark, d).select("event_id", "recipe_id", "ts")
    for half in (0, 1):
        S.append_log(o.where(F.col("event_id") % 2 == half), log)
        S.new_lines(spark, log, mark, sink)
    return spark.read.schema("doc string").parquet(sink).groupBy(_field("recipe_id")).agg(F.count("*").alias("n"))


@query("s18_scorecard_source", "SELECT c_custkey, c_acctbal / 1000 AS score FROM customer WHERE c_acctbal >= 0 AND c_acctbal / 1000 < 8")
def s18_scorecard_source(spark, d):
    """Results with a score from 0 to below 8."""
    doc = V.table(spark, d, "customer").select(F.to_json(F.struct("c_custkey", (F.col("c_acctbal") / 1000).alias("score"))).alias("doc"))
    return doc.select(_field("c_custkey", "long"), _field("score", "double")).where("score >= 0 AND score < 8")


_FINDINGS = f"WITH f AS (SELECT x.*, w.repo, w.path FROM ({'WITH ' + _WORKFLOWS + _check_sql(T.HARDENING)}) x JOIN (WITH {_WORKFLOWS} SELECT * FROM files) w USING (file_id))"


def _findings(spark, d):
    w = workflow_files(spark, d)
    found = T.check_findings(w, T.HARDENING, keep=("repo", "path"))
    return found.select("repo", F.lit("hardening").alias("family"), F.col("rule").alias("type"), "severity", F.concat_ws("/", F.col("file_id").cast("string"), "path").alias("file"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("reason"))


@query(
    "s20_sarif_results",
    f"""{_FINDINGS} SELECT repo, 'tessera/hardening/' || rule AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' WHEN 'info' THEN 'note' ELSE 'warning' END AS level,
file_id || '/' || path AS uri, 1 AS line, sha256('tessera/hardening/' || rule || '|' || file_id || '/' || path || '|' || rule || '|' || rule) AS fingerprint FROM f""",
)
def s20_sarif_results(spark, d):
    return S.sarif_results(_findings(spark, d), "tessera").drop("reason")


@query("s20_sarif_documents", f"{_FINDINGS} SELECT repo, count(*) AS results, count(DISTINCT rule) AS rules, '2.1.0' AS version FROM f GROUP BY repo")
def s20_sarif_documents(spark, d):
    """One document for each repository, counted from its JSON."""
    docs = S.sarif_documents(_findings(spark, d), "tessera")
    size = lambda path: F.size(F.try_variant_get(F.parse_json("doc"), path, "array<variant>")).cast("long")
    return docs.select("repo", size("$.runs[0].results").alias("results"), size("$.runs[0].tool.driver.rules").alias("rules"), F.get_json_object("doc", "$.version").alias("version"))


@query(
    "s22_metrics_snapshot",
    f"{with_views('outcomes', 'weak_points', 'recipes')} SELECT (SELECT count(DISTINCT repo) FROM weak_points) AS repos, (SELECT count(*) FROM weak_points) AS weak_points, (SELECT count(*) FROM outcomes) AS outcomes, (SELECT count(*) FROM recipes) AS recipes, (SELECT round(avg(confidence), 9) FROM recipes) AS mean_confidence",
)
def s22_metrics_snapshot(spark, d):
    w = V.weak_points(spark, d).agg(F.countDistinct("repo").alias("repos"), F.count("*").alias("weak_points"))
    r = V.recipes(spark, d).agg(F.count("*").alias("recipes"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))
    return w.join(F.broadcast(V.outcomes(spark, d).agg(F.count("*").alias("outcomes"))), F.lit(True)).join(F.broadcast(r), F.lit(True))


@query(
    "s24_added_lines",
    """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS diff_id, 'src/a' || (k % 5) || '.txt' AS path, 10 + k % 7 + 1 AS line_no, 'new ' || k AS line FROM o
UNION ALL SELECT k, 'src/a' || (k % 5) || '.txt', 10 + k % 7 + 2, '' FROM o UNION ALL SELECT k, 'src/a' || (k % 5) || '.txt', 90, 'last' FROM o UNION ALL SELECT k, 'b c.md', 1, 'only' FROM o""",
)
def s24_added_lines(spark, d):
    """Diffs of two files with removed, kept and added lines, numbered in their new version."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("src/a"), k % 5, F.lit(".txt"))
    first = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/x\n+++ b/x\n@@ -3,2 +"), 10 + k % 7, F.lit(",3 @@ def\n kept\n-old\n+new "), k, F.lit("\n+\n@@ -80 +90 @@\n+last\n"))
    diff = F.concat(first, F.lit("diff --git a/b c.md b/b c.md\n@@ -0,0 +1 @@\n+only\n"))
    return S.added_lines(V.table(spark, d, "orders").select(k.alias("diff_id"), diff.alias("diff")))
