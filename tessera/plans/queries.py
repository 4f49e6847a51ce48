"""Registry of the analytics queries and of their SQL.

Names begin with the operator's id in the survey.  Every ordering that a limit
depends on has a unique tie-breaker, and "now" is the newest time of the view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import confidence as C
from tessera.operators import filters as P
from tessera.operators import graph as G
from tessera.sources import views as V
from tessera.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def last(column: str = "event_id") -> list:
    return [F.col("ts").desc(), F.col(column).desc()]


# --- Document queries: filters, order and paging -------------------------------------------------


@query("l05_failed_outcomes", f"{with_views('outcomes')} SELECT event_id, recipe_id, repo, outcome FROM outcomes WHERE outcome = 'failure' ORDER BY ts DESC, event_id DESC LIMIT 100")
def l05_failed_outcomes(spark, d):
    return P.paged(V.outcomes(spark, d).where("outcome = 'failure'"), last(), 100).select("event_id", "recipe_id", "repo", "outcome")


@query("l07_offset_page", f"{with_views('outcomes')} SELECT event_id, bot, outcome FROM outcomes WHERE bot = 'bot-1' AND outcome <> 'success' ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 40")
def l07_offset_page(spark, d):
    return P.paged(V.outcomes(spark, d).where("bot = 'bot-1' AND outcome <> 'success'"), last(), 25, 40).select("event_id", "bot", "outcome")


@query("p02_negative_limit", f"{with_views('outcomes')} SELECT event_id, repo FROM (SELECT * FROM outcomes WHERE outcome = 'failure' ORDER BY ts ASC, event_id ASC LIMIT 30) t")
def p02_negative_limit(spark, d):
    return P.paged(V.outcomes(spark, d).where("outcome = 'failure'"), last(), -30, flipped=[F.col("ts"), F.col("event_id")]).select("event_id", "repo")


@query("f01_field_equal", "SELECT event_id, event_type FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') = '7'")
def f01_field_equal(spark, d):
    return V.table(spark, d, "events").where(P.field_equal(F.col("props"), "k", "7")).select("event_id", "event_type")


@query("f01_missing_equals_empty", "SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.a.b'), '') = '' AND event_type = 'error'")
def f01_missing_equals_empty(spark, d):
    return V.table(spark, d, "events").where(P.field_equal(F.col("props"), "a.b", "") & (F.col("event_type") == "error")).select("event_id")


@query("f02_field_compare", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 90")
def f02_field_compare(spark, d):
    return V.table(spark, d, "events").where(P.field_compare(F.col("props"), "k", ">=", "90abc")).select("event_id")


@query("f02_missing_is_less", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def f02_missing_is_less(spark, d):
    return V.table(spark, d, "events").where(P.field_compare(F.col("props"), "nothing", "<", "1")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f03_field_contains", "SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '9')")
def f03_field_contains(spark, d):
    return V.table(spark, d, "events").where(P.field_contains(F.col("props"), "k", "9")).select("event_id")


@query("f04_like", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'in')")
def f04_like(spark, d):
    doc = F.to_json(F.struct("p_name"))
    return V.table(spark, d, "part").where(P.field_like(doc, "p_name", "IN")).select("p_partkey", "p_name")


@query("f05_matches", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)^(s|l).*e')")
def f05_matches(spark, d):
    return V.table(spark, d, "part").where(P.field_matches(F.col("p_type"), "^(s|l).*e")).select("p_partkey", "p_type")


@query("f05_bad_pattern", "SELECT p_partkey FROM part WHERE false")
def f05_bad_pattern(spark, d):
    return V.table(spark, d, "part").where(P.field_matches(F.col("p_type"), "(")).select("p_partkey")


@query("f07_full_text", "SELECT event_id FROM events WHERE contains(lower(replace(props, ' ', '')), '\"k\":42')")
def f07_full_text(spark, d):
    return V.table(spark, d, "events").where(P.full_text(F.col("props"), '"K":42')).select("event_id")


@query(
    "f09_policy_reasons",
    f"""{with_views('weak_points')}, a AS (SELECT max(ts) AS now FROM weak_points), r AS (
  SELECT CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS rank, date_diff('day', ts::DATE, (SELECT now FROM a)::DATE) AS age, suppressed FROM weak_points)
SELECT CASE WHEN rank < 2 THEN 'severity' WHEN age > 1000 THEN 'age' WHEN suppressed THEN 'dismissed' ELSE 'accepted' END AS reason, count(*) AS n FROM r GROUP BY 1""",
)
def f09_policy_reasons(spark, d):
    w = V.weak_points(spark, d)
    now = w.agg(F.max("ts")).first()[0]
    reason = P.policy_reason(V.severity_rank(F.col("severity")), 2, F.datediff(F.lit(now), F.col("ts")), 1000, F.col("suppressed"))
    return w.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f10_critical_repos", f"{with_views('weak_points')} SELECT repo, count(*) AS n FROM weak_points GROUP BY repo HAVING bool_or(severity = 'Critical' AND category = 'PROMO')")
def f10_critical_repos(spark, d):
    scans = V.weak_points(spark, d).groupBy("repo").agg(F.count("*").alias("n"), F.bool_or((F.col("severity") == "Critical") & (F.col("category") == "PROMO")).alias("hit"))
    return scans.where("hit").select("repo", "n")


@query("f11_severity_cap", f"{with_views('weak_points')} SELECT category, CASE WHEN category = 'ECONOMY' AND severity IN ('Critical', 'High') THEN 'Medium' ELSE severity END AS severity, count(*) AS n FROM weak_points WHERE NOT suppressed GROUP BY 1, 2")
def f11_severity_cap(spark, d):
    capped = F.when((F.col("category") == "ECONOMY") & (V.severity_rank(F.col("severity")) > 2), "Medium").otherwise(F.col("severity"))
    return V.weak_points(spark, d).where("NOT suppressed").groupBy("category", capped.alias("severity")).agg(F.count("*").alias("n"))


@query("f12_severity_floor", f"{with_views('alerts')} SELECT severity, count(*) AS n FROM alerts WHERE severity IN ('critical', 'high', 'medium') GROUP BY 1")
def f12_severity_floor(spark, d):
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("critical", 1), ("high", 2), ("medium", 3), ("low", 4), ("info", 5)) for x in kv]), F.col("severity"))
    return V.alerts(spark, d).where(F.coalesce(rank, F.lit(5)) <= 3).groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "f13_stale_alerts",
    f"""{with_views('alerts')}, a AS (SELECT max(created_at)::DATE AS now FROM alerts)
SELECT repo, count(*) AS n, max(date_diff('day', created_at::DATE, now))::BIGINT AS oldest FROM alerts, a
WHERE state = 'open' AND date_diff('day', created_at::DATE, now) > CASE severity WHEN 'critical' THEN 7 WHEN 'high' THEN 30 WHEN 'medium' THEN 90 ELSE 180 END GROUP BY repo""",
)
def f13_stale_alerts(spark, d):
    a = V.alerts(spark, d)
    age = F.datediff(F.lit(a.agg(F.max("created_at")).first()[0]), "created_at")
    limit = F.when(F.col("severity") == "critical", 7).when(F.col("severity") == "high", 30).when(F.col("severity") == "medium", 90).otherwise(180)
    return a.where((F.col("state") == "open") & (age > limit)).groupBy("repo").agg(F.count("*").alias("n"), F.max(age).cast("long").alias("oldest"))


@query("f16_search", "SELECT p_partkey, p_name, p_size FROM part WHERE (contains(lower(p_name), 'ge') OR contains(lower(p_type), 'ge')) AND p_brand IN ('Brand#2', 'Brand#12', 'Brand#17') ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5")
def f16_search(spark, d):
    part = V.table(spark, d, "part")
    hit = F.contains(F.lower("p_name"), F.lit("ge")) | F.contains(F.lower("p_type"), F.lit("ge"))
    return P.paged(part.where(hit & F.col("p_brand").isin("Brand#2", "Brand#12", "Brand#17")), [F.col("p_size").desc(), F.col("p_partkey")], 20, 5).select("p_partkey", "p_name", "p_size")


@query("p03_most_vulnerable_repos", f"{with_views('weak_points')} SELECT repo, count(*) AS weak_points, count(DISTINCT category) AS categories FROM weak_points GROUP BY repo ORDER BY weak_points DESC, repo LIMIT 20")
def p03_most_vulnerable_repos(spark, d):
    g = V.weak_points(spark, d).groupBy("repo").agg(F.count("*").alias("weak_points"), F.countDistinct("category").alias("categories"))
    return g.orderBy(F.col("weak_points").desc(), "repo").limit(20)


@query("p07_language_tag", f"{with_views('repo_language')} SELECT repo, language, family, CASE WHEN family IS NULL THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS discount FROM repo_language")
def p07_language_tag(spark, d):
    return V.repo_language(spark, d).withColumn("discount", F.when(F.col("family").isNull(), 0.75).otherwise(1.0))


# --- Joins --------------------------------------------------------------------------------------


@query(
    "j01_pattern_correlations",
    f"""{with_views('outcomes')}, p AS (SELECT DISTINCT repo, recipe_id FROM outcomes WHERE outcome = 'failure')
SELECT a.recipe_id AS pattern_a, b.recipe_id AS pattern_b, count(*) AS shared FROM p a JOIN p b ON a.repo = b.repo AND a.recipe_id < b.recipe_id GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def j01_pattern_correlations(spark, d):
    p = V.outcomes(spark, d).where("outcome = 'failure'").select("repo", "recipe_id").distinct()
    a, b = p.withColumnRenamed("recipe_id", "pattern_a"), p.withColumnRenamed("recipe_id", "pattern_b")
    return a.join(b, "repo").where("pattern_a < pattern_b").groupBy("pattern_a", "pattern_b").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("j02_covered_patterns", f"{with_views('patterns', 'recipes')} SELECT category, fingerprint FROM patterns WHERE category IN (SELECT target_category FROM recipes WHERE auto_fixable)")
def j02_covered_patterns(spark, d):
    r = V.recipes(spark, d).where("auto_fixable").select(F.col("target_category").alias("category"))
    return V.patterns(spark, d).join(r, "category", "left_semi").select("category", "fingerprint")


@query("j03_uncovered_categories", f"{with_views('patterns', 'recipes')} SELECT category, count(*) AS n, list_sort(list(fingerprint))[1:3] AS samples FROM patterns WHERE category NOT IN (SELECT target_category FROM recipes WHERE confidence >= 0.9) GROUP BY category")
def j03_uncovered_categories(spark, d):
    r = V.recipes(spark, d).where("confidence >= 0.9").select(F.col("target_category").alias("category"))
    left = V.patterns(spark, d).join(r, "category", "left_anti")
    rank = F.row_number().over(Window.partitionBy("category").orderBy("fingerprint"))
    return left.withColumn("k", rank).groupBy("category").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.col("fingerprint")))).alias("samples"))


@query(
    "j04_best_recipe",
    f"""{with_views('patterns', 'recipes')}, m AS (SELECT p.category, p.fingerprint, r.id, r.confidence FROM patterns p JOIN recipes r ON r.target_category = p.category),
k AS (SELECT *, row_number() OVER (PARTITION BY category, fingerprint ORDER BY confidence DESC, id) AS k FROM m) SELECT category, fingerprint, id AS recipe_id, confidence FROM k WHERE k = 1""",
)
def j04_best_recipe(spark, d):
    r = V.recipes(spark, d).groupBy("target_category").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "id")).alias("x"))
    m = V.patterns(spark, d).join(r, F.col("category") == F.col("target_category"))
    return m.select("category", "fingerprint", F.col("x.id").alias("recipe_id"), (-F.col("x.c")).alias("confidence"))


@query("j05_language_lookup", f"{with_views('weak_points', 'repo_language')} SELECT coalesce(family, 'unknown') AS family, count(*) AS n FROM weak_points w LEFT JOIN repo_language l ON l.repo = w.repo GROUP BY 1")
def j05_language_lookup(spark, d):
    joined = V.weak_points(spark, d).join(V.repo_language(spark, d), "repo", "left")
    return joined.groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("n"))


@query("j06_fan_out", f"{with_views('weak_points')} SELECT category, repo, count(*) AS actions FROM (SELECT DISTINCT category, description, repo FROM weak_points WHERE severity = 'Critical') t GROUP BY 1, 2")
def j06_fan_out(spark, d):
    hit = V.weak_points(spark, d).where("severity = 'Critical'")
    affected = hit.groupBy("category", "description").agg(F.collect_set("repo").alias("repos"))
    return affected.select("category", F.explode("repos").alias("repo")).groupBy("category", "repo").agg(F.count("*").alias("actions"))


@query(
    "j07_strategy_windows",
    f"""{with_views('outcomes')}, b AS (SELECT date_trunc('day', min(ts)) AS d0 FROM outcomes), w AS (SELECT 'plan-' || k AS strategy, d0 + to_days((k * 3)::INT) AS s, d0 + to_days((k * 3 + 2)::INT) AS e FROM b, (SELECT unnest(range(0, 4)) AS k))
SELECT coalesce(strategy, 'unknown') AS strategy, count(*) AS total, count(*) FILTER (outcome = 'success') AS successes FROM outcomes LEFT JOIN w ON ts >= s AND ts < e GROUP BY 1""",
)
def j07_strategy_windows(spark, d):
    o = V.outcomes(spark, d)
    # strategies are a short list of disjoint windows: the interval join is a lookup by day
    start = F.lit(o.agg(F.date_trunc("day", F.min("ts"))).first()[0]).cast("timestamp_ntz")
    day = F.datediff(F.col("ts"), start)
    k = F.floor(day / 3)
    name = F.when((day >= 0) & (k < 4) & (F.pmod(day, F.lit(3)) < 2), F.concat(F.lit("plan-"), k)).otherwise("unknown")
    return o.groupBy(name.alias("strategy")).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "success").alias("successes"))


@query(
    "j08_repo_jaccard",
    f"""{with_views('outcomes')}, p AS (SELECT DISTINCT repo, recipe_id FROM outcomes WHERE outcome = 'failure'), n AS (SELECT repo, count(*) AS n FROM p GROUP BY repo),
s AS (SELECT a.repo AS a, b.repo AS b, count(*) AS shared FROM p a JOIN p b ON a.recipe_id = b.recipe_id AND a.repo < b.repo GROUP BY 1, 2)
SELECT a, b, shared, shared / (x.n + y.n - shared)::DOUBLE AS weight FROM s JOIN n x ON x.repo = a JOIN n y ON y.repo = b WHERE shared >= 3""",
)
def j08_repo_jaccard(spark, d):
    pairs = V.outcomes(spark, d).where("outcome = 'failure'")
    return G.jaccard_edges(pairs, "repo", "recipe_id").where("shared >= 3")


@query(
    "j09_registry_merge",
    f"""{with_views('weak_points')}, h AS (SELECT max(ts) - INTERVAL 1000 DAY AS cut FROM weak_points), o AS (SELECT category, description, count(*) AS n FROM weak_points, h WHERE ts < cut GROUP BY 1, 2), f AS (SELECT category, description, count(*) AS n FROM weak_points, h WHERE ts >= cut AND severity <> 'Low' GROUP BY 1, 2)
SELECT coalesce(o.category, f.category) AS category, coalesce(o.description, f.description) AS description, coalesce(f.n, 0) AS occurrences,
  CASE WHEN o.n IS NULL THEN 'new' WHEN f.n IS NULL THEN 'resolved' WHEN f.n > o.n THEN 'worsening' WHEN f.n < o.n THEN 'improving' ELSE 'stable' END AS trend
FROM o FULL JOIN f ON o.category = f.category AND o.description = f.description""",
)
def j09_registry_merge(spark, d):
    w = V.weak_points(spark, d)
    cut = w.agg(F.max("ts") - F.expr("INTERVAL 1000 DAY")).first()[0]
    late = F.col("ts") >= F.lit(cut).cast("timestamp_ntz")
    g = w.groupBy("category", "description").agg(F.count_if(~late).alias("o"), F.count_if(late & (F.col("severity") != "Low")).alias("f")).where("o > 0 OR f > 0")
    trend = F.when(F.col("o") == 0, "new").when(F.col("f") == 0, "resolved").when(F.col("f") > F.col("o"), "worsening").when(F.col("f") < F.col("o"), "improving").otherwise("stable")
    return g.select("category", "description", F.col("f").alias("occurrences"), trend.alias("trend"))


@query("j10_certificates", f"{with_views('patterns', 'recipes')} SELECT p.category, p.fingerprint, coalesce(max(r.id), 'pending') AS certificate FROM patterns p LEFT JOIN recipes r ON r.target_category = p.category AND r.confidence > 0.8 GROUP BY 1, 2")
def j10_certificates(spark, d):
    r = V.recipes(spark, d).where("confidence > 0.8").groupBy(F.col("target_category").alias("category")).agg(F.max("id").alias("id"))
    return V.patterns(spark, d).join(r, "category", "left").select("category", "fingerprint", F.coalesce("id", F.lit("pending")).alias("certificate"))


@query("j11_bot_performance", f"{with_views('outcomes')} SELECT bot, count(*) AS total, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (outcome = 'false_positive') AS false_positives FROM outcomes GROUP BY bot")
def j11_bot_performance(spark, d):
    return C.outcome_counts(V.outcomes(spark, d), "bot").select("bot", "total", "successes", "failures", "false_positives")


@query(
    "j14_same_slot_schedules",
    f"""{with_views('workflow_runs')}, s AS (SELECT DISTINCT workflow_id, dayofweek(created_at) AS dow, day(created_at) AS dom FROM workflow_runs WHERE workflow_id < 12)
SELECT a.workflow_id AS a, b.workflow_id AS b, count(*) AS slots FROM s a JOIN s b ON a.dow = b.dow AND a.dom = b.dom AND a.workflow_id < b.workflow_id GROUP BY 1, 2""",
)
def j14_same_slot_schedules(spark, d):
    s = V.workflow_runs(spark, d).where("workflow_id < 12").select("workflow_id", F.dayofweek("created_at").alias("dow"), F.dayofmonth("created_at").alias("dom")).distinct()
    a, b = s.withColumnRenamed("workflow_id", "a"), s.withColumnRenamed("workflow_id", "b")
    return a.join(b, ["dow", "dom"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("slots"))


@query("j15_changed_pins", f"{with_views('recipes')} SELECT a.target_category, a.id AS a, b.id AS b FROM recipes a JOIN recipes b ON a.target_category = b.target_category AND a.confidence <> b.confidence AND a.id < b.id")
def j15_changed_pins(spark, d):
    r = V.recipes(spark, d)
    a = r.select("target_category", F.col("id").alias("a"), F.col("confidence").alias("ca"))
    b = r.select("target_category", F.col("id").alias("b"), F.col("confidence").alias("cb"))
    return a.join(b, "target_category").where("a < b AND ca <> cb").select("target_category", "a", "b")


# --- Aggregations -------------------------------------------------------------------------------


@query("a01_cross_repo_patterns", f"{with_views('patterns')} SELECT category, fingerprint, occurrences, repos_affected FROM patterns WHERE repos_affected >= 3")
def a01_cross_repo_patterns(spark, d):
    return V.patterns(spark, d).where("repos_affected >= 3").select("category", "fingerprint", "occurrences", "repos_affected")


@query("a03_outcome_timeline", f"{with_views('outcomes')} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (outcome = 'false_positive') AS false_positives, count(*) AS total FROM outcomes WHERE recipe_id = 'recipe-3' GROUP BY 1")
def a03_outcome_timeline(spark, d):
    o = V.outcomes(spark, d).where("recipe_id = 'recipe-3'").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return C.outcome_counts(o, "day")


@query(
    "a04_recipe_effectiveness",
    f"""{with_views('outcomes')}, r AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ts, event_id) AS old FROM outcomes),
g AS (SELECT recipe_id, count(*) AS total, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (old <= 10) AS n10, count(*) FILTER (old <= 10 AND outcome = 'success') AS s10 FROM r GROUP BY 1)
SELECT recipe_id, total, successes, s10 AS recent_successes, CASE WHEN s10 * total > (successes * n10 + 0.1::DOUBLE * total * n10) THEN 'improving' WHEN s10 * total < (successes * n10 - 0.1::DOUBLE * total * n10) THEN 'declining' ELSE 'stable' END AS trend FROM g""",
)
def a04_recipe_effectiveness(spark, d):
    """The reference takes the oldest ten as the recent ones; kept."""
    rank = F.row_number().over(Window.partitionBy("recipe_id").orderBy("ts", "event_id"))
    won = F.col("outcome") == "success"
    g = V.outcomes(spark, d).withColumn("old", rank).groupBy("recipe_id").agg(F.count("*").alias("total"), F.count_if(won).alias("successes"), F.count_if(F.col("old") <= 10).alias("n10"), F.count_if((F.col("old") <= 10) & won).alias("recent_successes"))
    here, all_, band = F.col("recent_successes") * F.col("total"), F.col("successes") * F.col("n10"), 0.1 * F.col("total") * F.col("n10")
    trend = F.when(here > all_ + band, "improving").when(here < all_ - band, "declining").otherwise("stable")
    return g.select("recipe_id", "total", "successes", "recent_successes", trend.alias("trend"))


@query("a06_category_distribution", f"{with_views('weak_points')} SELECT category, severity, count(*) AS n, count(DISTINCT location) AS locations FROM weak_points GROUP BY GROUPING SETS ((category, severity), (category))")
def a06_category_distribution(spark, d):
    w = V.weak_points(spark, d).groupingSets([("category", "severity"), ("category",)], "category", "severity")
    return w.agg(F.count("*").alias("n"), F.countDistinct("location").alias("locations"))


@query("a07_recipe_coverage", f"{with_views('patterns', 'recipes')} SELECT count(*) FILTER (category IN (SELECT target_category FROM recipes WHERE auto_fixable)) AS covered, count(*) AS total FROM patterns")
def a07_recipe_coverage(spark, d):
    r = V.recipes(spark, d).where("auto_fixable").select(F.col("target_category").alias("category")).distinct().withColumn("hit", F.lit(1))
    return V.patterns(spark, d).join(r, "category", "left").agg(F.count("hit").alias("covered"), F.count("*").alias("total"))


@query("a08_pipeline_health", f"{with_views('recipes')} SELECT count(*) AS recipes, count(*) FILTER (confidence >= 0.85) AS trusted, count(*) FILTER (confidence >= 0.85 AND auto_fixable) AS auto_executable, avg(confidence) AS mean_confidence FROM recipes")
def a08_pipeline_health(spark, d):
    good = F.col("confidence") >= 0.85
    return V.recipes(spark, d).agg(F.count("*").alias("recipes"), F.count_if(good).alias("trusted"), F.count_if(good & F.col("auto_fixable")).alias("auto_executable"), F.avg("confidence").alias("mean_confidence"))


@query("a10_category_frequency", f"{with_views('weak_points')} SELECT strftime(ts, '%Y-%m') AS cycle, category, count(*) AS n FROM weak_points WHERE category = 'ECONOMY' GROUP BY 1, 2")
def a10_category_frequency(spark, d):
    return V.weak_points(spark, d).where("category = 'ECONOMY'").groupBy(F.date_format("ts", "yyyy-MM").alias("cycle"), "category").agg(F.count("*").alias("n"))


_INDEX = "idx AS (SELECT recipe_id, repo, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (outcome = 'false_positive') AS false_positives, count(*) AS total FROM outcomes GROUP BY 1, 2)"


@query("a11_outcome_index", f"{with_views('outcomes')}, {_INDEX} SELECT * FROM idx")
def a11_outcome_index(spark, d):
    return C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo")


@query("a12_repos_with_fix", f"{with_views('outcomes')}, {_INDEX} SELECT repo, successes, total, successes / total::DOUBLE AS rate FROM idx WHERE recipe_id = 'recipe-5' AND total >= 3")
def a12_repos_with_fix(spark, d):
    g = C.outcome_counts(V.outcomes(spark, d).where("recipe_id = 'recipe-5'"), "repo").where("total >= 3")
    return g.select("repo", "successes", "total", (F.col("successes") / F.col("total")).alias("rate"))


_DAY = "d AS (SELECT * FROM outcomes WHERE ts >= (SELECT max(ts) FROM outcomes) - INTERVAL 24 HOUR)"


def _last_day(spark, d):
    o = V.outcomes(spark, d)
    since = o.agg(F.max("ts") - F.expr("INTERVAL 24 HOURS")).first()[0]
    return o.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))


@query(
    "a13_recipe_degradation",
    f"""{with_views('outcomes')}, {_DAY} SELECT recipe_id, count(*) AS total, count(*) FILTER (outcome <> 'success') AS bad, count(DISTINCT repo) AS repos, CASE WHEN 2 * count(*) FILTER (outcome <> 'success') >= count(*) THEN 'critical' ELSE 'warning' END AS level
FROM d GROUP BY 1 HAVING 10 * count(*) FILTER (outcome <> 'success') >= 3 * count(*) AND count(DISTINCT repo) >= 5""",
)
def a13_recipe_degradation(spark, d):
    g = _last_day(spark, d).groupBy("recipe_id").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") != "success").alias("bad"), F.countDistinct("repo").alias("repos"))
    return g.where("10 * bad >= 3 * total AND repos >= 5").withColumn("level", F.when(2 * F.col("bad") >= F.col("total"), "critical").otherwise("warning"))


@query("a14_family_anomalies", f"{with_views('outcomes', 'repo_language')} SELECT family, count(*) AS total, count(*) FILTER (outcome <> 'success') AS bad, count(DISTINCT o.repo) AS repos FROM outcomes o JOIN repo_language l ON l.repo = o.repo GROUP BY 1 HAVING 10 * count(*) FILTER (outcome <> 'success') >= 3 * count(*)")
def a14_family_anomalies(spark, d):
    g = V.outcomes(spark, d).join(V.repo_language(spark, d), "repo").groupBy("family").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") != "success").alias("bad"), F.countDistinct("repo").alias("repos"))
    return g.where("10 * bad >= 3 * total")


_VERIFY = """v AS (SELECT recipe_id, count(*) AS total, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'success' AND verification = 'verified') AS good,
  count(*) FILTER (outcome = 'success' AND verification IN ('verified', 'still_present')) AS checked FROM outcomes GROUP BY 1)"""


def _verification(spark, d):
    won = F.col("outcome") == "success"
    return V.outcomes(spark, d).groupBy("recipe_id").agg(F.count("*").alias("total"), F.count_if(won).alias("successes"), F.count_if(won & (F.col("verification") == "verified")).alias("good"), F.count_if(won & F.col("verification").isin("verified", "still_present")).alias("checked"))


@query("a15_verification_rate", f"{with_views('outcomes')}, {_VERIFY} SELECT recipe_id, good, checked, CASE WHEN checked < 5 THEN NULL ELSE good / checked::DOUBLE END AS rate FROM v")
def a15_verification_rate(spark, d):
    return _verification(spark, d).select("recipe_id", "good", "checked", F.when(F.col("checked") >= 5, F.col("good") / F.col("checked")).alias("rate"))


@query("a16_recipe_health", f"{with_views('outcomes')}, {_VERIFY} SELECT recipe_id, successes / total::DOUBLE AS success_rate, CASE WHEN checked < 5 THEN 'insufficient' WHEN good < 0.3 * checked THEN 'quarantine' WHEN good < 0.7 * checked THEN 'degraded' ELSE 'healthy' END AS status FROM v")
def a16_recipe_health(spark, d):
    rate, n = F.col("good"), F.col("checked")
    status = F.when(n < 5, "insufficient").when(rate < 0.3 * n, "quarantine").when(rate < 0.7 * n, "degraded").otherwise("healthy")
    return _verification(spark, d).select("recipe_id", (F.col("successes") / F.col("total")).alias("success_rate"), status.alias("status"))


@query(
    "a17_routed_summary",
    f"""{with_views('patterns', 'recipes')}, b AS (SELECT target_category, max(confidence) AS confidence FROM recipes GROUP BY 1),
r AS (SELECT p.*, b.confidence, CASE WHEN b.confidence >= 0.9 THEN 'eliminate' WHEN b.confidence IS NOT NULL THEN 'substitute' ELSE 'control' END AS tier FROM patterns p LEFT JOIN b ON b.target_category = p.category)
SELECT tier, count(*) AS n, count(*) FILTER (tier = 'eliminate' AND confidence >= 0.95) AS automatic FROM r GROUP BY 1""",
)
def a17_routed_summary(spark, d):
    return _routed(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_if((F.col("tier") == "eliminate") & (F.col("confidence") >= 0.95)).alias("automatic"))


def _routed(spark, d):
    best = V.recipes(spark, d).groupBy(F.col("target_category").alias("category")).agg(F.max("confidence").alias("confidence"))
    tier = F.when(F.col("confidence") >= 0.9, "eliminate").when(F.col("confidence").isNotNull(), "substitute").otherwise("control")
    return V.patterns(spark, d).join(best, "category", "left").withColumn("tier", tier)


@query("a20_severity_summary", f"{with_views('alerts')} SELECT repo, severity, count(*) AS n FROM alerts WHERE state = 'open' GROUP BY 1, 2 HAVING (severity = 'critical' AND count(*) > 0) OR (severity = 'high' AND count(*) >= 5)")
def a20_severity_summary(spark, d):
    g = V.alerts(spark, d).where("state = 'open'").groupBy("repo", "severity").agg(F.count("*").alias("n"))
    return g.where("severity = 'critical' OR (severity = 'high' AND n >= 5)")


@query("a22_scan_summary", f"{with_views('weak_points')} SELECT severity, category, count(*) AS n FROM weak_points GROUP BY GROUPING SETS ((severity), (category), ())")
def a22_scan_summary(spark, d):
    w = V.weak_points(spark, d).groupingSets([("severity",), ("category",), ()], "severity", "category")
    return w.agg(F.count("*").alias("n"))


@query("a24_conformance_score", f"{with_views('outcomes')} SELECT repo, 100.0::DOUBLE * sum(CASE outcome WHEN 'success' THEN 2 WHEN 'false_positive' THEN 1 ELSE 0 END) / (2 * count(*)) AS score FROM outcomes WHERE verification <> 'unverified' GROUP BY 1")
def a24_conformance_score(spark, d):
    points = F.when(F.col("outcome") == "success", 2).when(F.col("outcome") == "false_positive", 1).otherwise(0)
    return V.outcomes(spark, d).where("verification <> 'unverified'").groupBy("repo").agg((100.0 * F.sum(points) / (2 * F.count("*"))).alias("score"))


@query("a27_most_frequent_fix", f"{with_views('outcomes')}, c AS (SELECT repo, recipe_id, count(*) AS n FROM outcomes WHERE outcome = 'success' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, recipe_id) AS k FROM c) SELECT repo, recipe_id, n FROM k WHERE k = 1")
def a27_most_frequent_fix(spark, d):
    g = V.outcomes(spark, d).where("outcome = 'success'").groupBy("repo", "recipe_id").agg(F.count("*").alias("n"))
    best = g.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("m"), "recipe_id")).alias("x"))
    return best.select("repo", "x.recipe_id", (-F.col("x.m")).alias("n"))


@query("a28_promote_patterns", f"{with_views('outcomes')}, {_INDEX} SELECT recipe_id, repo, successes, total FROM idx WHERE total >= 5 AND successes >= 0.75 * total AND NOT false_positives > 0.3 * total")
def a28_promote_patterns(spark, d):
    g = C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo")
    return g.where("total >= 5 AND successes >= 0.75 * total AND NOT false_positives > 0.3 * total").select("recipe_id", "repo", "successes", "total")


@query("a29_keywords", f"{with_views('weak_points')}, k AS (SELECT category, unnest(string_split(lower(description), ' ')) AS word FROM weak_points), c AS (SELECT category, word, count(*) AS n FROM k WHERE length(word) >= 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS r FROM c) SELECT category, word, n FROM r WHERE r <= 5")
def a29_keywords(spark, d):
    k = V.weak_points(spark, d).select("category", F.explode(F.split(F.lower("description"), " ")).alias("word")).where(F.length("word") >= 4)
    c = k.groupBy("category", "word").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.col("n").desc(), "word"))).where("r <= 5").drop("r")


@query("a31_duplicate_contents", "SELECT md5(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a31_duplicate_contents(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# --- Windows ------------------------------------------------------------------------------------


@query("w01_weak_point_trend", f"{with_views('scan_history')} SELECT repo, strftime(cycle, '%Y-%m-%d') AS cycle, weak_point_count, weak_point_count - coalesce(lag(weak_point_count) OVER (PARTITION BY repo ORDER BY cycle), weak_point_count) AS delta FROM scan_history")
def w01_weak_point_trend(spark, d):
    before = F.lag("weak_point_count").over(Window.partitionBy("repo").orderBy("cycle"))
    return V.scan_history(spark, d).select("repo", F.date_format("cycle", "yyyy-MM-dd").alias("cycle"), "weak_point_count", (F.col("weak_point_count") - F.coalesce(before, "weak_point_count")).alias("delta"))


@query(
    "w02_latest_z_score",
    f"""{with_views('scan_history')}, g AS (SELECT repo, count(*) AS n, sum(weak_point_count)::BIGINT AS s, sum(weak_point_count * weak_point_count)::BIGINT AS q, arg_max(weak_point_count, cycle) AS latest FROM scan_history GROUP BY 1)
SELECT repo, n, latest, (n * latest - s) / sqrt((n * q - s * s)::DOUBLE) AS z FROM g WHERE n >= 3 AND n * q > s * s""",
)
def w02_latest_z_score(spark, d):
    """z of the latest cycle in units of the population deviation; sums are integers, so engines agree."""
    c = F.col("weak_point_count")
    g = V.scan_history(spark, d).groupBy("repo").agg(F.count("*").alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("q"), F.max_by("weak_point_count", "cycle").alias("latest"))
    spread = F.col("n") * F.col("q") - F.col("s") * F.col("s")
    return g.where((F.col("n") >= 3) & (spread > 0)).select("repo", "n", "latest", ((F.col("n") * F.col("latest") - F.col("s")) / F.sqrt(spread.cast("double"))).alias("z"))


@query("w03_running_rate", f"{with_views('outcomes')}, r AS (SELECT recipe_id, event_id, count(*) OVER w AS n, count(*) FILTER (outcome = 'success') OVER w AS s FROM outcomes WINDOW w AS (PARTITION BY recipe_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT recipe_id, event_id, n, s / n::DOUBLE AS rate FROM r WHERE n >= 10")
def w03_running_rate(spark, d):
    w = Window.partitionBy("recipe_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    o = V.outcomes(spark, d).withColumn("n", F.count("*").over(w)).withColumn("s", F.count_if(F.col("outcome") == "success").over(w))
    return o.where("n >= 10").select("recipe_id", "event_id", "n", (F.col("s") / F.col("n")).alias("rate"))


@query(
    "w04_confidence_trend",
    f"""{with_views('outcomes')}, r AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ts DESC, event_id DESC) AS k FROM outcomes), g AS (SELECT recipe_id, count(*) AS n, count(*) FILTER (outcome = 'success') AS s FROM r WHERE k <= 10 GROUP BY 1)
SELECT recipe_id, n, s, CASE WHEN n < 3 THEN 'insufficient' WHEN 10 * s >= 8 * n THEN 'improving' WHEN 10 * s <= 4 * n THEN 'declining' ELSE 'stable' END AS trend FROM g""",
)
def w04_confidence_trend(spark, d):
    r = C.recent_window(V.outcomes(spark, d), ["recipe_id"], last(), 10)
    g = r.groupBy("recipe_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("s"))
    return g.withColumn("trend", F.when(F.col("n") < 3, "insufficient").when(F.expr("10 * s >= 8 * n"), "improving").when(F.expr("10 * s <= 4 * n"), "declining").otherwise("stable"))


@query(
    "w05_rate_drop",
    f"""{with_views('outcomes')}, r AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ts DESC, event_id DESC) AS k FROM outcomes),
g AS (SELECT recipe_id, count(*) FILTER (k <= 30) AS nr, count(*) FILTER (k <= 30 AND outcome = 'success') AS sr, count(*) FILTER (k > 30) AS nb, count(*) FILTER (k > 30 AND outcome = 'success') AS sb FROM r WHERE k <= 200 GROUP BY 1)
SELECT recipe_id, (sb / nb::DOUBLE - sr / nr::DOUBLE) / sqrt(greatest(sb / nb::DOUBLE * (1 - sb / nb::DOUBLE) / nr, 0.0001::DOUBLE)) AS sigmas FROM g WHERE nr + nb >= 35""",
)
def w05_rate_drop(spark, d):
    r = C.recent_window(V.outcomes(spark, d), ["recipe_id"], last(), 200)
    new, won = F.col("recency") <= 30, F.col("outcome") == "success"
    g = r.groupBy("recipe_id").agg(F.count_if(new).alias("nr"), F.count_if(new & won).alias("sr"), F.count_if(~new).alias("nb"), F.count_if(~new & won).alias("sb")).where("nr + nb >= 35")
    base, now = F.col("sb") / F.col("nb"), F.col("sr") / F.col("nr")
    return g.select("recipe_id", ((base - now) / F.sqrt(F.greatest(base * (1 - base) / F.col("nr"), F.lit(0.0001)))).alias("sigmas"))


@query("w06_red_baselines", f"{with_views('workflow_runs')}, k AS (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY created_at DESC, o_orderkey DESC) AS k FROM workflow_runs) SELECT workflow_id, o_orderkey FROM k WHERE k = 1 AND conclusion = 'failure'")
def w06_red_baselines(spark, d):
    latest = V.workflow_runs(spark, d).groupBy("workflow_id").agg(F.max(F.struct("created_at", "o_orderkey", "conclusion")).alias("x"))
    return latest.where("x.conclusion = 'failure'").select("workflow_id", "x.o_orderkey")


@query("w07_time_goes_back", "WITH o AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) AS n FROM o WHERE ts <= p GROUP BY 1")
def w07_time_goes_back(spark, d):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return V.table(spark, d, "events").withColumn("p", before).where("ts <= p").groupBy("user_id").agg(F.count("*").alias("n"))


@query("w08_consecutive_failures", f"{with_views('outcomes')}, r AS (SELECT bot, outcome, sum(CASE WHEN outcome = 'failure' THEN 0 ELSE 1 END) OVER (PARTITION BY bot ORDER BY ts DESC, event_id DESC) AS other FROM outcomes) SELECT bot, count(*) FILTER (other = 0) AS streak FROM r GROUP BY 1")
def w08_consecutive_failures(spark, d):
    other = F.sum(F.when(F.col("outcome") == "failure", 0).otherwise(1)).over(Window.partitionBy("bot").orderBy(*last()).rowsBetween(Window.unboundedPreceding, 0))
    return V.outcomes(spark, d).withColumn("other", other).groupBy("bot").agg(F.count_if(F.col("other") == 0).alias("streak"))


@query("w14_sliding_counts", f"{with_views('outcomes')}, r AS (SELECT bot, event_id, count(*) OVER (PARTITION BY bot ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM outcomes) SELECT bot, max(n) AS busiest FROM r GROUP BY 1")
def w14_sliding_counts(spark, d):
    o = V.outcomes(spark, d).withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    n = F.count("*").over(Window.partitionBy("bot").orderBy("s").rangeBetween(-3600, 0))
    return o.withColumn("n", n).groupBy("bot").agg(F.max("n").alias("busiest"))


# --- Confidence, routing, graph, content -------------------------------------------------------


@query("b01_bayes", f"{with_views('outcomes')} SELECT recipe_id, least(0.99::DOUBLE, greatest(0.1::DOUBLE, (5.0::DOUBLE + count(*) FILTER (outcome = 'success')) / (10 + count(*)))) AS confidence FROM outcomes GROUP BY 1")
def b01_bayes(spark, d):
    g = C.outcome_counts(V.outcomes(spark, d), "recipe_id")
    return g.select("recipe_id", C.bayes(F.lit(0.5), F.col("successes"), F.col("failures") + F.col("false_positives")).alias("confidence"))


@query("b03_stages", f"{with_views('outcomes')}, {_INDEX} SELECT recipe_id, repo, total, CASE WHEN total >= 50 THEN 'veteran' WHEN total >= 15 THEN 'mature' WHEN total >= 5 THEN 'adolescent' ELSE 'nascent' END AS stage FROM idx")
def b03_stages(spark, d):
    return C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo").select("recipe_id", "repo", "total", C.stage(F.col("total")).alias("stage"))


@query("b04_anneal", f"{with_views('recipes')}, t AS (SELECT id, least(0.999::DOUBLE, greatest(0.001::DOUBLE, confidence)) AS p FROM recipes) SELECT id, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.5::DOUBLE)), 6) AS annealed FROM t")
def b04_anneal(spark, d):
    return V.recipes(spark, d).select("id", F.round(C.anneal(F.col("confidence"), F.lit(0.5)), 6).alias("annealed"))


@query("b07_clamped_strategy", f"{with_views('recipes')}, {_INDEX.replace('FROM outcomes', 'FROM o')}".replace("WITH recipes", f"{with_views('outcomes')}, o AS (SELECT * FROM outcomes), recipes") + " SELECT idx.recipe_id, idx.repo, CASE WHEN total < 5 OR confidence < 0.85 THEN 'report_only' WHEN total < 15 OR confidence < 0.95 THEN 'review' ELSE 'auto_execute' END AS strategy FROM idx JOIN recipes ON id = recipe_id")
def b07_clamped_strategy(spark, d):
    g = C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo").join(V.recipes(spark, d), F.col("id") == F.col("recipe_id"))
    return g.select("recipe_id", "repo", C.clamp_strategy(C.strategy(F.col("confidence")), C.stage(F.col("total"))).alias("strategy"))


@query(
    "b08_transferred",
    f"""{with_views('outcomes')}, {_INDEX}, t AS (SELECT recipe_id, sum(successes)::BIGINT AS s, sum(total)::BIGINT AS n FROM idx WHERE total >= 3 GROUP BY 1), e AS (SELECT i.recipe_id, i.repo, coalesce(s, 0) - CASE WHEN total >= 3 THEN successes ELSE 0 END AS s, coalesce(n, 0) - CASE WHEN total >= 3 THEN total ELSE 0 END AS n FROM idx i LEFT JOIN t ON t.recipe_id = i.recipe_id)
SELECT recipe_id, repo, CASE WHEN n > 0 THEN s * 0.75::DOUBLE / (n * 0.75::DOUBLE) END AS transferred FROM e""",
)
def b08_transferred(spark, d):
    return C.transferred(C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo"), 0.75)


@query("r01_triangle_route", ORACLE["a17_routed_summary"].replace("SELECT tier, count(*) AS n, count(*) FILTER (tier = 'eliminate' AND confidence >= 0.95) AS automatic FROM r GROUP BY 1", "SELECT category, fingerprint, tier FROM r"))
def r01_triangle_route(spark, d):
    return _routed(spark, d).select("category", "fingerprint", "tier")


@query("r02_dispatch_strategy", f"{with_views('recipes')} SELECT id, CASE WHEN confidence >= 0.95 THEN 'auto_execute' WHEN confidence >= 0.85 THEN 'review' ELSE 'report_only' END AS strategy FROM recipes")
def r02_dispatch_strategy(spark, d):
    return V.recipes(spark, d).select("id", C.strategy(F.col("confidence")).alias("strategy"))


@query("g01_trust_edges", f"{with_views('outcomes')}, s AS (SELECT * FROM outcomes WHERE outcome = 'success'), e AS (SELECT recipe_id AS src, repo AS dst, 1.0::DOUBLE AS w FROM s UNION ALL SELECT bot, recipe_id, 1.0 FROM s UNION ALL SELECT repo, bot, 0.5 FROM s) SELECT src, dst, sum(w) AS weight FROM e GROUP BY 1, 2")
def g01_trust_edges(spark, d):
    return G.trust_edges(V.outcomes(spark, d)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@query("g03_trust_rank")
def g03_trust_rank(spark, d):
    return G.page_rank(G.trust_edges(V.outcomes(spark, d)))


@query("g07_out_degree", f"{with_views('outcomes')}, s AS (SELECT * FROM outcomes WHERE outcome = 'success'), e AS (SELECT recipe_id AS src FROM s UNION ALL SELECT bot FROM s UNION ALL SELECT repo FROM s) SELECT src, count(*) / (SELECT count(*) FROM e)::DOUBLE AS centrality FROM e GROUP BY 1")
def g07_out_degree(spark, d):
    e = G.trust_edges(V.outcomes(spark, d))
    total = e.count()
    return e.groupBy("src").agg((F.count("*") / total).alias("centrality"))


#: (rule, severity, pattern): a pattern both engines read alike.
CONTENT_RULES = (
    ("aws_key", "critical", "AKIA[0-9A-Z]{16}"),
    ("private_key", "critical", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("email", "low", "[A-Za-z0-9._]+@[A-Za-z0-9.-]+[.][a-z]{2,}"),
    ("long_number", "medium", "[0-9]{13,16}"),
    ("license_line", "info", "[Ll]icensed under"),
)


@query("x01_content_rules", f"{with_views('file_lines')} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, count(*) FILTER (regexp_matches(line, '{p}')) AS lines, coalesce(sum(len(regexp_extract_all(line, '{p}'))), 0)::BIGINT AS hits FROM file_lines" for r, s, p in CONTENT_RULES))
def x01_content_rules(spark, d):
    """One pass over the lines: an array of (rule, severity, hits), exploded after the sums."""
    lines = V.file_lines(spark, d)
    sums = lines.agg(*[f for r, _, p in CONTENT_RULES for f in (F.count_if(F.col("line").rlike(p)).alias(f"l_{r}"), F.sum(F.regexp_count("line", F.lit(p))).alias(f"h_{r}"))])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(f"l_{r}").alias("lines"), F.coalesce(F.col(f"h_{r}"), F.lit(0)).cast("long").alias("hits")) for r, s, _ in CONTENT_RULES])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


@query("x04_lines_with_context", f"{with_views('file_lines')}, l AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM file_lines) SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '{CONTENT_RULES[2][2]}') AND NOT coalesce(regexp_matches(before, '{CONTENT_RULES[4][2]}'), false)")
def x04_lines_with_context(spark, d):
    """Hits whose previous line doesn't allow them."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    hit = F.col("line").rlike(CONTENT_RULES[2][2]) & ~F.coalesce(F.col("before").rlike(CONTENT_RULES[4][2]), F.lit(False))
    return V.file_lines(spark, d).withColumn("before", before).where(hit).select("doc_id", "line_no")


@query("t01_tumbling_counts", "SELECT event_type, floor(epoch(ts))::BIGINT // 3600 * 3600 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def t01_tumbling_counts(spark, d):
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600
    return V.table(spark, d, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("t02_recent_50", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type, event_id, k FROM k WHERE k <= 50")
def t02_recent_50(spark, d):
    e = C.recent_window(V.table(spark, d, "events"), ["event_type"], last(), 50)
    return e.select("event_type", "event_id", F.col("recency").cast("long").alias("k"))
