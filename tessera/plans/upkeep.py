"""Registered queries that follow the whole of rules which older queries take in part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import confidence as C
from tessera.operators.intervals import window_totals
from tessera.plans.governance import _ACTIONS, actions
from tessera.plans.queries import query
from tessera.plans.routing import _BOOK, recipe_book
from tessera.plans.stores import _field, _fresh, _stores
from tessera.sources import stores as S
from tessera.sources import views as V
from tessera.sources.views import with_views

# --- Joins ---------------------------------------------------------------------------------------

_CRON = "c AS (SELECT o_orderkey AS id, 'repo-' || o_custkey AS repo, o_custkey % 24 AS hour, o_orderkey % 6 * 10 AS minute, CASE WHEN o_orderkey % 5 < 3 THEN '*' ELSE (o_orderkey % 7)::VARCHAR END AS dow FROM orders)"


@query("j14_shadowed_schedules", f"WITH {_CRON}, d AS (SELECT repo, hour, minute, count(*) AS daily, min(id) AS first_daily FROM c WHERE dow = '*' GROUP BY ALL) SELECT id, repo, dow, daily, first_daily FROM c JOIN d USING (repo, hour, minute) WHERE dow <> '*'")
def j14_shadowed_schedules(spark, d):
    """Schedules of single days at a time at which the repository runs daily anyway; daily ones are counted before the join."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dow = F.when(k % 5 < 3, "*").otherwise((k % 7).cast("string"))
    s = V.table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("repo-"), c).alias("repo"), (c % 24).alias("hour"), (k % 6 * 10).alias("minute"), dow.alias("dow"))
    daily = s.where("dow = '*'").groupBy("repo", "hour", "minute").agg(F.count("*").alias("daily"), F.min("id").alias("first_daily"))
    return s.where("dow <> '*'").join(daily, ["repo", "hour", "minute"]).select("id", "repo", "dow", "daily", "first_daily")


@query(
    "j07_overlapping_windows",
    f"""{with_views('outcomes')}, b AS (SELECT floor(epoch(min(ts)))::BIGINT AS t0 FROM outcomes), w AS (SELECT 'plan-' || s_suppkey AS strategy, t0 + s_suppkey * 7919 % 2160000 AS s, t0 + s_suppkey * 7919 % 2160000 + s_suppkey % 6 * 3600 AS e FROM supplier, b)
SELECT coalesce(strategy, 'unknown') AS strategy, count(*) AS total, count(*) FILTER (outcome = 'success') AS successes, count(DISTINCT recipe_id) FILTER (verification = 'still_present') AS still_present FROM outcomes LEFT JOIN w ON floor(epoch(ts))::BIGINT >= s AND floor(epoch(ts))::BIGINT < e GROUP BY 1""",
)
def j07_overlapping_windows(spark, d):
    """Outcomes by the strategies in whose windows they fall; windows overlap, and some have no length."""
    o = V.outcomes(spark, d).select("event_id", "recipe_id", "outcome", "verification", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    k = F.col("s_suppkey")
    base = F.broadcast(o.agg(F.min("at").alias("t0")))
    start = F.col("t0") + k * 7919 % 2160000
    w = V.table(spark, d, "supplier").crossJoin(base).select(F.concat(F.lit("plan-"), k).alias("strategy"), start.alias("start"), (start + k % 6 * 3600).alias("end"))
    o = o.select("at", F.when(F.col("verification") == "still_present", F.col("recipe_id")).alias("item"), "outcome")
    return window_totals(o, w, 6 * 3600, {"successes": F.col("outcome") == "success"}).withColumnRenamed("items", "still_present")


# --- Outcomes ------------------------------------------------------------------------------------

@query("a14_recent_families", f"{with_views('outcomes', 'repo_language')}, n AS (SELECT max(ts) AS now FROM outcomes), r AS (SELECT * FROM outcomes, n WHERE ts > now - INTERVAL 1 DAY) SELECT family, count(*) AS total, count(*) FILTER (outcome <> 'success') AS bad, count(DISTINCT r.repo) AS repos FROM r JOIN repo_language l ON l.repo = r.repo GROUP BY 1 HAVING 10 * count(*) FILTER (outcome <> 'success') >= 3 * count(*) AND count(DISTINCT r.repo) >= 5")
def a14_recent_families(spark, d):
    """Families of languages with three bad outcomes of ten within the last day, in five repositories at least."""
    o = V.outcomes(spark, d)
    recent = o.crossJoin(F.broadcast(o.agg(F.max("ts").alias("now")))).where("ts > now - INTERVAL 1 DAY")
    g = recent.join(V.repo_language(spark, d), "repo").groupBy("family").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") != "success").alias("bad"), F.countDistinct("repo").alias("repos"))
    return g.where("10 * bad >= 3 * total AND repos >= 5")


@query("b04_heated_confidence", f"""{with_views('outcomes')}, g AS (SELECT recipe_id, repo, count(*) AS n, count(*) FILTER (outcome = 'success') / count(*)::DOUBLE AS raw FROM outcomes GROUP BY ALL), t AS (SELECT *, least(0.999::DOUBLE, greatest(0.001::DOUBLE, raw)) AS p, greatest(exp(-0.05::DOUBLE * n), 0.01::DOUBLE) AS heat FROM g)
SELECT recipe_id, repo, round(1 / (1 + exp(-ln(p / (1 - p)) / (1 + heat))), 6) AS own, round(1 / (1 + exp(-ln(p / (1 - p)) / (1 + 2 * heat))), 6) AS elsewhere FROM t""")
def b04_heated_confidence(spark, d):
    """Success rates annealed by the heat of their number of attempts; for other repositories the heat counts twice."""
    g = V.outcomes(spark, d).groupBy("recipe_id", "repo").agg(F.count("*").alias("n"), (F.count_if(F.col("outcome") == "success") / F.count("*")).alias("raw"))
    heat = F.greatest(F.exp(-0.05 * F.col("n")), F.lit(0.01))
    return g.select("recipe_id", "repo", F.round(C.anneal(F.col("raw"), heat), 6).alias("own"), F.round(C.anneal(F.col("raw"), 2 * heat), 6).alias("elsewhere"))


@query("w07_refused_times", "WITH o AS (SELECT event_id, user_id, epoch_us(ts) - CASE WHEN event_id % 10 = 0 THEN json_extract_string(props, '$.k')::BIGINT * 3600000000 ELSE 0 END AS told FROM events), m AS (SELECT *, max(told) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tail FROM o) SELECT event_id, user_id, tail - told AS behind FROM m WHERE told <= tail")
def w07_refused_times(spark, d):
    """Records of a log whose time isn't later than the latest before them; a tenth of the clocks are slow."""
    slow = F.when(F.col("event_id") % 10 == 0, F.get_json_object("props", "$.k").cast("long") * 3_600_000_000).otherwise(0)
    o = V.table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) - slow).alias("told"))
    tail = F.max("told").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return o.withColumn("tail", tail).where("told <= tail").select("event_id", "user_id", (F.col("tail") - F.col("told")).alias("behind"))


@query("f10_recipe_filters", f"WITH {_BOOK} SELECT 'tier' AS filter, id, confidence FROM book WHERE tier = 'eliminate' UNION ALL SELECT 'confidence', id, confidence FROM book WHERE confidence >= 0.9")
def f10_recipe_filters(spark, d):
    """Recipes of a tier, and recipes that are sure enough."""
    book = recipe_book(spark, d)
    parts = [book.where("tier = 'eliminate'").select(F.lit("tier").alias("filter"), "id", "confidence"), book.where("confidence >= 0.9").select(F.lit("confidence").alias("filter"), "id", "confidence")]
    return parts[0].unionByName(parts[1])


# --- Contingency ---------------------------------------------------------------------------------

_SAID = "s AS (SELECT event_id, 'bot-' || (user_id % 60) AS bot, event_type = 'error' AS isolates FROM events WHERE event_type IN ('error', 'signup'))"


@query("k06_isolated", f"WITH {_SAID}, l AS (SELECT bot, arg_max(isolates, event_id) AS isolated, count(*) AS messages FROM s GROUP BY bot), r AS (SELECT s.event_id, s.bot, lag(isolates) OVER (PARTITION BY bot ORDER BY event_id) AS before, isolates FROM s), e AS (SELECT bot, count(*) FILTER (NOT isolates AND NOT coalesce(before, false)) AS errors FROM r GROUP BY bot) SELECT bot, isolated, messages, errors FROM l JOIN e USING (bot)")
def k06_isolated(spark, d):
    """Bots by what was last said of them, and how often one was restored that wasn't isolated."""
    said = V.table(spark, d, "events").where("event_type IN ('error', 'signup')").select("event_id", F.concat(F.lit("bot-"), F.col("user_id") % 60).alias("bot"), (F.col("event_type") == "error").alias("isolates"))
    before = F.lag("isolates").over(Window.partitionBy("bot").orderBy("event_id"))
    rows = said.withColumn("vain", ~F.col("isolates") & ~F.coalesce(before, F.lit(False)))
    return rows.groupBy("bot").agg(F.max_by("isolates", "event_id").alias("isolated"), F.count("*").alias("messages"), F.count_if("vain").alias("errors"))


@query("k06_rollback_wave", f"{with_views('outcomes')}, g AS (SELECT repo, count(*) FILTER (outcome = 'failure') AS bad, count(*) AS n FROM outcomes GROUP BY repo), w AS (SELECT repo FROM g WHERE 4 * bad >= n), l AS (SELECT repo, strftime(max(ts), '%Y-%m-%d') AS batch FROM outcomes GROUP BY repo) SELECT w.repo, batch, count(*) FILTER (outcome = 'success') AS undone, CASE WHEN count(*) FILTER (outcome = 'success') > 0 THEN 'ok' ELSE 'nothing to undo' END AS result FROM w JOIN l USING (repo) JOIN outcomes o ON o.repo = w.repo AND strftime(o.ts, '%Y-%m-%d') = batch GROUP BY ALL")
def k06_rollback_wave(spark, d):
    """For every repository that fails one time in four: its last day's successes become false positives."""
    o = V.outcomes(spark, d).withColumn("batch", F.date_format("ts", "yyyy-MM-dd"))
    bad = o.groupBy("repo").agg(F.count_if(F.col("outcome") == "failure").alias("bad"), F.count("*").alias("n"), F.max("batch").alias("batch")).where("4 * bad >= n").select("repo", "batch")
    g = o.join(bad, ["repo", "batch"]).groupBy("repo", "batch").agg(F.count_if(F.col("outcome") == "success").alias("undone"))
    return g.withColumn("result", F.when(F.col("undone") > 0, "ok").otherwise("nothing to undo"))


# --- Stores --------------------------------------------------------------------------------------

@query("s01_json_folder", "SELECT p_type AS category, count(*) AS parts FROM part WHERE p_type LIKE 'S%' OR p_type LIKE 'L%' GROUP BY 1")
def s01_json_folder(spark, d):
    """A document a file, one folder for each first letter; the folders asked for are read by a glob, and a file that is no JSON is left out."""
    path = _fresh(spark, "folder")
    docs = V.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("parts")).select(F.to_json(F.struct(F.col("p_type").alias("category"), "parts")).alias("value"), F.substring("p_type", 1, 1).alias("letter"), F.col("p_type").alias("name"))
    docs.unionByName(docs.withColumns({"value": F.lit("{broken"), "name": F.concat("name", F.lit("-broken"))})).write.partitionBy("letter", "name").text(path)
    return S.json_folder(spark, f"{path}/letter=[SL]/*", suffix=".txt").select(_field("category"), _field("parts", "long"))


@query("s04_store_dispatch", f"{with_views('patterns', 'recipes', 'outcomes')} SELECT 'outcomes' AS store, count(*) AS n FROM outcomes UNION ALL SELECT 'patterns', count(*) FROM patterns UNION ALL SELECT 'recipes', count(*) FROM recipes UNION ALL SELECT 'scans', count(*) FROM weak_points")
def s04_store_dispatch(spark, d):
    """Every store by its name; a name without a store is an error, which tests hold."""
    known = _stores(spark, d)
    parts = [S.dispatch(known, name).agg(F.lit(name).alias("store"), F.count("*").alias("n")) for name in sorted(known)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s12_scan_snapshots", f"{with_views('scan_history')} SELECT strftime(cycle, '%Y-%m') AS period, count(DISTINCT cycle) AS scans, count(*) AS repo_rows, sum(weak_point_count)::BIGINT AS total_weak_points FROM scan_history GROUP BY 1")
def s12_scan_snapshots(spark, d):
    """Scans appended as JSON lines under their time, in two calls, one line for each repository of a scan."""
    path = _fresh(spark, "snapshots")
    h = V.scan_history(spark, d).withColumn("scan_id", F.concat(F.lit("scan-"), F.date_format("cycle", "yyyyMMdd"))).withColumn("odd", F.dayofmonth("cycle") % 2)
    for half in (0, 1):
        S.append_log(h.where(F.col("odd") == half).drop("odd"), path, ts="cycle")
    rows = S.json_lines(spark, path).select(_field("scan_id"), _field("weak_point_count", "long"))
    period = F.concat_ws("-", F.substring("scan_id", 6, 4), F.substring("scan_id", 10, 2))
    return rows.groupBy(period.alias("period")).agg(F.countDistinct("scan_id").alias("scans"), F.count("*").alias("repo_rows"), F.sum("weak_point_count").alias("total_weak_points"))


@query("s14_dated_manifests", f"WITH {_ACTIONS}, k AS (SELECT strategy, action_id % 2 AS half FROM actions), c AS (SELECT strategy, count(*) FILTER (half = 1) AS pending, count(*) AS archived FROM k GROUP BY 1) SELECT strategy, pending, archived, 2 AS days FROM c")
def s14_dated_manifests(spark, d):
    """Two manifests on two days: the counts that the second one returns, and what the archive keeps of both."""
    path, kept = _fresh(spark, "pending"), _fresh(spark, "archive")
    a = actions(spark, d).select("action_id", "strategy", "repo")
    for half, day in ((0, "2024-01-01"), (1, "2024-01-02")):
        counts = S.write_manifest(a.where(F.col("action_id") % 2 == half), path, kept, day)
    archive = spark.read.json(kept).groupBy("strategy").agg(F.count("*").alias("archived"), F.countDistinct("day").cast("int").alias("days"))
    return counts.withColumnRenamed("n", "pending").join(archive, "strategy")
