"""Further registered queries: trends, set operations, gates, routing, and model expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import confidence as C
from tessera.operators import graph as G
from tessera.plans.queries import _INDEX, last, query
from tessera.sources import views as V
from tessera.sources.views import with_views
from tessera.streaming import windows as S


@query("a09_scan_snapshot", f"{with_views('weak_points')} SELECT repo, category, count(*) AS n FROM weak_points GROUP BY ROLLUP (repo, category)")
def a09_scan_snapshot(spark, d):
    return V.weak_points(spark, d).rollup("repo", "category").agg(F.count("*").alias("n"))


@query(
    "a19_strategy_effectiveness",
    f"""{with_views('outcomes')} SELECT CASE WHEN event_id % 3 = 0 THEN 'plan-a' ELSE 'plan-b' END AS strategy, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (outcome = 'success') / count(*) AS success_percent,
  count(*) FILTER (verification = 'verified') AS verified, count(DISTINCT recipe_id) FILTER (verification = 'still_present') AS open_recipes FROM outcomes GROUP BY 1""",
)
def a19_strategy_effectiveness(spark, d):
    name = F.when(F.col("event_id") % 3 == 0, "plan-a").otherwise("plan-b")
    won = F.count_if(F.col("outcome") == "success")
    return V.outcomes(spark, d).groupBy(name.alias("strategy")).agg(F.count("*").alias("total"), (100.0 * won / F.count("*")).alias("success_percent"), F.count_if(F.col("verification") == "verified").alias("verified"), F.countDistinct(F.when(F.col("verification") == "still_present", F.col("recipe_id"))).alias("open_recipes"))


@query("a21_batch_summary", f"{with_views('alerts')} SELECT state, count(*) AS n, count(DISTINCT repo) AS repos FROM alerts GROUP BY state")
def a21_batch_summary(spark, d):
    return V.alerts(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


@query("a23_backlog", f"{with_views('alerts')} SELECT repo, count(*) FILTER (state = 'open' AND severity IN ('critical', 'high')) AS eligible, count(*) FILTER (state = 'open' AND severity NOT IN ('critical', 'high')) AS waiting, count(*) FILTER (state <> 'open') AS closed FROM alerts GROUP BY repo HAVING count(*) FILTER (state = 'open' AND severity IN ('critical', 'high')) >= 50")
def a23_backlog(spark, d):
    open_, hot = F.col("state") == "open", F.col("severity").isin("critical", "high")
    g = V.alerts(spark, d).groupBy("repo").agg(F.count_if(open_ & hot).alias("eligible"), F.count_if(open_ & ~hot).alias("waiting"), F.count_if(~open_).alias("closed"))
    return g.where("eligible >= 50")


@query("a33_council", f"{with_views('outcomes')} SELECT recipe_id, sum(CASE WHEN bot = 'bot-0' THEN 2 ELSE 1 END * (event_id % 10))::DOUBLE / sum(CASE WHEN bot = 'bot-0' THEN 2 ELSE 1 END) AS confidence, list_sort(list(DISTINCT bot) FILTER (outcome = 'failure')) AS vetoes FROM outcomes GROUP BY 1")
def a33_council(spark, d):
    """Weighted mean of the approvals, and who objects."""
    weight = F.when(F.col("bot") == "bot-0", 2).otherwise(1)
    return V.outcomes(spark, d).groupBy("recipe_id").agg((F.sum(weight * (F.col("event_id") % 10)) / F.sum(weight)).alias("confidence"), F.sort_array(F.collect_set(F.when(F.col("outcome") == "failure", F.col("bot")))).alias("vetoes"))


@query("a34_utilization", f"{with_views('outcomes')} SELECT bot, count(*) / sum(count(*)) OVER ()::DOUBLE AS share, count(*) FILTER (outcome = 'success') / count(*)::DOUBLE AS accuracy FROM outcomes GROUP BY bot")
def a34_utilization(spark, d):
    o = V.outcomes(spark, d)
    total = o.count()
    return o.groupBy("bot").agg((F.count("*") / total).alias("share"), (F.count_if(F.col("outcome") == "success") / F.count("*")).alias("accuracy"))


_LAST20 = "k AS (SELECT recipe_id, event_id % 100 AS x, row_number() OVER (PARTITION BY recipe_id ORDER BY ts DESC, event_id DESC) AS k FROM outcomes)"


def _last20(spark, d):
    return C.recent_window(V.outcomes(spark, d), ["recipe_id"], last(), 20).select("recipe_id", (F.col("event_id") % 100).alias("x"), F.col("recency").alias("k"))


@query("w10_half_split", f"{with_views('outcomes')}, {_LAST20} SELECT recipe_id, sum(x) FILTER (k <= 10)::BIGINT AS newer, sum(x) FILTER (k > 10)::BIGINT AS older, CASE WHEN sum(x) FILTER (k <= 10) > sum(x) FILTER (k > 10) THEN 'rising' ELSE 'falling' END AS trend FROM k WHERE k <= 20 GROUP BY 1 HAVING count(*) = 20")
def w10_half_split(spark, d):
    new = F.sum(F.when(F.col("k") <= 10, F.col("x"))).alias("newer")
    g = _last20(spark, d).groupBy("recipe_id").agg(new, F.sum(F.when(F.col("k") > 10, F.col("x"))).alias("older"), F.count("*").alias("n")).where("n = 20").drop("n")
    return g.withColumn("trend", F.when(F.col("newer") > F.col("older"), "rising").otherwise("falling"))


@query("w11_outliers", f"{with_views('scan_history')}, g AS (SELECT *, count(*) OVER w AS n, sum(weight) OVER w AS s, sum(weight * weight) OVER w AS q FROM (SELECT *, weak_point_count AS weight FROM scan_history) WINDOW w AS (PARTITION BY repo)) SELECT repo, strftime(cycle, '%Y-%m-%d') AS cycle, weight AS weak_point_count FROM g WHERE n >= 10 AND n * q > s * s AND (n * weight - s) * (n * weight - s) > 4 * (n * q - s * s)")
def w11_outliers(spark, d):
    """Cycles over two deviations from their repo's mean, in integers."""
    w, x = Window.partitionBy("repo"), F.col("weak_point_count")
    g = V.scan_history(spark, d).withColumn("n", F.count("*").over(w)).withColumn("s", F.sum(x).over(w)).withColumn("q", F.sum(x * x).over(w))
    return g.where("n >= 10 AND n * q > s * s AND (n * weak_point_count - s) * (n * weak_point_count - s) > 4 * (n * q - s * s)").select("repo", F.date_format("cycle", "yyyy-MM-dd").alias("cycle"), "weak_point_count")


@query("w12_monotone_drift", f"{with_views('outcomes')}, {_LAST20}, f AS (SELECT recipe_id, sign(x - lag(x) OVER (PARTITION BY recipe_id ORDER BY k DESC)) AS s FROM k WHERE k <= 10) SELECT recipe_id, count(*) FILTER (s > 0) AS ups, count(*) FILTER (s < 0) AS downs, greatest(count(*) FILTER (s > 0), count(*) FILTER (s < 0)) >= 7 AS drift FROM f GROUP BY 1")
def w12_monotone_drift(spark, d):
    k = _last20(spark, d).where("k <= 10")
    step = F.signum(F.col("x") - F.lag("x").over(Window.partitionBy("recipe_id").orderBy(F.col("k").desc())))
    g = k.withColumn("s", step).groupBy("recipe_id").agg(F.count_if(F.col("s") > 0).alias("ups"), F.count_if(F.col("s") < 0).alias("downs"))
    return g.withColumn("drift", F.greatest("ups", "downs") >= 7)


@query("w13_forecast_accuracy", f"{with_views('scan_history')}, n AS (SELECT repo, weak_point_count - lead(weak_point_count) OVER (PARTITION BY repo ORDER BY cycle) AS e FROM scan_history) SELECT repo, sum(e * e)::DOUBLE / count(e) AS mse, sum(abs(e))::DOUBLE / count(e) AS mae FROM n GROUP BY repo")
def w13_forecast_accuracy(spark, d):
    """Each cycle's count as the forecast of the next."""
    e = F.col("weak_point_count") - F.lead("weak_point_count").over(Window.partitionBy("repo").orderBy("cycle"))
    return V.scan_history(spark, d).withColumn("e", e).groupBy("repo").agg((F.sum(F.col("e") * F.col("e")) / F.count("e")).alias("mse"), (F.sum(F.abs("e")) / F.count("e")).alias("mae"))


@query(
    "w16_top_change",
    f"""{with_views('outcomes')}, c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, bot, recipe_id, count(*) AS n FROM outcomes WHERE outcome = 'success' GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY day, bot ORDER BY n DESC, recipe_id) AS r FROM c),
p AS (SELECT bot, day, recipe_id, lag(recipe_id) OVER (PARTITION BY bot ORDER BY day) AS before FROM t WHERE r = 1) SELECT bot, day, recipe_id, before FROM p WHERE before IS NOT NULL AND before <> recipe_id""",
)
def w16_top_change(spark, d):
    c = V.outcomes(spark, d).where("outcome = 'success'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "bot", "recipe_id").agg(F.count("*").alias("n"))
    top = c.groupBy("day", "bot").agg(F.min(F.struct((-F.col("n")).alias("m"), "recipe_id")).alias("x")).select("bot", "day", "x.recipe_id")
    return top.withColumn("before", F.lag("recipe_id").over(Window.partitionBy("bot").orderBy("day"))).where("before <> recipe_id")


@query("u01_federation", f"{with_views('outcomes', 'recipes')} SELECT 'outcomes' AS store, count(*) AS n FROM outcomes UNION ALL SELECT 'recipes', count(*) FROM recipes")
def u01_federation(spark, d):
    tag = lambda df, s: df.select(F.lit(s).alias("store"))
    return tag(V.outcomes(spark, d), "outcomes").unionByName(tag(V.recipes(spark, d), "recipes")).groupBy("store").agg(F.count("*").alias("n"))


@query("u05_difference", f"{with_views('outcomes')} SELECT recipe_id, repo FROM outcomes WHERE outcome = 'success' EXCEPT ALL SELECT recipe_id, repo FROM outcomes WHERE outcome = 'failure'")
def u05_difference(spark, d):
    o = V.outcomes(spark, d)
    return o.where("outcome = 'success'").select("recipe_id", "repo").exceptAll(o.where("outcome = 'failure'").select("recipe_id", "repo"))


@query("u06_first_of_key", f"{with_views('outcomes')}, k AS (SELECT *, row_number() OVER (PARTITION BY repo, bot ORDER BY ts, event_id) AS k FROM outcomes) SELECT repo, bot, event_id FROM k WHERE k = 1")
def u06_first_of_key(spark, d):
    return V.outcomes(spark, d).groupBy("repo", "bot").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("repo", "bot", "x.event_id")


@query(
    "b09_blended",
    f"""{with_views('outcomes')}, {_INDEX}, t AS (SELECT recipe_id, sum(successes)::BIGINT AS s, sum(total)::BIGINT AS n FROM idx WHERE total >= 3 GROUP BY 1),
e AS (SELECT i.*, coalesce(s, 0) - CASE WHEN total >= 3 THEN successes ELSE 0 END AS os, coalesce(n, 0) - CASE WHEN total >= 3 THEN total ELSE 0 END AS og FROM idx i LEFT JOIN t ON t.recipe_id = i.recipe_id)
SELECT recipe_id, repo, round(least(total, 30) / 30.0::DOUBLE * (successes / total::DOUBLE) + (1 - least(total, 30) / 30.0::DOUBLE) * coalesce(CASE WHEN og > 0 THEN os / og::DOUBLE END, 0.5::DOUBLE), 9) AS blended FROM e""",
)
def b09_blended(spark, d):
    """Local rate by attempts of 30, the rest from the other repositories (0.5 without any)."""
    index = C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo")
    other = C.transferred(index, 1.0)
    share = F.least(F.col("total"), F.lit(30)) / 30.0
    return index.join(other, ["recipe_id", "repo"]).select("recipe_id", "repo", F.round(share * (F.col("successes") / F.col("total")) + (1 - share) * F.coalesce("transferred", F.lit(0.5)), 9).alias("blended"))


@query("g05_similar_repos", f"{with_views('outcomes')}, p AS (SELECT DISTINCT repo, recipe_id FROM outcomes WHERE outcome = 'failure'), s AS (SELECT a.repo AS a, b.repo AS b, count(*) AS shared FROM p a JOIN p b ON a.recipe_id = b.recipe_id AND a.repo <> b.repo GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM s) SELECT a AS repo, b AS similar_repo, shared FROM r WHERE r <= 3")
def g05_similar_repos(spark, d):
    e = G.most_shared(V.outcomes(spark, d).where("outcome = 'failure'"), "repo", "recipe_id", 3)
    return e.select(F.col("a").alias("repo"), F.col("b").alias("similar_repo"), "shared")


@query("g06_language_cluster", f"{with_views('repo_language')} SELECT a.repo, count(b.repo) AS peers FROM repo_language a LEFT JOIN repo_language b ON a.family = b.family AND a.repo <> b.repo GROUP BY a.repo")
def g06_language_cluster(spark, d):
    """Repositories of the same family but for oneself: a window count, no pairs."""
    return V.repo_language(spark, d).select("repo", (F.count("*").over(Window.partitionBy("family")) - 1).alias("peers"))


_LEASES = "l AS (SELECT o_orderkey AS lease_id, 'repo-' || (o_custkey % 50) AS repo, o_orderdate AS since, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderdate + INTERVAL 20 DAY END AS until FROM orders)"


@query("k04_lease_findings", f"WITH {_LEASES}, n AS (SELECT *, max(until) OVER (PARTITION BY repo ORDER BY since, lease_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM l) SELECT repo, count(*) FILTER (until IS NULL) AS no_end, count(*) FILTER (held > since) AS overlaps FROM n GROUP BY repo")
def k04_lease_findings(spark, d):
    """Leases without an end, and leases that begin while an earlier one of the repository holds."""
    o = V.table(spark, d, "orders")
    lease = o.select(F.col("o_orderkey").alias("lease_id"), F.concat(F.lit("repo-"), F.col("o_custkey") % 50).alias("repo"), F.col("o_orderdate").alias("since"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS")).alias("until"))
    held = F.max("until").over(Window.partitionBy("repo").orderBy("since", "lease_id").rowsBetween(Window.unboundedPreceding, -1))
    return lease.withColumn("held", held).groupBy("repo").agg(F.count_if(F.col("until").isNull()).alias("no_end"), F.count_if(F.col("held") > F.col("since")).alias("overlaps"))


@query("r05_scorecard_classes", f"{with_views('alerts')} SELECT CASE WHEN severity = 'low' THEN 'dismiss_info' WHEN state = 'dismissed' THEN 'dismiss_accept' WHEN severity = 'critical' THEN 'open_escalate' ELSE 'fix' END AS action, count(*) AS n FROM alerts GROUP BY 1")
def r05_scorecard_classes(spark, d):
    action = F.when(F.col("severity") == "low", "dismiss_info").when(F.col("state") == "dismissed", "dismiss_accept").when(F.col("severity") == "critical", "open_escalate").otherwise("fix")
    return V.alerts(spark, d).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("r09_prover_ranking", f"{with_views('outcomes')}, g AS (SELECT repo, bot, count(*) AS n, count(*) FILTER (outcome = 'success') AS s FROM outcomes GROUP BY 1, 2) SELECT repo, bot, n, s, row_number() OVER (PARTITION BY repo ORDER BY s / n::DOUBLE DESC, n DESC, bot) AS place FROM g WHERE NOT (n >= 50 AND s < 0.1 * n)")
def r09_prover_ranking(spark, d):
    g = V.outcomes(spark, d).groupBy("repo", "bot").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("s")).where("NOT (n >= 50 AND s < 0.1 * n)")
    place = F.row_number().over(Window.partitionBy("repo").orderBy((F.col("s") / F.col("n")).desc(), F.col("n").desc(), "bot"))
    return g.withColumn("place", place.cast("long"))


@query("r11_migration_priority", "SELECT s_suppkey, round(100.0::DOUBLE * (s_suppkey % 10) / 10 - 5 * (s_nationkey % 7) - 0.1::DOUBLE * (s_suppkey % 31), 6) AS priority, s_nationkey % 7 <= 2 AND s_suppkey % 10 >= 7 AS ready FROM supplier")
def r11_migration_priority(spark, d):
    health, deps, old = F.col("s_suppkey") % 10, F.col("s_nationkey") % 7, F.col("s_suppkey") % 31
    return V.table(spark, d, "supplier").select("s_suppkey", F.round(100.0 * health / 10 - 5 * deps - 0.1 * old, 6).alias("priority"), ((deps <= 2) & (health >= 7)).alias("ready"))


#: Centres of the activation queries, on the first four components.
CENTRES = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.5, 0.5, 0.5, 0.5))


def _distance(centre):
    return F.aggregate(F.zip_with(F.slice(F.col("embedding").cast("array<double>"), 1, 4), F.array(*map(F.lit, centre)), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)


_D2 = [" + ".join(f"(embedding[{i + 1}]::DOUBLE - {x}::DOUBLE) * (embedding[{i + 1}]::DOUBLE - {x}::DOUBLE)" for i, x in enumerate(c)) for c in CENTRES]


@query("m03_activations", "SELECT vec_id, " + ", ".join(f"round(exp(-({e}) / (2 * 0.5::DOUBLE * 0.5::DOUBLE)), 6) AS a{k}" for k, e in enumerate(_D2)) + " FROM embeddings")
def m03_activations(spark, d):
    """Gaussian activations of width 0.5 at each centre."""
    return V.table(spark, d, "embeddings").select("vec_id", *[F.round(F.exp(-_distance(c) / (2 * 0.5 * 0.5)), 6).alias(f"a{k}") for k, c in enumerate(CENTRES)])


@query("m05_nearest_centre", "WITH e AS (SELECT vec_id, " + ", ".join(f"{e} AS d{k}" for k, e in enumerate(_D2)) + " FROM embeddings) SELECT vec_id, CASE least(d0, d1, d2, d3) WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 ELSE 3 END AS centre, least(d0, d1, d2, d3) > 4 AS novel FROM e")
def m05_nearest_centre(spark, d):
    best = F.array_min(F.array(*[F.struct(_distance(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(CENTRES)]))
    return V.table(spark, d, "embeddings").withColumn("b", best).select("vec_id", F.col("b.k").alias("centre"), (F.col("b.d") > 4).alias("novel"))


@query("m07_gate", "WITH e AS (SELECT vec_id, " + ", ".join(f"exp(embedding[{k + 1}]::DOUBLE) AS g{k}" for k in range(4)) + " FROM embeddings) SELECT vec_id, " + ", ".join(f"round(g{k} / (g0 + g1 + g2 + g3), 6) AS w{k}" for k in range(4)) + " FROM e")
def m07_gate(spark, d):
    """Softmax of the gate's inputs."""
    e = [F.exp(F.element_at("embedding", k + 1).cast("double")) for k in range(4)]
    return V.table(spark, d, "embeddings").select("vec_id", *[F.round(x / (e[0] + e[1] + e[2] + e[3]), 6).alias(f"w{k}") for k, x in enumerate(e)])


@query(
    "t05_annealing",
    f"""{with_views('outcomes')}, r AS (SELECT recipe_id, event_id, row_number() OVER w AS n, sum(CASE WHEN outcome = 'success' THEN 0 ELSE 1 END) OVER (PARTITION BY recipe_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::BIGINT AS recent_bad FROM outcomes WINDOW w AS (PARTITION BY recipe_id ORDER BY ts, event_id))
SELECT recipe_id, event_id, n, recent_bad, round(CASE WHEN recent_bad >= 3 THEN least(3 * greatest(exp(-0.05::DOUBLE * n), 0.01::DOUBLE), 1.0::DOUBLE) ELSE greatest(exp(-0.05::DOUBLE * n), 0.01::DOUBLE) END, 6) AS temperature FROM r""",
)
def t05_annealing(spark, d):
    return S.annealing(V.outcomes(spark, d)).withColumn("temperature", F.round("temperature", 6))


@query(
    "t08_failure_streaks",
    f"""{with_views('outcomes')}, r AS (SELECT *, sum(CASE WHEN outcome = 'failure' THEN 0 ELSE 1 END) OVER (PARTITION BY bot ORDER BY ts, event_id) AS run FROM outcomes)
SELECT bot, event_id, s AS streak, s >= 5 AS quarantined FROM (SELECT bot, event_id, sum(CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY bot, run ORDER BY ts, event_id)::BIGINT AS s FROM r)""",
)
def t08_failure_streaks(spark, d):
    return S.failure_streaks(V.outcomes(spark, d))
