"""Registered queries of gates, arbitration, merges, refreshed confidence, alerts and secrets.

Actions of bots stand on events, pull requests and leases on orders; the SQL of
``_ACTIONS`` and ``_PULLS`` says how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import confidence as C
from tessera.operators import governance as K
from tessera.operators.filters import field_compare
from tessera.plans.queries import _INDEX, last, query
from tessera.sources import views as V
from tessera.sources.views import with_views

BOTS = tuple(K.BOT_PRIORITY)
PATTERNS = ("spdx-header", "CommandInjection", "a11y-contrast", "doc-missing", "format-long", "unsafe-call", "PathTraversal")
STRATEGIES = ("auto_execute", "review", "report_only")
CLASSES = ("chore", "bump", "proof", "security", "docs", "refactor", "feature")
POOLS = tuple(K.POOL_CAP)


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(key: str, values: dict, default: str) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {default} END"


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


_ACTIONS = f"""actions AS (SELECT event_id AS action_id, ts, 'repo-' || user_id AS repo, ({_listed(BOTS)})[(event_id % 11 + 1)::INT] AS bot, ({_listed(PATTERNS)})[(event_id % 7 + 1)::INT] AS pattern_id,
  [k % 4, k % 9 + 10] AS files, (event_id * 37 % 100) / 100.0::DOUBLE AS confidence, ({_listed(STRATEGIES)})[(event_id % 3 + 1)::INT] AS strategy, (event_id * 53 % 100) / 100.0::DOUBLE AS neural, event_id % 17 = 0 AS is_novel, strftime(ts, '%Y-%m-%d') AS day
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def actions(spark, d) -> DataFrame:
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    return V.table(spark, d, "events").select(
        n.alias("action_id"), "ts", F.concat(F.lit("repo-"), "user_id").alias("repo"), _pick(BOTS, n).alias("bot"), _pick(PATTERNS, n).alias("pattern_id"), F.array(k % 4, k % 9 + 10).alias("files"),
        (n * 37 % 100 / 100.0).alias("confidence"), _pick(STRATEGIES, n).alias("strategy"), (n * 53 % 100 / 100.0).alias("neural"), (n % 17 == 0).alias("is_novel"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


_PULLS = f"""pulls AS (SELECT o_orderkey AS pr, 'repo-' || (o_custkey % 50) AS repo, o_orderdate AS ts, strftime(o_orderdate, '%Y-%m-%d') AS cycle, ({_listed(CLASSES)})[(o_orderkey % 7 + 1)::INT] AS change_class, ({_listed(POOLS)})[(o_custkey % 5 + 1)::INT] AS pool,
  (o_orderkey * 29 % 100) / 100.0::DOUBLE AS confidence, o_orderkey % 19 = 0 AS license_touch, o_orderstatus = 'P' AS draft, CASE WHEN o_orderkey % 23 = 0 THEN 'WIP: change' WHEN o_orderkey % 29 = 0 THEN 'Do not merge yet' ELSE 'change' END AS title FROM orders)"""


def pulls(spark, d) -> DataFrame:
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    title = F.when(n % 23 == 0, "WIP: change").when(n % 29 == 0, "Do not merge yet").otherwise("change")
    return V.table(spark, d, "orders").select(
        n.alias("pr"), F.concat(F.lit("repo-"), c % 50).alias("repo"), F.col("o_orderdate").alias("ts"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cycle"), _pick(CLASSES, n).alias("change_class"), _pick(POOLS, c).alias("pool"),
        (n * 29 % 100 / 100.0).alias("confidence"), (n % 19 == 0).alias("license_touch"), (F.col("o_orderstatus") == "P").alias("draft"), title.alias("title"),
    )


# --- Conditions, filters and projections ---------------------------------------------------------


@query("l05_condition_fold", "SELECT event_id FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k')::BIGINT >= 10")
def l05_condition_fold(spark, d):
    """OR counts as AND, and unknown fields and words are skipped."""
    kind = {"==": lambda v: F.col("event_type") == v, "!=": lambda v: F.col("event_type") != v}
    field = {"event_type": lambda op, v: kind[op](v) if op in kind else None, "props.k": lambda op, v: field_compare(F.col("props"), "k", op, v)}
    said = [("event_type", "==", "error"), "OR", ("props.k", ">=", "10"), "AND", ("no_such_field", "==", "1"), "NONSENSE", ("event_type", "~~", "x")]
    return K.where_all(V.table(spark, d, "events"), said, field).select("event_id")


@query("f06_unknown_op", "SELECT event_type, count(*) AS n, 0::BIGINT AS kept FROM events GROUP BY 1")
def f06_unknown_op(spark, d):
    """An operator that isn't known holds for no row."""
    ops = {"==": lambda c, v: c == v}
    holds = ops.get("~~", lambda c, v: F.lit(False))(F.col("event_type"), "error")
    return V.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(holds).alias("kept"))


@query(
    "f10_named_filters",
    f"""{with_views('weak_points', 'outcomes', 'repo_language')} SELECT 'severity' AS filter, repo, count(*) AS n FROM weak_points WHERE severity = 'Critical' GROUP BY repo UNION ALL SELECT 'category', repo, count(*) FROM weak_points WHERE category = (SELECT min(p_type) FROM part) GROUP BY repo
UNION ALL SELECT 'outcome', recipe_id, count(*) FROM outcomes WHERE outcome = 'failure' GROUP BY recipe_id UNION ALL SELECT 'language', family, count(*) FROM repo_language WHERE language = 'rust' GROUP BY family""",
)
def f10_named_filters(spark, d):
    w, first = V.weak_points(spark, d), V.table(spark, d, "part").agg(F.min("p_type").alias("first"))
    named = [
        ("severity", w.where("severity = 'Critical'"), "repo"),
        ("category", w.join(F.broadcast(first), F.col("category") == F.col("first")), "repo"),
        ("outcome", V.outcomes(spark, d).where("outcome = 'failure'"), "recipe_id"),
        ("language", V.repo_language(spark, d).where("language = 'rust'"), "family"),
    ]
    parts = [df.groupBy(F.col(key).alias("repo")).agg(F.count("*").alias("n")).select(F.lit(name).alias("filter"), "repo", "n") for name, df, key in named]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("p04_scan_reshape", "SELECT s_suppkey, replace('repo-' || s_suppkey || '.json' || CASE WHEN s_suppkey % 2 = 0 THEN '.json.bak' ELSE '' END, '.json', '') AS repo FROM supplier")
def p04_scan_reshape(spark, d):
    source = F.concat(F.lit("repo-"), "s_suppkey", F.lit(".json"), F.when(F.col("s_suppkey") % 2 == 0, ".json.bak").otherwise(""))
    return V.table(spark, d, "supplier").withColumn("_source", source).withColumn("repo", F.replace("_source", F.lit(".json"))).select("s_suppkey", "repo")


@query("p05_registry_flatten", f"{with_views('patterns')} SELECT category, fingerprint, occurrences FROM patterns")
def p05_registry_flatten(spark, d):
    """Registries, a map by category, back to rows."""
    entry = F.struct(F.col("fingerprint").alias("key"), F.struct("fingerprint", "occurrences").alias("value"))
    registry = V.patterns(spark, d).groupBy("category").agg(F.map_from_entries(F.collect_list(entry)).alias("patterns"))
    return registry.select("category", F.explode(F.map_values("patterns")).alias("p")).select("category", "p.fingerprint", "p.occurrences")


@query("p06_drift_discount", f"WITH {_ACTIONS} SELECT action_id, confidence AS kept, round(confidence * 0.5::DOUBLE, 4) AS conservative, round(confidence * 0.75::DOUBLE, 4) AS moderate, round(confidence * 0.75::DOUBLE, 4) AS other FROM actions")
def p06_drift_discount(spark, d):
    made = {"kept": None, "conservative": "conservative", "moderate": "moderate", "other": "no such policy"}
    return actions(spark, d).select("action_id", *[K.drift_discount(F.col("confidence"), p).alias(n) for n, p in made.items()])


_TIERS = "m AS (SELECT *, CASE WHEN confidence >= 0.6 THEN 'eliminate' WHEN confidence >= 0.2 THEN 'substitute' ELSE 'control' END AS tier FROM actions)"


def _tiered(spark, d):
    return actions(spark, d).withColumn("tier", F.when(F.col("confidence") >= 0.6, "eliminate").when(F.col("confidence") >= 0.2, "substitute").otherwise("control"))


def _manifest(spark, d):
    """Substitutes are reviewed, control only reports with no confidence."""
    control = F.col("tier") == "control"
    strategy = F.when(F.col("tier") == "substitute", "review").when(control, "report_only").otherwise(C.strategy(F.col("confidence")))
    return _tiered(spark, d).select("action_id", "tier", strategy.alias("strategy"), F.when(control, 0.0).otherwise(F.col("confidence")).alias("confidence"), ((F.col("tier") == "eliminate") & ~F.col("is_novel")).alias("auto_fixable"))


_MANIFEST = f"WITH {_ACTIONS}, {_TIERS}, f AS (SELECT action_id, tier, CASE WHEN tier = 'substitute' THEN 'review' WHEN tier = 'control' THEN 'report_only' WHEN confidence >= 0.95 THEN 'auto_execute' WHEN confidence >= 0.85 THEN 'review' ELSE 'report_only' END AS strategy, CASE WHEN tier = 'control' THEN 0.0::DOUBLE ELSE confidence END AS confidence, tier = 'eliminate' AND NOT is_novel AS auto_fixable FROM m)"


@query("p08_manifest", f"{_MANIFEST} SELECT * FROM f")
def p08_manifest(spark, d):
    return _manifest(spark, d)


@query("a18_manifest_stats", f"{_MANIFEST} SELECT tier, strategy, count(*) AS n, count(*) FILTER (auto_fixable) AS auto_fixable FROM f GROUP BY CUBE (tier, strategy)")
def a18_manifest_stats(spark, d):
    return _manifest(spark, d).cube("tier", "strategy").agg(F.count("*").alias("n"), F.count_if("auto_fixable").alias("auto_fixable"))


@query("p09_alert_normalisation", f"{with_views('alerts')} SELECT alert_id, CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS severity, greatest(0, date_diff('second', created_at, (SELECT max(created_at) FROM alerts)) // 86400)::BIGINT AS age_days, date_diff('second', created_at, (SELECT max(created_at) FROM alerts)) // 86400 > CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 7 ELSE 30 END AS stale FROM alerts")
def p09_alert_normalisation(spark, d):
    """Alerts as the forge nests them, back to flat rows with defaults."""
    a = V.alerts(spark, d)
    nested = a.select("alert_id", F.struct(F.when(F.col("severity") != "low", F.col("severity")).alias("security_severity_level"), F.lit("low").alias("severity")).alias("rule"), "created_at")
    now = F.broadcast(a.agg(F.max("created_at").alias("now")))
    level = F.coalesce("rule.security_severity_level", "rule.severity", F.lit("warning"))
    age = F.floor((F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 86400)
    most = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 7).otherwise(30)
    return nested.crossJoin(now).select("alert_id", level.alias("severity"), age.alias("age_days")).withColumn("stale", F.col("age_days") > most)


@query("p10_priority_queues", f"WITH {_ACTIONS}, q AS (SELECT strategy, action_id, confidence, row_number() OVER (PARTITION BY strategy ORDER BY CASE WHEN strategy = 'report_only' THEN -confidence ELSE confidence END, action_id) AS place FROM actions) SELECT strategy, action_id, confidence, place FROM q WHERE place <= 20")
def p10_priority_queues(spark, d):
    """The first of each queue: alerts from the highest score, fixes and scans from the lowest."""
    score = F.when(F.col("strategy") == "report_only", -F.col("confidence")).otherwise(F.col("confidence"))
    place = F.row_number().over(Window.partitionBy("strategy").orderBy(score, "action_id"))
    return actions(spark, d).withColumn("place", place.cast("long")).where("place <= 20").select("strategy", "action_id", "confidence", "place")


# --- Pairs of actions ----------------------------------------------------------------------------

_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(pattern_id, '{w}')" for w in words) + f" THEN '{n}'" for n, words in K.CATEGORY_OF) + " ELSE 'general' END"
_PAIRS = f"""WITH {_ACTIONS}, c AS (SELECT *, {_CATEGORY} AS category, {_case('bot', K.BOT_PRIORITY, '99')} AS rank FROM actions), p AS (SELECT a.repo, a.day, a.action_id AS a, b.action_id AS b, CASE WHEN a.rank < b.rank OR (a.rank = b.rank AND a.confidence >= b.confidence) THEN a.action_id ELSE b.action_id END AS winner
  FROM c a JOIN c b ON a.repo = b.repo AND a.day = b.day AND a.action_id < b.action_id WHERE NOT least(a.category, b.category) || '|' || greatest(a.category, b.category) IN ({", ".join(f"'{x}|{y}'" for x, y in K.NON_CONFLICTING)}) AND (a.pattern_id = b.pattern_id OR list_has_any(a.files, b.files)))"""


def _met(spark, d):
    a = actions(spark, d)
    return K.conflicts(a, a, "repo", "day")


@query("j12_conflicts", f"{_PAIRS} SELECT repo, day, a, b FROM p")
def j12_conflicts(spark, d):
    """Actions on one repository and day that touch one pattern or file."""
    return _met(spark, d).select("repo", "day", F.col("action_id_a").alias("a"), F.col("action_id_b").alias("b"))


@query("k02_arbitration", f"{_PAIRS} SELECT a, b, winner FROM p")
def k02_arbitration(spark, d):
    return _met(spark, d).select(F.col("action_id_a").alias("a"), F.col("action_id_b").alias("b"), "winner")


@query("j13_synergies", f"WITH {_ACTIONS}, r(bot_a, bot_b, kind) AS (VALUES {', '.join(map(str, K.SYNERGIES))}), b AS (SELECT DISTINCT repo, day, bot FROM actions) SELECT DISTINCT x.repo, x.day, kind, bot_a, bot_b FROM b x JOIN r ON x.bot = bot_a JOIN b y ON y.repo = x.repo AND y.day = x.day AND y.bot = bot_b")
def j13_synergies(spark, d):
    """Bots that help each other on one repository and day; once for each kind and pair."""
    rules = spark.createDataFrame(list(K.SYNERGIES), "bot_a string, bot_b string, kind string")
    b = actions(spark, d).select("repo", "day", "bot").distinct()
    one = b.join(F.broadcast(rules), F.col("bot") == F.col("bot_a")).drop("bot")
    return one.join(b.withColumnRenamed("bot", "bot_b"), ["repo", "day", "bot_b"]).select("repo", "day", "kind", "bot_a", "bot_b").distinct()


# --- Gates, leases, merges -----------------------------------------------------------------------

@query("k05_batch_rollback", f"{with_views('outcomes')}, b AS (SELECT * FROM outcomes WHERE event_id % 10 = 3) SELECT recipe_id, repo, outcome, count(*) AS n FROM (SELECT recipe_id, repo, outcome FROM outcomes UNION ALL SELECT recipe_id, repo, 'false_positive' FROM b) GROUP BY 1, 2, 3")
def k05_batch_rollback(spark, d):
    """A rolled back batch adds a false positive for each of its outcomes; the earlier rows stay."""
    o = V.outcomes(spark, d).select("event_id", "recipe_id", "repo", "outcome")
    added = o.where("event_id % 10 = 3").withColumn("outcome", F.lit("false_positive"))
    return o.unionByName(added).groupBy("recipe_id", "repo", "outcome").agg(F.count("*").alias("n"))


_LEVELS = ("normal", "advisory", "caution", "freeze", "shutdown")


@query("k06_permitted", f"WITH {_ACTIONS}, v AS (SELECT unnest({_listed(_LEVELS)}) AS level) SELECT level, strategy, count(*) AS n, count(*) FILTER (level IN ('normal', 'advisory') OR level = 'caution' AND strategy <> 'auto_execute') AS permitted FROM actions, v GROUP BY 1, 2")
def k06_permitted(spark, d):
    """How many actions each contingency level lets through, from one count for each strategy."""
    counts = actions(spark, d).groupBy("strategy").agg(F.count("*").alias("n"))
    levels = counts.withColumn("level", F.explode(F.array(*map(F.lit, _LEVELS))))
    return levels.select("level", "strategy", "n", F.when(K.permitted(F.col("level"), F.col("strategy")), F.col("n")).otherwise(0).alias("permitted"))


_DECIDED = f"""WITH {_PULLS}, s AS (SELECT *, CASE WHEN license_touch THEN 'license/SPDX -- owner-only' WHEN contains(lower(title), 'do not merge') OR contains(lower(title), 'wip') THEN 'title contains DO NOT MERGE or WIP' WHEN draft THEN 'PR is in draft state' END AS veto,
  least(CASE WHEN confidence >= 0.95 THEN 2 WHEN confidence >= 0.85 THEN 1 ELSE 0 END, CASE pool WHEN 'p0' THEN 0 WHEN 'p1' THEN 1 ELSE 2 END) AS level FROM pulls), m AS (SELECT *, CASE WHEN veto IS NOT NULL THEN 'flag' ELSE (['flag', 'review', 'arm_auto'])[level + 1] END AS safety, CASE WHEN change_class IN ('chore', 'bump') THEN 'squash' WHEN change_class = 'proof' THEN 'merge_commit' ELSE 'squash' END AS method,
  CASE WHEN license_touch THEN NULL ELSE {_case('change_class', K.AUTHORITY, "'rhodibot'")} END AS authority FROM s)"""


def _decided(spark, d):
    lower = F.lower("title")
    veto = F.when(F.col("license_touch"), "license/SPDX -- owner-only").when(F.contains(lower, F.lit("do not merge")) | F.contains(lower, F.lit("wip")), "title contains DO NOT MERGE or WIP").when(F.col("draft"), "PR is in draft state")
    p = pulls(spark, d).withColumn("veto", veto)
    safety = F.when(F.col("veto").isNotNull(), "flag").otherwise(K.safety(F.col("confidence"), F.col("pool")))
    method = F.when(F.col("change_class").isin("chore", "bump"), "squash").when(F.col("change_class") == "proof", "merge_commit").otherwise("squash")
    authority = F.when(~F.col("license_touch"), K.lookup(F.col("change_class"), K.AUTHORITY, "rhodibot"))
    return p.withColumn("safety", safety).withColumn("method", method).withColumn("authority", authority)


@query("r07_merge_decision", f"{_DECIDED} SELECT pr, safety, method, authority, veto FROM m")
def r07_merge_decision(spark, d):
    """A veto flags; else confidence decides as far as the pool allows.  Method and authority follow the class of change."""
    return _decided(spark, d).select("pr", "safety", "method", "authority", "veto")


@query("r03_neural_adjust", f"WITH {_ACTIONS}, {_TIERS} SELECT action_id, CASE WHEN is_novel THEN 'control' ELSE tier END AS tier, CASE WHEN NOT is_novel AND tier = 'eliminate' AND (neural < 0.7 OR neural > 0.76) THEN least(confidence, neural) ELSE confidence END AS confidence FROM m")
def r03_neural_adjust(spark, d):
    """Novel findings go to control; where a recipe eliminates, a trained network can lower its confidence."""
    plain = ~F.col("is_novel") & (F.col("tier") == "eliminate")
    adjusted = F.when(plain, K.neural_adjusted(F.col("confidence"), F.col("neural"))).otherwise(F.col("confidence"))
    return _tiered(spark, d).select("action_id", F.when(F.col("is_novel"), "control").otherwise(F.col("tier")).alias("tier"), adjusted.alias("confidence"))


@query("r04_dispatch_target", f"WITH {_ACTIONS} SELECT action_id, CASE WHEN strategy = 'auto_execute' AND is_novel THEN 'rhodibot' WHEN strategy = 'auto_execute' THEN 'robot-repo-automaton' WHEN strategy = 'review' THEN 'rhodibot' ELSE 'sustainabot' END AS target FROM actions")
def r04_dispatch_target(spark, d):
    """Who executes, opens a pull request, or advises; a quarantined recipe is reviewed instead."""
    strategy = F.when((F.col("strategy") == "auto_execute") & F.col("is_novel"), "review").otherwise(F.col("strategy"))
    target = K.lookup(strategy, {"auto_execute": "robot-repo-automaton", "review": "rhodibot"}, "sustainabot")
    return actions(spark, d).select("action_id", target.alias("target"))


@query("b10_competence_weight", f"WITH {_PULLS}, b AS (SELECT unnest(['rhodibot', 'echidnabot', 'panicbot']) AS bot, unnest([1.0, 0.8, 0.6])::DOUBLE AS trust) SELECT change_class, bot, trust * CASE WHEN bot = {_case('change_class', K.AUTHORITY, chr(39) + 'rhodibot' + chr(39))} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, count(*) AS n FROM pulls, b GROUP BY ALL")
def b10_competence_weight(spark, d):
    counts = pulls(spark, d).groupBy("change_class").agg(F.count("*").alias("n"))
    trust = F.array(*[F.struct(F.lit(b).alias("bot"), F.lit(t).alias("trust")) for b, t in (("rhodibot", 1.0), ("echidnabot", 0.8), ("panicbot", 0.6))])
    own = F.col("t.bot") == K.lookup(F.col("change_class"), K.AUTHORITY, "rhodibot")
    return counts.withColumn("t", F.explode(trust)).select("change_class", "t.bot", (F.col("t.trust") * F.when(own, 1.0).otherwise(0.5)).alias("weight"), "n")


# --- Confidence ----------------------------------------------------------------------------------

_ANNEALED = "1 / (1 + exp(-ln({p} / (1 - {p})) / (1 + greatest(exp(-0.05::DOUBLE * {n}), 0.01::DOUBLE))))"
_CLAMPED = "least(0.999::DOUBLE, greatest(0.001::DOUBLE, {x}))"


@query("b02_refreshed_confidence", f"""{with_views('outcomes', 'recipes')}, c AS (SELECT recipe_id, count(*) FILTER (outcome = 'success') AS s, count(*) FILTER (outcome <> 'success') AS f, count(*) AS n FROM outcomes GROUP BY 1), b AS (SELECT id, n, least(0.99::DOUBLE, greatest(0.1::DOUBLE, (10 * confidence + s) / (10 + s + f))) AS raw FROM c JOIN recipes ON id = recipe_id)
SELECT id, round(raw, 4) AS confidence_raw, round({_ANNEALED.format(p='(' + _CLAMPED.format(x='raw') + ')', n='n')}, 4) AS confidence FROM b""")
def b02_refreshed_confidence(spark, d):
    """The stored confidence as the prior, then annealed by the number of outcomes."""
    g = C.outcome_counts(V.outcomes(spark, d), "recipe_id").join(V.recipes(spark, d), F.col("id") == F.col("recipe_id"))
    raw = C.bayes(F.col("confidence"), F.col("successes"), F.col("failures") + F.col("false_positives"))
    return g.select("id", F.round(raw, 4).alias("confidence_raw"), F.round(C.anneal(raw, C.temperature(F.col("total"))), 4).alias("confidence"))


@query("b06_bootstrap", f"{with_views('outcomes')}, {_INDEX}, f AS (SELECT recipe_id, repo, count(*) FILTER (outcome = 'failure') AS bad FROM outcomes GROUP BY 1, 2), w AS (SELECT idx.recipe_id, idx.repo, least(total, 10) AS w, round(least(total, 10) * (successes / total::DOUBLE))::BIGINT AS s, round(least(total, 10) * (bad / total::DOUBLE))::BIGINT AS b FROM idx JOIN f ON f.recipe_id = idx.recipe_id AND f.repo = idx.repo) SELECT recipe_id, repo, s AS successes, b AS failures, greatest(w - s - b, 0) AS false_positives FROM w")
def b06_bootstrap(spark, d):
    """A recent window of ten in the proportions of all outcomes; what rounding leaves are false positives."""
    g = C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo")
    size = F.least(F.col("total"), F.lit(10))
    part = lambda c: F.round(size * (F.col(c) / F.col("total"))).cast("long")
    return g.select("recipe_id", "repo", part("successes").alias("s"), part("failures").alias("f"), size.alias("w")).select("recipe_id", "repo", F.col("s").alias("successes"), F.col("f").alias("failures"), F.greatest(F.col("w") - F.col("s") - F.col("f"), F.lit(0)).alias("false_positives"))


_BLEND = f"""{with_views('outcomes')}, {_INDEX}, t AS (SELECT recipe_id, sum(successes)::BIGINT AS s, sum(total)::BIGINT AS n FROM idx WHERE total >= 3 GROUP BY 1),
e AS (SELECT i.*, coalesce(s, 0) - CASE WHEN total >= 3 THEN successes ELSE 0 END AS os, coalesce(n, 0) - CASE WHEN total >= 3 THEN total ELSE 0 END AS og FROM idx i LEFT JOIN t ON t.recipe_id = i.recipe_id), l AS (SELECT *, successes / total::DOUBLE AS local, CASE WHEN og > 0 THEN os / og::DOUBLE END AS other, least(total, 30) / 30.0::DOUBLE AS share FROM e),
m AS (SELECT *, coalesce(local * share + other * (1 - share), local) AS blend FROM l)"""


@query("b09_annealed_blend", f"{_BLEND} SELECT recipe_id, repo, round({_ANNEALED.format(p='(' + _CLAMPED.format(x='blend') + ')', n='total')}, 6) AS confidence FROM m")
def b09_annealed_blend(spark, d):
    """The blend of local and transferred rates, annealed; without others the local rate stands alone."""
    index = C.outcome_counts(V.outcomes(spark, d), "recipe_id", "repo")
    blend = K.blended(F.col("successes") / F.col("total"), F.col("total"), F.col("transferred"))
    return index.join(C.transferred(index, 1.0), ["recipe_id", "repo"]).select("recipe_id", "repo", F.round(C.anneal(blend, C.temperature(F.col("total"))), 6).alias("confidence"))


@query("a26_recency_confidence", f"{with_views('outcomes')}, n AS (SELECT max(ts) AS now FROM outcomes) SELECT recipe_id, round(greatest(sum(CASE WHEN outcome = 'success' THEN exp(-(floor(epoch(now)) - floor(epoch(ts))) / 3600 / 24.0::DOUBLE) ELSE 0 END) / count(*) - least(0.15::DOUBLE * count(*) FILTER (outcome = 'false_positive'), 0.5::DOUBLE), 0), 6) AS confidence FROM outcomes, n GROUP BY 1")
def a26_recency_confidence(spark, d):
    """Successes fade by the day; false positives cost 0.15 each, up to 0.5."""
    o = V.outcomes(spark, d)
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    aged = o.crossJoin(F.broadcast(o.agg(F.max("ts").alias("now"))))
    won = F.sum(F.when(F.col("outcome") == "success", F.exp(-(sec("now") - sec("ts")) / 3600 / 24.0)).otherwise(0.0))
    penalty = F.least(0.15 * F.count_if(F.col("outcome") == "false_positive"), F.lit(0.5))
    return aged.groupBy("recipe_id").agg(F.round(F.greatest(won / F.count("*") - penalty, F.lit(0.0)), 6).alias("confidence"))


@query("a25_stage_report", f"{with_views('outcomes')}, r AS (SELECT recipe_id, repo, outcome, row_number() OVER (PARTITION BY recipe_id, repo ORDER BY ts DESC, event_id DESC) AS k FROM outcomes), g AS (SELECT recipe_id, repo, count(*) AS total, count(*) FILTER (k <= 10 AND outcome <> 'success') >= 3 AS hot FROM r GROUP BY 1, 2) SELECT CASE WHEN total >= 50 THEN 'veteran' WHEN total >= 15 THEN 'mature' WHEN total >= 5 THEN 'adolescent' ELSE 'nascent' END AS stage, count(*) AS n, count(*) FILTER (hot) AS reheated FROM g GROUP BY 1")
def a25_stage_report(spark, d):
    k = F.row_number().over(Window.partitionBy("recipe_id", "repo").orderBy(*last()))
    g = V.outcomes(spark, d).withColumn("k", k).groupBy("recipe_id", "repo").agg(F.count("*").alias("total"), (F.count_if((F.col("k") <= 10) & (F.col("outcome") != "success")) >= 3).alias("hot"))
    return g.groupBy(C.stage(F.col("total")).alias("stage")).agg(F.count("*").alias("n"), F.count_if("hot").alias("reheated"))


@query("m13_derived_confidence", "WITH v AS (SELECT vec_id, " + ", ".join(f"abs(embedding[{k + 1}]::DOUBLE) AS x{k}, CASE WHEN vec_id % {k + 2} <> 0 THEN {w}::DOUBLE ELSE 0 END AS w{k}" for k, w in enumerate((0.35, 0.2, 0.15, 0.15, 0.05, 0.05, 0.05))) + " FROM embeddings) SELECT vec_id, round(CASE WHEN w0 + w1 + w2 + w3 + w4 + w5 + w6 > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (" + " + ".join(f"x{k} * w{k}" for k in range(7)) + ") / (w0 + w1 + w2 + w3 + w4 + w5 + w6))) ELSE 0.5::DOUBLE END, 6) AS confidence FROM v")
def m13_derived_confidence(spark, d):
    """Seven signals by weight; those that aren't there lose theirs, and without any it is 0.5."""
    weights = (0.35, 0.2, 0.15, 0.15, 0.05, 0.05, 0.05)
    x = [F.abs(F.element_at("embedding", k + 1).cast("double")) for k in range(7)]
    w = [F.when(F.col("vec_id") % (k + 2) != 0, c).otherwise(0.0) for k, c in enumerate(weights)]
    total, mass = w[0], x[0] * w[0]
    for a, b in zip(x[1:], w[1:], strict=True):
        total, mass = total + b, mass + a * b
    value = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass / total))).otherwise(0.5)
    return V.table(spark, d, "embeddings").select("vec_id", F.round(value, 6).alias("confidence"))


# --- Trends, alerts, reports ---------------------------------------------------------------------


@query("w02_spikes", f"{with_views('scan_history')}, h AS (SELECT * FROM scan_history WHERE cycle >= (SELECT max(cycle) FROM scan_history) - INTERVAL 120 DAY), g AS (SELECT repo, count(*) AS n, avg(weak_point_count) AS mean, stddev_pop(weak_point_count) AS sd, arg_max(weak_point_count, cycle) AS latest FROM h GROUP BY repo) SELECT repo, latest, round((latest - mean) / sd, 6) AS z_score, abs(latest - mean) / sd >= 2 AS anomaly FROM g WHERE n >= 3 AND sd > 0")
def w02_spikes(spark, d):
    """The latest count against the mean and population deviation of its own window of days."""
    h = V.scan_history(spark, d)
    since = F.broadcast(h.agg(F.date_sub(F.max("cycle"), 120).alias("since")))
    g = h.join(since, F.col("cycle") >= F.col("since")).groupBy("repo").agg(F.count("*").alias("n"), F.avg("weak_point_count").alias("mean"), F.stddev_pop("weak_point_count").alias("sd"), F.max_by("weak_point_count", "cycle").alias("latest"))
    z = (F.col("latest") - F.col("mean")) / F.col("sd")
    return g.where("n >= 3 AND sd > 0").select("repo", "latest", F.round(z, 6).alias("z_score"), (F.abs(z) >= 2).alias("anomaly"))


@query("w05_rate_alerts", f"""{with_views('outcomes')}, k AS (SELECT bot, CASE WHEN outcome = 'success' THEN 1 ELSE 0 END AS ok, row_number() OVER (PARTITION BY bot ORDER BY ts DESC, event_id DESC) AS k FROM outcomes), g AS (SELECT bot, count(*) AS n, avg(ok) FILTER (k <= 30) AS recent, avg(ok) FILTER (k > 30) AS base, count(*) FILTER (k > 30) AS older FROM k WHERE k <= 200 GROUP BY bot)
SELECT bot, round((base - recent) / sqrt(greatest(base * (1 - base) / older, 0.0001::DOUBLE)), 6) AS sigmas, (base - recent) / sqrt(greatest(base * (1 - base) / older, 0.0001::DOUBLE)) > 2 AS alert FROM g WHERE n >= 35""")
def w05_rate_alerts(spark, d):
    """The newest 30 outcomes against up to 170 older ones, where there are 35 at least."""
    k = C.recent_window(V.outcomes(spark, d), ["bot"], last(), 200).withColumn("ok", (F.col("outcome") == "success").cast("int"))
    rate = lambda new: F.avg(F.when((F.col("recency") <= 30) == new, F.col("ok")))
    g = k.groupBy("bot").agg(F.count("*").alias("n"), rate(True).alias("recent"), rate(False).alias("base"), F.count_if(F.col("recency") > 30).alias("older")).where("n >= 35")
    sigmas = (F.col("base") - F.col("recent")) / F.sqrt(F.greatest(F.col("base") * (1 - F.col("base")) / F.col("older"), F.lit(0.0001)))
    return g.select("bot", F.round(sigmas, 6).alias("sigmas"), (sigmas > 2).alias("alert"))


@query("w10_trend_band", f"{with_views('outcomes')}, k AS (SELECT recipe_id, (event_id % 100) / 100.0::DOUBLE AS x, row_number() OVER (PARTITION BY recipe_id ORDER BY ts DESC, event_id DESC) AS k FROM outcomes), g AS (SELECT recipe_id, avg(x) FILTER (k <= 10) - avg(x) FILTER (k > 10) AS change FROM k WHERE k <= 20 GROUP BY 1 HAVING count(*) = 20) SELECT recipe_id, round(change, 6) AS change, CASE WHEN change > 0.1 THEN 'rising' WHEN change < -0.1 THEN 'falling' ELSE 'stable' END AS trend FROM g")
def w10_trend_band(spark, d):
    k = C.recent_window(V.outcomes(spark, d), ["recipe_id"], last(), 20).withColumn("x", F.col("event_id") % 100 / 100.0)
    half = lambda new: F.avg(F.when((F.col("recency") <= 10) == new, F.col("x")))
    g = k.groupBy("recipe_id").agg((half(True) - half(False)).alias("change"), F.count("*").alias("n")).where("n = 20")
    return g.select("recipe_id", F.round("change", 6).alias("change"), F.when(F.col("change") > 0.1, "rising").when(F.col("change") < -0.1, "falling").otherwise("stable").alias("trend"))


@query("w11_floored_outliers", f"{with_views('scan_history')}, g AS (SELECT repo, cycle, weak_point_count AS x, count(*) OVER w AS n, avg(weak_point_count) OVER w AS mean, var_pop(weak_point_count) OVER w AS var FROM scan_history WINDOW w AS (PARTITION BY repo)) SELECT repo, strftime(cycle, '%Y-%m-%d') AS cycle, x AS weak_point_count FROM g WHERE n >= 10 AND abs(x - mean) > 2 * sqrt(greatest(var, 0.0001::DOUBLE)) + 1e-9")
def w11_floored_outliers(spark, d):
    """As ``w11_outliers``, with a floor of 1e-4 under the variance."""
    w = Window.partitionBy("repo")
    x = F.col("weak_point_count")
    g = V.scan_history(spark, d).withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg(x).over(w)).withColumn("var", F.var_pop(x).over(w))
    return g.where((F.col("n") >= 10) & (F.abs(x - F.col("mean")) > 2 * F.sqrt(F.greatest(F.col("var"), F.lit(0.0001))) + 1e-9)).select("repo", F.date_format("cycle", "yyyy-MM-dd").alias("cycle"), "weak_point_count")


@query("a29_common_severity", f"{with_views('weak_points')}, c AS (SELECT category, severity, count(*) AS n FROM weak_points GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, severity) AS k FROM c) SELECT category, severity, n FROM r WHERE k = 1")
def a29_common_severity(spark, d):
    c = V.weak_points(spark, d).groupBy("category", "severity").agg(F.count("*").alias("n"))
    return c.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("m"), "severity", "n")).alias("x")).select("category", "x.severity", "x.n")


@query("a30_issue_counts", f"{with_views('weak_points')} SELECT CASE WHEN category IS NULL THEN '*' ELSE category END AS category, severity, count(*) AS n, count(DISTINCT repo) AS repos FROM weak_points GROUP BY GROUPING SETS ((category, severity), (severity))")
def a30_issue_counts(spark, d):
    w = V.weak_points(spark, d)
    numbers = [F.count("*").alias("n"), F.countDistinct("repo").alias("repos")]
    return w.groupBy("category", "severity").agg(*numbers).unionByName(w.groupBy("severity").agg(*numbers).withColumn("category", F.lit("*")))


@query("u04_set_sizes", f"{with_views('outcomes')}, s AS (SELECT bot, list_sort(list(DISTINCT recipe_id)) AS l FROM outcomes WHERE outcome = 'failure' GROUP BY bot) SELECT a.bot AS a, b.bot AS b, len(list_intersect(a.l, b.l)) AS shared, len(list_distinct(list_concat(a.l, b.l))) AS all_ids FROM s a JOIN s b ON a.bot < b.bot")
def u04_set_sizes(spark, d):
    """Shared and all recipes of each two bots (a handful)."""
    s = V.outcomes(spark, d).where("outcome = 'failure'").groupBy("bot").agg(F.collect_set("recipe_id").alias("l"))
    a, b = s.select(F.col("bot").alias("a"), F.col("l").alias("la")), s.select(F.col("bot").alias("b"), F.col("l").alias("lb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.size(F.array_intersect("la", "lb")).cast("long").alias("shared"), F.size(F.array_union("la", "lb")).cast("long").alias("all_ids"))


@query("t14_stale_heartbeats", f"{with_views('outcomes')}, n AS (SELECT max(ts) AS now FROM outcomes), h AS (SELECT repo, max(ts) AS seen FROM outcomes GROUP BY repo) SELECT repo, date_diff('second', date_trunc('second', seen), date_trunc('second', now)) > 86400 AS stale, date_diff('second', date_trunc('second', seen), date_trunc('second', now)) > 604800 AS critical FROM h, n")
def t14_stale_heartbeats(spark, d):
    """Senders that were last seen more than a day, or a week, before the newest."""
    h = V.outcomes(spark, d).groupBy("repo").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("seen"))
    aged = h.crossJoin(F.broadcast(h.agg(F.max("seen").alias("now"))))
    age = F.col("now") - F.col("seen")
    return aged.select("repo", (age > 86400).alias("stale"), (age > 604800).alias("critical"))


@query("q02_confidence_history", f"WITH {_ACTIONS} SELECT action_id, confidence FROM actions WHERE pattern_id = 'unsafe-call' ORDER BY ts, action_id LIMIT 500")
def q02_confidence_history(spark, d):
    return actions(spark, d).where("pattern_id = 'unsafe-call'").orderBy("ts", "action_id").limit(500).select("action_id", "confidence")


@query("q03_declining_trust", f"{with_views('outcomes')}, g AS (SELECT repo, bot, count(*) AS n, count(*) FILTER (outcome = 'success') / count(*)::DOUBLE AS trust, max(ts) >= (SELECT max(ts) FROM outcomes) - INTERVAL 30 DAY AS active FROM outcomes GROUP BY repo, bot) SELECT repo, bot, n, round(trust, 6) AS trust FROM g WHERE trust < 0.4 AND active")
def q03_declining_trust(spark, d):
    """Bots whose trust on a repository is under 0.4, where they were active within 30 days."""
    o = V.outcomes(spark, d)
    g = o.groupBy("repo", "bot").agg(F.count("*").alias("n"), (F.count_if(F.col("outcome") == "success") / F.count("*")).alias("trust"), F.max("ts").alias("seen"))
    now = F.broadcast(o.agg(F.max("ts").alias("now")))
    return g.where("trust < 0.4").join(now, F.col("seen") >= F.col("now") - F.expr("INTERVAL 30 DAYS")).select("repo", "bot", "n", F.round("trust", 6).alias("trust"))


@query("q04_unresolved", f"{with_views('alerts')} SELECT alert_id, repo, severity FROM alerts WHERE state = 'open' AND severity IN ('critical', 'high') ORDER BY created_at DESC, alert_id DESC LIMIT 200")
def q04_unresolved(spark, d):
    """The newest unresolved alerts."""
    return V.alerts(spark, d).where("state = 'open' AND severity IN ('critical', 'high')").orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).limit(200).select("alert_id", "repo", "severity")


@query("q05_widespread_findings", f"{with_views('weak_points')} SELECT category, description, count(DISTINCT repo) AS repos, list_sort(list(DISTINCT severity)) AS severities FROM weak_points WHERE NOT suppressed GROUP BY 1, 2 HAVING count(DISTINCT repo) >= 5")
def q05_widespread_findings(spark, d):
    g = V.weak_points(spark, d).where("NOT suppressed").groupBy("category", "description")
    return g.agg(F.countDistinct("repo").alias("repos"), F.sort_array(F.collect_set("severity")).alias("severities")).where("repos >= 5")


@query("q07_upsert", f"{with_views('outcomes')}, k AS (SELECT *, row_number() OVER (PARTITION BY recipe_id, repo ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS k FROM outcomes) SELECT recipe_id, repo, event_id, outcome FROM k WHERE k = 1")
def q07_upsert(spark, d):
    """Updates (odd ids) replace stored rows of their key and add those that aren't there."""
    o = V.outcomes(spark, d).select("recipe_id", "repo", "ts", "event_id", "outcome")
    newest = lambda df: df.groupBy("recipe_id", "repo").agg(F.max(F.struct("ts", "event_id", "outcome")).alias("x"))
    stored, updates = newest(o.where("event_id % 2 = 0")).withColumnRenamed("x", "old"), newest(o.where("event_id % 2 = 1"))
    merged = stored.join(updates, ["recipe_id", "repo"], "full").withColumn("x", F.coalesce("x", "old"))
    return merged.select("recipe_id", "repo", "x.event_id", "x.outcome")


# --- Secrets -------------------------------------------------------------------------------------


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("x03_secrets", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS label FROM documents WHERE regexp_matches(text, '{_quoted(p)}')" for n, p in K.SECRETS))
def x03_secrets(spark, d):
    """The kinds of secrets that each document's text shows, in one pass over the texts."""
    shown = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in K.SECRETS]), lambda x: x.isNotNull())
    return V.table(spark, d, "documents").select("doc_id", F.explode(shown).alias("label"))


@query("x04_secret_lines", f"{with_views('file_lines')}, l AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM file_lines) " + " UNION ALL ".join(f"SELECT doc_id, line_no, '{n}' AS label FROM l WHERE regexp_matches(line, '{_quoted(p)}') AND NOT contains(line, 'allow-secret') AND NOT coalesce(contains(before, 'allow-secret'), false)" for n, p in K.SECRETS))
def x04_secret_lines(spark, d):
    """Lines that show a secret, unless they or the line before say that it is allowed."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    shown = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in K.SECRETS]), lambda x: x.isNotNull())
    allowed = F.contains("line", F.lit("allow-secret")) | F.coalesce(F.contains("before", F.lit("allow-secret")), F.lit(False))
    return V.file_lines(spark, d).withColumn("before", before).where(~allowed).select("doc_id", "line_no", F.explode(shown).alias("label"))
