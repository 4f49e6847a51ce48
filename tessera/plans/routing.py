"""Registered queries of recipe choice, triangle routes, classifications and models.

Recipes stand on all parts, patterns on the pattern view, changes and alerts on
orders; the SQL of ``_BOOK``, ``_ASKED`` and ``_CHANGES`` says how.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import graph as G
from tessera.operators import models as M
from tessera.operators import routing as R
from tessera.operators.governance import lookup
from tessera.plans.content import _at, _list, _quoted, _sql_at
from tessera.plans.queries import query
from tessera.sources import views as V
from tessera.sources.views import with_views

SPOKEN = ("rust", "shell", "python", "*", "any")
TIERS = ("eliminate", "substitute", "control")


def recipe_book(spark, d):
    """(id, confidence, tier, languages, categories, pattern_ids) of all parts."""
    k = F.col("p_partkey")
    word = V.fingerprint(F.col("p_name"))
    return V.table(spark, d, "part").select(
        F.concat(F.lit("recipe-"), k).alias("id"), (k * 37 % 100 / 100.0).alias("confidence"), _at(TIERS, F.col("p_size").cast("long")).alias("tier"), F.array(_at(SPOKEN, k)).alias("languages"),
        F.when((k % 3 == 0) & (F.length("p_type") % 2 == 0), F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("categories"),
        F.when(k % 5 != 0, F.array(F.concat(F.lit("PA"), k % 9, F.lit("-"), word))).otherwise(F.array().cast("array<string>")).alias("pattern_ids"),
    )


_BOOK = f"""book AS (SELECT 'recipe-' || p_partkey AS id, (p_partkey * 37 % 100) / 100.0::DOUBLE AS confidence, {_sql_at(TIERS, 'p_size')} AS tier, {_sql_at(SPOKEN, 'p_partkey')} AS language,
  CASE WHEN p_partkey % 3 = 0 AND length(p_type) % 2 = 0 THEN p_type END AS category, CASE WHEN p_partkey % 5 <> 0 THEN 'PA' || (p_partkey % 9) || '-' || substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 30) END AS pattern_id FROM part)"""


def asked(spark, d):
    """Patterns with an id, a rule and a language."""
    p = V.patterns(spark, d)
    rule = F.concat(F.lit("PA"), F.col("occurrences") % 12)
    return p.select(F.concat_ws("-", rule, "fingerprint").alias("id"), "category", F.concat(F.lit("Found "), "fingerprint").alias("description"), rule.alias("pa_rule"), _at(("rust", "shell", "julia"), F.col("repos_affected")).alias("language"))


_ASKED = "asked AS (SELECT 'PA' || (occurrences % 12) || '-' || fingerprint AS id, category, 'Found ' || fingerprint AS description, 'PA' || (occurrences % 12) AS pa_rule, (['rust', 'shell', 'julia'])[(repos_affected % 3 + 1)::INT] AS language FROM patterns)"
_MATCHED = f"""{with_views('patterns')}, {_BOOK}, {_ASKED}, words AS (SELECT *, unnest(string_split(pattern_id, '-')) AS word FROM book),
m AS (SELECT a.*, 1 AS step, b.id AS recipe_id, b.confidence, b.tier FROM asked a JOIN book b ON b.pattern_id = a.id AND b.language IN ('*', 'any', a.language)
UNION ALL SELECT a.*, 2, b.id, b.confidence, b.tier FROM asked a JOIN book b ON b.category = a.category AND b.language IN ('*', 'any', a.language)
UNION ALL SELECT a.*, 3, b.id, b.confidence, b.tier FROM asked a JOIN words b ON starts_with(b.pattern_id, a.pa_rule || '-') AND b.word <> a.pa_rule AND b.word <> '' AND contains(lower(a.description), b.word) AND b.language IN ('*', 'any', a.language)),
best AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY category, description, id ORDER BY step, confidence DESC, recipe_id) AS k FROM m) WHERE k = 1),
b AS (SELECT a.*, best.step, best.recipe_id, best.confidence, best.tier FROM asked a LEFT JOIN best USING (category, description, id))"""
_SUBS = "s AS (SELECT DISTINCT p_type AS category, CASE WHEN p_type = 'PROMO' THEN 'eliminate' ELSE 'substitute' END AS sub_tier, CASE WHEN length(p_type) % 2 = 1 AND p_type <> 'SMALL' THEN ['SafeMath'] ELSE []::VARCHAR[] END AS modules FROM part)"


def _best(spark, d):
    return R.best_recipes(asked(spark, d), recipe_book(spark, d))


def _routed(spark, d):
    kind = F.col("p_type")
    modules = F.when((F.length(kind) % 2 == 1) & (kind != "SMALL"), F.array(F.lit("SafeMath"))).otherwise(F.array().cast("array<string>"))
    subs = V.table(spark, d, "part").select(kind.alias("category"), F.when(kind == "PROMO", "eliminate").otherwise("substitute").alias("sub_tier"), modules.alias("modules")).distinct()
    return R.triangle(_best(spark, d), subs)


@query("j04_recipe_steps", f"{_MATCHED} SELECT id, category, description, coalesce(step, 0)::BIGINT AS step, recipe_id, coalesce(confidence, 0) AS confidence FROM b")
def j04_recipe_steps(spark, d):
    """The best recipe of each pattern: by its id, else its category, else its rule and a keyword; step 0 found none."""
    return _best(spark, d).select("id", "category", "description", F.coalesce("step", F.lit(0)).cast("long").alias("step"), "recipe_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


_ROUTE = f"""{_MATCHED}, {_SUBS}, t AS (SELECT b.*, CASE WHEN tier = 'eliminate' OR sub_tier = 'eliminate' THEN 'eliminate' WHEN recipe_id IS NOT NULL OR len(modules) > 0 THEN 'substitute' ELSE 'control' END AS route,
CASE WHEN tier = 'eliminate' THEN recipe_id WHEN sub_tier = 'eliminate' THEN 'synthetic-eliminate-' || category WHEN recipe_id IS NOT NULL THEN recipe_id WHEN len(modules) > 0 THEN 'proven-substitute-' || category END AS routed_id FROM b LEFT JOIN s USING (category))"""


@query("r01_full_route", f"{_ROUTE} SELECT id, category, description, route, routed_id FROM t")
def r01_full_route(spark, d):
    return _routed(spark, d).select("id", "category", "description", "route", "routed_id")


@query("a17_route_counts", f"{_ROUTE} SELECT route, count(*) AS n, count(DISTINCT routed_id) AS recipes, count(*) FILTER (step = 1) AS by_id, count(*) FILTER (step = 3) AS by_keyword FROM t GROUP BY 1")
def a17_route_counts(spark, d):
    return _routed(spark, d).groupBy("route").agg(F.count("*").alias("n"), F.countDistinct("routed_id").alias("recipes"), F.count_if(F.col("step") == 1).alias("by_id"), F.count_if(F.col("step") == 3).alias("by_keyword"))


# --- Policies and classifications ----------------------------------------------------------------

NAMED = ("Rust", "TypeScript", "python", "Idris2", "golang", "cobol", "Kotlin", "ADA")


@query("f14_language_policy", f"WITH l AS (SELECT s_suppkey, {_sql_at(NAMED, 's_suppkey')} AS language FROM supplier) SELECT s_suppkey, lower(language) IN ({', '.join(map(_quoted, R.ALLOWED))}) AS allowed, CASE lower(language) {' '.join(f'WHEN {_quoted(a)} THEN {_quoted(b)}' for a, b in R.BANNED.items())} END AS replacement FROM l")
def f14_language_policy(spark, d):
    language = F.lower(_at(NAMED, F.col("s_suppkey")))
    return V.table(spark, d, "supplier").select("s_suppkey", language.isin(*R.ALLOWED).alias("allowed"), lookup(language, R.BANNED).alias("replacement"))


TITLED = (
    "chore(ci): replace mirror.yml with reusable wrapper", "chore(ci): replace rust-ci.yml with reusable wrapper (#3)", "docs: adopt docs-template/ skeleton", "chore: migrate LICENSE to MPL-2.0", "Bump a from 1 to 2",
    "feat: docs: adopt docs-template/ skeleton", "chore(linguist): exclude vendor", "refactor b", "docs(readme): expand stub README",
)
BRANCHES = ("main", "dependabot/a", "security/b", "chore/c", "refactor/d")
FILES = ("src/a.rs", "LICENSE", "docs/b.md", "proofs/c.txt", "lib/SECURITY.ex", "d.lean", ".github/workflows/e.yml", "README.adoc", "LICENSES.txt", "src/licenses/x", "NOTICE.md", ".github/f.YML")


def _changes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return V.table(spark, d, "orders").select(
        k.alias("pr"), _at(TITLED, k).alias("title"), _at(BRANCHES, c).alias("branch"), F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(_at(FILES, k + c), _at(FILES, k * 5))).alias("files"),
        F.when(k % 17 == 0, F.array(F.lit("security"))).otherwise(F.array().cast("array<string>")).alias("labels"), (k % 11 == 0).alias("draft"), _at(("MERGEABLE", "CONFLICTING", "UNKNOWN"), c).alias("mergeable"), _at(("BLOCKED", "CLEAN", "UNSTABLE", "DIRTY"), k + c).alias("state"), "o_orderdate",
    )


_CHANGES = f"""c AS (SELECT o_orderkey AS pr, {_sql_at(TITLED, 'o_orderkey')} AS title, {_sql_at(BRANCHES, 'o_custkey')} AS branch, CASE WHEN o_orderkey % 13 = 0 THEN []::VARCHAR[] ELSE [{_sql_at(FILES, '(o_orderkey + o_custkey)')}, {_sql_at(FILES, '(o_orderkey * 5)')}] END AS files,
  CASE WHEN o_orderkey % 17 = 0 THEN ['security'] ELSE []::VARCHAR[] END AS labels, o_orderkey % 11 = 0 AS draft, (['MERGEABLE', 'CONFLICTING', 'UNKNOWN'])[(o_custkey % 3 + 1)::INT] AS mergeable, (['BLOCKED', 'CLEAN', 'UNSTABLE', 'DIRTY'])[((o_orderkey + o_custkey) % 4 + 1)::INT] AS state, o_orderdate FROM orders)"""


@query("f15_eligibility", f"WITH {_CHANGES} SELECT pr, CASE WHEN draft OR mergeable = 'CONFLICTING' OR state = 'DIRTY' THEN 'state_blocked' " + " ".join(f"WHEN regexp_matches(title, {_quoted(p)}) THEN '{r}'" for p, r in R.TITLES) + " ELSE 'requires_review' END AS verdict FROM c")
def f15_eligibility(spark, d):
    return _changes(spark, d).select("pr", R.eligibility(F.col("title"), F.col("draft"), F.col("mergeable"), F.col("state")).alias("verdict"))


@query("f15_stalled_bumps", f"WITH {_CHANGES}, n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT pr FROM c, n WHERE branch LIKE 'dependabot/%' AND len(labels) = 0 AND floor((epoch(now) - epoch(o_orderdate)) / 86400) >= 7")
def f15_stalled_bumps(spark, d):
    """Bumps of a bot that wait for a review (here: without labels) for seven whole days."""
    c = _changes(spark, d)
    now = F.broadcast(V.table(spark, d, "orders").agg(F.max("o_orderdate").alias("now")))
    age = F.floor((F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400)
    return c.where(F.col("branch").startswith("dependabot/") & (F.size("labels") == 0)).join(now, F.lit(True)).where(age >= 7).select("pr")


_FILE = lambda test: f"len(list_filter(files, lambda p: {test})) > 0"


@query(
    "r08_change_class",
    f"""WITH {_CHANGES} SELECT pr, CASE WHEN {_FILE("regexp_matches(lower(p), '[.](license|spdx)$') OR contains(p, '/licenses/') OR starts_with(p, 'licenses/') OR split_part(p, '/', -1) IN ('LICENSE', 'COPYING', 'COPYING.LESSER', 'NOTICE', 'UNLICENSE') OR starts_with(split_part(p, '/', -1), 'LICENSE.') OR starts_with(split_part(p, '/', -1), 'LICENSE-')")} THEN 'license_touch'
WHEN starts_with(branch, 'dependabot/') OR starts_with(branch, 'renovate/') OR starts_with(title, 'Bump ') OR starts_with(title, 'chore(deps') OR starts_with(title, 'build(deps') THEN 'bump' WHEN {_FILE("regexp_matches(lower(p), '[.](agda|idr|idr2|lean|v|thy)$') OR contains(p, 'proofs/')")} THEN 'proof'
WHEN {_FILE("contains(p, 'SECURITY') OR contains(p, 'security/')")} OR starts_with(branch, 'security/') OR list_contains(labels, 'security') THEN 'security' WHEN len(files) > 0 AND len(list_filter(files, lambda p: regexp_matches(lower(p), '[.](adoc|md|txt|rst)$') OR contains(p, 'docs/'))) = len(files) THEN 'docs'
WHEN starts_with(branch, 'chore/') OR starts_with(lower(title), 'chore') THEN 'chore' WHEN starts_with(branch, 'refactor/') OR starts_with(lower(title), 'refactor') THEN 'refactor' ELSE 'feature' END AS change_class,
CASE WHEN {_FILE("contains(p, '.github/workflows/') OR (contains(p, '.github/') AND regexp_matches(lower(p), '[.]ya?ml$')) OR contains(p, 'lib/rules/')")} THEN 'meta' ELSE 'object' END AS change_level FROM c""",
)
def r08_change_class(spark, d):
    c = _changes(spark, d)
    return c.select("pr", R.change_class(F.col("files"), F.col("branch"), F.col("title"), F.col("labels")).alias("change_class"), R.change_level(F.col("files")).alias("change_level"))


SCORED = ("MaintainedID", "PinnedDependenciesID", "SASTID", "BranchProtectionID", "TokenPermissionsID", "CodeReviewID", "CITestsID")


@query("r05_scorecard_actions", f"WITH r AS (SELECT {_sql_at(SCORED, 'o_orderkey')} AS rule, o_custkey % 4 = 0 AS exempt FROM orders) SELECT rule, CASE WHEN rule IN ('MaintainedID', 'ContributorsID', 'CITestsID', 'CIIBestPracticesID') THEN 'dismiss_info' WHEN rule = 'PinnedDependenciesID' AND exempt THEN 'dismiss_accept' WHEN rule IN ('SASTID', 'PinnedDependenciesID') THEN 'fix' WHEN rule IN ('BranchProtectionID', 'CodeReviewID') THEN 'fix_settings' ELSE 'open_escalate' END AS action, count(*) AS n FROM r GROUP BY ALL")
def r05_scorecard_actions(spark, d):
    a = V.table(spark, d, "orders").select(_at(SCORED, F.col("o_orderkey")).alias("rule"), (F.col("o_custkey") % 4 == 0).alias("exempt"))
    return a.groupBy("rule", R.scorecard_action(F.col("rule"), F.col("exempt")).alias("action")).agg(F.count("*").alias("n"))


@query(
    "r06_synthesised_recipes",
    f"""{with_views('patterns')}, {_BOOK}, u AS (SELECT * FROM patterns WHERE category NOT IN (SELECT category FROM book WHERE category IS NOT NULL)), s AS (SELECT category, severity_rank, count(*) AS c FROM u GROUP BY 1, 2),
m AS (SELECT category, severity_rank, row_number() OVER (PARTITION BY category ORDER BY c DESC, severity_rank DESC) AS k FROM s)
SELECT 'recipe-' || trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-') AS id, category, 0.5::DOUBLE AS confidence, 'control' AS tier, max(m.severity_rank) AS severity_rank, count(*) AS pattern_count FROM u JOIN m USING (category) WHERE k = 1 GROUP BY category""",
)
def r06_synthesised_recipes(spark, d):
    """A cautious recipe for each category that none covers, with its most common severity."""
    covered = recipe_book(spark, d).select(F.explode("categories").alias("category")).distinct()
    u = V.patterns(spark, d).join(covered, "category", "left_anti")
    top = u.groupBy("category", "severity_rank").agg(F.count("*").alias("c")).groupBy("category").agg(F.max(F.struct("c", "severity_rank")).alias("x"), F.sum("c").alias("pattern_count"))
    return top.select(F.concat(F.lit("recipe-"), V.fingerprint(F.col("category"))).alias("id"), "category", F.lit(0.5).alias("confidence"), F.lit("control").alias("tier"), F.col("x.severity_rank").alias("severity_rank"), "pattern_count")


CLAIMS = ("buffer stays linear", "loop terminates", "by simp and omega", "Equivalence of both parsers", "state is memory-safe", "holds, sorry", "nothing known", "rfl", "ring, simp, norm_num", "unsafe cast is safe")


@query(
    "r10_obligations",
    f"""WITH c AS (SELECT o_orderkey, {_sql_at(CLAIMS, 'o_orderkey')} AS claim, CASE WHEN o_custkey % 10 = 0 THEN 'Admitted.' ELSE '' END AS context FROM orders),
e AS (SELECT *, claim || ' ' || context AS both_texts, len(list_filter({_list(R.TACTICS)}, lambda t: contains(lower(claim || ' ' || context), t))) AS tactics FROM c),
g AS (SELECT *, CASE WHEN len(list_filter({_list(R.CONTROL_MARKERS)}, lambda t: contains(both_texts, t))) > 0 THEN 'control' WHEN tactics > 0 THEN 'eliminate' ELSE 'substitute' END AS tier FROM e)
SELECT o_orderkey, tier, CASE tier WHEN 'control' THEN 'hard_obligation' WHEN 'eliminate' THEN 'decidable' ELSE CASE """ + " ".join(f"WHEN len(list_filter({_list(words)}, lambda t: contains(lower(claim), t))) > 0 THEN '{k}'" for k, words in R.OBLIGATIONS) + """ ELSE 'unknown' END END AS class,
CASE tier WHEN 'control' THEN 0.5::DOUBLE WHEN 'substitute' THEN 0.75::DOUBLE ELSE CASE WHEN tactics >= 3 THEN 0.96::DOUBLE WHEN tactics = 2 THEN 0.93::DOUBLE ELSE 0.9::DOUBLE END END AS confidence FROM g""",
)
def r10_obligations(spark, d):
    context = F.when(F.col("o_custkey") % 10 == 0, "Admitted.").otherwise("")
    tier, kind, confidence = R.obligation(_at(CLAIMS, F.col("o_orderkey")), context)
    return V.table(spark, d, "orders").select("o_orderkey", tier.alias("tier"), kind.alias("class"), confidence.alias("confidence"))


SEVERITIES = ("critical", "high", "medium", "low", "unknown")
_ALERT = f"""a AS (SELECT o_orderkey, (['open', 'open', 'open', 'fixed', 'dismissed'])[(o_custkey % 5 + 1)::INT] AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'tolerable_risk' ELSE 'not_used' END AS reason, {_sql_at(SEVERITIES, 'o_orderkey')} AS severity,
  '< ' || (o_orderkey % 3 + 1) || '.2.0' AS from_range, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'next' ELSE 'v' || (o_custkey % 3 + 1) || '.3.1' END AS fixed_in, o_custkey % 2 = 0 AS strict FROM orders)"""


@query(
    "r10_dependency_alerts",
    f"""WITH {_ALERT}, v AS (SELECT *, (o_orderkey % 3 + 1) AS old, TRY_CAST(nullif(regexp_extract(fixed_in, '^v*(\\d+)', 1), '') AS BIGINT) AS new FROM a), s AS (SELECT *, CASE WHEN new > old THEN 'major' WHEN new = old THEN 'same' ELSE 'minor' END AS step FROM v),
b AS (SELECT *, CASE severity || '|' || step """ + " ".join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in R.BUMP_CONFIDENCE.items()) + """ ELSE 0.8::DOUBLE END AS base FROM s), c AS (SELECT *, round(CASE WHEN strict THEN least(base + 0.01::DOUBLE, 0.98::DOUBLE) ELSE greatest(base - 0.03::DOUBLE, 0.7::DOUBLE) END, 4) AS sure FROM b),
t AS (SELECT *, CASE WHEN state = 'dismissed' AND reason = 'tolerable_risk' THEN 'control' WHEN state = 'fixed' OR fixed_in IS NULL THEN 'control' WHEN step = 'major' THEN 'substitute' WHEN sure >= 0.85 THEN 'eliminate' ELSE 'substitute' END AS tier FROM c)
SELECT o_orderkey, tier, CASE tier WHEN 'control' THEN 0.5::DOUBLE WHEN 'substitute' THEN 0.85::DOUBLE ELSE sure END AS confidence FROM t""",
)
def r10_dependency_alerts(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fixed = F.when(k % 19 == 0, F.lit(None).cast("string")).when(k % 23 == 0, "next").otherwise(F.concat(F.lit("v"), c % 3 + 1, F.lit(".3.1")))
    tier, confidence = R.dependency_alert(_at(("open", "open", "open", "fixed", "dismissed"), c), F.when(k % 2 == 0, "tolerable_risk").otherwise("not_used"), _at(SEVERITIES, k), F.concat(F.lit("< "), k % 3 + 1, F.lit(".2.0")), fixed, c % 2 == 0)
    return V.table(spark, d, "orders").select("o_orderkey", tier.alias("tier"), confidence.alias("confidence"))


SIDES = ("Js.Array.map(x)", "Array.map(x)", "Belt.Map.get(y)", "Option.map(z)", "plain(w)")


@query(
    "r11_conflict_choice",
    f"WITH s AS (SELECT {_sql_at(SIDES, 'o_orderkey')} AS ours, {_sql_at(SIDES, 'o_custkey')} AS theirs FROM orders), f AS (SELECT ours, theirs, " + ", ".join(f"len(list_filter({_list(words)}, lambda t: contains({side}, t))) > 0 AS {side}_{name}" for side in ("ours", "theirs") for name, words in (("new", R.MODERN), ("old", R.DEPRECATED))) + " FROM s) SELECT ours, theirs, CASE WHEN ours_new AND theirs_old THEN 'chose_ours' WHEN theirs_new AND ours_old THEN 'chose_theirs' ELSE 'manual_merge' END AS choice, count(*) AS n FROM f GROUP BY ALL",
)
def r11_conflict_choice(spark, d):
    s = V.table(spark, d, "orders").select(_at(SIDES, F.col("o_orderkey")).alias("ours"), _at(SIDES, F.col("o_custkey")).alias("theirs"))
    return s.groupBy("ours", "theirs", R.conflict_choice(F.col("ours"), F.col("theirs")).alias("choice")).agg(F.count("*").alias("n"))


@query(
    "r12_honesty",
    "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 13 % 101 END AS claimed, (c_custkey * 7 % 60) AS deductions FROM customer), a AS (SELECT *, greatest(0, least(100, coalesce(claimed, 50) - deductions)) AS adjusted FROM c) SELECT c_custkey, adjusted, coalesce(claimed - adjusted, 0) AS delta, CASE WHEN claimed IS NULL THEN 'no_claim' WHEN abs(claimed - adjusted) <= 5 THEN 'honest' WHEN abs(claimed - adjusted) <= 15 THEN 'optimistic' WHEN abs(claimed - adjusted) <= 30 THEN 'inflated' ELSE 'dishonest' END AS grade FROM a",
)
def r12_honesty(spark, d):
    k = F.col("c_custkey")
    claimed = F.when(k % 7 != 0, k * 13 % 101)
    adjusted, grade = R.honesty(claimed, k * 7 % 60)
    return V.table(spark, d, "customer").select("c_custkey", adjusted.alias("adjusted"), F.coalesce(claimed - adjusted, F.lit(0)).alias("delta"), grade.alias("grade"))


@query(
    "a24_conformance_coverage",
    """WITH r AS (SELECT s_suppkey, s_nationkey, l.l_linenumber % 4 AS v, l.l_linenumber AS weight FROM supplier JOIN lineitem l ON l_suppkey = s_suppkey),
g AS (SELECT s_suppkey, sum(weight) FILTER (v <> 3)::DOUBLE AS applicable, sum(weight) FILTER (v IN (0, 1))::DOUBLE AS verified, coalesce(sum(CASE v WHEN 0 THEN weight WHEN 1 THEN weight / 2.0::DOUBLE END), 0)::DOUBLE AS passed FROM r GROUP BY 1)
SELECT s_suppkey, round(CASE WHEN verified > 0 THEN passed / verified * 100 ELSE 0 END, 2) AS score, round(CASE WHEN applicable > 0 THEN coalesce(verified, 0) / applicable ELSE 0 END, 4) AS coverage FROM g""",
)
def a24_conformance_coverage(spark, d):
    """Passed weight (partial: half) of the verified, and verified of the applicable; criteria by line number."""
    v, w = F.col("l_linenumber") % 4, F.col("l_linenumber")
    g = V.table(spark, d, "lineitem").join(V.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey").agg(F.sum(F.when(v != 3, w)).alias("a"), F.sum(F.when(v.isin(0, 1), w)).alias("b"), F.sum(F.when(v == 0, w).when(v == 1, w / 2.0)).alias("c"))
    ratio = lambda x, y: F.when(F.col(y) > 0, F.coalesce(x, F.lit(0)) / F.col(y)).otherwise(0.0)
    return g.select("s_suppkey", F.round(ratio("c", "b") * 100, 2).alias("score"), F.round(ratio("b", "a"), 4).alias("coverage"))


@query("g04_attention", None)
def g04_attention(spark, d):
    """Recipes and bots by trust, best first, and repositories below 0.4, worst first."""
    r = G.page_rank(G.trust_edges(V.outcomes(spark, d)))
    kind = F.regexp_extract("node", "^([a-z]+)-", 1)
    wanted = r.withColumn("kind", kind).where("kind IN ('recipe', 'bot') OR score < 0.4")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "repo", F.col("score")).otherwise(-F.col("score")), "node"))
    return wanted.select("kind", "node", "score", place.alias("place"))


_NEEDS = "n AS (SELECT s_suppkey AS node FROM supplier), e AS (SELECT s_suppkey AS node, s_suppkey // 2 AS needs FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey, s_suppkey - 7 FROM supplier WHERE s_suppkey % 3 = 0)"


@query("g08_order", f"WITH RECURSIVE {_NEEDS}, k AS (SELECT e.* FROM e JOIN n a USING (node) JOIN n b ON b.node = e.needs WHERE e.node <> e.needs), r(node, level) AS (SELECT node, 0 FROM n UNION SELECT k.node, r.level + 1 FROM r JOIN k ON k.needs = r.node) SELECT node, max(level)::BIGINT AS level FROM r GROUP BY node")
def g08_order(spark, d):
    """Bots after all that they depend on."""
    s = F.col("s_suppkey")
    nodes = V.table(spark, d, "supplier").select(s.alias("node"))
    edges = V.table(spark, d, "supplier").select(s.alias("node"), F.explode(F.array(F.when(s > 0, F.floor(s / 2)), F.when(s % 3 == 0, s - 7))).alias("needs")).where("needs IS NOT NULL AND node <> needs")
    return R.ordered(edges, nodes)


# --- Models --------------------------------------------------------------------------------------


def _model(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return e, M.radial_network(e.withColumn("y", (F.col("label") % 2).cast("double")))


@query("m02_kmeans", None)
def m02_kmeans(spark, d):
    """The nearest of the fitted centres, over whole vectors."""
    e, net = _model(spark, d)
    return M.nearest(e, net).select("vec_id", "centre", "distance")


@query("m04_readout", None)
def m04_readout(spark, d):
    """Predicted probability from Gaussian activations of fitted centres, and novelty."""
    e, net = _model(spark, d)
    return M.predict(e, net).select("vec_id", "prediction", "novel")


