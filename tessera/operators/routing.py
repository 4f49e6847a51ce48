"""Choosing a recipe for each pattern, and the rules that classify changes, alerts and claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import written

# Fixed values
ANY = ("*", "any")
WORKFLOW_CATEGORIES = ("DependencyPinning", "PinnedDependencies", "TokenPermissions", "DangerousWorkflow", "DependencyUpdateTool", "BranchProtection")
ALLOWED = ("affine", "rust", "gleam", "julia", "logtalk", "haskell", "bash", "nickel", "guile", "ocaml", "ada", "elixir", "zig", "idris2")
BANNED = {"typescript": "affine", "rescript": "affine", "nodejs": "deno", "golang": "rust", "python": "julia", "java": "rust", "kotlin": "rust", "swift": "tauri"}
TITLES = (
    (r"^chore\(ci\): replace secret-scanner\.yml with reusable wrapper", "AM001"),
    (r"^chore\(ci\): replace scorecard\.yml with reusable wrapper", "AM002"),
    (r"^chore\(ci\): replace codeql\.yml with reusable wrapper", "AM003"),
    (r"^chore\(ci\): replace mirror\.yml with reusable wrapper", "AM004"),
    (r"^chore\(ci\): replace rust-ci\.yml with reusable wrapper", "AM006"),
    (r"^chore\(ci\): replace elixir-ci\.yml with reusable wrapper", "AM006"),
    (r"^docs: seed CHANGELOG\.md \(Keep-a-Changelog format\)", "AM007"),
    (r"^docs: adopt docs-template/ skeleton", "AM008"),
    (r"^docs\(readme\): expand stub README", "AM008"),
    (r"^docs: record tech-debt audit findings", "AM008"),
    (r"^chore\(linguist\): exclude ", "AM009"),
    (r"^license/migrate-to-mpl-2\.0|^chore: migrate.*MPL-2\.0", "AM009"),
)
INFO_RULES = ("MaintainedID", "ContributorsID", "CITestsID", "CIIBestPracticesID")
SETTINGS_RULES = ("BranchProtectionID", "CodeReviewID")
CONTROL_MARKERS = ("sorry", "Admitted", "admit", "SORRY", "ADMIT", "postulate", "axiom", "assume", "believe_me", "assert_total", "unsafeCoerce", "unsafe")
TACTICS = ("simp", "omega", "decide", "ring", "norm_num", "linarith", "trivial", "tauto", "auto", "exact", "rfl", "refl", "native_decide", "decide!", "norm_cast", "push_cast")
OBLIGATIONS = (
    ("linearity", ("linear", "affine", "ownership", "borrow")),
    ("termination", ("terminat", "halt", "total", "recursi", "well-founded")),
    ("equiv", ("equiv", "bisimul", "preserves behavior", "preserves behaviour", "refine")),
    ("safety", ("safe", "invariant", "non-interference", "memory-safe", "crash-free")),
)
MODERN = ("Array.", "Dict.", "Console.", "String.", "Promise.", "Option.", "Result.", "Map.", "Set.", "Int.", "Float.", "Math.", "RegExp.", "Nullable.", "JSON.")
DEPRECATED = ("Js.", "Belt.")
BUMP_CONFIDENCE = {"critical|same": 0.97, "high|same": 0.95, "medium|same": 0.92, "low|same": 0.88, "critical|minor": 0.93, "high|minor": 0.90, "medium|minor": 0.87, "low|minor": 0.82}


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _best(recipes: DataFrame, *keys: str) -> DataFrame:
    """The most confident recipe of each key, the least id on ties."""
    pick = F.min(F.struct((-F.col("confidence")).alias("c"), "id", "tier")).alias("best")
    return recipes.groupBy(*keys).agg(pick)


def best_recipes(patterns: DataFrame, recipes: DataFrame) -> DataFrame:
    """Patterns (id, category, description, pa_rule, language) with step, recipe_id, confidence and tier.

    The first step that finds a recipe decides: one that lists the pattern, one
    for its category, one of its rule with a keyword in the description.
    Recipes are (id, confidence, tier, languages, categories, pattern_ids);
    each step keeps the best recipe of a key before it joins, so that joins meet
    one row a key and never a recipe with all patterns.
    """
    spoken = F.when(F.size(F.array_intersect("languages", F.array(*map(F.lit, ANY)))) > 0, F.array(F.lit("*"))).otherwise(F.array_distinct("languages"))
    r = recipes.withColumn("language", F.explode(spoken))
    exact = _best(r.withColumn("key", F.explode(F.array_distinct("pattern_ids"))), "key", "language")
    kind = _best(r.withColumn("key", F.explode(F.array_distinct("categories"))), "key", "language")
    named = r.withColumn("pattern_id", F.explode(F.array_distinct("pattern_ids")))
    rules = named.select("id", "language", "confidence", "tier", F.regexp_extract("pattern_id", "^([^-]+)-", 1).alias("key"), F.explode(F.array_distinct(F.split("pattern_id", "-"))).alias("word"))
    words = _best(rules.where("key <> '' AND word <> '' AND word <> key"), "key", "word", "language")

    effective = F.when(F.col("category").isin(*WORKFLOW_CATEGORIES), "yaml").otherwise(F.col("language"))
    p = patterns.withColumn("_pattern", F.struct(*patterns.columns))
    tries = lambda language: F.explode(F.array_distinct(F.array(language, F.lit("*")))).alias("language")
    lower = lambda df: df.groupBy("_pattern").agg(F.min("best").alias("best"))
    a = lower(p.select("_pattern", F.col("id").alias("key"), tries(F.col("language"))).join(exact, ["key", "language"]))
    b = lower(p.select("_pattern", F.col("category").alias("key"), tries(effective)).join(kind, ["key", "language"]))
    c = p.where("pa_rule <> ''").select("_pattern", F.col("pa_rule").alias("key"), F.lower("description").alias("text"), tries(effective)).join(words, ["key", "language"])
    c = lower(c.where(F.contains("text", "word")))
    found = a.withColumn("step", F.lit(1)).unionByName(b.withColumn("step", F.lit(2))).unionByName(c.withColumn("step", F.lit(3)))
    first = found.groupBy("_pattern").agg(F.min(F.struct("step", "best")).alias("x"))
    out = p.join(first, "_pattern", "left")
    return out.select(*patterns.columns, F.col("x.step").alias("step"), F.col("x.best.id").alias("recipe_id"), (-F.col("x.best.c")).alias("confidence"), F.col("x.best.tier").alias("tier"))


def triangle(best: DataFrame, substitutions: DataFrame) -> DataFrame:
    """Adds route and routed_id: eliminate, substitute or control.

    Substitutions are (category, sub_tier, modules), one row a category.  An
    eliminating substitution comes before a recipe that only substitutes.
    """
    s = best.join(substitutions, "category", "left")
    eliminate, proven = F.col("tier") == "eliminate", F.size(F.coalesce("modules", F.array().cast("array<string>"))) > 0
    route = F.when(eliminate | (F.col("sub_tier") == "eliminate"), "eliminate").when(F.col("recipe_id").isNotNull() | proven, "substitute").otherwise("control")
    routed = F.when(eliminate, F.col("recipe_id")).when(F.col("sub_tier") == "eliminate", F.concat(F.lit("synthetic-eliminate-"), "category"))
    routed = routed.when(F.col("recipe_id").isNotNull(), F.col("recipe_id")).when(proven, F.concat(F.lit("proven-substitute-"), "category"))
    return s.withColumn("route", route).withColumn("routed_id", routed).drop("sub_tier", "modules")


def eligibility(title: Column, draft: Column, mergeable: Column, state: Column) -> Column:
    """state_blocked, the rule of the first fitting title, or requires_review."""
    out = F.when(draft | (mergeable == "CONFLICTING") | (state == "DIRTY"), F.lit("state_blocked"))
    for pattern, rule in TITLES:
        out = out.when(title.rlike(pattern), F.lit(rule))
    return out.otherwise("requires_review")


def change_class(files: Column, branch: Column, title: Column, labels: Column) -> Column:
    """The most guarded class that a change shows."""
    some = lambda pattern: F.exists(files, lambda p: p.rlike(pattern))
    starts = lambda c, *heads: reduce(lambda a, b: a | b, [c.startswith(h) for h in heads])
    license_touch = some(r"(?i)\.(license|spdx)$") | some(r"(^|/)(LICENSE|COPYING|COPYING\.LESSER|NOTICE|UNLICENSE|LICENSE[.-][^/]*)$|/licenses/|^licenses/")
    bump = starts(branch, "dependabot/", "renovate/") | starts(title, "Bump ", "chore(deps", "build(deps")
    docs = (F.size(files) > 0) & F.forall(files, lambda p: p.rlike(r"(?i)\.(adoc|md|txt|rst)$") | p.contains("docs/"))
    security = some("SECURITY|security/") | branch.startswith("security/") | F.array_contains(labels, "security")
    out = F.when(license_touch, "license_touch").when(bump, "bump").when(some(r"(?i)\.(agda|idr|idr2|lean|v|thy)$") | some("proofs/"), "proof")
    out = out.when(security, "security").when(docs, "docs").when(branch.startswith("chore/") | F.lower(title).startswith("chore"), "chore")
    return out.when(branch.startswith("refactor/") | F.lower(title).startswith("refactor"), "refactor").otherwise("feature")


def change_level(files: Column) -> Column:
    """meta where a change touches what judges changes."""
    meta = F.exists(files, lambda p: p.rlike(r"\.github/workflows/|/bot_directives/|^bot_directives/|lib/rules/|merge-orchestration/(schemas|ci-templates)") | (p.contains(".github/") & p.rlike(r"(?i)\.ya?ml$")))
    return F.when(meta, "meta").otherwise("object")


def scorecard_action(rule: Column, exempt: Column) -> Column:
    out = F.when(rule.isin(*INFO_RULES), "dismiss_info").when((rule == "PinnedDependenciesID") & exempt, "dismiss_accept")
    return out.when(rule.isin("SASTID", "PinnedDependenciesID"), "fix").when(rule.isin(*SETTINGS_RULES), "fix_settings").otherwise("open_escalate")


def obligation(claim: Column, context: Column) -> tuple[Column, Column, Column]:
    """(tier, class, confidence) of a claim to be proved."""
    both = F.concat(claim, F.lit(" "), context)
    tactics = reduce(lambda a, b: a + b, [F.contains(F.lower(both), F.lit(t)).cast("int") for t in TACTICS])
    control, eliminate = any_of(both, CONTROL_MARKERS), tactics > 0
    kind = reduce(lambda c, kv: c.when(any_of(F.lower(claim), kv[1]), F.lit(kv[0])), OBLIGATIONS[1:], F.when(any_of(F.lower(claim), OBLIGATIONS[0][1]), F.lit(OBLIGATIONS[0][0]))).otherwise("unknown")
    tier = F.when(control, "control").when(eliminate, "eliminate").otherwise("substitute")
    sure = F.when(tactics >= 3, 0.96).when(tactics == 2, 0.93).otherwise(0.90)
    return tier, F.when(control, "hard_obligation").when(eliminate, "decidable").otherwise(kind), F.when(control, 0.5).when(eliminate, sure).otherwise(0.75)


def dependency_alert(state: Column, reason: Column, severity: Column, from_range: Column, to: Column, strict: Column) -> tuple[Column, Column]:
    """(tier, confidence) of an alert on a dependency; unread versions count as a minor step."""
    old = F.regexp_extract(from_range, r"(\d+)\.", 1)
    new = F.regexp_extract(to, r"^v*(\d+)", 1)
    old, new = (F.when(x != "", x.cast("long")) for x in (old, new))
    step = F.when(new > old, "major").when(new == old, "same").otherwise("minor")
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BUMP_CONFIDENCE.items() for x in kv]), F.concat_ws("|", severity, step)), F.lit(0.8))
    sure = F.round(F.when(strict, F.least(base + 0.01, F.lit(0.98))).otherwise(F.greatest(base - 0.03, F.lit(0.7))), 4)
    control = ((state == "dismissed") & (reason.isNull() | reason.isin("tolerable_risk", "no_bandwidth"))) | (state == "fixed") | (F.coalesce(to, F.lit("")) == "")
    tier = F.when(control, "control").when(step == "major", "substitute").when(sure >= 0.85, "eliminate").otherwise("substitute")
    return tier, F.when(tier == "control", 0.5).when(tier == "substitute", 0.85).otherwise(sure)


def conflict_choice(ours: Column, theirs: Column) -> Column:
    return F.when(any_of(ours, MODERN) & any_of(theirs, DEPRECATED), "chose_ours").when(any_of(theirs, MODERN) & any_of(ours, DEPRECATED), "chose_theirs").otherwise("manual_merge")


def honesty(claimed: Column, deductions: Column) -> tuple[Column, Column]:
    """(adjusted, grade); no claim counts as 50 and has no grade."""
    adjusted = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(claimed, F.lit(50)) - deductions))
    gap = F.abs(claimed - adjusted)
    return adjusted, F.when(claimed.isNull(), "no_claim").when(gap <= 5, "honest").when(gap <= 15, "optimistic").when(gap <= 30, "inflated").otherwise("dishonest")


def ordered(edges: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, level): nodes after all that they depend on, by (node, needs); an order by level and node is topological.

    One join a level; unknown needs are ignored.  A cycle is an error.
    """
    known = written(edges.join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi").join(nodes, "node", "left_semi").select("node", "needs").distinct())
    level = written(nodes.select("node", F.lit(0).cast("long").alias("level")))
    for k in range(1, rounds + 1):
        deep = known.join(level.where(f"level = {k - 1}"), known["needs"] == level["node"], "left_semi").select("node").distinct().withColumn("deep", F.lit(k).cast("long"))
        level = written(level.join(deep, "node", "left").select("node", F.coalesce("deep", "level").alias("level")))
        if level.where(f"level = {k}").isEmpty():
            return level
    raise ValueError(f"a dependency is circular, or deeper than {rounds}")
