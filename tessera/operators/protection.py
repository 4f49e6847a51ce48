"""Rules for protected branches, over the documents that a forge gives for them.

``protections`` and ``rulesets`` are (repo, doc) with JSON text; ``checks`` is (repo, on, seq, name): what ran on the
newest commits of the main branch (on = 'main') and on the newest heads of pull requests (on = 'pull'), a higher seq being
newer; a commit on which nothing ran has one row with a null name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Severities, the paths of an owners' file, and how many commits or heads are looked at
SEVERITY = {"BP001": "high", "BP002": "warn", "BP003": "critical", "BP004": "warn", "BP005": "high", "BP006": "high", "BP007": "critical", "BP008": "high", "BP009": "critical"}
OWNERS = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
SAMPLED = 5

_CONTEXTS = "struct<required_status_checks:struct<contexts:array<string>,checks:array<struct<context:string>>>>"
_RULESET = "struct<enforcement:string,target:string,rules:array<struct<type:string,parameters:struct<required_status_checks:array<struct<context:string>>>>>>"


def _on(name: str, bare: bool = True) -> Column:
    """Whether a switch is on, as an object with ``enabled`` or as a bare true."""
    inside = F.get_json_object("doc", f"$.{name}.enabled") == "true"
    return F.coalesce(inside | (F.get_json_object("doc", f"$.{name}") == "true") if bare else inside, F.lit(False))


def _protected(protections: DataFrame) -> DataFrame:
    """Documents that describe a protection: JSON objects that aren't an error message."""
    whole = F.try_parse_json("doc").isNotNull() & F.trim("doc").startswith("{")
    return protections.where(whole & F.get_json_object("doc", "$.message").isNull())


def protection_findings(protections: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, rule, severity, detail): BP001 to BP007.  A branch without protection has none of them; others tell it."""
    owned = files.where(F.col("path").isin(*OWNERS) & F.exists(F.split("content", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))).select("repo", F.lit(True).alias("owned")).distinct()
    review = lambda name: F.get_json_object("doc", f"$.required_pull_request_reviews.{name}")
    count = F.coalesce(F.when(review("required_approving_review_count").rlike(r"^\d+$"), review("required_approving_review_count").cast("int")), F.lit(0))
    block = F.coalesce(F.get_json_object("doc", "$.required_pull_request_reviews").startswith("{"), F.lit(False))
    true = lambda c: F.coalesce(c == "true", F.lit(False))
    open_ = F.concat_ws(" and ", F.when(_on("allow_force_pushes"), "force-push"), F.when(_on("allow_deletions"), "deletion"))
    bad = {
        "BP001": F.when(~_on("required_signatures", bare=False), ""), "BP002": F.when(~_on("required_linear_history"), ""), "BP003": F.when(count < 1, count.cast("string")), "BP004": F.when(block & ~true(review("dismiss_stale_reviews")), ""),
        "BP005": F.when(true(review("require_code_owner_reviews")) & F.col("owned").isNull(), ""), "BP006": F.when(~_on("enforce_admins"), ""), "BP007": F.when(open_ != "", open_),
    }
    made = [F.struct(F.lit(r).alias("rule"), F.lit(SEVERITY[r]).alias("severity"), c.alias("detail")) for r, c in bad.items()]
    rows = _protected(protections).join(owned, "repo", "left")
    return rows.select("repo", F.explode(F.filter(F.array(*made), lambda x: x["detail"].isNotNull())).alias("x")).select("repo", "x.*")


def _seen(checks: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Repositories that were looked at, and the names that ran on their newest commits."""
    commits = checks.where(F.col("on") == on).select("repo", "seq").distinct()
    newest = commits.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("seq").desc()))).where(F.col("k") <= SAMPLED).select("repo", "seq")
    ran = checks.where(F.col("on") == on).join(newest, ["repo", "seq"]).where("name IS NOT NULL").select("repo", F.col("name").alias("context")).distinct()
    return newest.select("repo").distinct(), ran


def _phantoms(wanted: DataFrame, checks: DataFrame, on: str, rule: str) -> DataFrame:
    known, ran = _seen(checks, on)
    lost = wanted.where("context IS NOT NULL").distinct().join(known, "repo", "left_semi").join(ran, ["repo", "context"], "left_anti")
    return lost.select("repo", F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), F.col("context").alias("detail"))


def phantom_contexts(protections: DataFrame, rulesets: DataFrame, checks: DataFrame) -> DataFrame:
    """(repo, rule, severity, detail): BP008 and BP009, checks that are required and never run.

    Those of a protection are looked for on commits of the main branch, those of active rulesets for branches on heads
    of pull requests.  A repository of which no commit is known has none.
    """
    r = F.from_json("doc", _CONTEXTS)["required_status_checks"]
    plain = _protected(protections).select("repo", F.explode(F.coalesce(r["contexts"], F.transform(r["checks"], lambda c: c["context"]))).alias("context"))
    parsed = rulesets.select("repo", F.from_json("doc", _RULESET).alias("s")).where("s.enforcement = 'active' AND s.target = 'branch'")
    asked = F.flatten(F.transform(F.filter("s.rules", lambda x: x["type"] == "required_status_checks"), lambda x: F.coalesce(x["parameters"]["required_status_checks"], F.array().cast("array<struct<context:string>>"))))
    active = parsed.select("repo", F.explode(asked).alias("c")).select("repo", "c.context")
    return _phantoms(plain, checks, "main", "BP008").unionByName(_phantoms(active, checks, "pull", "BP009"))
