"""Registered queries of branch protection.  A customer is a repository, its orders are what ran on its commits and pull requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import protection as P
from tessera.plans.content import _at, _sql_at
from tessera.plans.queries import query
from tessera.sources import views as V

SIGNED = ('"required_signatures":{"enabled":true}', '"required_signatures":{"enabled":false}', '"other":1')
LINEAR = ('"required_linear_history":true', '"required_linear_history":{"enabled":true}', '"required_linear_history":{"enabled":false}')
REVIEWS = ('"required_pull_request_reviews":{"required_approving_review_count":1,"dismiss_stale_reviews":true}', '"required_pull_request_reviews":{"required_approving_review_count":0,"require_code_owner_reviews":true}', '"required_pull_request_reviews":null', '"required_pull_request_reviews":{"required_approving_review_count":2,"require_code_owner_reviews":true,"dismiss_stale_reviews":false}')
ADMINS = ('"enforce_admins":{"enabled":true}', '"enforce_admins":false')
OPEN = ('"allow_force_pushes":{"enabled":false}', '"allow_force_pushes":true,"allow_deletions":{"enabled":true}', '"allow_deletions":true')
CHECKS = ('"required_status_checks":{"contexts":["build","lint"]}', '"required_status_checks":{"checks":[{"context":"build"},{"context":"ghost"}]}', '"required_status_checks":{"contexts":[]}', '"required_status_checks":null')
RULESETS = (
    '{"enforcement":"active","target":"branch","rules":[{"type":"deletion"},{"type":"required_status_checks","parameters":{"required_status_checks":[{"context":"scan"},{"context":"build"}]}}]}', '{"enforcement":"disabled","target":"branch","rules":[{"type":"required_status_checks","parameters":{"required_status_checks":[{"context":"scan"}]}}]}',
    '{"enforcement":"active","target":"tag","rules":[{"type":"required_status_checks","parameters":{"required_status_checks":[{"context":"scan"}]}}]}', '{"message":"Not Found"}',
)
OWNERS = ("* @team", "# nobody\n\n", "")
NAMES = ("build", "lint", "scan", "docs")
_PARTS = (SIGNED, LINEAR, REVIEWS, ADMINS, OPEN, CHECKS)


def _tables(spark, d):
    c = F.col("c_custkey")
    customer = V.table(spark, d, "customer").select(c, F.concat(F.lit("repo-"), c).alias("repo"))
    body = F.concat(F.lit("{"), F.concat_ws(",", *[_at(p, F.floor(c / (k + 1)).cast("long")) for k, p in enumerate(_PARTS)]), F.lit("}"))
    protections = customer.select("repo", F.when(c % 11 == 0, '{"message":"Branch not protected"}').otherwise(body).alias("doc"))
    rulesets = customer.select("repo", _at(RULESETS, c).alias("doc"))
    files = customer.where("c_custkey % 5 < 4").select("repo", F.lit(".github/CODEOWNERS").alias("path"), _at(OWNERS, c).alias("content"))
    k = F.col("o_orderkey")
    checks = V.table(spark, d, "orders").select(F.concat(F.lit("repo-"), "o_custkey").alias("repo"), F.when(k % 2 == 0, "main").otherwise("pull").alias("on"), k.alias("seq"), F.when(k % 9 > 0, _at(NAMES, F.floor(k / 2).cast("long"))).alias("name"))
    return protections, rulesets, files, checks


_DOCS = (
    "p AS (SELECT 'repo-' || c_custkey AS repo, c_custkey AS c, ('{' || concat_ws(',', " + ", ".join(_sql_at(p, f"(c_custkey // {k + 1})") for k, p in enumerate(_PARTS)) + ") || '}')::JSON AS doc FROM customer WHERE c_custkey % 11 > 0)"
)
_ENABLED = "coalesce(doc->>'$.{0}.enabled' = 'true' OR doc->>'$.{0}' = 'true', false)"
_REVIEW = "(doc->'$.required_pull_request_reviews')"


@query(
    "x07_branch_protection",
    f"""WITH {_DOCS} SELECT repo, 'BP001' AS rule, 'high' AS severity, '' AS detail FROM p WHERE coalesce(doc->>'$.required_signatures.enabled', '') <> 'true'
UNION ALL SELECT repo, 'BP002', 'warn', '' FROM p WHERE NOT {_ENABLED.format('required_linear_history')} UNION ALL SELECT repo, 'BP003', 'critical', '0' FROM p WHERE coalesce(({_REVIEW}->>'$.required_approving_review_count')::INT, 0) < 1
UNION ALL SELECT repo, 'BP004', 'warn', '' FROM p WHERE json_type({_REVIEW}) = 'OBJECT' AND coalesce({_REVIEW}->>'$.dismiss_stale_reviews', 'false') = 'false'
UNION ALL SELECT repo, 'BP005', 'high', '' FROM p WHERE {_REVIEW}->>'$.require_code_owner_reviews' = 'true' AND NOT (c % 5 < 4 AND c % 3 = 0) UNION ALL SELECT repo, 'BP006', 'high', '' FROM p WHERE NOT {_ENABLED.format('enforce_admins')}
UNION ALL SELECT repo, 'BP007', 'critical', concat_ws(' and ', CASE WHEN {_ENABLED.format('allow_force_pushes')} THEN 'force-push' END, CASE WHEN {_ENABLED.format('allow_deletions')} THEN 'deletion' END) FROM p WHERE {_ENABLED.format('allow_force_pushes')} OR {_ENABLED.format('allow_deletions')}""",
)
def x07_branch_protection(spark, d):
    """Signatures, history, reviews, owners, administrators, pushes: what a protection leaves open."""
    protections, _, files, _ = _tables(spark, d)
    return P.protection_findings(protections, files)


@query(
    "x07_phantom_checks",
    f"""WITH {_DOCS}, k AS (SELECT 'repo-' || o_custkey AS repo, o_orderkey AS seq, o_orderkey % 2 AS pull, CASE WHEN o_orderkey % 9 > 0 THEN {_sql_at(NAMES, '(o_orderkey // 2)')} END AS name FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, pull ORDER BY seq DESC) AS place FROM k), s AS (SELECT * FROM n WHERE place <= 5),
w AS (SELECT repo, 0 AS pull, unnest(CASE c // 6 % 4 WHEN 0 THEN ['build', 'lint'] WHEN 1 THEN ['build', 'ghost'] ELSE []::VARCHAR[] END) AS context FROM p UNION ALL SELECT 'repo-' || c_custkey, 1, unnest(['scan', 'build']) FROM customer WHERE c_custkey % 4 = 0)
SELECT repo, CASE pull WHEN 0 THEN 'BP008' ELSE 'BP009' END AS rule, CASE pull WHEN 0 THEN 'high' ELSE 'critical' END AS severity, context AS detail FROM w WHERE EXISTS (SELECT 1 FROM s WHERE s.repo = w.repo AND s.pull = w.pull) AND NOT EXISTS (SELECT 1 FROM s WHERE s.repo = w.repo AND s.pull = w.pull AND s.name = w.context)""",
)
def x07_phantom_checks(spark, d):
    """Required checks that ran on none of the newest commits, or heads of pull requests."""
    protections, rulesets, _, checks = _tables(spark, d)
    return P.phantom_contexts(protections, rulesets, checks)
