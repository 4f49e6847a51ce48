"""Registered queries of inventory checks.  An order is a file of its customer's repository; path and content are picked from lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import inventory as I
from tessera.plans.content import _at, _sql_at
from tessera.plans.queries import query
from tessera.sources import views as V

FLOW = ".github/workflows/"
PATHS = (
    "SECURITY.md", FLOW + "ci.yml", "LICENSE", "src/main.py", FLOW + "codeql.yml", ".editorconfig", ".github/dependabot.yml", "0-AI-MANIFEST.a2ml", FLOW + "lint.yaml", "Makefile", "lib/a/b.ts", FLOW + "notes.txt", "LICENSE.txt", ".gitattributes",
    "PLAN-2024.md", "go.mod", FLOW + "nested/x.yml", "renovate.json", "node_modules/x/y.go", "Dockerfile", "old.BAK", "AI.a2ml", "docs/SECURITY.md", "STATE.scm", "COPYING", "src/core/lib.rs", "week-status-report-7.md", "src/target/z.java", "gemini.md",
)
TEXTS = (
    "name: x\npermissions: read-all\n", "uses: github/codeql-action/init@v3\nlanguage: python\n", "uses:  actions/checkout@v4\n", "run: semgrep ci\npermissions:\n", "# mentions CodeQL\nLanguage: actions\n", "* text=auto\n", "a\r\nb\r\n", "uses: a/b@" + "0a" * 20 + "\n", "language: cpp codeql\n",
)


def inventory(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = _at(PATHS, k * 7 + c)
    return V.table(spark, d, "orders").select(F.concat(F.lit("Repo_"), c).alias("repo"), path.alias("path"), F.when(k % 13 != 0, _at(TEXTS, k * 5 + c)).alias("content"))


_FILES = f"f AS (SELECT 'Repo_' || o_custkey AS repo, {_sql_at(PATHS, '(o_orderkey * 7 + o_custkey)')} AS path, CASE WHEN o_orderkey % 13 <> 0 THEN {_sql_at(TEXTS, '(o_orderkey * 5 + o_custkey)')} END AS content FROM orders)"
_WORKFLOW = "starts_with(path, '.github/workflows/') AND len(string_split(path, '/')) = 3"

_SCORECARD = f"""WITH {_FILES}, r AS (SELECT DISTINCT repo FROM f), w AS (SELECT * FROM f WHERE {_WORKFLOW}), y AS (SELECT * FROM w WHERE path LIKE '%.yml' OR path LIKE '%.yaml'),
m AS (SELECT repo, lower(unnest(regexp_extract_all(content, '(?i)language:\\s*([a-z0-9-]+)', 1))) AS lang FROM w WHERE contains(lower(content), 'codeql')),
l AS (SELECT repo, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'javascript-typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java-kotlin' END AS lang FROM f WHERE NOT regexp_matches(path, '(^|/)(node_modules|target)/')),
e AS (SELECT DISTINCT repo FROM m WHERE lang = 'actions' UNION SELECT DISTINCT m.repo FROM m JOIN l ON l.repo = m.repo AND l.lang = m.lang),
s AS (SELECT repo, 'SC-016' AS number, 'Security-Policy' AS name, 'SecurityPolicy' AS category, 'Medium' AS severity, 0.9::DOUBLE AS confidence, true AS auto_fixable, 'No SECURITY.md found in ' || repo AS description FROM r ANTI JOIN (SELECT repo FROM f WHERE path = 'SECURITY.md') USING (repo)
UNION ALL SELECT repo, 'SC-018', 'Token-Permissions', 'TokenPermissions', 'High', 0.95, true, count(*) || ' workflow(s) missing permissions declaration in ' || repo FROM y WHERE NOT contains(content, 'permissions:') GROUP BY repo
UNION ALL SELECT repo, 'SC-008', 'Dependency-Update-Tool', 'DependencyUpdate', 'High', 0.95, true, 'No dependabot.yml or renovate.json found in ' || repo FROM r ANTI JOIN (SELECT repo FROM f WHERE path IN ('.github/dependabot.yml', 'renovate.json')) USING (repo)
UNION ALL SELECT repo, 'SC-010', 'License', 'LicenseCompliance', 'Low', 0.85, false, 'No LICENSE file found in ' || repo FROM r ANTI JOIN (SELECT repo FROM f WHERE path IN ('LICENSE', 'LICENSE.txt', 'COPYING')) USING (repo)
UNION ALL SELECT repo, 'SC-014', 'SAST', 'StaticAnalysis', 'Medium', 0.9, true, CASE WHEN repo IN (SELECT repo FROM w WHERE contains(lower(content), 'codeql')) THEN 'Nominal-only SAST in ' || repo || ': codeql.yml language matrix contains no language present in the repo and lacks `actions`, so CodeQL records zero results on every commit. Remediation: set the CodeQL matrix to `language: actions`.' ELSE 'No SAST tool (CodeQL/SonarCloud/Semgrep) detected in ' || repo END
  FROM r WHERE repo NOT IN (SELECT repo FROM w WHERE contains(content, 'semgrep')) AND repo NOT IN (SELECT repo FROM e)
UNION ALL SELECT repo, 'SC-013', 'Pinned-Dependencies', 'DependencyPinning', 'Medium', 0.9, true, count(*) || ' workflow(s) with tag-pinned (not SHA-pinned) actions in ' || repo FROM y WHERE regexp_matches(content, 'uses: +[a-z]+/[a-z]+@v[0-9]') GROUP BY repo)"""


@query("x10_scorecard_patterns", f"{_SCORECARD} SELECT number || '-' || replace(lower(repo), '_', '-') AS id, repo, name AS \"check\", category, severity, confidence, auto_fixable, CASE WHEN auto_fixable THEN 'eliminate' ELSE 'control' END AS tier, description FROM s")
def x10_scorecard_patterns(spark, d):
    """The six local checks of every repository, from one pass over its inventory."""
    return I.scorecard_patterns(inventory(spark, d))


@query("x10_scorecard_stats", f"{_SCORECARD} SELECT category, count(*) AS n FROM s GROUP BY category")
def x10_scorecard_stats(spark, d):
    return I.scorecard_patterns(inventory(spark, d)).groupBy("category").agg(F.count("*").alias("n"))


_ROOT = f"""WITH {_FILES}, t AS (SELECT DISTINCT repo, path AS file FROM f WHERE NOT contains(path, '/')), b(file, severity, action) AS (VALUES ('Makefile', 'medium', 'replace'), ('go.mod', 'high', 'flag'), ('Dockerfile', 'low', 'rename'), ('AI.a2ml', 'high', 'delete'), ('STATE.scm', 'critical', 'move')),
q(file, other, severity) AS (VALUES ('LICENSE', 'LICENSE.txt', 'critical'), ('.editorconfig', '.editorconfig', 'medium'), ('0-AI-MANIFEST.a2ml', 'AI.a2ml', 'high'))"""


@query(
    "x08_root_hygiene",
    f"""{_ROOT} SELECT repo, file, 'banned' AS type, severity, action FROM t JOIN b USING (file)
UNION ALL SELECT repo, file, 'stale', CASE WHEN regexp_matches(lower(file), '^(plan-|.*-status-report-)') THEN 'low' ELSE 'medium' END, CASE WHEN regexp_matches(lower(file), '^(plan-|.*-status-report-)') THEN 'move' ELSE 'delete' END FROM t WHERE regexp_matches(lower(file), '^plan-.*md$|-status-report-.*md$|[.]bak$|^gemini.md$')
UNION ALL SELECT repo, q.file, 'missing', severity, 'create' FROM (SELECT DISTINCT repo FROM f) r, q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.repo = r.repo AND t.file IN (q.file, q.other))""",
)
def x08_root_hygiene(spark, d):
    """Banned, outdated and missing files of every root."""
    return I.root_findings(inventory(spark, d))


@query("x08_phantom_diffs", f"WITH {_FILES} SELECT DISTINCT repo, path FROM f WHERE contains(content, chr(13)) AND repo NOT IN (SELECT repo FROM f WHERE path = '.gitattributes' AND contains(content, 'text=auto'))")
def x08_phantom_diffs(spark, d):
    return I.phantom_diffs(inventory(spark, d))


@query("x08_folder_sizes", f"WITH {_FILES}, p AS (SELECT repo, path, length(coalesce(content, '')) AS n, string_split(path, '/') AS s FROM f), a AS (SELECT repo, n, array_to_string(s[1 : unnest(range(0, len(s)))], '/') AS folder FROM p) SELECT repo, folder, count(*) AS files, sum(n)::BIGINT AS chars FROM a GROUP BY 1, 2")
def x08_folder_sizes(spark, d):
    """Files and characters under every folder, by the prefixes of paths."""
    return I.folder_sizes(inventory(spark, d))
