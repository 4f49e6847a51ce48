"""Checks of repositories by their inventory: which paths there are, and what a few of them say.

An inventory is a sparse table (repo, path, content); contents may be null.  Every rule is a column over its rows, and
all rules of a family are aggregated in one pass by repository, so a repository with millions of files sends a row of
flags from each task and never its files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of the local checks id, category, risk and whether a fix exists; confidences by risk
CHECKS = {
    "Security-Policy": ("SC-016", "SecurityPolicy", "medium", True),
    "Token-Permissions": ("SC-018", "TokenPermissions", "high", True),
    "Dependency-Update-Tool": ("SC-008", "DependencyUpdate", "high", True),
    "License": ("SC-010", "LicenseCompliance", "low", False),
    "SAST": ("SC-014", "StaticAnalysis", "medium", True),
    "Pinned-Dependencies": ("SC-013", "DependencyPinning", "medium", True),
}
CONFIDENCE = {"critical": 0.99, "high": 0.95, "medium": 0.90, "low": 0.85}
POLICIES = ("SECURITY.md", ".github/SECURITY.md", "security.md")
UPDATERS = (".github/dependabot.yml", "renovate.json", ".renovaterc.json")
LICENSES = ("LICENSE", "LICENSE.txt", "LICENSE.md", "LICENCE", "COPYING")
OTHER_SAST = ("sonarcloud", "semgrep", "snyk")
LANGUAGE_OF = {
    "js": "javascript-typescript", "jsx": "javascript-typescript", "ts": "javascript-typescript", "tsx": "javascript-typescript", "mjs": "javascript-typescript", "py": "python", "go": "go",
    "java": "java-kotlin", "kt": "java-kotlin", "rb": "ruby", "cs": "csharp", "cpp": "cpp", "c": "cpp", "swift": "swift",
}
LEFT_OUT = r"(^|/)(\.git|node_modules|_build|deps|target)/"

# Files that may not stand in a repository's root (name, severity, action)
BANNED = (
    ("AI.djot", "high", "delete"), ("STATE.scm", "critical", "move"), ("META.scm", "critical", "move"), ("ECOSYSTEM.scm", "critical", "move"), ("AGENTIC.scm", "critical", "move"), ("NEUROSYM.scm", "critical", "move"),
    ("PLAYBOOK.scm", "critical", "move"), ("LANGUAGES.scm", "critical", "move"), ("Dockerfile", "low", "rename"), ("docker-compose.yml", "low", "rename"), ("docker-compose.yaml", "low", "rename"), ("Makefile", "medium", "replace"),
    ("package-lock.json", "high", "delete"), ("yarn.lock", "high", "delete"), ("bun.lockb", "high", "delete"), ("pnpm-lock.yaml", "high", "delete"), (".npmrc", "medium", "delete"), ("tsconfig.json", "high", "flag"), ("go.mod", "high", "flag"),
    ("go.sum", "high", "flag"), ("AI.a2ml", "high", "delete"), ("Trustfile.hs", "high", "convert"),
)
# Patterns of files that are out of date in a root, the first that matches (pattern, severity, action)
STALE = (
    (r"(?i)^PLAN-.*\.md$", "low", "move"), (r"(?i)^SNAPSHOT-.*\.md$", "low", "move"), (r"(?i)^TODO-.*\.md$", "low", "move"), (r"(?i)^SESSION-.*\.md$", "low", "move"), (r"(?i)^DESIGN-.*\.md$", "low", "move"),
    (r"(?i)^.*-STATUS-REPORT-.*\.md$", "low", "move"), (r"(?i)^.*\.bak$", "medium", "delete"), (r"(?i)^.*\.tmp$", "medium", "delete"), (r"(?i)^.*\.orig$", "medium", "delete"), (r"(?i)^SONNET-TASKS\.md$", "high", "delete"),
    (r"(?i)^GEMINI\.md$", "medium", "delete"), (r"(?i)^CLAUDE-WORK.*\.md$", "medium", "delete"),
)
# Files that a root needs, others that stand for them, severity
REQUIRED = (("LICENSE", ("LICENSE.txt",), "critical"), (".editorconfig", (), "medium"), ("0-AI-MANIFEST.a2ml", ("AI.a2ml",), "high"))
NORMALISED = ("eol=lf", "text=auto", "text eol=lf")


def _any(flags) -> Column:
    return reduce(lambda a, b: a | b, flags)


def _has(*names: str) -> Column:
    """Whether a repository has one of these paths."""
    return F.max(F.col("path").isin(*names))


def _says(*words: str) -> Column:
    return F.coalesce(_any([F.contains("content", F.lit(w)) for w in words]), F.lit(False))


def scorecard_patterns(inventory: DataFrame) -> DataFrame:
    """(id, repo, check, category, severity, confidence, auto_fixable, tier, description): the local checks that repositories fail.

    A repository without workflows fails no check of theirs.  A workflow whose content is null says nothing: it has
    no rights to lack and pins nothing.  Paths repeated in a repository are one file each time they come.
    """
    flow = F.col("path").rlike(r"^\.github/workflows/[^/]+$")
    yaml = flow & F.col("path").rlike(r"\.ya?ml$")
    bare = yaml & F.col("content").isNotNull() & ~_says("permissions:")
    tagged = yaml & F.coalesce(F.col("content").rlike(r"uses:\s+[\w-]+/[\w-]+@v\d"), F.lit(False))
    codeql = flow & _says("codeql", "CodeQL")
    extension = F.regexp_extract("path", r"[^/]\.([A-Za-z0-9]+)$", 1)
    spoken = F.when(~F.col("path").rlike(LEFT_OUT), F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]), extension))
    matrix = F.when(codeql, F.transform(F.regexp_extract_all("content", F.lit(r"(?i)language:\s*([a-z0-9-]+)"), F.lit(1)), lambda x: F.lower(x)))
    flags = inventory.groupBy("repo").agg(
        _has(*POLICIES).alias("policy"), _has(*UPDATERS).alias("updater"), _has(*LICENSES).alias("license"), F.count_if(bare).alias("bare"), F.count_if(tagged).alias("tagged"),
        F.max(flow & _says(*OTHER_SAST)).alias("other"), F.max(codeql).alias("codeql"), F.array_distinct(F.flatten(F.collect_set(matrix))).alias("matrix"), F.collect_set(spoken).alias("spoken"),
    )
    effective = F.array_contains("matrix", "actions") | F.arrays_overlap("matrix", "spoken")
    repo = F.col("repo")
    tell = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    failed = {
        "Security-Policy": F.when(~F.col("policy"), tell("No SECURITY.md found in ", repo)),
        "Token-Permissions": F.when(F.col("bare") > 0, tell(F.col("bare"), " workflow(s) missing permissions declaration in ", repo)),
        "Dependency-Update-Tool": F.when(~F.col("updater"), tell("No dependabot.yml or renovate.json found in ", repo)),
        "License": F.when(~F.col("license"), tell("No LICENSE file found in ", repo)),
        "SAST": F.when(~F.col("other") & ~F.col("codeql"), tell("No SAST tool (CodeQL/SonarCloud/Semgrep) detected in ", repo)).when(
            ~F.col("other") & ~effective,
            tell("Nominal-only SAST in ", repo, ": codeql.yml language matrix contains no language present in the repo and lacks `actions`, so CodeQL records zero results on every commit. Remediation: set the CodeQL matrix to `language: actions`."),
        ),
        "Pinned-Dependencies": F.when(F.col("tagged") > 0, tell(F.col("tagged"), " workflow(s) with tag-pinned (not SHA-pinned) actions in ", repo)),
    }
    made = [F.struct(F.lit(i).alias("number"), F.lit(name).alias("check"), F.lit(c).alias("category"), F.lit(r.capitalize()).alias("severity"), F.lit(CONFIDENCE[r]).alias("confidence"), F.lit(a).alias("auto_fixable"), F.lit("eliminate" if a else "control").alias("tier"), failed[name].alias("description")) for name, (i, c, r, a) in CHECKS.items()]
    rows = flags.select("repo", F.explode(F.filter(F.array(*made), lambda x: x["description"].isNotNull())).alias("x"))
    mark = F.regexp_replace(F.lower("repo"), "[^a-z0-9]+", "-")
    return rows.select(F.concat("x.number", F.lit("-"), mark).alias("id"), "repo", "x.check", "x.category", "x.severity", "x.confidence", "x.auto_fixable", "x.tier", "x.description")


def root_findings(inventory: DataFrame) -> DataFrame:
    """(repo, file, type, severity, action): banned and outdated files of a root, and required ones that it lacks; each once."""
    root = inventory.where(~F.contains("path", F.lit("/"))).select("repo", F.col("path").alias("file")).distinct()
    name = F.col("file")
    case = lambda rules, meets, k: reduce(lambda c, r: c.when(meets(r), r[k]), rules, F.when(F.lit(False), ""))
    banned, stale = (lambda r: name == r[0]), (lambda r: name.rlike(r[0]))
    found = [F.struct(F.lit(kind).alias("type"), case(rules, meets, 1).alias("severity"), case(rules, meets, 2).alias("action")) for kind, rules, meets in (("banned", BANNED, banned), ("stale", STALE, stale))]
    there = root.select("repo", "file", F.explode(F.filter(F.array(*found), lambda x: x["severity"].isNotNull())).alias("x")).select("repo", "file", "x.*")
    needed = inventory.groupBy("repo").agg(*[_has(f, *others).alias(f"has{k}") for k, (f, others, _) in enumerate(REQUIRED)])
    lacks = [F.when(~F.col(f"has{k}"), F.struct(F.lit(f).alias("file"), F.lit("missing").alias("type"), F.lit(s).alias("severity"), F.lit("create").alias("action"))) for k, (f, _, s) in enumerate(REQUIRED)]
    return there.unionByName(needed.select("repo", F.explode(F.array_compact(F.array(*lacks))).alias("x")).select("repo", "x.*"))


def phantom_diffs(inventory: DataFrame) -> DataFrame:
    """(repo, path): texts with carriage returns in repositories whose attributes don't normalise line ends."""
    calm = F.max((F.col("path") == ".gitattributes") & _says(*NORMALISED))
    loud = inventory.groupBy("repo").agg(calm.alias("calm")).where("NOT calm").select("repo")
    return inventory.where(F.contains("content", F.lit("\r\n"))).select("repo", "path").distinct().join(loud, "repo")


def folder_sizes(inventory: DataFrame) -> DataFrame:
    """(repo, folder, files, chars): what lies under every folder of a repository, itself and deeper; the root is ''."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = inventory.select("repo", F.length(F.coalesce("content", F.lit(""))).alias("n"), F.explode(above).alias("folder"))
    return rows.groupBy("repo", "folder").agg(F.count("*").alias("files"), F.sum("n").alias("chars"))
