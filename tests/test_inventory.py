"""Inventory checks against a walk over each repository's files."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from tessera.operators import inventory as I
from tessera.plans import inventory as plans

TEXTS = (*plans.TEXTS, None, "", "snyk", "CodeQL only")


def files(seed, repos, n):
    r = random.Random(seed)
    return [(f"R {r.randrange(repos)}", r.choice(plans.PATHS), r.choice(TEXTS)) for _ in range(n)]


def brute(rows):
    out = set()
    by = defaultdict(list)
    for repo, path, text in rows:
        by[repo].append((path, text))
    for repo, own in by.items():
        paths = {p for p, _ in own}
        flows = [(p, t) for p, t in own if p.startswith(".github/workflows/") and p.count("/") == 2]
        yaml = [t for p, t in flows if p.endswith((".yml", ".yaml")) and t is not None]
        bare, tagged = sum("permissions:" not in t for t in yaml), sum(bool(re.search(r"uses:\s+[\w-]+/[\w-]+@v\d", t)) for t in yaml)
        texts = [t for _, t in flows if t is not None]
        codeql = [t for t in texts if "codeql" in t or "CodeQL" in t]
        matrix = {x.lower() for t in codeql for x in re.findall(r"(?i)language:\s*([a-z0-9-]+)", t)}
        spoken = {I.LANGUAGE_OF.get(p.rsplit("/", 1)[-1].rsplit(".", 1)[-1]) for p in paths if not re.search(r"(^|/)(node_modules|target|_build|deps|\.git)/", p)}
        if not paths & set(I.POLICIES):
            out.add((repo, "Security-Policy", None))
        if bare:
            out.add((repo, "Token-Permissions", str(bare)))
        if not paths & set(I.UPDATERS):
            out.add((repo, "Dependency-Update-Tool", None))
        if not paths & set(I.LICENSES):
            out.add((repo, "License", None))
        if tagged:
            out.add((repo, "Pinned-Dependencies", str(tagged)))
        if not any(w in t for t in texts for w in I.OTHER_SAST):
            if not codeql:
                out.add((repo, "SAST", "No"))
            elif "actions" not in matrix and not matrix & spoken:
                out.add((repo, "SAST", "Nominal-only"))
    return out


def test_scorecard(spark):
    rows = files(3, 40, 500)
    got = set()
    for r in I.scorecard_patterns(spark.createDataFrame(rows, "repo string, path string, content string")).collect():
        first = r["description"].split(" ")[0]
        got.add((r["repo"], r["check"], first if r["check"] in ("SAST", "Token-Permissions", "Pinned-Dependencies") else None))
        assert r["id"] == I.CHECKS[r["check"]][0] + "-" + r["repo"].lower().replace(" ", "-") and r["repo"] in r["description"]
        assert r["tier"] == ("eliminate" if r["auto_fixable"] else "control")
    want = brute(rows)
    assert got == want and {k for _, k, _ in want} == set(I.CHECKS) and {x for _, k, x in want if k == "SAST"} == {"No", "Nominal-only"}


def test_root(spark):
    rows = [("a", p, None) for p in ("Makefile", "x/Makefile", "Plan-a.md", "a.bak", "a.bak", "LICENSE.txt", "AI.a2ml", "design-.MD", "GEMINI.md.old")] + [("b", "docs/x", None)]
    got = sorted(tuple(r) for r in I.root_findings(spark.createDataFrame(rows, "repo string, path string, content string")).select("repo", "type", "file", "severity", "action").collect())
    missing = [("b", "missing", f, s, "create") for f, s in (("0-AI-MANIFEST.a2ml", "high"), (".editorconfig", "medium"), ("LICENSE", "critical"))]
    want = [("a", "banned", "AI.a2ml", "high", "delete"), ("a", "banned", "Makefile", "medium", "replace"), ("a", "missing", ".editorconfig", "medium", "create")]
    want += [("a", "stale", "Plan-a.md", "low", "move"), ("a", "stale", "a.bak", "medium", "delete"), ("a", "stale", "design-.MD", "low", "move"), *missing]
    assert got == sorted(want)


def test_folders_and_line_ends(spark):
    rows = [*files(5, 6, 120), ("z", "a", "x\r\ny"), ("y", "a/b/c", None)]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    count, chars = Counter(), Counter()
    for repo, path, text in rows:
        parts = path.split("/")
        for k in range(len(parts)):
            count[repo, "/".join(parts[:k])] += 1
            chars[repo, "/".join(parts[:k])] += len(text or "")
    assert {(r["repo"], r["folder"]): (r["files"], r["chars"]) for r in I.folder_sizes(df).collect()} == {k: (n, chars[k]) for k, n in count.items()}
    calm = {r for r, p, t in rows if p == ".gitattributes" and t and ("eol=lf" in t or "text=auto" in t)}
    assert {tuple(r) for r in I.phantom_diffs(df).select("repo", "path").collect()} == {(r, p) for r, p, t in rows if t and "\r\n" in t and r not in calm}


def test_nothing(spark):
    none = spark.createDataFrame([], "repo string, path string, content string")
    assert all(f(none).isEmpty() for f in (I.scorecard_patterns, I.root_findings, I.phantom_diffs, I.folder_sizes))
