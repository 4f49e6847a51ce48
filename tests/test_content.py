"""Content rules against Python's regular expressions and hand-made texts."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import content as T
from tessera.plans import content as P

#: The exceptions as look-arounds, which Java and Python have and the rules do without.
AROUND = {
    "js_http_url_in_code": r"""["']http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)""",
    "ncl_http_url": r'(?<!xmlns)(?<!xmlns:[a-z])=\s*"http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|www\.w3\.org/|www\.apple\.com/DTDs/|www\.freedesktop\.org/standards/)',
}
LISTED = T.PATTERNS + T.STUB_CRYPTO


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, language string, path string, content string")


def test_patterns(spark):
    """Every rule, in its language, on every line apart from comments, and found at least once."""
    lines = [x for x in P.LINES if not re.match(r"//|/\*|--|#\[cfg|\{- |\(\*", x) and x != P.LAZY_LINE]
    pairs = sorted({(p.languages[0] if p.languages else "none") for p in LISTED})
    rows = [(k * 1000 + n, language, "", line) for k, language in enumerate(pairs) for n, line in enumerate(lines)]
    got = {(r["file_id"], r["rule"]): r["occurrences"] for r in T.pattern_findings(files(spark, rows), LISTED).collect()}
    want = {}
    for k, language, _, line in rows:
        for p in LISTED:
            if not p.languages or language in p.languages:
                text = re.sub(r"\{-.*?-\}", "", line) if language in ("idris2", "haskell", "agda") else line
                n = len(re.findall(AROUND.get(p.rule, p.pattern), text))
                if n:
                    want[k, p.rule] = n
    assert got == want
    # a pragma is a block comment to its language
    assert {p.rule for p in LISTED} - {r for _, r in got} == {"agda_type_in_type"}


def test_nothing(spark):
    rows = [(1, "rust", "", None), (2, None, "", "x.unwrap()"), (3, "rust", "", ""), (4, "unheard", "", "x.unwrap()")]
    assert T.pattern_findings(files(spark, rows), T.PATTERNS).count() == 0
    assert T.pattern_findings(files(spark, []), T.PATTERNS).count() == 0
    assert {r["file_id"] for r in T.check_findings(files(spark, rows), T.HARDENING).collect()} == {2, 3, 4}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a", "a"),
        ("s = Lazy::new(|| f(g(1)).expect(x)); b", "s = LAZY_INIT_ELIDED; b"),
        ('OnceLock::new(|| f(")", r#"("#)) c', "LAZY_INIT_ELIDED c"),
        ("Lazy::new(|| f(", "Lazy::new(|| f("),
        ("LazyLock::new(|| a) LazyLock::new( || b) d", "LAZY_INIT_ELIDED LAZY_INIT_ELIDED d"),
    ],
)
def test_without_lazy(text, want):
    assert T.without_lazy(text) == want


def test_lazy_in_rust(spark):
    rows = [(1, "rust", "", P.LAZY_LINE), (2, "rust", "", P.LAZY_LINE + '\nx.expect("a")'), (3, "rust", "", 'x.expect("a")\n#[cfg(test)]\ny.expect("b")')]
    assert {(r["file_id"], r["occurrences"]) for r in T.pattern_findings(files(spark, rows), T.PATTERNS).where("rule = 'expect_in_hot_path'").collect()} == {(2, 1), (3, 1)}


BAD = """on: [push, pull_request]
permissions: write-all
jobs:
  build:
    runs-on: [self-hosted, x]
    steps:
      - uses: actions/setup-node@v4
      - run: echo ${{ github.head_ref }}
      - run: curl https://a/b | bash
  call:
    uses: ./x.yml
    secrets: inherit
  slow:
    # a note
    timeout-minutes: 5
"""
GOOD = """# SPDX-License-Identifier: MPL-2.0
on:
  push:
    branches: [main]
permissions:
  contents: read
concurrency: a
# curl https://a/b | bash
jobs:
  build:
    timeout-minutes: 3
    steps:
      - uses: actions/checkout@0123456789012345678901234567890123456789
"""


def test_workflows(spark):
    f = files(spark, [(1, None, "a.yml", BAD), (2, None, "a.yml", GOOD), (3, None, "codeql.yml", GOOD)])
    audit = {(r["file_id"], r["rule"]) for r in T.check_findings(f, T.WORKFLOW, T.COMMENT_LINE).collect()}
    assert audit == {(1, "broad_permissions"), (1, "missing_caching:setup-node"), (1, "download_then_run"), (1, "double_trigger"), (3, "codeql_missing_actions")}
    hard = {(r["file_id"], r["rule"]) for r in T.check_findings(f, T.HARDENING).collect()}
    assert hard == {(1, x) for x in ("missing_spdx", "WH001", "WH002:write-all", "WH008", "WH011", "SC007")} | {(2, "WH011"), (3, "WH011")}, "hardening reads comments too"
    assert {tuple(r) for r in T.jobs_without_timeout(f).collect()} == {(1, "build")}
    used = T.uses(f)
    assert {r["slug"] for r in used.where(T.unpinned(used["slug"])).collect()} == {"actions/setup-node@v4"}


def test_equal_texts_are_scanned_once(spark):
    """Four thousand files of four texts: a scan reads few rows, and every file has its text's findings, null texts and languages apart."""
    texts = [("a", "x"), ("a", None), (None, "x"), ("1:a", "")]
    df = spark.createDataFrame([(k, *texts[k % 4], f"p{k}") for k in range(4000)], "file_id long, content string, language string, path string")
    seen = spark.sparkContext.accumulator(0)
    said = F.udf(lambda c, x: seen.add(1) or f"{c}|{x}", "string").asNondeterministic()
    got = T.each_text_once(df, ("content", "language"), lambda t: t.select("file_id", said("content", "language").alias("said"))).collect()
    assert {(r["file_id"], r["path"], r["said"]) for r in got} == {(k, f"p{k}", "{}|{}".format(*texts[k % 4])) for k in range(4000)} and len(got) == 4000
    assert seen.value <= 16


def test_files_stay_where_few_texts_show_much(spark):
    """Files of two texts (and none) meet what these show without being dealt; a null text is one of its own, apart from an empty one."""
    df = spark.range(3000).select(F.col("id").alias("file_id"), F.element_at(F.array(F.lit("x"), F.lit(""), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("content"))
    got = T.each_text_once(df, ("content",), lambda t: t.select("file_id", F.coalesce("content", F.lit("none")).alias("said")))
    assert sorted(map(tuple, got.collect())) == [(k, ("x", "", "none")[k % 3]) for k in range(3000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_checks_ask_each_files_path(spark):
    checks = (T.Check("here", "low", (r"x",), path=r"^a"), T.Check("any", "low", (r"x",)), T.Check("placed", "low", path=r"b$"))
    df = spark.createDataFrame([(1, "a", "x", "r"), (2, "b", "x", "s"), (3, None, "x", "t"), (4, "b", None, "u")], "file_id long, path string, content string, repo string")
    want = {(1, "r", "here"), (1, "r", "any"), (2, "s", "any"), (2, "s", "placed"), (3, "t", "any"), (4, "u", "placed")}
    assert {(r["file_id"], r["repo"], r["rule"]) for r in T.check_findings(df, checks, keep=("repo",)).collect()} == want
