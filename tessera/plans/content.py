"""Registered queries of the content rules, over source and workflow files.

The supplied tables hold no source code, so each order stands for a file whose
lines are picked from ``LINES`` or, for workflows, from one list for each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import content as T
from tessera.plans.queries import query
from tessera.sources import views as V

LANGUAGES = (
    "rust", "rescript", "affine", "idris2", "haskell", "ocaml", "coq", "lean", "agda", "isabelle", "hol4", "zig",
    "fstar", "ada", "nickel", "elixir", "erlang", "javascript", "typescript", "shell", "bash", "gleam", "rust", "javascript",
)
LAZY_LINE = 'static A: LazyLock<B> = LazyLock::new(|| b(")").expect("x"));'
LINES = (
    "let a = b.unwrap();", "c.unwrap_or(0)", 'd.expect("e")', LAZY_LINE, "m.lock().unwrap()", "m.read().unwrap() + m.write().unwrap()", "unsafe { f() }", 'panic!("g")', "todo!()", "unimplemented!( )",
    "mem::transmute(h)", "mem::forget(i)", "ManuallyDrop::new(j)", "Box::from_raw(k)", "l.as_ptr()", "// n.unwrap()", "/* o.unwrap() */", "#[cfg(test)]", "let p = Q.getExn(r)", "Obj.magic(s)",
    "JSON.parseExn(t)", "pub fn handle(u) {", "v /. w", "x *. y", "z +. a", "b -. c", "believe_me d", "-- assert_total e", "assert_total f", "assert_smaller g h", "unsafePerformIO i", "unsafeCoerce j",
    "k = undefined", "{- undefined -}", "Obj.repr l", "(* Admitted *)", "Admitted.", "admit.", "Axiom m : n.", "by sorry", "native_decide", "axiom o : p", "postulate q : r", "{-# OPTIONS --type-in-type #-}",
    "oops", "mk_thm ([], s)", "@ptrCast(t)", "@alignCast(u)", "@intToPtr(v)", "@bitCast(w)", "@ptrToInt(x)", "assume (y)", "pragma Suppress (All_Checks);", "Ada.Unchecked_Conversion", "Unchecked_Deallocation (z)",
    "a'Unchecked_Access", 'url = "http://b.example/c"', 'url = "http://localhost/d"', 'xmlns:e = "http://f.example"', "md5:0123abcd", 'uses = "g/h@v3"', 'language = "python"', 'password = "i"', "docker run j",
    'System.cmd("k#{l}", [])', 'System.shell("m #{n}")', ':os.cmd("o #{p}")', "Code.eval_string(q)", ":erlang.binary_to_term(r)", "String.to_atom(s)", 'origin: "*"', "verify: :verify_none", "Port.open({:spawn, t}, [])",
    'send_resp(conn, 200, "#{u}")', "erlang:binary_to_term(v)", "list_to_atom(w)", "os:cmd(x)", "ssl:connect(y, [{verify, verify_none}])", 'httpc:request("http://z")', "'Access-Control-Allow-Origin': '*'", "eval (a)",
    "b.innerHTML = c", "document.write(d)", "require('child_process').execSync(e)", "deno run -A f.ts", "fetch('http://g.example') + fetch('http://127.0.0.1/')", "const token = 'abcdefgh12345'", "sessionId = Math.random()",
    "curl -s https://h.example | sh", "bash <(curl -s https://i.example)", 'format!("stub:sha3")', "n(); // TODO implement real hash", "dummy signature, fake cert", "Command::new(env::var(j))", "exec $KMD --now",
    "uid = 0", "user_input + '/' + l", "permissive: continue", "let ok = 1;", "// plain",
)

ON = (
    "on: [push, pull_request]", "on:\n  push:\n  pull_request:", "on:\n  pull_request_target:", "on: workflow_run", "on:\n  workflow_call:", "on: [pull_request, push]", "on: pull_request_target",
)
RIGHTS = ("permissions: write-all", "permissions:\n  contents: read", "npermissions: read-all", "# permissions: write-all", "permissions:\n  security-events: write")
REST = ("name: a", "# SPDX-License-Identifier: MPL-2.0\nconcurrency: b", "# SPDX-License-Identifier: MPL-2.0")
JOBS = (
    "jobs:\n  build:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4", "jobs:\n  build:\n    timeout-minutes: 10\n    runs-on: [self-hosted, linux]\n  call:\n    uses: ./.github/workflows/x.yml\n    secrets: inherit",
    "jobs:\n  prove:\n    container:\n      image: coqorg/coq:8.18\n    steps:\n      - uses: actions/checkout@v4\n# comment\n\n  next:\n    runs-on: x", "jobs:\n  prove:\n    container:\n      image: haskell:9\n      options: --cpus 1 --user root\n    steps:\n      - uses: actions/checkout@" + "0a" * 20,
)
STEPS = (
    "      - run: echo ${{ github.event.issue.title }}", "      - run: echo ok", '      - run: curl -d "{${{ github.head_ref }}}" x', "      - run: curl https://a.example/x | bash", "      # curl https://a.example/x | bash",
    '      - run: echo "A=${{ github.event.issue.body }}" >> $GITHUB_ENV', '      - run: echo "::set-output name=a::b"', "        env: ${{ toJSON(secrets) }}", "        with:\n          ref: ${{ github.event.pull_request.head.sha }}",
    "      - uses: actions/setup-node@v4", "      - uses: actions/setup-go@v5\n        with:\n          cache: true", "      - uses: actins/setup-node@v4", "      - uses: docker://alpine:3", "      - uses: softprops/action-gh-release@v2",
    "      - uses: pypa/gh-action-pypi-publish@v1\n        with:\n          password: ${{ secrets.PYPI }}", "      - uses: goreleaser/goreleaser-action@v6\n      - uses: anchore/sbom-action@v0\n      - uses: sigstore/cosign-installer@v3",
    "      - uses: o/p/scorecard-reusable.yml@main", "      - run: grep -r 'uses:' .", "      - language: actions", "      - uses: JS-DevTools/npm-publish@v3\n        with:\n          token: ${{ secrets.NPM }}", "      - uses: mlugg/setup-zig@v1",
    "      - uses: codecov/codecov-actoin@v4", "  publish:",
)
PATHS = ("scorecard.yml", "codeql.yml", "ci.yml", "workflow-linter.yml", "mirror.yml", "codeql-analysis.yaml", "governance.yml", "release.yml", "secret-scanner.yml", "a.yml", "b.yml")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _at(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _sql_at(values, index: str) -> str:
    return f"({_list(values)})[({index} % {len(values)} + 1)::INT]"


def source_files(spark, d) -> DataFrame:
    """Five lines to a file; one file in 101 has no text."""
    k = F.col("o_orderkey")
    lines = F.concat_ws("\n", *[_at(LINES, k * (2 * j + 1) + 17 * j) for j in range(5)])
    return V.table(spark, d, "orders").select(k.alias("file_id"), _at(LANGUAGES, k).alias("language"), F.when(k % 101 != 0, lines).alias("content"))


_SOURCES = (
    f"files AS (SELECT o_orderkey AS file_id, {_sql_at(LANGUAGES, 'o_orderkey')} AS language, CASE WHEN o_orderkey % 101 <> 0 THEN "
    + " || chr(10) || ".join(_sql_at(LINES, f"(o_orderkey * {2 * j + 1} + {17 * j})") for j in range(5))
    + " END AS content FROM orders)"
)


def workflow_files(spark, d) -> DataFrame:
    """Workflows from a trigger, rights, further keys, a job and two steps."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat_ws("\n", _at(REST, k + c), _at(ON, k), _at(RIGHTS, k), _at(JOBS, k), _at(STEPS, k + c), _at(STEPS, k * 3 + 1))
    return V.table(spark, d, "orders").select(k.alias("file_id"), F.concat(F.lit("repo-"), c).alias("repo"), _at(PATHS, k).alias("path"), F.when(k % 101 != 0, text).alias("content"))


_WORKFLOWS = (
    f"files AS (SELECT o_orderkey AS file_id, 'repo-' || o_custkey AS repo, {_sql_at(PATHS, 'o_orderkey')} AS path, CASE WHEN o_orderkey % 101 <> 0 THEN "
    + " || chr(10) || ".join([_sql_at(REST, "(o_orderkey + o_custkey)"), *[_sql_at(x, "o_orderkey") for x in (ON, RIGHTS, JOBS)], _sql_at(STEPS, "(o_orderkey + o_custkey)"), _sql_at(STEPS, "(o_orderkey * 3 + 1)")])
    + " END AS content FROM orders)"
)


def _sql_replaced(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by)}, 'g')"


def _sql_scannable() -> str:
    out = "CASE language"
    for name, patterns in T.COMMENTS.items():
        text = "content"
        for p in patterns:
            text = _sql_replaced(text, p)
        out += f" WHEN '{name}' THEN {text}"
    return out + " ELSE content END"


def _pattern_sql(patterns, text: str = "t.text") -> str:
    """One struct for each rule; the only lazy initialiser of the files is a fixed line."""
    rows = []
    for p in patterns:
        left = f"replace({text}, {_quoted(LAZY_LINE)}, 'LAZY_INIT_ELIDED')" if p.runtime else text
        left = _sql_replaced(left, p.but, " ") if p.but else left
        n = f"len(regexp_extract_all({left}, {_quoted(p.pattern)}))"
        rows.append(f"{{'rule': '{p.rule}', 'severity': '{p.severity}', 'occurrences': " + (f"CASE WHEN language IN ({', '.join(map(_quoted, p.languages))}) THEN {n} END" if p.languages else n) + "}")
    return f", t AS (SELECT file_id, language, {_sql_scannable()} AS text FROM files) SELECT file_id, x.rule, x.severity, x.occurrences FROM (SELECT file_id, unnest([{', '.join(rows)}]) AS x FROM t) WHERE x.occurrences > 0"


def _check_sql(checks, strip: str = "", path: str = "path") -> str:
    rows = []
    for c in checks:
        said = [f"regexp_matches(text, {_quoted(p)})" for p in c.needs] + [f"NOT regexp_matches(text, {_quoted(p)})" for p in c.lacks] + ([f"regexp_matches({path}, {_quoted(c.path)})"] if c.path else [])
        rows.append(f"{{'rule': {_quoted(c.rule)}, 'severity': '{c.severity}', 'found': {' AND '.join(said)}}}")
    text = _sql_replaced("content", strip) if strip else "content"
    return f", t AS (SELECT *, {text} AS text FROM files) SELECT file_id, x.rule, x.severity FROM (SELECT file_id, unnest([{', '.join(rows)}]) AS x FROM t) WHERE x.found"


@query("x01_language_patterns", f"WITH {_SOURCES}{_pattern_sql(T.PATTERNS)}")
def x01_language_patterns(spark, d):
    """Counted patterns of each file's language; comments (x02) are not read."""
    return T.pattern_findings(source_files(spark, d), T.PATTERNS)


@query("x02_scannable", f"WITH {_SOURCES} SELECT file_id, md5({_sql_scannable()}) AS scannable_md5 FROM files")
def x02_scannable(spark, d):
    return source_files(spark, d).select("file_id", F.md5(T.scannable(F.col("content"), F.col("language"))).alias("scannable_md5"))


@query("x05_stub_crypto", f"WITH {_SOURCES.replace('AS language', 'AS written', 1).replace('AS content', 'AS content, NULL::VARCHAR AS language', 1)}{_pattern_sql(T.STUB_CRYPTO)}")
def x05_stub_crypto(spark, d):
    """Stand-ins for cryptography, whatever the language."""
    return T.pattern_findings(source_files(spark, d).withColumn("language", F.lit(None).cast("string")), T.STUB_CRYPTO)


@query("x05_container_checks", f"WITH {_SOURCES}{_check_sql(T.CONTAINER)}")
def x05_container_checks(spark, d):
    return T.check_findings(source_files(spark, d).withColumn("path", F.lit("")), T.CONTAINER)


@query("x06_workflow_audit", f"WITH {_WORKFLOWS}{_check_sql(T.WORKFLOW, T.COMMENT_LINE)}")
def x06_workflow_audit(spark, d):
    """Checks of workflows without their comment lines."""
    return T.check_findings(workflow_files(spark, d), T.WORKFLOW, T.COMMENT_LINE)


@query(
    "x06_jobs_without_timeout",
    f"""WITH {_WORKFLOWS}, a AS (SELECT file_id, regexp_extract(content || chr(10), '(?s)(?:^|\\n)jobs:[ \\t]*\\n(.*)', 1) AS after FROM files),
j AS (SELECT file_id, unnest(regexp_extract_all(after, {_quoted(T.JOB)}, 1)) AS job, unnest(regexp_extract_all(after, {_quoted(T.JOB)}, 2)) AS body FROM a)
SELECT file_id, job FROM j WHERE NOT regexp_matches(body, '(?m)^    (timeout-minutes:\\s*\\d|uses:\\s*\\S)')""",
)
def x06_jobs_without_timeout(spark, d):
    return T.jobs_without_timeout(workflow_files(spark, d))


@query("x06_missing_workflows", f"WITH {_WORKFLOWS}, r AS (SELECT DISTINCT repo FROM files), w AS (SELECT unnest({_list(T.STANDARD_WORKFLOWS)}) AS path) SELECT repo, path FROM r, w EXCEPT SELECT repo, path FROM files")
def x06_missing_workflows(spark, d):
    """Standard workflows that a repository lacks: each repository's set of paths, subtracted from the list."""
    standard = F.array(*map(F.lit, T.STANDARD_WORKFLOWS))
    own = workflow_files(spark, d).groupBy("repo").agg(F.collect_set(F.when(F.col("path").isin(*T.STANDARD_WORKFLOWS), F.col("path"))).alias("own"))
    return own.select("repo", F.explode(F.array_except(standard, "own")).alias("path"))


@query("x06_duplicate_workflows", f"WITH {_WORKFLOWS} SELECT repo, min(path) AS first_path, count(DISTINCT path) AS n FROM files WHERE content IS NOT NULL GROUP BY repo, content HAVING count(DISTINCT path) > 1")
def x06_duplicate_workflows(spark, d):
    """Workflows of a repository with one content under several names."""
    g = workflow_files(spark, d).where(F.col("content").isNotNull()).groupBy("repo", F.sha2("content", 256).alias("h"))
    return g.agg(F.min("path").alias("first_path"), F.countDistinct("path").alias("n")).where("n > 1").select("repo", "first_path", "n")


@query("x07_hardening", f"WITH {_WORKFLOWS}{_check_sql(T.HARDENING)}")
def x07_hardening(spark, d):
    """Hardening and supply-chain checks of workflows."""
    return T.check_findings(workflow_files(spark, d), T.HARDENING)


_USES = f", u AS (SELECT file_id, unnest(regexp_extract_all(content, {_quoted(T.USES)}, 1)) AS slug FROM files)"


@query("x07_unpinned_uses", f"WITH {_WORKFLOWS}{_USES} SELECT file_id, slug, count(*) AS n FROM u WHERE slug NOT LIKE './%' AND slug NOT LIKE 'docker://%' AND contains(slug, '@') AND NOT regexp_matches(slug, '@[a-fA-F0-9]{{40}}\\b') GROUP BY 1, 2")
def x07_unpinned_uses(spark, d):
    return T.uses(workflow_files(spark, d)).where(T.unpinned(F.col("slug"))).groupBy("file_id", "slug").agg(F.count("*").alias("n"))


@query("x07_lookalike_actions", f"WITH {_WORKFLOWS}{_USES}, a AS (SELECT DISTINCT file_id, split_part(slug, '@', 1) AS action FROM u), p AS (SELECT unnest({_list(T.POPULAR_ACTIONS)}) AS popular) SELECT file_id, action, popular FROM a, p WHERE levenshtein(action, popular) <= 2 AND split_part(action, '/', 1) <> split_part(popular, '/', 1)")
def x07_lookalike_actions(spark, d):
    return T.lookalikes(T.uses(workflow_files(spark, d)))


@query("x08_schedule_clashes", "WITH s AS (SELECT o_custkey % 50 AS repo, o_orderkey AS file_id, (o_orderkey % 60) || ' ' || (o_custkey % 24) || ' * * *' AS cron FROM orders) SELECT repo, cron, min(file_id) AS first_file, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 1")
def x08_schedule_clashes(spark, d):
    """Schedules that several files of a repository share."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = V.table(spark, d, "orders").select((c % 50).alias("repo"), k.alias("file_id"), F.concat_ws(" ", (k % 60).cast("string"), (c % 24).cast("string"), F.lit("* * *")).alias("cron"))
    return s.groupBy("repo", "cron").agg(F.min("file_id").alias("first_file"), F.count("*").alias("n")).where("n > 1")


@query(
    "x09_estate_findings",
    f"WITH {_SOURCES}, f AS (SELECT file_id, rule, severity FROM ({('WITH ' + _SOURCES + _pattern_sql(T.PATTERNS))}) UNION ALL SELECT file_id, rule, severity FROM ({('WITH ' + _SOURCES + _check_sql(T.CONTAINER))}) UNION ALL SELECT file_id, 'missing_spdx', 'low' FROM files WHERE NOT contains(content, 'SPDX-License-Identifier:')), "
    "g AS (SELECT rule, severity, count(DISTINCT file_id) AS files FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY severity ORDER BY files DESC, rule) AS place FROM g",
)
def x09_estate_findings(spark, d):
    """All families together (U2): files by rule, ranked within each severity."""
    def scan(files):
        bare = files.where(~F.contains("content", F.lit("SPDX-License-Identifier:"))).select("file_id", F.lit("missing_spdx").alias("rule"), F.lit("low").alias("severity"))
        return T.text_patterns(files, T.PATTERNS).drop("occurrences").unionByName(T.text_checks(files, T.CONTAINER).drop("_check")).unionByName(bare)

    found = T.each_text_once(source_files(spark, d), ("language", "content"), scan)
    g = found.groupBy("rule", "severity").agg(F.countDistinct("file_id").alias("files"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy(F.col("files").desc(), "rule")).cast("long"))
