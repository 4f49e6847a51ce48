"""Registered queries of the workflow checks that follow blocks.

Workflows are made of fixed parts, one choice of each to an order, as in ``plans/content.py``.  The SQL has patterns of its
own and finds a line's block by the greatest start before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators.content import each_text_once
from tessera.plans.content import _at, _sql_at
from tessera.plans.queries import query
from tessera.sources import views as V

HEADS = ("on: push", "on:\n  workflow_call:\n    inputs: {}", "# on:\n#   workflow_call:\non: pull_request")
ENVS = ("", "    env:\n      HAS_KEY: ${{ secrets.DEPLOY_KEY != '' }}", "    env:\n      RAW: ${{ secrets.FARM_TOKEN }}\n      OTHER: x", "    env:\n      # HAS_KEY: ${{ secrets.DEPLOY_KEY != '' }}\n      FLAG: ${{ secrets.FARM_TOKEN != \"\" }}")
FIRST = (
    "      - id: probe\n        run: echo ok=true >> $GITHUB_OUTPUT", "      - name: shell\n        run: |\n          echo start\n          echo ${{ github.event.issue.title }}\n\n          echo ${{ github.head_ref }} end\n        env:\n          A: ${{ github.event.issue.body }}",
    "      - run: >-\n          echo ${{ github.actor }}\n          # echo ${{ github.event.comment.body }}\n          echo ${{ github.event.pull_request.title }}\n      - name: ${{ github.head_ref }}", "      - if: env.HAS_KEY == 'true'\n        run: echo key", "      - run: echo ${{ github.ref }}",
    "      - name: list\n        with:\n          items:\n            - one\n            - two\n          repository: a/b", "      - if: env.OTHER != env.RAW || env.FLAG\n        run: echo raw",
)
SECOND = (
    "      - uses: webfactory/ssh-agent@v0\n        with:\n          ssh-private-key: ${{ secrets.DEPLOY_KEY }}", "      - if: secrets.DEPLOY_KEY != ''\n        uses: webfactory/ssh-agent@v0\n        with:\n          ssh-private-key: ${{ secrets.DEPLOY_KEY }}",
    "      - name: dispatch\n        if: ${{ steps.probe.outputs.ok == 'true' }}\n        uses: peter-evans/repository-dispatch@v3\n        with:\n          token: ${{ secrets.FARM_TOKEN }}", "      - uses: peter-evans/create-pull-request@v6\n        if: github.ref == 'x' && env.RAW != ''\n        with:\n          token: ${{ secrets.FARM_TOKEN }}",
    "      - uses: peter-evans/create-pull-request@v6\n        with:\n          token: ${{ secrets.GITHUB_TOKEN }}\n      # uses: webfactory/ssh-agent@v0", "      - uses: actions-ecosystem/action-create-comment@v1\n        with:\n          github_token: plain",
    "      - uses: actions-ecosystem/action-create-comment@v1\n        with:\n          github_token: ${{ secrets.BOT }}",
)
THIRD = (
    "      - uses: actions/checkout@v4\n        with:\n          repository: o/standards\n          ref: ${{ github.workflow_sha }}", "      - name: own\n        uses: actions/checkout@v4\n        with:\n          ref: ${{ github.workflow_sha }}\n          repository: ${{ github.repository }}",
    "      - uses: actions/checkout@v4\n        with:\n          repository: ${{ inputs.repo }}\n          ref: ${{ github.workflow_sha }}", "      - uses: actions/checkout@v4\n        with:\n          repository: o/standards\n          ref: ${{ github.head_ref }}\n  second:\n    runs-on: x\n    steps:\n      - run: echo ${{ github.event.review.body }}",
    "      - uses: actions/checkout@v4\n      - uses: other/action@v1\n        with:\n          repository: o/standards\n          ref: ${{ github.workflow_sha }}", "      - uses: actions/checkout@v4\n        with:\n          repository: o/standards\n          ref: main",
)


def block_files(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat_ws("\n", _at(HEADS, k), F.lit("jobs:\n  build:"), _at(ENVS, c), F.lit("    steps:"), _at(FIRST, k + c), _at(SECOND, k * 3 + c), _at(THIRD, c))
    return V.table(spark, d, "orders").select(k.alias("file_id"), F.when(k % 101 != 0, text).alias("content"))


def _by_text(find, spark, d) -> DataFrame:
    """What ``find`` finds in the lines of each file; equal files are read once."""
    return each_text_once(block_files(spark, d), ("content",), lambda texts: find(B.block_lines(texts)))


_LINES = (
    "f AS (SELECT o_orderkey AS file_id, string_split(regexp_replace(concat_ws(chr(10), "
    + ", ".join([_sql_at(HEADS, "o_orderkey"), "'jobs:' || chr(10) || '  build:'", _sql_at(ENVS, "o_custkey"), "'    steps:'", _sql_at(FIRST, "(o_orderkey + o_custkey)"), _sql_at(SECOND, "(o_orderkey * 3 + o_custkey)"), _sql_at(THIRD, "o_custkey")])
    + r"), '(^|\n)[ \t]*#[^\n]*', '\1', 'g'), chr(10)) AS l FROM orders WHERE o_orderkey % 101 <> 0), n AS (SELECT file_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM f), "
    + r"i AS (SELECT *, length(line) - length(ltrim(line)) AS indent, line <> '' AS ink, starts_with(ltrim(line), '- ') AS dash FROM n), "
    + r"s AS (SELECT a.file_id, a.line_no AS step, a.indent, coalesce(min(b.line_no), 999999) AS over FROM i a LEFT JOIN i b ON b.file_id = a.file_id AND b.line_no > a.line_no AND (b.dash OR (b.ink AND b.indent <= a.indent)) WHERE a.dash GROUP BY ALL), "
    + r"j AS (SELECT file_id, line_no AS at_line, rtrim(trim(line), ':') AS job FROM i WHERE indent = 2 AND ends_with(line, ':') AND line <> '  workflow_call:'), "
    + r"t AS (SELECT s.file_id, s.step, i.line_no, i.line FROM s JOIN i ON i.file_id = s.file_id AND i.line_no >= s.step AND i.line_no < s.over), "
    + r"k AS (SELECT s.file_id, s.step, arg_max(job, at_line) AS job FROM s JOIN j ON j.file_id = s.file_id AND j.at_line < s.step GROUP BY ALL)"
)
_SHELL = (
    r", r AS (SELECT file_id, line_no, strpos(line, 'run:') - 1 AS col, regexp_matches(line, 'run: [|>]') AS block FROM i WHERE contains(line, 'run:')), "
    r"e AS (SELECT r.file_id, r.line_no AS run, r.col, coalesce(min(i.line_no), 999999) AS over FROM r LEFT JOIN i ON i.file_id = r.file_id AND i.line_no > r.line_no AND i.ink AND i.indent <= r.col WHERE block GROUP BY ALL), "
    r"x AS (SELECT file_id, line_no FROM r UNION SELECT e.file_id, i.line_no FROM e JOIN i ON i.file_id = e.file_id AND i.line_no > e.run AND i.line_no < e.over)"
)


@query("x06_block_injections", f"WITH {_LINES}{_SHELL} SELECT file_id, line_no, arg_max(job, at_line) AS job, any_value(regexp_extract(line, '\\$\\{{\\{{ (github\\.(head_ref|ref|event\\.(issue|pull_request|comment|review)\\.(title|body)))', 1)) AS source FROM x JOIN i USING (file_id, line_no) JOIN j USING (file_id) WHERE at_line < line_no AND regexp_matches(line, '\\$\\{{\\{{ github\\.(head_ref|ref|event\\.(issue|pull_request|comment|review)\\.(title|body))') GROUP BY file_id, line_no")
def x06_block_injections(spark, d):
    """Shell lines with text that others write, also the later lines of a block."""
    return _by_text(B.injections, spark, d)


_CHECKOUT = r""", c AS (SELECT file_id, step, bool_or(contains(line, 'uses: actions/checkout@')) AS uses, arg_min(regexp_extract(line, '^ *repository: (.*)$', 1), line_no) FILTER (regexp_matches(line, '^ *repository: ')) AS repository,
  arg_min(regexp_extract(line, '^ *ref: (.*)$', 1), line_no) FILTER (regexp_matches(line, '^ *ref: ')) AS ref FROM t GROUP BY ALL), w AS (SELECT DISTINCT file_id FROM i WHERE trim(line) = 'workflow_call:')"""


@query(
    "x06_checkout_refs",
    f"""WITH {_LINES}{_CHECKOUT} SELECT file_id, step AS line_no, job, 'workflow_sha_as_foreign_ref' AS rule, repository FROM c JOIN k USING (file_id, step) WHERE uses AND contains(ref, 'github.workflow_sha') AND NOT contains(repository, 'github.repository')
UNION ALL SELECT file_id, step, job, 'reusable_caller_context_self_checkout', repository FROM c JOIN k USING (file_id, step) JOIN w USING (file_id) WHERE uses AND repository = 'o/standards' AND regexp_matches(ref, 'github\\.(ref|head_ref|sha|workflow_sha) ')""",
)
def x06_checkout_refs(spark, d):
    """Checkouts of other repositories at a ref of the caller's, with the step and the job that they stand in."""
    return _by_text(B.checkout_findings, spark, d)


_GATES = r""", a AS (SELECT file_id, step, regexp_extract(string_agg(line, chr(10) ORDER BY line_no), 'uses: (webfactory/ssh-agent|peter-evans/repository-dispatch|peter-evans/create-pull-request|actions-ecosystem/action-create-comment)@', 1) AS action, string_agg(line, chr(10) ORDER BY line_no) AS body FROM t GROUP BY ALL),
b AS (SELECT *, regexp_extract(body, CASE action WHEN 'webfactory/ssh-agent' THEN 'ssh-private-key' WHEN 'actions-ecosystem/action-create-comment' THEN 'github_token' ELSE 'token' END || ': \$\{\{ secrets\.([A-Z_]+) \}\}', 1) AS secret FROM a WHERE action <> ''),
z AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS whole FROM i GROUP BY file_id),
v AS (SELECT b.*, whole, regexp_extract(whole, '(\w+): \$\{\{ secrets\.' || secret || ' != [''"]{2} \}\}', 1) AS told, regexp_extract(whole, '(\w+): \$\{\{ secrets\.' || secret || ' \}\}', 1) AS raw FROM b JOIN z USING (file_id) WHERE secret <> '')"""


@query(
    "x06_ungated_secrets",
    f"""WITH {_LINES}{_GATES} SELECT file_id, step AS line_no, job, action, secret FROM v JOIN k USING (file_id, step) WHERE NOT (regexp_matches(body, 'if: secrets\\.' || secret || ' != ''''') OR (contains(body, 'steps.probe.outputs.') AND contains(whole, 'GITHUB_OUTPUT'))
OR (told <> '' AND regexp_matches(whole, 'if:[^\\n]*env\\.' || told || '\\b')) OR (raw <> '' AND regexp_matches(whole, 'if:[^\\n]*env\\.' || raw || '\\b[^\\n]*(!=|==)')))""",
)
def x06_ungated_secrets(spark, d):
    """Steps that need a secret and that no condition keeps from running without it."""
    return _by_text(B.ungated_secrets, spark, d)
