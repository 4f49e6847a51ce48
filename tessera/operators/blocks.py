"""Workflow checks that follow blocks: a line's enclosing job, step and shell block by windows over lines.

Indentation makes the tree.  A step begins at a line with a list dash and ends before the next one, or before a line
that is indented no deeper; a shell block begins after ``run: |`` and ends before a line that is indented no deeper
than its key.  So the block that a line stands in is the last start before it, unless a line between them shut it:
running values over a file's lines.  What a check needs from a block is aggregated by block, and what it needs from
elsewhere in the file is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.content import COMMENT_LINE, UNTRUSTED

# Actions that fail without their secret, and the input that takes it
SECRET_ACTIONS = (("webfactory/ssh-agent", "ssh-private-key"), ("peter-evans/repository-dispatch", "token"), ("peter-evans/create-pull-request", "token"), ("actions-ecosystem/action-create-comment", "github_token"))
CALLER_REF = r"\$\{\{\s*github\.(?:ref|head_ref|sha|workflow_sha)\s*\}\}"
_RUN = r"^(\s*(?:-\s+)?)run:\s*[|>][+-]?\d*\s*$"
_INJECTED = r"\$\{\{\s*(" + "|".join(x.replace(".", r"\.") for x in UNTRUSTED) + ")"


def block_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, line, job, step, shell) of files (file_id, content), without the text of comment lines.

    step is the number of the line that begins the step, shell that of the block's ``run:``, job the job's name;
    each is null outside.  Null contents have no lines.
    """
    text = F.regexp_replace("content", F.lit(COMMENT_LINE), F.lit(""))
    rows = files.where("content IS NOT NULL").select("file_id", F.posexplode(F.split(text, "\n")).alias("p", "line"))
    line = F.col("line")
    rows = rows.select("file_id", (F.col("p") + 1).cast("long").alias("line_no"), "line", F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("indent"), (F.trim(F.translate("line", "\t\r", "  ")) == "").alias("blank"))
    upto = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when, value: F.last(F.when(when, value), True).over(upto)
    dash = line.rlike(r"^\s*-\s+")
    rows = rows.withColumns({
        "began": last(dash, F.struct("line_no", "indent")),
        "ran": last(line.rlike(_RUN), F.struct("line_no", F.length(F.regexp_extract("line", _RUN, 1)).alias("indent"))),
        "top": last(line.rlike(r"^[^\s#-]"), F.struct("line_no", line.rlike(r"^jobs:\s*$").alias("jobs"))),
        "named": last(line.rlike(r"^  [A-Za-z0-9_-]+:\s*$"), F.struct("line_no", F.regexp_extract("line", r"^  ([A-Za-z0-9_-]+):", 1).alias("name"))),
    })
    out = ~F.col("blank")
    rows = rows.withColumns({
        "step_shut": last(out & ~dash & (F.col("indent") <= F.col("began.indent")), F.col("line_no")),
        "run_shut": last(out & (F.col("line_no") > F.col("ran.line_no")) & (F.col("indent") <= F.col("ran.indent")), F.col("line_no")),
    })
    inside = lambda start, shut: F.coalesce(F.col(shut) < F.col(start), F.col(start).isNotNull())
    job = F.when(F.col("top.jobs") & (F.col("named.line_no") > F.col("top.line_no")), F.col("named.name"))
    step = F.when(inside("began.line_no", "step_shut"), F.col("began.line_no"))
    shell = F.when(inside("ran.line_no", "run_shut") & (F.col("line_no") > F.col("ran.line_no")), F.col("ran.line_no"))
    return rows.select("file_id", "line_no", "line", job.alias("job"), step.alias("step"), shell.alias("shell"))


def injections(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, job, source): what others write, set into a shell line, in a block's later lines as on the line of ``run:``."""
    source = F.regexp_extract("line", _INJECTED, 1)
    shown = lines.where(F.col("shell").isNotNull() | F.col("line").rlike(r"^\s*-?\s*run:"))
    return shown.select("file_id", "line_no", "job", source.alias("source")).where("source <> ''")


def _first(pattern: str, group: int = 1) -> Column:
    """The group's first match in a block of lines."""
    found = F.regexp_extract("line", pattern, group)
    return F.min(F.when(found != "", F.struct("line_no", found.alias("v"))))["v"]


def checkouts(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, job, repository, ref, reusable) of the steps that check a named repository out at a named ref."""
    uses = F.max(F.col("line").rlike(r"uses:\s*actions/checkout@"))
    steps = lines.where("step IS NOT NULL").groupBy("file_id", F.col("step").alias("line_no")).agg(F.min(F.struct("line_no", "job"))["job"].alias("job"), uses.alias("uses"), _first(r"^\s*repository:\s*(.+?)\s*$").alias("repository"), _first(r"^\s*ref:\s*(.+?)\s*$").alias("ref"))
    steps = steps.where("uses AND repository IS NOT NULL AND ref IS NOT NULL").drop("uses")
    called = lines.where(F.col("line").rlike(r"^\s*workflow_call:")).select("file_id", F.lit(True).alias("reusable")).distinct()
    return steps.join(called, "file_id", "left").withColumn("reusable", F.coalesce("reusable", F.lit(False)))


def checkout_findings(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, job, rule, repository): refs of the caller that the repository checked out can't have."""
    repository, ref = F.col("repository"), F.col("ref")
    own = repository.rlike(r"\$\{\{\s*github\.repository\s*\}\}")
    foreign = ref.rlike(r"\$\{\{\s*github\.workflow_sha\s*\}\}") & ~own
    itself = F.col("reusable") & ~own & repository.contains("/") & ~repository.startswith("${{") & ref.rlike(CALLER_REF)
    rules = F.array_compact(F.array(F.when(foreign, "workflow_sha_as_foreign_ref"), F.when(itself, "reusable_caller_context_self_checkout")))
    return checkouts(lines).select("file_id", "line_no", "job", F.explode(rules).alias("rule"), "repository")


def _assigned(lines: DataFrame, rest: str) -> DataFrame:
    """(file_id, secret, env): the first variable of a file that is set from a secret, with ``rest`` before the braces close."""
    pattern = r"(\w+):\s*\$\{\{\s*secrets\.([A-Z_][A-Z0-9_]*)\s*" + rest + r"\}\}"
    part = lambda k: F.regexp_extract_all("line", F.lit(pattern), F.lit(k))
    found = lines.select("file_id", "line_no", F.posexplode(F.arrays_zip(part(1).alias("env"), part(2).alias("secret"))).alias("p", "x"))
    return found.groupBy("file_id", "x.secret").agg(F.min(F.struct("line_no", "p", "x.env"))["env"].alias("env"))


def ungated_secrets(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, job, action, secret): steps whose action fails without a secret, and that nothing keeps from running without it.

    A gate is a condition of the step on the secret itself, one on an output of an earlier step where the file writes
    outputs, or any condition of the file on a variable that is set from the secret, or from whether it is there.
    """
    line = F.col("line")
    condition = F.regexp_extract("line", "if:(.*)$", 1)
    # what a line's condition names before its last comparison
    before = lambda compared, names: F.regexp_extract_all(F.regexp_extract(condition, "^(.*)(?:" + compared + ")", 1), F.lit(names), F.lit(1))
    own = F.when(line.rlike(r"^\s*(?:-\s+)?if:"), before(r"""!=\s*['"]""", r"secrets\.(\w+)")).otherwise(F.array().cast("array<string>"))
    asked = [F.struct(F.lit(a).alias("action"), F.max(line.rlike(rf"uses:\s*{a}@")).alias("uses"), _first(p + r":\s*\$\{\{\s*secrets\.([A-Z_][A-Z0-9_]*)\s*\}\}").alias("secret")) for a, p in SECRET_ACTIONS]
    steps = lines.where("step IS NOT NULL").groupBy("file_id", F.col("step").alias("line_no")).agg(
        F.min(F.struct("line_no", "job"))["job"].alias("job"), F.array(*asked).alias("asked"), F.flatten(F.collect_list(own)).alias("own"), F.max(line.rlike(r"if:.*steps\.[A-Za-z0-9_-]+\.outputs\.")).alias("output")
    )
    steps = steps.select("file_id", "line_no", "job", "own", "output", F.explode(F.filter("asked", lambda a: a["uses"] & a["secret"].isNotNull())).alias("a")).select("*", "a.action", "a.secret").drop("a")
    writes = lines.where(F.contains("line", F.lit("GITHUB_OUTPUT"))).select("file_id", F.lit(True).alias("writes")).distinct()
    named = lines.where(line.contains("if:")).select("file_id", F.explode(F.concat(
        F.transform(F.regexp_extract_all(condition, F.lit(r"env\.(\w+)"), F.lit(1)), lambda e: F.struct(e.alias("env"), F.lit(False).alias("compared"))),
        F.transform(before("!=|==", r"env\.(\w+)"), lambda e: F.struct(e.alias("env"), F.lit(True).alias("compared"))),
    )).alias("x")).groupBy("file_id", "x.env").agg(F.max("x.compared").alias("compared"))
    told = _assigned(lines, r"""!=\s*['"]['"]?\s*""").join(named, ["file_id", "env"]).select("file_id", "secret", F.lit(True).alias("told"))
    raw = _assigned(lines, "").join(named.where("compared"), ["file_id", "env"]).select("file_id", "secret", F.lit(True).alias("raw"))
    rows = steps.join(writes, "file_id", "left").join(told, ["file_id", "secret"], "left").join(raw, ["file_id", "secret"], "left")
    itself = F.exists("own", lambda s: s.startswith(F.col("secret")))
    gated = itself | (F.col("output") & F.coalesce("writes", F.lit(False))) | F.coalesce("told", "raw", F.lit(False))
    return rows.where(~gated).select("file_id", "line_no", "job", "action", "secret")
