"""Blocks of workflow lines against a walk over the lines, and checks against small files."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B


def walked(text):
    """(job, step, shell) of each line, one after the other."""
    out, top, job, step, shell = [], None, None, None, None
    for k, line in enumerate(text.split("\n"), 1):
        if re.match(r"[ \t]*#", line):
            line = ""
        blank, indent = not line.strip(), len(line) - len(line.lstrip())
        if re.match(r"[^\s#-]", line):
            top, job = line.rstrip() == "jobs:", None
        if top and (m := re.match(r"  ([\w-]+):\s*$", line)):
            job = m[1]
        if re.match(r"\s*-\s+", line):
            step = (k, indent)
        elif step and not blank and indent <= step[1]:
            step = None
        if shell and not blank and indent <= shell[1]:
            shell = None
        m = re.match(r"(\s*(?:-\s+)?)run:\s*[|>][+-]?\d*\s*$", line)
        # the line that begins a block is in none, also where it looks like text of an open one
        out.append((job, step and step[0], shell[0] if shell and not m else None))
        if m:
            shell = (k, len(m[1]))
    return out


def random_file(r):
    lines = []
    for _ in range(r.randint(1, 40)):
        pad = " " * r.choice([0, 2, 4, 6, 8, 10])
        lines.append(r.choice(["", "", pad, pad + "- name: x", pad + "- run: |", pad + "run: >-", pad + "run: echo", pad + "key:", pad + "key: v", pad + "# - run: |", "jobs:", "  build:", "  test-2:", "on: push", pad + "echo $X", "- a"]))
    return "\n".join(lines)


def test_blocks_by_walk(spark):
    r = random.Random(6)
    files = [(k, random_file(r)) for k in range(300)] + [(1000, None), (1001, "")]
    got = {}
    for x in B.block_lines(spark.createDataFrame(files, "file_id long, content string")).collect():
        got.setdefault(x["file_id"], {})[x["line_no"]] = (x["job"], x["step"], x["shell"])
    for k, text in files:
        want = {i + 1: v for i, v in enumerate(walked(text))} if text is not None else {}
        assert got.get(k, {}) == want, text
    steps = [v for f in got.values() for v in f.values()]
    assert sum(s is not None for _, s, _ in steps) > 500 and sum(h is not None for _, _, h in steps) > 200 and sum(j is not None for j, _, _ in steps) > 200


STEP = "jobs:\n  a:\n{env}    steps:\n      - uses: webfactory/ssh-agent@v0\n{gate}        with:\n          ssh-private-key: ${{{{ secrets.KEY }}}}\n{more}"


@pytest.mark.parametrize(
    ("env", "gate", "more", "found"),
    [
        ("", "", "", True),
        ("", "        if: secrets.KEY != ''\n", "", False),
        ("", "        if: ${{ secrets.KEY != \"\" }}\n", "", False),
        ("", "        if: secrets.KEY == ''\n", "", True),
        ("", "        if: secrets.OTHER != ''\n", "", True),
        ("", "", "      - if: secrets.KEY != ''\n        run: x\n", True),
        ("", "        if: steps.a.outputs.b\n", "", True),
        ("", "        if: steps.a.outputs.b\n", "      - run: echo x >> $GITHUB_OUTPUT\n", False),
        ("    env:\n      HAS: ${{ secrets.KEY != '' }}\n", "        if: env.HAS == 'true'\n", "", False),
        ("    env:\n      HAS: ${{ secrets.KEY != '' }}\n", "        if: env.HASTE == 'true'\n", "", True),
        ("    env:\n      RAW: ${{ secrets.KEY }}\n", "        if: env.RAW != ''\n", "", False),
        ("    env:\n      RAW: ${{ secrets.KEY }}\n", "        if: env.RAW\n", "", True),
        ("    env:\n      # RAW: ${{ secrets.KEY }}\n", "        if: env.RAW != ''\n", "", True),
        ("    env:\n      FIRST: ${{ secrets.KEY }}\n      RAW: ${{ secrets.KEY }}\n", "        if: env.RAW != ''\n", "", True),
    ],
)
def test_gates(spark, env, gate, more, found):
    text = STEP.format(env=env, gate=gate, more=more)
    rows = B.ungated_secrets(B.block_lines(spark.createDataFrame([(1, text)], "file_id long, content string"))).collect()
    assert [(r["action"], r["secret"], r["job"]) for r in rows] == [("webfactory/ssh-agent", "KEY", "a")] * found


def test_checkouts(spark):
    head = "on:\n  workflow_call:\njobs:\n  a:\n    steps:\n"
    step = "      - uses: actions/checkout@v4\n        with:\n          repository: {}\n          ref: {}\n"
    texts = {
        1: head + step.format("o/r", "${{ github.workflow_sha }}"), 2: head + step.format("${{ github.repository }}", "${{ github.workflow_sha }}"), 3: head + step.format("o/r", "${{ github.ref }}"),
        4: head.replace("workflow_call", "push") + step.format("o/r", "${{ github.ref }}"), 5: head + step.format("o/r", "main"), 6: head + "      - uses: actions/checkout@v4\n      - with:\n          repository: o/r\n          ref: ${{ github.sha }}\n",
        7: head.replace("  workflow_call", "  # workflow_call") + step.format("${{ inputs.r }}", "${{ github.workflow_sha }}"),
    }
    rows = B.checkout_findings(B.block_lines(spark.createDataFrame(list(texts.items()), "file_id long, content string"))).collect()
    foreign, itself = "workflow_sha_as_foreign_ref", "reusable_caller_context_self_checkout"
    assert sorted((r["file_id"], r["rule"]) for r in rows) == [(1, itself), (1, foreign), (3, itself), (7, foreign)]


def test_injected_lines(spark):
    text = "jobs:\n  a:\n    steps:\n      - run: |\n          one\n\n          echo ${{ github.head_ref }}\n        env:\n          X: ${{ github.head_ref }}\n      - run: echo ${{github.event.issue.body}}\n      - name: ${{ github.ref }}\n"
    rows = B.injections(B.block_lines(spark.createDataFrame([(1, text)], "file_id long, content string"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["source"], r["job"]) for r in rows] == [(7, "github.head_ref", "a"), (10, "github.event.issue.body", "a")]


def test_empty(spark):
    lines = B.block_lines(spark.createDataFrame([], "file_id long, content string"))
    assert lines.isEmpty() and B.checkout_findings(lines).isEmpty() and B.ungated_secrets(lines).isEmpty() and B.injections(lines).isEmpty()
    assert lines.select(F.count("*")).first()[0] == 0


def test_queries_read_equal_files_once(spark, monkeypatch):
    """A thousand files of two contents: the lines of two are followed, and each file has its findings."""
    from tessera.plans import blocks as P

    bad = "jobs:\n  a:\n    steps:\n      - run: |\n          echo ${{ github.head_ref }}\n      - uses: webfactory/ssh-agent@v0\n        with:\n          ssh-private-key: ${{ secrets.KEY }}"
    files = spark.range(1000).select(F.col("id").alias("file_id"), F.when(F.col("id") % 2 == 0, bad).otherwise("jobs:").alias("content"))
    read, real = [], B.block_lines
    monkeypatch.setattr(P, "block_files", lambda spark, d: files)
    monkeypatch.setattr(B, "block_lines", lambda f: read.append(f.count()) or real(f))
    for find in (P.x06_block_injections, P.x06_ungated_secrets):
        assert sorted(r["file_id"] for r in find(spark, "").collect()) == list(range(0, 1000, 2))
    assert read == [2, 2]
