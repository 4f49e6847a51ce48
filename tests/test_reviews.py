"""Review summaries by hand."""

from __future__ import annotations

from tessera.operators.reviews import review_summaries


def test_summaries(spark):
    changes = spark.createDataFrame([(1,), (2,), (2,), (3,)], "change long")
    comments = [(1, 2, "low", "b", None, "later", "r2"), (1, 1, "low", "a", 7, "first", "r1"), (1, 3, "critical", "c", 9, "worst", "r3"), (1, 4, "odd", "d", 1, "hidden", "r4"), (3, 1, "odd", "x", 1, "y", "z"), (9, 1, "low", "no", 1, "such", "change")]
    df = spark.createDataFrame(comments, "change long, place long, severity string, path string, line long, body string, rule string").repartition(3)
    got = {r["change"]: r["summary"] for r in review_summaries(changes, df, "T").collect()}
    assert got == {
        1: "> **T** -- 4 finding(s)\n\n---\n\n### :red_circle: Critical (1)\n\n- **`c:9`** -- worst (`r3`)\n\n### :blue_circle: Low (2)\n\n- **`a:7`** -- first (`r1`)\n- **`b`** -- later (`r2`)\n",
        2: "> **T**: No issues found. :white_check_mark:",
        3: "> **T** -- 1 finding(s)\n\n---\n",
    }
    assert review_summaries(changes.limit(0), df, "T").isEmpty()
