"""Routes, orders and models against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.plans.routing  # noqa: F401  (registers its queries)
from tessera.operators import models as M
from tessera.operators import routing as R
from tessera.plans.queries import QUERIES


def test_recipe_steps(spark):
    recipes = spark.createDataFrame(
        [("a", 0.9, "substitute", ["rust"], [], ["PA1-x"]), ("b", 0.8, "eliminate", ["any"], ["K"], []), ("c", 0.99, "control", ["*"], [], ["PA2-quote-vars"]), ("d", 0.99, "control", ["yaml"], ["TokenPermissions"], []), ("e", 0.8, "control", ["*", "any"], ["K"], [])],
        "id string, confidence double, tier string, languages array<string>, categories array<string>, pattern_ids array<string>",
    )
    patterns = spark.createDataFrame(
        [("PA1-x", "K", "", "PA1", "rust"), ("PA1-x", "K", "", "PA1", "zig"), ("p", "L", "Unquoted thing", "PA2", "zig"), ("q", "L", "else", "PA2", "zig"), ("r", "TokenPermissions", "", "", "zig"), (None, None, None, None, None)],
        "id string, category string, description string, pa_rule string, language string",
    )
    got = {(r["id"], r["language"]): (r["step"], r["recipe_id"]) for r in R.best_recipes(patterns, recipes).collect()}
    assert got == {("PA1-x", "rust"): (1, "a"), ("PA1-x", "zig"): (2, "b"), ("p", "zig"): (3, "c"), ("q", "zig"): (None, None), ("r", "zig"): (2, "d"), (None, None): (None, None)}
    assert R.best_recipes(patterns.limit(0), recipes).count() == 0


def test_triangle(spark):
    best = spark.createDataFrame([("A", "r", "eliminate"), ("B", "r", "substitute"), ("C", "r", "control"), ("D", None, None), ("E", None, None)], "category string, recipe_id string, tier string")
    subs = spark.createDataFrame([("B", "eliminate", []), ("D", "substitute", ["m"]), ("E", None, None)], "category string, sub_tier string, modules array<string>")
    got = {r["category"]: (r["route"], r["routed_id"]) for r in R.triangle(best, subs).collect()}
    assert got == {"A": ("eliminate", "r"), "B": ("eliminate", "synthetic-eliminate-B"), "C": ("substitute", "r"), "D": ("substitute", "proven-substitute-D"), "E": ("control", None)}


def test_order(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    edges = lambda *e: spark.createDataFrame(list(e), "node string, needs string")
    assert {tuple(r) for r in R.ordered(edges(("b", "a"), ("c", "b"), ("c", "a"), ("d", "unknown")), nodes).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 0)}
    with pytest.raises(ValueError, match="circular"):
        R.ordered(edges(("a", "b"), ("b", "a")), nodes, rounds=5)


def test_network(spark):
    """Centres are a fixed point of k-means, and each step equals numpy's."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (60, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 3))])
    y = (np.arange(180) < 60).astype(float)
    rows = spark.createDataFrame([(k, v.tolist(), t) for k, (v, t) in enumerate(zip(x, y.tolist(), strict=True))] + [(900, None, 1.0), (901, [float("nan"), 0.0, 0.0], 1.0)], "vec_id long, x array<double>, y double")
    net = M.radial_network(rows, k=3)
    centres = np.array(net.centres)
    d = np.linalg.norm(x[:, None] - centres, axis=2)
    assert all(np.linalg.norm(x[d.argmin(1) == k].mean(0) - centres[k]) < M.SHIFT for k in range(3))
    gaps = np.linalg.norm(centres[:, None] - centres, axis=2) + np.eye(3) * 99
    assert np.allclose(net.widths, np.maximum(gaps.min(1) * 1.5, 0.01))
    a = np.exp(-(d**2) / (2 * np.array(net.widths) ** 2))
    out = {r["vec_id"]: r for r in M.predict(rows.where(F.col("vec_id") < 900), net).collect()}
    want = 1 / (1 + np.exp(-(a @ np.array(net.weights) + net.bias)))
    assert np.allclose([out[k]["prediction"] for k in range(180)], want)
    assert [out[k]["centre"] for k in range(180)] == d.argmin(1).tolist()
    assert not any(r["novel"] for r in out.values())
    assert ((want > want.mean()) == (y == 1)).all()


def test_attention(spark, sf):
    """Ranked within each kind, and only poorly trusted repositories."""
    scores = {r["node"]: r["score"] for r in QUERIES["g03_trust_rank"](spark, sf).collect()}
    got = QUERIES["g04_attention"](spark, sf).collect()
    for kind, sign in (("recipe", -1), ("bot", -1), ("repo", 1)):
        want = sorted((sign * round(s, 9), n) for n, s in scores.items() if n.startswith(kind) and (kind != "repo" or s < 0.4))
        assert [r["node"] for r in sorted((r for r in got if r["kind"] == kind), key=lambda r: r["place"])] == [n for _, n in want]
