"""Prover models against numpy, and similar names against all pairs (of ASCII letters: the other engine compares bytes)."""

from __future__ import annotations

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.operators import provers as M
from tessera.operators.similar import jaro, jaro_pairs


def test_models_by_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("safety", 60), ("equiv", 40), ("few", 4), (None, 10)):
        x = rng.random((n, 6))
        y = x @ rng.standard_normal(6) + rng.standard_normal() + rng.normal(0, 0.1, n)
        rows += [(name, a.tolist(), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [("safety", None, 1.0), ("safety", [0.0] * 6, None)]
    df = spark.createDataFrame(rows, "class string, x array<double>, y double").repartition(5)
    got = {r["class"]: r for r in M.class_models(df).collect()}
    assert set(got) == {"safety", "equiv", None}
    for name, r in got.items():
        some = [(x, y) for c, x, y in rows if x is not None and y is not None and (name is None or c == name)]
        z = np.hstack([np.ones((len(some), 1)), np.array([x for x, _ in some])])
        y = np.array([v for _, v in some])
        want = np.linalg.solve(z.T @ z / len(y) + M.RIDGE * np.eye(7), z.T @ y / len(y))
        assert r["n"] == len(y) and np.allclose(r["weights"], want, rtol=1e-8)
        assert np.allclose(r["mean"], z[:, 1:].mean(0)) and np.allclose(r["spread"], z[:, 1:].var(0))
    assert M.class_models(df.limit(0)).isEmpty()


def test_recommendation_by_hand(spark):
    models = spark.createDataFrame(
        [("safety", 9, [0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0], [0.5] * 6, [0.1] * 6), (None, 99, [0.2, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0], [0.5] * 6, [0.1] * 6)],
        "class string, n long, weights array<double>, mean array<double>, spread array<double>",
    )
    asked = spark.createDataFrame([(1, "safety", None), (2, "new", None), (3, None, ["lean", "z3"]), (4, "safety", ["odd", "lean"]), (5, "safety", [])], "obligation long, class string, provers array<string>")
    none = F.lit(None)
    features = lambda p: M.attempt_features(F.col("class"), p, none.cast("string"), none.cast("double"), none.cast("long"), none)
    got = {r["obligation"]: (r["prover"], round(r["prediction"], 6), r["own"]) for r in M.recommend(asked, models, features).collect()}
    place = lambda p: (M.PROVERS.index(p) + 1) / (len(M.PROVERS) + 1)
    last, first = max(M.KNOWN, key=place), min(M.KNOWN, key=place)
    assert got == {1: (last, round(0.1 + place(last), 6), True), 2: (first, round(0.2 - place(first), 6), False), 3: ("z3", round(0.2 - place("z3"), 6), False), 4: ("odd", 1.1, True)}
    assert M.recommend(asked, models.limit(0), features).isEmpty()


def test_targets(spark):
    df = spark.createDataFrame([("success",), ("failure",), ("timeout",), ("odd",), (None,)], "o string")
    assert [r[0] for r in df.select(M.target(F.col("o"))).collect()] == [1.0, 0.0, 0.25, 0.5, 0.5]


def test_known_similarities():
    assert round(jaro("martha", "marhta"), 4) == 0.9444 and round(jaro("dixon", "dicksonx"), 4) == 0.7667
    assert jaro("", "a") == 0 and jaro("same", "same") == 1 and jaro("ab", "cd") == 0


def test_pairs_by_all_pairs(spark):
    r = random.Random(7)
    similar = lambda x, y: duckdb.execute("SELECT jaro_similarity(?, ?)", [x, y]).fetchall()[0][0]
    make = lambda n: ["".join(r.choice("abcdef- ") for _ in range(r.randint(1, 9))) for _ in range(n)]
    a, b = make(90), make(70)
    one = spark.createDataFrame([(x,) for x in [*a, *a[:5], "", None]], "name string")
    two = spark.createDataFrame([(x,) for x in [*b, *a[:3], "", None]], "name string")
    for least in (0.6, 0.85):
        got = {(x["a"], x["b"]): x["similarity"] for x in jaro_pairs(one, two, least).collect()}
        every = {(x, y): similar(x, y) for x in set(a) for y in {*b, *a[:3]}}
        assert set(got) == {k for k, v in every.items() if v > least}
        assert all(abs(v - every[k]) < 1e-12 for k, v in got.items())
