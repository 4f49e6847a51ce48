"""Which prover to try: one linear model a class of obligations, all solved at once in columns.

A class's model needs its sums of products alone: partial aggregates by class, then
elimination on an array of seven rows.  No class's rows meet in a task, and there is no
loop over classes.  The reference's networks of a few centres a class are replaced by this
readout on the features themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names in the order of their scores, outcomes' targets, provers that are tried, rows of a model of its own
CLASSES = ("safety", "linearity", "termination", "equiv", "correctness", "confluence", "totality", "invariant", "refinement", "model-check", "other")
PROVERS = (
    "z3", "cvc5", "altergo", "coq", "lean", "agda", "idris2", "isabelle", "fstar", "dafny", "why3", "metamath", "hol_light", "mizar", "hol4", "pvs", "acl2", "tlaps", "vampire", "eprover", "spass", "cadical", "kissat",
    "minisat", "twelf", "nuprl", "minlog", "imandra", "alloy", "spin", "cbmc", "seahorn", "dreal", "framac", "key", "abc", "glpk", "scip", "minizinc", "chuffed", "ortools", "typedwasm", "other",
)
KNOWN = ("z3", "cvc5", "altergo", "coq", "lean", "agda", "idris2", "vampire", "cadical", "metamath", "dafny", "why3")
TARGETS = {"success": 1.0, "failure": 0.0, "timeout": 0.25}
LEAST_ROWS, LONGEST = 5, 2000
#: Added to the diagonal of the mean products: a class's own score is constant within it.
RIDGE = 1e-3
FEATURES = 6


def score(name: Column, names: tuple[str, ...]) -> Column:
    """A name's place among the names, in (0, 1); one that isn't there has 1."""
    place = F.array_position(F.array(*map(F.lit, names)), F.coalesce(name, F.lit("")))
    return F.when(place > 0, place / float(len(names) + 1)).otherwise(1.0)


def attempt_features(obligation_class: Column, prover: Column, claim: Column, confidence: Column, duration_ms: Column, parent: Column) -> Column:
    """Six numbers in about [0, 1]; missing ones are those of an empty claim, half confidence, no time and no parent."""
    length = F.least(F.length(F.coalesce(claim, F.lit(""))), F.lit(LONGEST)) / float(LONGEST)
    time = F.log10(F.coalesce(duration_ms, F.lit(0)) + 1) / 5.0
    return F.array(score(obligation_class, CLASSES), score(prover, PROVERS), length, F.coalesce(confidence, F.lit(0.5)), time, F.when(parent.isNotNull(), 1.0).otherwise(0.0))


def target(outcome: Column) -> Column:
    return reduce(lambda c, kv: c.when(outcome == kv[0], kv[1]), list(TARGETS.items())[1:], F.when(outcome == "success", 1.0)).otherwise(0.5)


def _solved(matrix: Column, size: int) -> Column:
    """Weights of an augmented positive matrix, by elimination without exchange."""

    def step(m: Column, k: Column) -> Column:
        pivot = F.transform(F.get(m, k), lambda v: v / F.get(F.get(m, k), k))
        return F.transform(m, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda x, y: x - F.get(row, k) * y)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def class_models(attempts: DataFrame) -> DataFrame:
    """(class, n, weights, mean, spread) of attempts (class, x array of six, y): a row for each class of enough rows, and a null class for all rows."""
    z = [F.lit(1.0), *[F.get("x", F.lit(k)) for k in range(FEATURES)]]
    size = len(z)
    rows = attempts.where("x IS NOT NULL AND y IS NOT NULL")
    products = [F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)] + [F.sum(z[i] * F.col("y")).alias(f"b{i}") for i in range(size)]
    sums = rows.groupBy("class").agg(F.count("*").alias("n"), *products)
    names = [c for c in sums.columns if c != "class"]
    whole = sums.agg(*[F.sum(c).alias(c) for c in names]).where("n > 0").select(F.lit(None).cast("string").alias("class"), *names)
    kept = sums.where((F.col("n") >= LEAST_ROWS) & F.col("class").isNotNull()).select("class", *names).unionByName(whole)
    mean = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}") / F.col("n")
    matrix = F.array(*[F.array(*[mean(i, j) + (RIDGE if i == j else 0.0) for j in range(size)], F.col(f"b{i}") / F.col("n")) for i in range(size)])
    centre = F.array(*[mean(0, k + 1) for k in range(FEATURES)])
    spread = F.array(*[mean(k + 1, k + 1) - mean(0, k + 1) * mean(0, k + 1) for k in range(FEATURES)])
    return kept.select("class", "n", matrix.alias("matrix"), centre.alias("mean"), spread.alias("spread")).select("class", "n", _solved(F.col("matrix"), size).alias("weights"), "mean", "spread")


def recommend(obligations: DataFrame, models: DataFrame, features) -> DataFrame:
    """(obligation, prover, prediction, confidence, own) of obligations (obligation, class, ..., provers array or null).

    ``features`` maps a prover column to the features of a row.  The class's own model predicts, else that of all rows; the
    greatest prediction wins, then the greatest confidence (how near the features lie to what the model has seen), then
    the first name.  Without any model there are no rows.
    """
    rows = obligations.withColumn("prover", F.explode(F.coalesce("provers", F.array(*map(F.lit, KNOWN))))).withColumn("x", features(F.col("prover")))
    own = models.where("class IS NOT NULL").select(F.col("class").alias("of"), F.struct("weights", "mean", "spread").alias("own"))
    whole = models.where("class IS NULL").select(F.struct("weights", "mean", "spread").alias("whole"))
    rows = rows.join(own, F.col("class") == F.col("of"), "left").crossJoin(F.broadcast(whole)).withColumn("m", F.coalesce("own", "whole"))
    total = F.aggregate(F.zip_with(F.slice("m.weights", 2, FEATURES), "x", lambda w, v: w * v), F.get("m.weights", F.lit(0)), lambda s, v: s + v)
    off = F.zip_with(F.zip_with("x", "m.mean", lambda v, c: (v - c) * (v - c)), "m.spread", lambda d, s: d / (s + 0.01))
    near = F.exp(-0.5 * F.aggregate(off, F.lit(0.0), lambda s, v: s + v) / FEATURES)
    scored = rows.select("obligation", "prover", total.alias("prediction"), near.alias("confidence"), F.col("own").isNotNull().alias("own"))
    best = F.min(F.struct((-F.col("prediction")).alias("a"), (-F.col("confidence")).alias("b"), "prover", "own")).alias("x")
    return scored.groupBy("obligation").agg(best).select("obligation", "x.prover", (-F.col("x.a")).alias("prediction"), (-F.col("x.b")).alias("confidence"), "x.own")
