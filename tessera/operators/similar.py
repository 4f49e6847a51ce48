"""Names that resemble each other by Jaro similarity, joined without comparing all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Shared characters within half the longer length, and how many pairs of them stand out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(b)
    first, places = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = None
                first.append(c)
                places.append(j)
                break
    if not first:
        return 0.0
    moved = sum(c != b[j] for c, j in zip(first, sorted(places), strict=True)) // 2
    m = len(first)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.pandas_udf(T.DoubleType())
def _jaro_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# a filter on it would else be pushed below the counting, to a row for each shared character
jaro_column = _jaro_column.asNondeterministic()


def _characters(names: DataFrame, x: str) -> DataFrame:
    """(token, name, length) of distinct names: a token is a character and how often it has stood before in the name."""
    c = names.select(F.col("name").alias(x), F.length("name").alias(f"n{x}"), F.explode(F.filter(F.split("name", ""), lambda v: v != "")).alias("c"))
    counted = c.groupBy(x, f"n{x}", "c").agg(F.count("*").alias("k"))
    return counted.select(x, f"n{x}", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda k: F.concat("c", k.cast("string")))).alias("token"))


def jaro_pairs(names: DataFrame, others: DataFrame, more_than: float) -> DataFrame:
    """(a, b, similarity) of distinct names (name) and others (name) whose similarity exceeds ``more_than``, above 1/3.

    Two names share no more characters within Jaro's reach than they share at all.  So a pair's tokens are counted in a
    join by token, and only pairs whose count and lengths leave the threshold open are verified.  Null and empty names
    resemble nothing.
    """
    a, b = (_characters(df.where("name IS NOT NULL AND name <> ''").select("name").distinct(), x) for df, x in ((names, "a"), (others, "b")))
    # few characters make many pairs: the names are dealt out, or all pairs of small tables would be one task's
    a = a.repartition(names.sparkSession.sparkContext.defaultParallelism, "a")
    shared = a.join(b, "token").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m"))
    # with no two characters out of order the similarity is at most (m / na + m / nb + 1) / 3
    open_ = shared.where(F.col("m") / F.col("na") + F.col("m") / F.col("nb") + 1 > 3 * more_than - 1e-9)
    return open_.withColumn("similarity", jaro_column("a", "b")).where(F.col("similarity") > more_than).select("a", "b", "similarity")
