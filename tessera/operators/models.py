"""A radial-basis network: fitted centres, their widths, and a linear readout of Gaussian activations."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTRES = 20
ROUNDS = 50
SHIFT = 0.001
WIDTH_SCALE = 1.5
LEAST_WIDTH = 0.01
NOVEL = 3.0


class Network(NamedTuple):
    """Centres and widths (at most ``CENTRES`` of them, so they stand in expressions) and the readout's weights."""

    centres: list[list[float]]
    widths: list[float]
    weights: list[float]
    bias: float


def squared_distance(x: Column, centre: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def centre_widths(centres: list[list[float]]) -> list[float]:
    """One and a half times the distance to the next centre, 0.01 at least; a single centre has width 1.5."""
    near = [min((math.dist(a, b) for j, b in enumerate(centres) if j != i), default=1.0) for i, a in enumerate(centres)]
    return [max(WIDTH_SCALE * n, LEAST_WIDTH) for n in near]


def activations(x: Column, centres: list[list[float]], widths: list[float]) -> Column:
    return F.array(*[F.exp(-squared_distance(x, c) / (2.0 * w * w)) for c, w in zip(centres, widths, strict=True)])


def radial_network(rows: DataFrame, k: int = CENTRES, seed: int = 7) -> Network:
    """Fitted on rows (x array of doubles, y double) with equally long, finite x; other rows are left out."""
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    vectors = rows.select(array_to_vector("x").alias("features"))
    found = KMeans(k=k, maxIter=ROUNDS, tol=SHIFT, seed=seed).fit(vectors)
    centres = [c.tolist() for c in found.clusterCenters()]
    widths = centre_widths(centres)
    seen = rows.select(array_to_vector(activations(F.col("x"), centres, widths)).alias("features"), F.col("y").alias("label"))
    fit = LinearRegression(regParam=1e-6).fit(seen)
    return Network(centres, widths, fit.coefficients.toArray().tolist(), fit.intercept)


def nearest(rows: DataFrame, net: Network) -> DataFrame:
    """Adds the nearest centre, the first on ties, and its distance."""
    best = F.array_min(F.array(*[F.struct(squared_distance(F.col("x"), c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(net.centres)]))
    return rows.withColumn("_b", best).withColumn("centre", F.col("_b.k")).withColumn("distance", F.sqrt("_b.d")).drop("_b")


def predict(rows: DataFrame, net: Network) -> DataFrame:
    """Adds prediction, the readout through a sigmoid, and novel: farther than three mean widths from every centre."""
    a = activations(F.col("x"), net.centres, net.widths)
    total = F.aggregate(F.zip_with(a, F.array(*map(F.lit, net.weights)), lambda p, q: p * q), F.lit(net.bias), lambda s, v: s + v)
    far = NOVEL * sum(net.widths) / len(net.widths)
    return nearest(rows, net).withColumn("prediction", 1.0 / (1.0 + F.exp(-total))).withColumn("novel", F.col("distance") > far)
