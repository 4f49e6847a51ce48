"""Trust graph: edges from outcomes, Jaccard edges, and ranking."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Keys that a long's bits hold; sets of keys that are compared at once
BITS, BLOCK = 62, 4096
# Items of a block, items that meet it in a task, and about the most tasks
FEW, MANY, TASKS = 256, 32768, 40_000


def trust_edges(outcomes: DataFrame) -> DataFrame:
    """(src, dst, weight): each success links recipe to repo and bot to recipe (1.0), and repo to bot (0.5)."""
    edge = lambda a, b, w: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(w).alias("weight"))
    good = outcomes.where("outcome = 'success'")
    return good.select(F.explode(F.array(edge("recipe_id", "repo", 1.0), edge("bot", "recipe_id", 1.0), edge("repo", "bot", 0.5))).alias("e")).select("e.*")


def _key_sets(pairs: DataFrame, item: str, key: str) -> tuple[DataFrame | None, int]:
    """(item, n, keys) with an item's distinct keys as bits of one number, or None if there are more keys than bits; n counts a null key too.  With it about how many items there are."""
    # a row for each key and one for all
    found = pairs.where(F.col(item).isNotNull()).rollup(key).agg(F.grouping(key).alias("all"), F.approx_count_distinct(item).alias("items")).limit(BITS + 3).collect()
    known = [r[0] for r in found if r[0] is not None]
    if len(known) > BITS:
        return None, 0
    bits = F.create_map(*[F.lit(x) for k, v in enumerate(sorted(known)) for x in (v, 1 << k)]) if known else F.lit(None)
    bit = F.coalesce(F.element_at(bits, F.col(key)) if known else F.lit(None), F.lit(0)).cast("long")
    # a new partitioning, as few small rows make many pairs
    sets = pairs.where(F.col(item).isNotNull()).groupBy(item).agg(F.bit_or(bit).alias("keys"), F.max(F.col(key).isNull().cast("long")).alias("bare"))
    return sets.select(item, (F.bit_count("keys") + F.col("bare")).cast("long").alias("n"), "keys"), max((r["items"] for r in found if r["all"]), default=0)


def _tasks(df: DataFrame) -> int:
    return 4 * max(df.sparkSession.sparkContext.defaultParallelism, 8)


def jaccard_edges(pairs: DataFrame, item: str, key: str) -> DataFrame:
    """(a, b, shared, weight) of items that share keys, from distinct (item, key).

    Up to ``BITS`` keys make a number of each item, and pairs are compared where they are made; more keys are joined.
    Items are written once, in blocks of like sets, and dealt twice; items meet a block at a time where both are read, so
    neither the driver nor a task holds all items.  Rows of an item and of equal sets follow each other, and few items
    stand on the right in a task, as such rows take far fewer bytes in a column store.
    """
    sets, n = _key_sets(pairs, item, key)
    if sets is not None:
        # smaller blocks where items are few, so that all tasks have some
        size = min(FEW, n // isqrt(4 * _tasks(pairs)) + 1)
        blocks = n // size + 1
        across = min(blocks, max(n // MANY, 4 * _tasks(pairs) // blocks) + 1)
        alike = sets.repartitionByRange(n // MANY + 1, "keys", item).sortWithinPartitions("keys", item)
        # an id's low bits count the rows of its partition
        block = F.expr(f"monotonically_increasing_id() div {size}")
        dealt = written(alike.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("keys", item, "n"))).alias("items")).select("items"))
        one = dealt.repartition(across).select(F.inline("items").alias("keys_a", "a", "na"))
        many = dealt.repartition(min(blocks, TASKS // across + 1))
        met = one.hint("shuffle_replicate_nl").crossJoin(many).select("keys_a", "a", "na", F.inline("items").alias("keys_b", "b", "nb"))
        shared = F.bit_count(F.col("keys_a").bitwiseAND(F.col("keys_b"))).cast("long")
        sized = met.where("a < b").withColumn("shared", shared).where("shared > 0")
    else:
        p = pairs.select(item, key).distinct()
        size = p.groupBy(item).agg(F.count("*").alias("n"))
        a, b = p.select(F.col(item).alias("a"), key), p.select(F.col(item).alias("b"), key)
        shared = a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
        sized = shared.join(size.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(item).alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("weight"))


def _nearest(batches: Iterator[pd.DataFrame], few: int) -> Iterator[pd.DataFrame]:
    """(keys, shared, b): for each of a block's sets of keys the ``few`` of another block that share most, then the smallest; those come in order."""
    for batch in batches:
        for mine, others in zip(batch["mine"], batch["others"]):
            mine, names = np.asarray(mine, dtype=np.int64), np.array([x["b"] for x in others], dtype=object)
            keys = np.array([x["keys"] for x in others], dtype=np.int64)
            for k in range(0, len(mine), 256):
                part = mine[k : k + 256]
                code = (BITS - np.bitwise_count(part[:, None] & keys).astype(np.int64) << 32) + np.arange(len(keys))
                code = np.partition(code, few - 1, axis=1)[:, :few] if len(keys) > few else code
                yield pd.DataFrame({"keys": np.repeat(part, code.shape[1]), "shared": BITS - (code.ravel() >> 32), "b": names[code.ravel() & (1 << 32) - 1]})


def most_shared(pairs: DataFrame, item: str, key: str, top: int) -> DataFrame:
    """(a, b, shared): for each item the ``top`` others that share most keys, then the smallest.

    Items with the same keys have the same neighbours but for themselves, so sets of keys are compared, each with its
    ``top`` + 1 smallest items; blocks of sets meet blocks, and a block keeps ``top`` + 1 candidates for each set.
    """
    (sets, _), few = _key_sets(pairs, item, key), top + 1
    if sets is None:
        e = jaccard_edges(pairs, item, key)
        both = e.select("a", "b", "shared").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    else:
        sets = written(sets.where("keys <> 0").select("keys", F.col(item).cast("string").alias("b")))
        first = written(sets.withColumn("r", F.row_number().over(Window.partitionBy("keys").orderBy("b"))).where(F.col("r") <= few).drop("r"))
        blocks = first.count() // BLOCK + 1
        place = F.pmod(F.xxhash64("keys"), F.lit(blocks))
        mine = first.select("keys").distinct().groupBy(place.alias("block")).agg(F.collect_list("keys").alias("mine"))
        others = first.groupBy(place.alias("over")).agg(F.sort_array(F.collect_list(F.struct("b", "keys"))).alias("others"))
        met = mine.withColumn("over", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(others, "over")
        near = met.repartition(_tasks(pairs), "block", "over").select("mine", "others").mapInPandas(lambda x: _nearest(x, few), "keys long, shared long, b string").where("shared > 0")
        best = near.withColumn("r", F.row_number().over(Window.partitionBy("keys").orderBy(F.col("shared").desc(), "b"))).where(F.col("r") <= few).drop("r")
        both = sets.withColumnRenamed("b", "a").join(best, "keys").where("a <> b").select("a", "b", "shared")
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.col("shared").desc(), "b"))
    return both.withColumn("r", r).where(F.col("r") <= top).select("a", "b", "shared")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 0.001, every: int = 5) -> DataFrame:
    """(node, score): weighted ranks over (src, dst, weight), divided by the largest (0.001 at least).

    Parallel edges are summed.  Every ``every`` rounds the ranks are written to
    the shared folder, which keeps plans short and survives lost executors.
    """
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    e = written(e.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "share"))
    nodes = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    ranks = nodes.withColumn("score", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        got = e.join(ranks, e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = nodes.join(got, nodes["node"] == got["dst"], "left").select("node", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if (k + 1) % every and k + 1 < rounds:
            ranks = new
            continue
        new = written(new)
        shift = new.alias("x").join(ranks.alias("y"), "node").agg(F.max(F.abs(F.col("x.score") - F.col("y.score")))).first()[0]
        ranks = new
        if shift is None or shift < tolerance:
            break
    most = max(ranks.agg(F.max("score")).first()[0] or 0.0, 0.001)
    return ranks.select("node", F.least(F.lit(1.0), F.col("score") / most).alias("score"))
