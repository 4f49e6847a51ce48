"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations.

Targets: sources by name (null last) weigh 3, 1, 2, repeating, and share 1.5
times all words; a target stops at twice its source, and the excess is shared
again by weight.  Both this and the copies within a source are a water filling:
with the entries in order of cap over weight, the filled ones are a prefix, and
running sums give the common level.

Copies: within a source, a document of a size class (bits of its word count)
expects level * (TILT + bits) copies, at most 2, so that the expected words are
the target.  The whole part is certain.  The fraction is an inclusion
probability p, unequal between classes: documents are ranked by the odds of a
hashed uniform number over the odds of p, and taken in that order until the
fractions' words are reached (to the nearest document).

Ranks are never computed over a whole source: the rank value in (0, 1) is cut
into bins, words per bin are summed first, and only within a bin are documents
ordered.  All numbers derive from doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import documents, packed, staged

WEIGHTS, SHARE, LIMIT, TILT = (3, 1, 2), 1.5, 2, 8
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source in a bin, about.
BIN_ROWS = 200


def water_filled(table: DataFrame, group: list[str], amount: str, cap: str, weight: str, order: list[str]) -> DataFrame:
    """``table`` with ``level``: least(cap, level * weight) sums to ``amount`` in each group, or level is null where all caps are needed."""
    ratio = F.col(cap) / F.col(weight)
    part = Window.partitionBy(*group)
    before = part.orderBy("__ratio", *order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = table.withColumn("__ratio", ratio)
    out = out.withColumn("__level", (F.col(amount) - zero(F.sum(cap).over(before))) / (F.sum(weight).over(part) - zero(F.sum(weight).over(before))))
    out = out.withColumn("__place", F.row_number().over(part.orderBy("__ratio", *order)))
    first = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.col("__place"))).over(part)
    out = out.withColumn("__first", first)
    return out.withColumn("level", F.max(F.when(F.col("__place") == F.col("__first"), F.col("__level"))).over(part)).drop("__ratio", "__level", "__place", "__first")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the key's md5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, size); a row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank - 1) % len(WEIGHTS) + 1)
    sums = sums.withColumn("weight", weight).withColumn("cap", LIMIT * F.col("source_size")).withColumn("one", F.lit(1))
    sums = sums.withColumn("amount", SHARE * F.sum("source_size").over(Window.partitionBy("one")))
    filled = water_filled(sums, ["one"], "amount", "cap", "weight", ["source"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return filled.select("source", "source_size", target.alias("target"))


def mix_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target and copies (0, 1 or 2 of each row).

    Copies are found on a table of (key, source, size) alone; the texts then
    join their copies by key, and rows that agree in key, source and size share
    theirs out by a row number.  Null texts and texts without words have size 0 and no words to take; a null
    source is a source.  Rows that agree in ``key`` and size are alike to the
    sampler.  Columns of ``docs`` by the names of the new ones are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    mixed = mix_sized(staged(docs.select(F.col(key), "source", size.alias("words"))), key)
    number = lambda by, more: F.row_number().over(Window.partitionBy(by).orderBy(more))
    # the input's columns travel as one struct, so none of their names can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    left = docs.select(row.alias("row"), F.struct(F.col(key).alias("key"), F.col("source").alias("source"), size.alias("size")).alias("alike"))
    left = left.withColumn("i", number("alike", F.col("row").getField(text)))
    right = mixed.select(F.struct(F.col(key).alias("key"), "source", "size").alias("other"), "source_size", "target", "copies")
    right = right.withColumn("j", number("other", "copies"))
    both = left.join(right, left["alike"].eqNullSafe(right["other"]) & (left["i"] == right["j"]))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return both.select(*kept, F.col("alike.size").alias("size"), "source_size", "target", "copies")


def mix_sized(sized: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, words) with size (the words), source_size, target and copies."""
    rows = sized.withColumnRenamed("words", "size")
    rows = rows.withColumn("__src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("__bits", F.length(F.bin("size")))
    targets = source_targets(rows.select("source", "size"))
    targets = targets.withColumn("__src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")

    strata = rows.groupBy("__src", "__bits").agg(F.sum("size").alias("__words"), F.count("*").alias("__n")).join(targets, "__src")
    strata = strata.withColumn("__cap", LIMIT * F.col("__words")).withColumn("__w", F.col("__words") * (TILT + F.col("__bits")))
    strata = water_filled(strata.where("__words > 0"), ["__src"], "target", "__cap", "__w", ["__bits"])
    expect = F.when(F.col("level").isNull(), F.lit(float(LIMIT))).otherwise(F.least(F.lit(float(LIMIT)), F.col("level") * (TILT + F.col("__bits"))))
    strata = strata.withColumn("__sure", F.floor(expect).cast("int")).withColumn("__p", expect - F.floor(expect))
    by_source = Window.partitionBy("__src")
    strata = strata.withColumn("__rest", F.sum(F.round(F.col("__words") * F.col("__p"), 3)).over(by_source)).withColumn("__rows", F.sum("__n").over(by_source))
    strata = staged(strata.select("__src", "__bits", "__sure", "__p", "__rest", "__rows", "source_size", "target"))

    u = uniform(F.col(key))
    over = u * (1 - F.col("__p"))
    kept = rows.join(strata, ["__src", "__bits"], "left")
    kept = kept.withColumn("__x", F.when(F.col("__p") > 0, over / (over + (1 - u) * F.col("__p"))))
    # rows that the sampler can't take are spread over bins of their own
    spread = -1 - F.pmod(F.xxhash64(key, "size"), F.greatest(F.lit(16), F.col("__rows") / BIN_ROWS).cast("long"))
    kept = kept.withColumn("__bin", F.coalesce(F.floor(F.col("__x") * F.greatest(F.lit(16), F.col("__rows") / BIN_ROWS)).cast("long"), spread, F.lit(-1).cast("long")))
    sums = kept.where("__x IS NOT NULL").groupBy("__src", "__bin").agg(F.sum("size").alias("__in"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__in").over(Window.partitionBy("__src").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__in")
    kept = kept.join(sums, ["__src", "__bin"], "left")
    within = Window.partitionBy("__src", "__bin").orderBy("__x", F.col(key), "size").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("__before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    picked = F.col("__x").isNotNull() & (done + F.col("size") / 2 <= F.col("__rest"))
    copies = (F.coalesce("__sure", F.lit(0)) + F.coalesce(picked, F.lit(False)).cast("int")).cast("int")
    kept = kept.withColumn("copies", copies)
    # texts without words are in no stratum: their source's figures
    names = targets.select("__src", F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    kept = kept.join(names, "__src", "left").withColumn("source_size", F.coalesce("source_size", "__size")).withColumn("target", F.coalesce("target", "__target"))
    return kept.select(key, "source", "size", "source_size", "target", "copies")


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # a small table of sizes; the texts are read once
    sized = staged(docs.select("doc_id", "source", size.alias("words")))
    mixed = mix_sized(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: each row as often as the sampler takes it."""
    rows, unpacked = packed(docs, "doc_id", "text", "source")
    mixed = mix_copies(rows).where("copies > 0")
    return unpacked(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT src, source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY src, source
), s1 AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size) / w::DOUBLE AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS amount FROM s
), s2 AS (
  SELECT *, (amount - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lev,
    row_number() OVER (ORDER BY ratio, source) AS place
  FROM s1 WINDOW b AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, (SELECT arg_min(lev, place) FROM s2 WHERE ratio >= lev) AS level FROM s2
), t AS (
  SELECT src, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * w) END AS target FROM s3
), k AS (
  SELECT d.src, length(bin(size)) AS bits, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(target) AS target
  FROM d JOIN t ON d.src = t.src GROUP BY d.src, length(bin(size)) HAVING sum(size) > 0
), k1 AS (
  SELECT *, 2 * words AS cap, words * (8 + bits) AS w, (2 * words) / (words * (8 + bits))::DOUBLE AS ratio FROM k
), k2 AS (
  SELECT *, (target - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(w) OVER (PARTITION BY src) - coalesce(sum(w) OVER b, 0))::DOUBLE AS lev,
    row_number() OVER (PARTITION BY src ORDER BY ratio, bits) AS place
  FROM k1 WINDOW b AS (PARTITION BY src ORDER BY ratio, bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k3 AS (
  SELECT k2.*, l.level FROM k2 LEFT JOIN (SELECT src, arg_min(lev, place) AS level FROM k2 WHERE ratio >= lev GROUP BY src) l ON l.src = k2.src
), k4 AS (
  SELECT *, CASE WHEN level IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, level * (8 + bits)) END AS e FROM k3
), k5 AS (
  SELECT src, bits, floor(e) AS sure, e - floor(e) AS p, sum(round(words * (e - floor(e)), 3)) OVER (PARTITION BY src) AS rest FROM k4
), x AS (
  SELECT d.*, sure, p, rest, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS x
  FROM d LEFT JOIN k5 ON d.src = k5.src AND length(bin(d.size)) = k5.bits
), y AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY x, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM x WHERE x IS NOT NULL
  UNION ALL BY NAME SELECT *, NULL AS done FROM x WHERE x IS NULL
)
SELECT doc_id, size, t.source_size, t.target,
  (size * (coalesce(sure, 0) + CASE WHEN x IS NOT NULL AND done + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM y JOIN t ON y.src = t.src
"""
