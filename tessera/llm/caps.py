"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction, and a vector belongs to it if their inner product is
over a threshold.  The directions are products: the space is turned by
structured random rotations (signs and Hadamard transforms), cut into BLOCKS
parts, and every combination of one code word per part is a filter, so TABLES *
WORDS ** BLOCKS filters cost a few matrix products.  List decoding keeps the
prefixes of combinations that the best remaining words can still lift over the
threshold.  Vectors that share a filter are compared exactly, in double
precision; a pair counts at its smallest common filter only.

Equal vectors form one class.  A filter's classes are dealt to blocks of about
BLOCK_ROWS by hash, and each pair of blocks is a unit of work of its own, so no
task holds an unbounded filter.  A unit sends sums of links per class and a
spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textops as X
from tessera.llm.common import documents, staged
from tessera.llm.components import components

COSINE = 0.95
#: Threshold in standard deviations of a random vector's inner product with a direction.
TABLES, BLOCKS, WORDS, SIGMAS, SEED = 8, 2, 256, 3.65, 20240229
BLOCK_ROWS, PAIRS = 256, 50_000
#: Components up to which the threshold leaves no filters or few: such vectors are all compared, by blocks.
SMALL_DIM = 16


@lru_cache(maxsize=8)
def _code(dim: int, table: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Signs of the rotation, and the parts' places and unit code words."""
    rng = np.random.default_rng([SEED, dim, table])
    wide = 1 << max(2, (dim - 1).bit_length())
    signs = [rng.choice([-1.0, 1.0], wide) for _ in range(3)]
    parts = np.array_split(np.arange(wide), BLOCKS)
    words = []
    for p in parts:
        w = rng.standard_normal((WORDS, len(p)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(len(p) / wide))
    return signs, parts, words


def _rotated(x: np.ndarray, signs: list[np.ndarray]) -> np.ndarray:
    wide = len(signs[0])
    x = np.hstack([x, np.zeros((len(x), wide - x.shape[1]))])
    for s in signs:
        x = x * s
        h = 1
        while h < wide:
            y = x.reshape(len(x), wide // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), wide)
            h *= 2
        x = x / np.sqrt(wide)
    return x


def decode(unit: np.ndarray, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that a unit vector is over the threshold of, filters ascending in a row."""
    rows, filters = [], []
    for table in range(TABLES):
        signs, parts, words = _code(unit.shape[1], table)
        turned = _rotated(unit, signs)
        need = sigmas / np.sqrt(len(signs[0]))
        dots = [turned[:, p] @ w.T for p, w in zip(parts, words, strict=True)]
        rest = np.cumsum([d.max(1) for d in dots[::-1]], axis=0)[::-1]
        row, name, so_far = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, d in enumerate(dots):
            after = rest[k + 1] if k + 1 < BLOCKS else np.zeros(len(unit))
            total = so_far[:, None] + d[row]
            i, w = np.nonzero(total + after[row][:, None] >= need)
            row, name, so_far = row[i], name[i] * WORDS + w, total[i, w]
        rows.append(row)
        filters.append(name + table * WORDS**BLOCKS)
    row, name = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((name, row))
    return row[order], name[order]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows (none of them zero) at length one; by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(classes: DataFrame) -> DataFrame:
    """``classes`` (cls, n, dim, embedding) with their filters; vectors of one length up to SMALL_DIM share a single one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                dims = part.column(2).to_numpy()
                for dim in np.unique(dims):
                    some = part.take(pa.array(np.flatnonzero(dims == dim)))
                    x = some.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    if dim <= SMALL_DIM:
                        row, name = np.arange(len(x)), np.full(len(x), TABLES * WORDS**BLOCKS + dim)
                    else:
                        row, name = decode(_unit(x))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(name.astype(np.int32)))], names=[*some.schema.names, "filters"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("filters", T.ArrayType(T.IntegerType()))]))


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of consecutive groups, in runs of about PAIRS."""
    row = np.arange(int(sizes.sum())) + (starts[0] if len(starts) else 0)
    left = np.repeat(starts + sizes, sizes) - 1 - row
    i = 0
    total = np.concatenate([[0], np.cumsum(left)])
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1)
        n = left[i:j]
        a = np.repeat(row[i:j], n)
        yield a, X.ragged(row[i:j] + 1, n)
        i = j


def _compare(block: pa.RecordBatch, cosine: float) -> pa.RecordBatch:
    """Sums of links and a spanning forest of the links of whole groups (filter, a, b, cls, side, n, embedding, filters)."""
    name, a, b, cls, side, n = (block.column(k).to_numpy(zero_copy_only=False) for k in range(6))
    dim = np.diff(block.column(6).offsets.to_numpy())
    fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (dim[1:] != dim[:-1])])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(name)))
    lists = block.column(7)
    length = np.diff(lists.offsets.to_numpy())
    padded = np.full((len(name), int(length.max())), -1, np.int64)
    padded[np.repeat(np.arange(len(name)), length), X.ragged(np.zeros(len(name), np.int64), length)] = lists.flatten().to_numpy()
    flat, at = block.column(6).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dim)])
    add, root = np.zeros(len(name), np.int64), np.arange(len(name))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for d in np.unique(dim):
        of = np.flatnonzero(dim == d)
        x = np.zeros((len(name), d))
        x[of] = flat[X.ragged(at[of], dim[of])].reshape(-1, d)
        x[of] = _unit(x[of])
        some = dim[starts] == d
        for i, j in _runs(starts[some], sizes[some]):
            ok = (side[i] != side[j]) | (a[i] == b[i])
            i, j = i[ok], j[ok]
            hit = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            links.append((i, j))
            mine = _first_shared(padded, i, j, name[i])
            ii, jj = i[mine], j[mine]
            np.add.at(add, ii, n[jj])
            np.add.at(add, jj, n[ii])
    if links:
        i, j = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            root = root[root]
    some = np.flatnonzero((add > 0) | (root != np.arange(len(root))))
    return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(cls[root[some]]), pa.array(add[some])], names=["a", "b", "add"])


def _first_shared(lists: np.ndarray, i: np.ndarray, j: np.ndarray, name: np.ndarray) -> np.ndarray:
    """True where no filter below ``name`` stands in both ascending lists of a pair."""
    mine = np.ones(len(i), bool)
    open_ = np.arange(len(i))
    for t in range(lists.shape[1]):
        one = lists[i[open_], t]
        below = (one >= 0) & (one < name[open_])
        open_, one = open_[below], one[below]
        if not len(open_):
            break
        found = (lists[j[open_]] == one[:, None]).any(1)
        mine[open_[found]] = False
        open_ = open_[~found]
    return mine


def _runs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_pairs`` of groups that need not be adjacent."""
    local = np.cumsum(sizes) - sizes
    shift = np.repeat(starts - local, sizes)
    for i, j in _pairs(sizes, local):
        yield i + shift[i], j + shift[j]


def cap_links(classes: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(cls, links) and spanning links (a, b) of (cls, n, dim, embedding), classes of n equal valid vectors."""
    coded = staged(_filters(classes))
    member = coded.select("cls", F.explode("filters").alias("name"))
    count = member.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name", F.ceil(F.col("c") / block_rows).cast("int").alias("s"))
    unit = member.join(count, "name").withColumn("k", F.pmod(F.xxhash64("cls", "name"), F.col("s")).cast("int"))
    unit = unit.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    unit = unit.select("cls", "name", F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b"), (F.col("k") > F.col("o")).cast("int").alias("side"))
    full = unit.join(coded, "cls").select("name", "a", "b", "cls", "side", "n", "embedding", "filters")
    dealt = full.repartition("name", "a", "b").sortWithinPartitions("name", "a", "b", F.size("embedding"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                if rest is not None:
                    part = pa.concat_batches([rest, part])
                keys = [part.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield _compare(pa.concat_batches([part.slice(0, cut)]), cosine)
                rest = part.slice(cut)
        if rest is not None and rest.num_rows:
            yield _compare(pa.concat_batches([rest]), cosine)

    found = staged(dealt.mapInArrow(run, "a long, b long, add long"))
    return found.groupBy(F.col("a").alias("cls")).agg(F.sum("add").alias("links")), found.where("a <> b").select("a", "b").distinct()


def embedding_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; so do vectors of different lengths.  Rows with equal
    vectors link, also rows of one vec_id.  A component is named by its
    smallest vec_id; a null vec_id names none but its own.
    """
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    e = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    # adding 0.0 makes -0.0 and 0.0 one value
    v = v.withColumn("cls", F.when(good, F.xxhash64(F.size("embedding"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))))
    classes = staged(v.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")))
    links, edges = cap_links(classes.select("cls", "n", F.size("embedding").alias("dim"), "embedding"), cosine)
    roots = components(edges)
    small = classes.select("cls", "n", "least").join(links, "cls", "left").join(roots, F.col("cls") == roots["node"], "left")
    small = small.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"), "least")
    named = staged(small.join(small.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "n_links", "component_id"))
    out = v.select("vec_id", "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(documents(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), g AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), r(node, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b
), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
), c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
