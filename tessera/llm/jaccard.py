"""N-gram Jaccard self-join by prefix filters under several global orders.

A text's set is its distinct 5-word shingles (64-bit hashes).  If two sets have
a Jaccard similarity of t or more, then under *any* total order of shingles
their prefixes of n - ceil(t n) + 1 shingles share one.  Three orders are used:
by corpus frequency (from a fixed-size count sketch of all documents, ties by
hash) and by two independent hashes.  More than that: what two sets share
beyond both prefixes stands in the rest of the one whose prefix ends first, so
the prefixes have to share as many as the rest leaves open (``needed``).  A pair
is a candidate if they do under all three; candidates are verified on the whole
sets.

Texts with equal sets form one class, and only classes are joined.  The first
order deals classes to lists, one for each prefix shingle that several hold:

* Short lists (up to HEAVY classes) give pairs of classes as rows, at most
  HEAVY / 2 for each row of a list; they are counted, and the other orders and
  the sets follow in joins by class.
* Classes that long lists hold together, directly or in steps, form a group.
  Its classes are dealt to blocks, and every pair of blocks is one unit of work:
  a task applies size and both further orders to all pairs of the unit, then
  compares sets, and returns the number of links of each class and links that
  span what is linked.  So a group of k near copies makes k * blocks rows, and
  neither pairs nor a whole group meet in the data.

Every pair that shares a prefix shingle is in one of the two, so no link is
lost and each is counted once.  Groups grow by steps; where frequent shingles
chained many unlike texts together, the blocks' work would grow with the square
of their number.  The frequency order is what prevents that: a shingle that
many texts hold is in a prefix only where four fifths of the text are more
frequent still.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm import textops as X
from tessera.llm.common import Scratch, bounded_batches, documents, packed, staged
from tessera.llm.components import components

WIDTH = 5
#: Similarity in percent.
PERCENT = 80
#: Counters of the frequency sketch (a power of two) and blocks that it is summed in.  Its size is fixed: the more
#: shingles share a counter, the later a frequent shingle stands out; lists get longer, and results stay the same.
SKETCH, BLOCKS = 1 << 24, 256
#: Steps of the counts that tasks get, an octave: a byte holds each.
STEPS = 8
#: Bytes of the filter of wanted documents (a power of two): fixed, so a full filter costs time and no results.
FILTER = 1 << 23
#: Classes of a prefix shingle from which its pairs are compared in blocks instead of as rows; and documents (by the
#: sketch) from which a shingle is taken for such a one without counting its classes at one place.
HEAVY, HOT = 64, 1 << 20
#: Classes, and shingles of theirs, of a block that is compared in one task with another, and shingles counted at once.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 21, 4096
#: Pairs of rows that are counted at once.
PAIRS = 1 << 20


def _shingles(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First document, shingle hashes grouped by document, and offsets, by slices of a batch."""
    data, offsets = X.flat(batch.column(column))
    for i, j in X.slices(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, of = X.word_spans(part, offs)
        value, of = X.windows(X.span_hashes(part, starts, ends, True), of, j - i, WIDTH, True)
        if np.any(of[1:] < of[:-1]):
            order = np.argsort(of, kind="stable")
            value, of = value[order], of[order]
        yield i, value, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=j - i))]).astype(np.int64)


def _summed(tasks: DataFrame, size: int, kind: type, join, last=lambda x: x) -> np.ndarray:
    """The blocks that tasks sent, joined in tasks of their own; only the result, after ``last``, reaches the driver, as bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(b), kind)
                sums[k] = join(sums[k], x) if k in sums else x
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "x": pa.array([zlib.compress(last(s).tobytes(), 1) for s in sums.values()], pa.binary())})

    out = np.zeros((BLOCKS, size // BLOCKS), np.uint8)
    for block, x in tasks.repartition("block").mapInArrow(add, "block int, x binary").collect():
        out[block] = np.frombuffer(zlib.decompress(x), np.uint8)
    return out.reshape(-1)


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    rows = total.reshape(BLOCKS, -1)
    some = np.flatnonzero(rows.any(1))
    return pa.RecordBatch.from_pydict({"block": pa.array(some.astype(np.int32)), "x": pa.array([zlib.compress(rows[k].tobytes(), 1) for k in some], pa.binary())})


def frequency_sketch(texts: DataFrame) -> np.ndarray:
    """Counts of all shingles of a one-column text table, in SKETCH counters by hash, as STEPS * log2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int32)
        held: list[np.ndarray] = []

        def add() -> None:
            np.add.at(total, (np.concatenate(held) & np.uint64(SKETCH - 1)).astype(np.int64), np.int32(1))
            held.clear()

        for batch in batches:
            for _, value, _ in _shingles(batch, 0):
                held.append(value)
                if len(held) > 16:
                    add()
        if held:
            add()
            yield _blocks(total)

    def add_up(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x.astype(np.int64) + y, np.iinfo(np.int32).max).astype(np.int32)

    return _summed(texts.mapInArrow(count, "block int, x binary"), SKETCH, np.int32, add_up, _levels)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.round(STEPS * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _long(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(names: np.ndarray) -> np.ndarray:
    """Two bits of the filter for each name."""
    return np.stack([names & np.uint64(8 * FILTER - 1), (names >> np.uint64(32)) & np.uint64(8 * FILTER - 1)])


def _inside(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = _places(names)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def wanted_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter, in FILTER bytes, of the doc_ids of a one-column table (null: -1)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, np.uint8)
        for batch in batches:
            at = _places(X.mix(_long(batch.column(0)).view(np.uint64))).reshape(-1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield _blocks(bits)

    return _summed(wanted.mapInArrow(mark, "block int, x binary"), FILTER, np.uint8, np.bitwise_or)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def needed(n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles the prefixes of two linked sets of these sizes share at least.

    With a prefix of n - ceil(t n) + 1, ceil(t n) - 1 are left; linked sets share
    t / (1 + t) of the sum of their sizes or more, of which the rest of one of
    them holds no more than it has.
    """
    rest = (percent * np.maximum(n, other) + 99) // 100 - 1
    return np.maximum((percent * (n + other) + 99 + percent) // (100 + percent) - rest, 1)


def needed_sql(n: str, other: str, percent: int) -> str:
    """``needed`` of two columns."""
    rest = f"({percent} * greatest({n}, {other}) + 99) div 100 - 1"
    return f"greatest(({percent} * ({n} + {other}) + {99 + percent}) div {100 + percent} - ({rest}), 1)"


def by_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Sort keys of the further orders: a bijection of the hashes."""
    return X.mix(values ^ np.uint64((k * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))


def _prefix(keys: np.ndarray, percent: int) -> np.ndarray:
    """Which of the shingles with these sort keys are the prefix; all of a tie at its end."""
    k = prefix_size(len(keys), percent)
    return keys <= np.partition(keys, k - 1)[k - 1] if k < len(keys) else np.ones(len(keys), bool)


def _class_of(values: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    with np.errstate(over="ignore"):
        x = X.mix(values ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + X.mix(np.array([len(values)], np.uint64))[0]
        y = np.bitwise_xor.reduce(X.mix(values + np.uint64(0x6A09E667F3BCC909)))
        return int(X.mix(np.array([x ^ X.mix(np.array([y], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def _lists(parts: list[np.ndarray], gone: np.ndarray | None = None) -> pa.Array:
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)), mask=None if gone is None else pa.array(gone))


def _doc_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """By slices of (doc_id, text): first row, shingle sets, places of the sets that aren't empty, and their classes."""
    for i, value, offs in _shingles(batch, 1):
        sets = [np.unique(value[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        full = np.array([k for k, v in enumerate(sets) if len(v)], np.int64)
        yield i, sets, full, np.array([_class_of(sets[k]) for k in full], np.int64)


def _prefixed(docs: DataFrame, sketch, percent: int) -> DataFrame:
    """(doc_id, n, cls, p1, hot) of (doc_id, text); cls is null where there are no words.

    p1 is the first order's prefix without its hottest shingles, and hot is these.  Within a task they
    stand with one document of a class; its copies have nulls.
    """

    hottest = int(STEPS * np.log2(HOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        nothing = np.zeros(0, np.uint64)
        for batch in batches:
            for i, sets, full, cls in _doc_sets(batch):
                names: list = [None] * len(sets)
                first, hot = [nothing] * len(sets), [nothing] * len(sets)
                new = np.zeros(len(sets), bool)
                for k, c in zip(full, cls.tolist(), strict=True):
                    names[k] = c
                    if c in seen:
                        continue
                    seen.add(c)
                    new[k] = True
                    often = counts[sets[k] & np.uint64(SKETCH - 1)]
                    inside = _prefix((often.astype(np.uint64) << np.uint64(32)) | (sets[k] >> np.uint64(32)), percent)
                    first[k], hot[k] = sets[k][inside & (often < hottest)], sets[k][inside & (often >= hottest)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(sets)), pa.array([len(v) for v in sets], pa.int64()), pa.array(names, pa.int64()), _lists(first, gone=~new), _lists(hot, gone=~new)],
                    names=["doc_id", "n", "cls", "p1", "hot"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, cls long, p1 array<long>, hot array<long>")


def _sets(docs: DataFrame, wanted, percent: int) -> DataFrame:
    """(cls, p2, p3, s) of the wanted (doc_id, text), and of some others: two further prefixes, as sort keys, and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            some = _inside(bits, X.mix(_long(batch.column(0)).view(np.uint64)))
            for _, sets, full, cls in _doc_sets(batch.filter(pa.array(some))):
                rows = [sets[k] for k in full]
                cols = [pa.array(cls)]
                for k in (2, 3):
                    cols.append(_lists([np.sort(by_hash(v, k))[: prefix_size(len(v), percent)] for v in rows]))
                yield pa.RecordBatch.from_arrays([*cols, _lists(rows)], names=["cls", "p2", "p3", "s"])

    return docs.mapInArrow(run, "cls long, p2 array<long>, p3 array<long>, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, least) of classes whose prefixes share ``least`` under the other orders too, and that link."""

    def side(x: str, *columns: str) -> DataFrame:
        return sets.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}{x}") for c in columns])

    near = pairs.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b")
    for k in (2, 3):
        near = near.where(F.size(F.array_intersect(f"p{k}a", f"p{k}b")) >= F.col("least"))
    near = near.select("a", "b")
    both = near.join(side("a", "s"), "a").join(side("b", "s"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _forest(cls: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (i, j) connect: a node and its smallest place."""
    root = np.arange(len(cls))
    while True:
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            break
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
    some = np.flatnonzero(root != np.arange(len(root)))
    return cls[some], cls[root[some]]


def _overlaps(lists: pa.ListArray) -> np.ndarray:
    """How many values each two of the lists share, above the diagonal; the values of a list are distinct."""
    n = np.diff(lists.offsets.to_numpy())
    rows = len(n)
    token, of = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1], np.repeat(np.arange(rows), n)
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    often = np.bincount(token)[token]
    shared = np.zeros((rows, rows), np.float32)
    # values that many lists hold: products of 0/1 columns
    many = often > max(8, rows // 8)
    column, at = np.unique(token[many], return_inverse=True)[1], of[many]
    for k in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [k, k + COLUMNS])
        held = np.zeros((rows, COLUMNS), np.float32)
        held[at[i:j], column[i:j] - k] = 1
        shared += held @ held.T
    # the others: one count for each two lists that hold a value
    few = ~many & (often > 1)
    token, of = token[few], of[few]
    if len(token):
        last = np.searchsorted(token, token, side="right")
        left = last - np.arange(len(token)) - 1
        flat, done = shared.reshape(-1), np.cumsum(left)
        i = 0
        while i < len(token):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS)))
            np.add.at(flat, np.repeat(of[i:j] * rows, left[i:j]) + of[X.ragged(np.arange(i, j) + 1, left[i:j])], np.float32(1))
            i = j
    return np.triu(shared, 1)


def _unit_links(unit: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the classes of one unit (group, a, b, side, cls, m, p2, p3, s) that link; each pair in one unit only.

    A pair has to pass the size filter and share enough of the second and of the third prefixes before its sets count.
    """
    a, b, side = (unit.column(k).to_numpy() for k in range(1, 4))
    sets = unit.column(8)
    size = np.diff(sets.offsets.to_numpy()).astype(np.int32)
    one, two = size[:, None], size[None, :]
    near = 100 * np.minimum(one, two) >= percent * np.maximum(one, two)
    if a[0] != b[0]:
        near &= side[:, None] != side[None, :]
    least = needed(one, two, percent)
    for k in (6, 7):
        near &= _overlaps(unit.column(k)) >= least
        if not near.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = _overlaps(sets)
    return np.nonzero(near & (100 * shared >= percent * ((one + two) - shared)))


def _in_groups(group: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What the units of (cls, group) find: rows (a, b, null), links that span what is linked, and (a, null, add).

    add is the number of documents of other classes that class a links with in one unit.  A group's
    classes are dealt to blocks by hash, and each pair of blocks is a unit, so no task holds a group.
    """
    member = group.join(classes.select("cls", "n", "m"), "cls")
    fill = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)
    blocks = member.groupBy("group").agg(F.ceil(fill).cast("int").alias("blocks"))
    unit = member.join(blocks, "group").withColumn("k", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = unit.select("cls", "m", "group", F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b"), (F.col("k") > F.col("o")).cast("int").alias("side"))
    full = unit.join(sets, "cls").select("group", "a", "b", "side", "cls", "m", "p2", "p3", "s")
    dealt = full.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 3):
            if unit.num_rows < 2:
                continue
            cls, m = unit.column(4).to_numpy(), unit.column(5).to_numpy()
            i, j = _unit_links(unit, percent)
            if not len(i):
                continue
            add = np.bincount(i, weights=m[j], minlength=len(cls)) + np.bincount(j, weights=m[i], minlength=len(cls))
            some = np.flatnonzero(add)
            a, b = _forest(cls, i, j)
            rows = [pa.array(np.concatenate([a, cls[some]])), pa.array([*b.tolist(), *[None] * len(some)], pa.int64()), pa.array([*[None] * len(a), *add[some].astype(np.int64).tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["a", "b", "add"])

    return dealt.mapInArrow(run, "a long, b long, add long")


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in their first ``keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in range(keys)):
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Join (doc_id, text) with itself on shingle similarity.

    Returns a row per document (doc_id, n, cls), a row per class (cls, n, m, doc_id, root, component_id, n_links),
    and verified pairs of classes (a, b).  A class is a shingle set, m its documents, doc_id their smallest,
    component_id the smallest that links reach, and n_links the number of other documents that each of its documents
    links with, equal sets included.  Documents without words have a null cls.  The pairs connect each component;
    they are all links but those inside groups, which are counted where they are found.
    Null and repeated doc_ids are kept as they are; a null one is never a smallest.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    bounded_batches(spark)
    share = spark.sparkContext.broadcast
    sketch = share(frequency_sketch(docs.select("text")))
    rows = scratch.staged(_prefixed(docs, sketch, percent))
    table = staged(rows.select("doc_id", "n", "cls"))
    numbers = [F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("m")]
    classes = scratch.staged(rows.where("cls IS NOT NULL").groupBy("cls").agg(*numbers, F.first("p1", True).alias("p1"), F.first("hot", True).alias("hot")))

    counted = classes.select("cls", "n", F.explode("p1").alias("token")).withColumn("l", F.count("*").over(Window.partitionBy("token")))
    shared = scratch.staged(counted.where("l > 1"))
    heavy = shared.where(F.col("l") > HEAVY).select("token", "cls").unionByName(classes.select(F.explode("hot").alias("token"), "cls"))
    hub = heavy.groupBy("token").agg(F.min("cls").alias("hub"))
    steps = scratch.staged(heavy.join(hub, "token").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct())
    group = components(steps).select(F.col("node").alias("cls"), F.col("root").alias("group"))

    light = shared.where(F.col("l") <= HEAVY).join(group, "cls", "left").select("token", "cls", "n", "group")
    one, two = (light.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "group")]) for x in "ab")
    fits = f"cls_a < cls_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND coalesce(group_a <> group_b, true)"
    # two classes of different groups share no long list, so the short ones count all that their prefixes share
    least = F.expr(needed_sql("n_a", "n_b", percent)).alias("least")
    pairs = one.join(two, "token").where(fits).groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), least).count()
    pairs = scratch.staged(pairs.where("count >= least").select("a", "b", "least"))

    named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(group.select("cls")).distinct()
    wanted = share(wanted_filter(classes.join(named, "cls").select("doc_id")))
    sets = scratch.staged(_sets(docs, wanted, percent).dropDuplicates(["cls"]))
    alone = _verified(pairs, sets, percent).select("a", "b", F.lit(None).cast("long").alias("add"), F.lit(True).alias("whole"))
    found = staged(alone.unionByName(_in_groups(group, classes, sets, percent).withColumn("whole", F.lit(False))))
    links = found.where("b IS NOT NULL").select("a", "b").distinct()
    roots = components(links)

    size = classes.select(F.col("cls").alias("b"), F.col("m").alias("add"))
    ends = found.where("whole").select("a", "b").unionByName(found.where("whole").select(F.col("b").alias("a"), F.col("a").alias("b")))
    add = ends.join(size, "b").select("a", "add").unionByName(found.where("add IS NOT NULL").select("a", "add")).groupBy("a").agg(F.sum("add").alias("add"))
    named = classes.join(roots, classes["cls"] == roots["node"], "left").join(add, classes["cls"] == add["a"], "left")
    named = named.select("cls", "n", "m", "doc_id", F.coalesce("root", "cls").alias("root"), (F.col("m") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = staged(named.join(least, "root").select("cls", "n", "m", "doc_id", "root", "component_id", "n_links"))
    scratch.clear()
    for b in (sketch, wanted):
        b.destroy()
    return table, out, links


def with_components(table: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; one without words is its own, with no links."""
    own = classes.select("cls", "component_id", "n_links")
    return table.join(own, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, classes, _ = jaccard_classes(documents(spark, sf_dir).select("doc_id", "text"))
    return with_components(table, classes)


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that link with others, and with how many."""
    return op5_jaccard_join(spark, sf_dir).where("n_links > 0").select("doc_id", "component_id", "n_links")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Of its rows that repeat that doc_id, the one with the smallest text stays; a
    component whose doc_ids are all null keeps one row likewise.  Documents
    without words all stay.
    """
    rows, unpacked = packed(docs, "doc_id", "text")
    table, classes, _ = jaccard_classes(rows.select("doc_id", "text"))
    marked = table.join(classes.select("cls", "root", "component_id"), "cls", "left")
    keep = staged(marked.where("cls IS NULL OR doc_id <=> component_id").select("doc_id", "cls", "root"))
    ids = keep.where("doc_id IS NOT NULL").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    several = table.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = rows.join(ids, "doc_id", "left_semi").select(*rows.columns)
    if several.isEmpty() and keep.where("doc_id IS NULL").isEmpty():
        return unpacked(kept)
    return unpacked(_one_each(_with_class(kept.unionByName(rows.where("doc_id IS NULL"))), keep, rows.columns))


def _with_class(docs: DataFrame) -> DataFrame:
    """``docs`` with the class of each row's own text as __cls; null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            two = pa.RecordBatch.from_arrays([batch.column(text)] * 2, names=["x", "text"])
            for i, sets, full, cls in _doc_sets(two):
                own: list = [None] * len(sets)
                for k, c in zip(full, cls.tolist(), strict=True):
                    own[k] = c
                part = batch.slice(i, len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "__cls"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__cls", T.LongType())]))


def _one_each(rows: DataFrame, keep: DataFrame, names: list[str]) -> DataFrame:
    """Of the rows with their own class: one of each root that ``keep`` names by (doc_id, cls); all rows without words.

    The one is a smallest row by text, found by partial aggregates, so many rows of one root don't meet in a task.
    """
    rows = staged(rows)
    named = keep.where("cls IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("cls").alias("__of"), "root").distinct().withColumnRenamed("root", "__root")
    worded = rows.where("__cls IS NOT NULL").join(named, (F.col("__cls") == F.col("__of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    first = F.min(F.struct("text", *[n for n in names if n != "text"])).alias("__row")
    one = worded.groupBy("__root").agg(first).select(*[F.col("__row").getField(n).alias(n) for n in names])
    return one.unionByName(rows.where("__cls IS NULL").select(*names))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)
), k AS (SELECT a AS doc_id, count(*) AS k FROM l GROUP BY a
), r(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id, coalesce(any_value(k.k), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

LINKS_SQL = f"SELECT doc_id, component_id, n_links FROM ({OP5_SQL}) WHERE n_links > 0"
