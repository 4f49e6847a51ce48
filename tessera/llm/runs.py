"""Periodic runs of words by Main-Lorentz divide and conquer on interned ids.

A run is a stretch of words with smallest period q, at least max(6, 4 q) long,
that no neighbouring word extends.

Every word of a run, and every five words in a row of it, occur again within
the run.  So only stretches whose five-word windows all occur twice in their
text (regions) can hold one, and only these are searched:

* A region is halved until its parts are too short.  A run lies wholly in the
  last part that its words don't leave, and crosses that part's midpoint, with two
  periods or more on one side of it.  All parts of a level are taken at once.
* On each side the candidates are the periods q whose square begins (or ends)
  at the midpoint: the Z-value at q is q or more.  Z-values are taken on
  64-bit names of word blocks of 1, 2, 4, ... words, so that a value costs a
  logarithm of its size and one comparison where the first words differ.
* The smallest candidate is extended to both sides as far as its period holds;
  multiples of it inside the same repetition are no smallest periods and leave.
  A midpoint has a logarithmic number of others.
* Intervals found at several midpoints are one; the smallest period stays.

Words and blocks are compared by 64-bit hashes, so equality is up to a chance
collision.  Null texts are empty; texts without words have no runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textops as X
from tessera.llm.common import bounded_batches, documents
from tessera.llm.spelling import crc32_sql

#: Words of a run at least, and periods that it has to hold.
LEAST, TIMES = 6, 4
WINDOW = 5
#: Words of regions searched at once, and the largest block with a name (as a power of two); only memory and time depend on them.
FLAT_WORDS, LARGEST = 400_000, 12

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Blocks:
    """Names of all blocks of 1, 2, 4, ... words of a flat array of word ids."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [X.mix(ids ^ np.uint64(0xD1B54A32D192ED03))]
        with np.errstate(over="ignore"):
            while len(self.names) <= LARGEST and 1 << len(self.names) <= longest:
                last, step = self.names[-1], 1 << (len(self.names) - 1)
                self.names.append(X.mix(last[:-step] * _A + X.mix(last[step:] + _B)))

    def ahead(self, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from a and from b (a < b) agree, b's before ``end``."""
        return self._common(a, b, end - b, 1)

    def behind(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words up to and with a and b (a < b) agree, a's from ``begin`` on."""
        return self._common(a, b, a - begin + 1, -1)

    def _common(self, a: np.ndarray, b: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
        out = np.zeros(len(a), np.int64)

        def step(at: np.ndarray, k: int) -> np.ndarray:
            """Those of ``at`` that agree for 2^k words more."""
            size = 1 << k
            at = at[out[at] + size <= room[at]]
            shift = out[at] if way > 0 else -out[at] - size + 1
            at = at[self.names[k][a[at] + shift] == self.names[k][b[at] + shift]]
            out[at] += size
            return at

        top = len(self.names) - 1
        at = np.arange(len(a))
        while len(at):
            at = step(at, top)
        for k in range(top - 1, -1, -1):
            step(np.arange(len(a)), k)
        return out

    def squares(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a and the n words from b are the same."""
        out = self.names[0][a] == self.names[0][b]
        level = np.minimum(np.frexp(n.astype(np.float64))[1] - 1, len(self.names) - 1)
        for k in np.unique(level[out]):
            size = 1 << int(k)
            at = np.flatnonzero(out & (level == k))
            last = n[at] - size
            done = np.zeros(len(at), np.int64)
            live = np.arange(len(at))
            # blocks side by side, the last one laid against the end
            while len(live):
                i, s = at[live], np.minimum(done[live], last[live])
                good = self.names[k][a[i] + s] == self.names[k][b[i] + s]
                out[i[~good]] = False
                done[live] += size
                live = live[good & (s < last[live])]
        return out


def _crossing(names: Blocks, lo: np.ndarray, hi: np.ndarray, mid: np.ndarray, begin: np.ndarray, end: np.ndarray, right: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and period of the runs with two periods right (or left) of the midpoints; begin and end bound the extension."""
    side = np.minimum((hi - lo) // TIMES, (hi - mid if right else mid - lo) // 2)
    of = np.repeat(np.arange(len(lo)), side)
    q = X.ragged(np.ones(len(lo), np.int64), side)
    first = mid[of] if right else mid[of] - 2 * q
    same = names.squares(first, first + q, q)
    of, q = of[same], q[same]
    found = []
    while len(of):
        head = np.concatenate([[True], of[1:] != of[:-1]])
        part, least = of[head], q[head]
        m = mid[part]
        a, b = (m, m + least) if right else (m - least, m)
        after = names.ahead(a, b, end[part])
        before = np.zeros(len(part), np.int64)
        some = a > begin[part]
        before[some] = names.behind(a[some] - 1, b[some] - 1, begin[part][some])
        found.append((a - before, b + after, least))
        # a multiple of a period that holds for two of its own lengths is no smallest period
        place = np.cumsum(head) - 1
        reach = (after + least if right else before + least)[place]
        stay = ~head & ~((q % least[place] == 0) & (2 * q <= reach))
        of, q = of[stay], q[stay]
    return found


def runs_of(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs inside the parts [begin, end) of a flat array, in order of start and period."""
    none = np.zeros(0, np.int64)
    names = Blocks(ids, int((end - begin).max(initial=1)))
    lo, hi, low, high = begin, end, begin, end
    found = [(none, none, none)]
    while len(lo):
        some = hi - lo >= LEAST
        lo, hi, low, high = lo[some], hi[some], low[some], high[some]
        mid = (lo + hi) // 2
        for right in (True, False):
            found += _crossing(names, lo, hi, mid, low, high, right)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        low, high = np.concatenate([low, low]), np.concatenate([high, high])
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    long = e - s >= np.maximum(LEAST, TIMES * q)
    s, e, q = s[long], e[long], q[long]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def regions(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches in which every window of five words occurs twice in its document ``of``."""
    none = np.zeros(0, np.int64)
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return none, none
    with np.errstate(over="ignore"):
        name = X.mix(of[:n].astype(np.uint64) + _B)
        for k in range(WINDOW):
            name = X.mix(name * _A + ids[k : k + n])
    inside = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
    name = name[inside]
    order = np.argsort(name)
    equal = np.flatnonzero(name[order][1:] == name[order][:-1])
    twice = np.zeros(n + 2, np.int8)
    twice[inside[order[equal]] + 1] = twice[inside[order[equal + 1]] + 1] = 1
    edge = np.diff(twice)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + WINDOW - 1
    long = end - begin >= LEAST
    return begin[long], end[long]


def document_runs(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of words with these ids (uint64) and documents (ascending); starts are places in ``ids``."""
    begin, end = regions(ids, of)
    sizes = end - begin
    found = [(np.zeros(0, np.int64),) * 3]
    for i, j in X.slices(np.concatenate([[0], np.cumsum(sizes)]), FLAT_WORDS):
        b, n = begin[i:j], sizes[i:j]
        flat = np.concatenate([[0], np.cumsum(n)])
        s, e, q = runs_of(ids[X.ragged(b, n)], flat[:-1], flat[1:])
        shift = (b - flat[:-1])[np.searchsorted(flat, s, side="right") - 1]
        found.append((s + shift, e + shift, q))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def planted(first: np.ndarray, counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of the word that stands at each place, where documents whose ``h`` is a multiple of ten are made periodic (h below 0: not)."""
    idx = np.arange(int(counts.sum()))
    for d in np.flatnonzero((h >= 0) & (h % 10 == 0) & (counts > 0)).tolist():
        n, g = int(counts[d]), int(h[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        idx[first[d] + a : first[d] + n] = first[d] + a + np.arange(n - a) % p
    return idx


NEW = [T.StructField("n_runs", T.LongType()), *[T.StructField(f, T.LongType()) for f in ("start", "length", "period")]]
LISTS = [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())]
DIGESTS = [T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]


def _slice_runs(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, digests: bool) -> list[pa.Array]:
    """The new columns of some documents."""
    n = len(offsets) - 1
    starts, ends, of = X.word_spans(data, offsets)
    counts = np.bincount(of, minlength=n).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    idx = planted(first, counts, h)
    starts, ends = starts[idx], ends[idx]
    s, e, q = document_runs(X.span_hashes(data, starts, ends, False), of)
    doc = of[s]
    size, at = e - s, s - first[doc]
    number = np.bincount(doc, minlength=n).astype(np.int64)
    # the first of each document by length, start and period
    order = np.lexsort((q, at, -size, doc))
    best = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
    cols = [pa.array(number)]
    for x in (at, size, q):
        value = np.zeros(n, np.int64)
        value[doc[best]] = x[best]
        cols.append(pa.array(value, mask=number == 0))
    step = np.zeros(len(of) + 1, np.int64)
    np.add.at(step, s + q, 1)
    np.add.at(step, e, -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    length = ends[kept] - starts[kept] + 1
    text = np.append(data, np.uint8(32))[X.ragged(starts[kept], length)]
    text[np.cumsum(length) - 1] = 32
    cut = np.concatenate([[0], np.cumsum(np.bincount(of[kept], weights=length, minlength=n))]).astype(np.int64)
    raw = memoryview(text.tobytes())
    parts = [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    edge = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
    if digests:
        lines = [b"%d,%d,%d\n" % x for x in zip(at.tolist(), size.tolist(), q.tolist(), strict=True)]
        cols.append(pa.array([hashlib.sha256(b"".join(lines[a:b])).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string()))
        cols.append(pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()))
    else:
        rows = pa.StructArray.from_arrays([pa.array(x) for x in (at, size, q)], names=["start", "length", "period"])
        cols.append(pa.ListArray.from_arrays(pa.array(edge), rows))
        cols.append(pa.array([bytes(p).decode("utf-8", "replace") for p in parts], pa.string()))
    return cols


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, plant: Column | None = None, digests: bool = False) -> DataFrame:
    """A row per row of ``docs``: ``doc`` (a struct of its columns, or of those to ``keep``), n_runs, and start, length and period of the longest run.

    Besides ``runs`` (all of them, by start) and ``collapsed`` (each run's first period alone, words joined by one
    space), or the digests of both.  ``plant`` is a number that makes some documents periodic, as ``planted`` says; null: not.
    """
    bounded_batches(docs.sparkSession)
    h = F.coalesce(plant, F.lit(-1)).cast("long") if plant is not None else F.lit(-1).cast("long")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col(f"`{text}`").alias("text"), h.alias("h"))
    new = NEW + (DIGESTS if digests else LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.flat(batch.column(1))
            h = pc.cast(batch.column(2), pa.int64()).to_numpy(zero_copy_only=False)
            for i, j in X.slices(offsets):
                cols = _slice_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], h[i:j], digests)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], names=["doc", *[f.name for f in new]])

    return source.mapInArrow(run, T.StructType([source.schema["doc"], *new]))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # the id alone is kept: texts don't come back from the workers
    found = find_runs(docs, keep=["doc_id"], plant=F.crc32(F.col("doc_id").cast("string")), digests=True)
    milli = F.expr("1000 * length div period")
    return found.select("doc.doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents
), g AS (
  SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), p AS (
  SELECT r, doc_id, w, n, a, 1 + (n - a) // (3 + g % 8) AS p, coalesce(h % 10 = 0, false) AND n > 0 AS planted FROM g
), w AS (
  SELECT r, i, w[(CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1)::INT] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM p)
), m AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i JOIN p ON p.r = x.r WHERE 4 * (y.i - x.i) <= p.n
), k AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m
), s AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), u AS (
  SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length
), t AS (
  SELECT r, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u
), c AS (
  SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone ON gone.r = w.r AND gone.i = w.i GROUP BY w.r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN t USING (r) LEFT JOIN c USING (r)
"""
