"""Quality rules as a short-circuit cascade.

Every rule is a predicate over whole texts.  On a sample each rule's cost
(seconds a document) and selectivity (share rejected) are measured, and the
cascade runs the rules by rejection per cost; a later rule sees only the
documents that all earlier ones passed.  A verdict is the conjunction of all
rules, so the order changes the cost and never the result.

Null and empty texts count as texts without words and fail ``min_words``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textops as X
from tessera.llm.common import bounded_batches, documents, free_name, packed

MIN_WORDS, REPEAT_SHARE = 10, 20
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 400

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Texts:
    """A run of documents with what several rules need, computed when asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._words = None

    def only(self, keep: np.ndarray) -> Texts:
        if keep.all():
            return self
        lengths = np.diff(self.offsets)[keep]
        return Texts(self.data[X.ragged(self.offsets[:-1][keep], lengths)], np.concatenate([[0], np.cumsum(lengths)]))

    @property
    def words(self):
        if self._words is None:
            self._words = X.word_spans(self.data, self.offsets)
        return self._words

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def n_words(t: Texts) -> np.ndarray:
    return np.bincount(t.words[2], minlength=t.n).astype(np.int64)


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words."""
    ink = ~X._SPACE[t.data]
    return t.per_doc(ink & ((t.data & 0xC0) != 0x80))


def n_symbols(t: Texts) -> np.ndarray:
    return t.per_doc(_SYMBOL[t.data])


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the lines that hold a word."""
    starts, _, _ = t.words
    cut = np.flatnonzero(t.data == 10)
    begin = np.unique(np.concatenate([t.offsets[:-1][np.diff(t.offsets) > 0], cut + 1])) if t.n else np.zeros(0, np.int64)
    begin = begin[begin < len(t.data)]
    of = np.searchsorted(t.offsets, begin, side="right") - 1
    cut = np.append(cut, len(t.data))
    end = np.minimum(cut[np.searchsorted(cut, begin, side="left")], t.offsets[of + 1])
    has = np.searchsorted(starts, end, side="left") > np.searchsorted(starts, begin, side="left")
    return begin[has], end[has], of[has]


def line_counts(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line."""
    begin, end, of = _lines(t)
    lines = np.bincount(of, minlength=t.n).astype(np.int64)
    _, offs = X.per_doc_distinct(X.span_hashes(t.data, begin, end, False), of, t.n)
    return lines, lines - np.diff(offs)


def n_repeat_words(t: Texts, width: int = 5) -> np.ndarray:
    """Words inside a window of ``width`` words that the text holds twice or more."""
    starts, ends, of = t.words
    hashes = X.span_hashes(t.data, starts, ends, False)
    n = len(hashes) - width + 1
    out = np.zeros(t.n, np.int64)
    if n <= 0:
        return out
    value, _ = X.windows(hashes, of, t.n, width, False)
    whole = np.flatnonzero(of[:n] == of[width - 1 :])
    with np.errstate(over="ignore"):
        value = value + X.mix(of[whole].astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    same = np.zeros(len(ranked), dtype=bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    step = np.zeros(len(hashes) + 1, np.int64)
    at = whole[order[same]]
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.bincount(of[np.cumsum(step[:-1]) > 0], minlength=t.n).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """``bad`` marks the documents that the rule rejects."""

    name: str
    bad: Callable[[Texts], np.ndarray]


def _shouts(t: Texts) -> np.ndarray:
    upper = t.per_doc((t.data >= 65) & (t.data <= 90))
    lower = t.per_doc((t.data >= 97) & (t.data <= 122))
    return 100 * upper > 50 * (upper + lower)


def _dup_lines(t: Texts) -> np.ndarray:
    lines, dups = line_counts(t)
    return 100 * dups > 50 * lines


def _word_length(t: Texts) -> np.ndarray:
    words, chars = n_words(t), word_chars(t)
    return (chars < 2 * words) | (chars > 20 * words)


#: Limits are in percent of words, letters or lines.
RULES = (
    Rule("min_words", lambda t: n_words(t) < MIN_WORDS),
    Rule("repeats", lambda t: 100 * n_repeat_words(t) > REPEAT_SHARE * n_words(t)),
    Rule("symbols", lambda t: 100 * n_symbols(t) > 20 * n_words(t)),
    Rule("shouting", _shouts),
    Rule("dup_lines", _dup_lines),
    Rule("word_length", _word_length),
)


def plan(sample: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """Cost, selectivity and rank of each rule on sampled texts, in running order."""
    data, offsets = X.flat(sample)
    n = max(1, len(offsets) - 1)
    found = []
    for rule in rules:
        t = Texts(data, offsets)
        began = time.perf_counter()
        bad = rule.bad(t)
        cost = (time.perf_counter() - began) / n
        share = float(bad.sum()) / n
        found.append({"rule": rule.name, "cost": cost, "rejects": share, "rank": share / max(cost, 1e-9)})
    return sorted(found, key=lambda x: (-x["rank"], x["cost"], x["rule"]))


def cascade(t: Texts, order: list[str], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """True for the documents that every rule passes; rejected ones leave the run at once."""
    by = {r.name: r for r in rules}
    alive = np.arange(t.n)
    for name in order:
        if not len(alive):
            break
        bad = by[name].bad(t)
        if bad.any():
            t, alive = t.only(~bad), alive[~bad]
    kept = np.zeros(int(alive.max()) + 1 if len(alive) else 0, dtype=bool)
    kept[alive] = True
    return kept


def _verdicts(t: Texts, order: list[str]) -> np.ndarray:
    kept = cascade(t, order)
    return np.concatenate([kept, np.zeros(t.n - len(kept), dtype=bool)])


def sampled_order(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """The cascade's order from ``rows`` whole texts, the first by hash of the text.

    The order changes what a rejection costs and never a verdict.
    """
    hashed = docs.select(F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").withColumn("h", F.xxhash64("t"))
    # the hashes alone are ranked, so tasks send no texts but the chosen ones
    least = hashed.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= least).groupBy("h").agg(F.min("t").alias("t")).collect() if least is not None else []
    return [x["rule"] for x in plan(pa.array([r["t"] for r in sample], pa.string()))]


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, text: str = "text", order: list[str] | None = None, features: bool = True) -> DataFrame:
    """``docs`` with the column ``kept`` and, if asked, the base counts of every text.

    Columns of ``docs`` by the names of the new ones are replaced.
    """
    order = order or sampled_order(docs, text)
    bounded_batches(docs.sparkSession)
    new = [T.StructField(f, T.LongType()) for f in FEATURES] * features
    new += [T.StructField("base_failed", T.BooleanType())] * features + [T.StructField("kept", T.BooleanType())]
    names = {f.name for f in new}
    base = [f for f in docs.schema.fields if f.name not in names]
    source = docs.select(*[F.col(f"`{f.name}`") for f in base])
    column = text
    if text in names:
        column = free_name(docs, "text_")
        source = docs.select(*[F.col(f"`{f.name}`") for f in base], F.col(f"`{text}`").alias(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.flat(batch.column(batch.schema.get_field_index(column)))
            parts: list[list[np.ndarray]] = []
            for i, j in X.slices(offsets):
                t = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kept = _verdicts(t, order)
                if features:
                    words, repeats = n_words(t), n_repeat_words(t)
                    failed = (words < MIN_WORDS) | (100 * repeats > REPEAT_SHARE * words)
                    parts.append([words, word_chars(t), n_symbols(t), line_counts(t)[1], repeats, failed, kept & ~failed])
                else:
                    parts.append([kept])
            if parts:
                cols = [batch.column(k) for k in range(len(base))]
                cols += [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in base] + [f.name for f in new])

    return source.mapInArrow(run, T.StructType(base + new))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    order = sampled_order(docs)
    return score_quality(docs, order=order).drop("text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule passes, with their own columns."""
    rows, unpacked = packed(docs, "doc_id", "text")
    return unpacked(score_quality(rows, features=False).where("kept"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM pos WHERE i + 4 <= len(w)
), rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE c >= 2 GROUP BY doc_id
), ln AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dl AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN dl ON d.doc_id = dl.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words
    OR 100 * n_upper > 50 * (n_upper + n_lower) OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""
