"""Spelling variants by bands of letter-parity masks.

A word's mask has a bit for each letter that it holds an odd number of times.
One inserted or deleted code point flips one bit and one replaced code point at
most two, so of three bands of the mask at least one stays the same.  Words of
equal length, or of lengths that differ by one, are joined on an equal band and
verified.

One value of a band is shared by ever more words as a vocabulary grows.  So the
join's key also has a half of the word: an edit leaves the first or the second
half of the shorter word as it was.  A pair meets under up to six keys and is
taken under the first of them, so nothing has to be made distinct.

Null texts have no words.  Words and their counts are those of the whole table;
ties between forms go to the smallest word in code-point order.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.common import Scratch, bounded_batches, documents

#: Code points of a word and occurrences in the table, at least; how much more frequent a form is; and the share of planted typos.
LEAST_LENGTH, LEAST_COUNT, TIMES, TYPO = 7, 2, 10, 31
#: Words that a task counts before it passes its counts on; only memory depends on it.
HELD_WORDS = 200_000
#: Bits of the mask: a to z have their own, the further letters share the others.
LETTERS, BITS, BANDS = 26, 62, 3

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def _counted(runs: list[str], typo: str | None) -> Iterator[tuple[str, int]]:
    """The words of one document; with a typo key, runs that its checksum picks lose a code point."""
    if typo is None:
        yield from Counter(runs).items()
        return
    start = zlib.crc32(f"{typo}:".encode())
    for w, n in Counter(runs).items():
        h = zlib.crc32(w.encode(), start)
        if h % TYPO == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        if len(w) >= LEAST_LENGTH:
            yield w, n


def word_counts(docs: DataFrame, text: str = "text", typos: str | None = None) -> DataFrame:
    """(word, n) of all words that occur often enough; ``typos`` names the key column of planted typos (null: empty)."""
    bounded_batches(docs.sparkSession)
    key = F.coalesce(F.col(f"`{typos}`").cast("string"), F.lit("")) if typos else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            data, offsets = X.flat(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in X.slices(offsets):
                part = X._LOWER[data[offsets[i] : offsets[j]]].tobytes()
                for k in range(i, j):
                    runs = _RUN.findall(part[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]].decode("utf-8", "replace"))
                    if runs:
                        for w, n in _counted(runs, keys[k]):
                            total[w] += n
                if len(total) > HELD_WORDS:
                    yield out()
        if total:
            yield out()

    rows = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def parity_mask(word: Column) -> Column:
    """A bit for each letter of odd number; letters outside a to z share bits, which flips fewer of them and never more."""

    def bit(c: Column) -> Column:
        code = F.ascii(c)
        place = F.when(code < 128, code - ord("a")).otherwise(LETTERS + (code - 0xC0) % (BITS - LETTERS))
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.when(c != "", bit(c)).otherwise(F.lit(0).cast("long"))))


def _band(mask: str, k: int) -> Column:
    """Every third bit: common and rare letters are dealt to all bands."""
    return F.col(mask).bitwiseAND(F.lit(sum(1 << b for b in range(k, BITS, BANDS))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word_a, n_a, word_b, n_b) of all pairs that differ by one inserted, deleted or replaced code point, each once.

    ``words`` has one row per word.  The shorter word is a; of two equally long ones, the smaller.
    """
    masked = words.withColumn("mask", parity_mask(F.col("word"))).withColumn("length", F.length("word"))
    # every word is the shorter one of a class of its length, and the longer one of the class below
    roles = masked.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", F.col("length") - F.col("more"))
    half = F.floor(F.col("m") / 2).cast("int")
    roles = roles.withColumn("head", F.expr("substring(word, 1, cast(m div 2 as int))")).withColumn("tail", F.expr("right(word, cast(m - m div 2 as int))"))
    keys = [F.struct(F.lit(s).alias("side"), F.lit(k).alias("band"), F.xxhash64("m", F.lit(s), F.col(side), F.lit(k), _band("mask", k)).alias("key")) for s, side in enumerate(("head", "tail")) for k in range(BANDS)]
    keyed = roles.select("word", "n", "mask", "more", "m", "head", "tail", F.explode(F.array(*keys)).alias("k")).select("k.*", "word", "n", "mask", "more", "m", "head", "tail")

    def renamed(df: DataFrame, x: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "key"])

    both = renamed(keyed.where("more = 0"), "a").join(renamed(keyed, "b"), "key")
    # equal keys of other classes, halves or bands are chance and fall here
    same = "m_a = m_b AND side_a = side_b AND band_a = band_b AND (more_b = 1 OR word_a < word_b)"
    both = both.where(same).where("CASE WHEN side_a = 0 THEN head_a = head_b ELSE tail_a = tail_b AND head_a <> head_b END")
    xor = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    first = F.lit(BANDS - 1)
    for k in reversed(range(BANDS)):
        first = F.when(xor.bitwiseAND(F.lit(sum(1 << b for b in range(k, BITS, BANDS)))) == 0, F.lit(k)).otherwise(first)
    both = both.where(F.col("band_a") == first).where(F.bit_count(xor) <= 2)
    return both.where(F.expr("levenshtein(word_a, word_b, 1) = 1")).select("word_a", "n_a", "word_b", "n_b")


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n).

    A form has ``times`` the word's occurrences, so a chain of forms has as many steps as the largest count has
    digits, and following them takes that number's logarithm in joins.  A word has a bounded number of near
    words (its letters times the alphabet), so no key of these joins is hot.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.staged(words.select("word", "n"))
    pairs = scratch.staged(near_pairs(words))
    near = pairs.select(F.col("word_a").alias("word"), F.col("n_b").alias("by"), F.col("word_b").alias("other"))
    near = near.unionByName(pairs.select(F.col("word_b").alias("word"), F.col("n_a").alias("by"), F.col("word_a").alias("other")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("by")).alias("less"), "other")).alias("best"))
    table = words.join(best, "word", "left")
    has = -F.col("best.less") >= times * F.col("n")
    table = table.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    table = scratch.staged(table)
    chain = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = table.agg(F.max("form_n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, times)))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        chain = scratch.staged(chain.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
    out = scratch.staged(table.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word")))
    scratch.paths.pop()
    scratch.clear()
    return out


def op12_letter_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(documents(spark, sf_dir).select("doc_id", "text"), typos="doc_id")
    return spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text of code points below U+0100."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + (unicode(ch) & 63))::BIGINT] END))"
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, (y & 1) * 3988292384), xor(c, b))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP12_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents
), r AS (
  SELECT id, w, count(*) AS n FROM w WHERE length(w) >= 7 GROUP BY ALL
), h AS (
  SELECT w, n, {crc32_sql("id || ':' || w")} AS h FROM r
), t AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), e AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v)
), p AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, v.word FROM e JOIN v ON e.rest = v.word
  UNION SELECT v.word, e.word FROM e JOIN v ON e.rest = v.word
), b AS (
  SELECT p.a AS word, count(*) AS n_near, max(v.n) AS top FROM p JOIN v ON v.word = p.b GROUP BY p.a
), f AS (
  SELECT b.word, min(p.b) AS form, any_value(b.top) AS form_n FROM b JOIN v ON v.word = b.word JOIN p ON p.a = b.word JOIN v o ON o.word = p.b AND o.n = b.top
  WHERE b.top >= 10 * v.n GROUP BY b.word
), c(word, root, k) AS (
  SELECT word, word, 0 FROM v
  UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.root
)
SELECT v.word, f.form, c.root, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM v LEFT JOIN f USING (word) LEFT JOIN b USING (word) JOIN (SELECT word, arg_max(root, k) AS root FROM c GROUP BY word) c USING (word)
"""
