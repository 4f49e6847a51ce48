"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

The kernel of order 3 counts the common subsequences of three characters of two
words, each occurrence weighted by decay ** (characters that it spans), and is
normalised by the words' own kernels.  So a word with inserted or left-out
characters stays close to the insult that it hides.  A unit is a word without
ASCII punctuation, or a run of single characters ("i d i o t") joined; units of
over 24 characters are taken in windows of 24, every 3 characters, so what
stretches over up to 22 characters is whole in one.  A sentence scores as its
worst unit, and a text as its worst sentence.

Training is multiple-instance: every unit of a clean text is clean, and the
witness of a toxic text is the unit of it that toxic texts hold most, and far
more often than clean ones do; a toxic text without one takes no part.  After each fit, the worst-scored clean units
join it.  Landmarks are the commonest witnesses and the commonest clean units;
kernel values against them, whitened (Nyström), feed a linear squared-hinge
SVM, solved by Newton steps.  As the decision is linear in the landmarks'
kernels, it folds into one weight per character triple, which is what the tasks
evaluate.  A logistic curve through the training texts turns decisions into
scores.

The fit uses labelled texts of each label in hash order of doc_id: at most
TRAIN_DOCS, and none after the one with which TRAIN_CHARS characters are
reached.  Only documents that are there count; a doc_id that stands in several
rows takes part once, with the shortest text.  Scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm import textops as X
from tessera.llm.common import bounded_batches, bucket_of, documents, free_name, packed

TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000_000
LANDMARKS, COMMON = 160, 40
DECAY, WINDOW, STEP = 0.6, 24, 3
#: Fits, each with the last one's worst errors added to the clean units.
ROUNDS = 3
THRESHOLD = 0.7
CODES = 40

_DROP = np.zeros(128, bool)
_DROP[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _codes(points: np.ndarray) -> np.ndarray:
    """Letters a-z are 1 to 26, digits 27, other characters 28 to 39 by remainder."""
    p = points.astype(np.int64)
    p = np.where(((p >= 65) & (p <= 90)) | ((p >= 192) & (p <= 222)), p + 32, p)
    return np.where((p >= 97) & (p <= 122), p - 96, np.where((p >= 48) & (p <= 57), 27, 28 + p % 12)).astype(np.int16)


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units as rows of codes (0 pads), and the pairs (unit, document) without repeats."""
    n_docs = len(offsets) - 1
    keep = np.ones(len(data), bool)
    low = data < 128
    keep[low] = ~_DROP[data[low]]
    lengths = np.add.reduceat(np.append(keep, 0), offsets[:-1])[:n_docs] * (np.diff(offsets) > 0) if n_docs else np.zeros(0, np.int64)
    data, offsets = data[keep], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    starts, ends, docs = X.word_spans(data, offsets)
    head = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(head)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    code = _codes(points)
    a, n = at[starts], at[ends] - at[starts]
    # single characters in a row, three at least: their codes, one after the other
    lone = n == 1
    first = lone & np.concatenate([[True], ~lone[:-1] | (docs[1:] != docs[:-1])]) if len(n) else lone
    run = np.cumsum(first) - 1
    extra_code, extra_a, extra_n, extra_doc = np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lone.any():
        size = np.bincount(run[lone])
        good = size >= 3
        pick = lone & good[np.maximum(run, 0)]
        extra_code = code[a[pick]]
        extra_n = size[good]
        extra_a = len(code) + (np.cumsum(extra_n) - extra_n).astype(np.int64)
        extra_doc = docs[first][good]
    code = np.concatenate([code, extra_code])
    a, n, docs = np.concatenate([a, extra_a]), np.concatenate([n, extra_n]), np.concatenate([docs, extra_doc])
    long = n > WINDOW
    if long.any():
        count = 1 + -(-(n[long] - WINDOW) // STEP)
        k = X.ragged(np.zeros(len(count), np.int64), count)
        base_a, base_n = np.repeat(a[long], count), np.repeat(n[long], count)
        begin = np.minimum(base_a + k * STEP, base_a + base_n - WINDOW)
        a, n, docs = np.concatenate([a[~long], begin]), np.concatenate([n[~long], np.full(len(begin), WINDOW)]), np.concatenate([docs[~long], np.repeat(docs[long], count)])
    if not len(a):
        return np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = X.span_hashes((code & 0xFF).astype(np.uint8), a, a + n, False)
    _, where, unit = np.unique(hashes, return_index=True, return_inverse=True)
    rows = np.zeros((len(where), WINDOW), np.int16)
    spread = X.ragged(a[where], n[where])
    rows[np.repeat(np.arange(len(where)), n[where]), X.ragged(np.zeros(len(where), np.int64), n[where])] = code[spread]
    pair = np.unique(docs * np.int64(len(where)) + unit)
    return rows, pair % len(where), pair // len(where)


def kernel(a: np.ndarray, b: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of order 3 of row i of ``a`` with row i of ``b``, by the usual recursion."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    prime = np.ones((n, la + 1, lb + 1), np.float32)
    for _ in range(2):
        nxt = np.zeros((n, la + 1, lb + 1), np.float32)
        for i in range(1, la + 1):
            row = np.zeros(n, np.float32)
            for j in range(1, lb + 1):
                row = decay * row + decay * decay * same[:, i - 1, j - 1] * prime[:, i - 1, j - 1]
                nxt[:, i, j] = decay * nxt[:, i - 1, j] + row
        prime = nxt
    return decay * decay * (same * prime[:, :-1, :-1]).sum((1, 2), dtype=np.float64)


def triples(rows: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, float]]:
    """Code of each subsequence of three of rows of one length, with its weight."""
    r = rows.astype(np.int64)
    for i in range(length):
        for j in range(i + 1, length):
            two = (r[:, i] * CODES + r[:, j]) * CODES
            for k in range(j + 1, length):
                yield two + r[:, k], DECAY ** (k - i + 1)


def by_length(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    lengths = (rows > 0).sum(1)
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def self_kernel(rows: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself."""
    out = np.zeros(len(rows))
    for n, at in by_length(rows):
        if n >= 3:
            for i in range(0, len(at), 4096):
                part = rows[at[i : i + 4096], :n]
                out[at[i : i + 4096]] = kernel(part, part)
    return out


def weighted(rows: np.ndarray, weights: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Sum of the triples' weights, (n,) or (n, m), over the root of the rows' own kernels."""
    out = np.zeros((len(rows), *weights.shape[1:]))
    for n, at in by_length(rows):
        if n >= 3:
            part, total = rows[at], 0
            for code, w in triples(part, n):
                total = total + w * weights[code]
            out[at] = total
    scale = np.where(norm > 0, 1 / np.sqrt(np.maximum(norm, 1e-300)), 0)
    return out * (scale if out.ndim == 1 else scale[:, None])


@dataclass
class Model:
    """Decision = bias + the folded weights' sum; score = logistic(slope * decision + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def decide(self, rows: np.ndarray) -> np.ndarray:
        return self.bias + weighted(rows, self.weights, self_kernel(rows))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text; one without units has the bias alone."""
        rows, unit, doc = units_of(data, offsets)
        worst = np.full(len(offsets) - 1, self.bias)
        if len(unit):
            value = self.decide(rows)[unit]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            worst[doc[first]] = np.maximum(np.maximum.reduceat(value, first), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.2) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    reg = ridge * np.eye(z.shape[1])
    reg[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(w @ reg @ w + (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum())

    now = loss(w)
    for _ in range(60):
        on = y * (z @ w) < 1
        za = z[on] * weight[on, None]
        step = np.linalg.solve(reg + za.T @ z[on], za.T @ y[on]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if now - new <= 1e-6 * now:
            break
        w, now = w + size * step, new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.stack([x, np.ones(len(x))], 1)
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    ridge = np.array([1e-3, 1e-6])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - t * m).sum() + 0.5 * (ridge * w * w).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (t - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _all_units(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``units_of`` by slices, for bounded memory."""
    data, offsets = X.flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    parts, base = [], 0
    for i, j in X.slices(offsets):
        r, u, d = units_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((r, u + base, d + i))
        base += len(r)
    if not base:
        return np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, unit, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    names = np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 2}").reshape(-1)
    _, first, same = np.unique(names, return_index=True, return_inverse=True)
    pair = np.unique(doc * np.int64(len(first)) + same[unit])
    return rows[first], pair % len(first), pair // len(first)


def fit(texts: list[str] | pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Model of labelled texts; without texts of both labels every score is the share of toxic ones."""
    labels = np.asarray(labels) > 0
    share = float((labels.sum() + 0.5) / (len(labels) + 1)) if labels.any() else 0.0
    plain = Model(np.zeros(CODES**3, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if labels.all() or not labels.any():
        return plain
    rows, unit, doc = _all_units(texts)
    if not len(rows):
        return plain
    df = np.stack([np.bincount(unit[labels[doc] == k], minlength=len(rows)) for k in (0, 1)]).astype(float)
    n0, n1 = (~labels).sum(), labels.sum()
    usable = (rows > 0).sum(1) >= 3
    p0, p1 = (df[0] + 0.5) / (n0 + 1), (df[1] + 0.5) / (n1 + 1)
    # suspects: units whose count in toxic texts is far above what clean texts let expect;
    # a toxic text's witness is its strongest suspect, so words that copies of a text share don't count
    expect = (df[0] + 0.5) * n1 / n0
    suspect = usable & (p1 > 5 * p0) & (df[1] >= 3) & (df[1] - expect > 4.5 * np.sqrt(expect + 0.1))
    evidence = np.where(suspect, np.log(p1 / p0) * df[1], 0.0)
    named = labels[doc] & suspect[unit]
    if not named.any():
        return plain
    order = np.lexsort((unit[named], -evidence[unit[named]], doc[named]))
    td, tu = doc[named][order], unit[named][order]
    witness, times = np.unique(tu[np.concatenate([[True], td[1:] != td[:-1]])], return_counts=True)
    frequent = np.lexsort((np.arange(len(rows)), np.where(usable, -df[0], 1)))
    best = witness[np.lexsort((witness, -times))[:LANDMARKS]]
    marks = np.unique(np.concatenate([best, frequent[:COMMON]]))
    norm = self_kernel(rows)
    table = np.zeros((CODES**3, len(marks)), np.float32)
    for n, at in by_length(rows[marks]):
        if n >= 3:
            for code, w in triples(rows[marks][at], n):
                np.add.at(table, (code, at), w)
    table /= np.sqrt(np.maximum(norm[marks], 1e-12))[None, :].astype(np.float32)
    features = lambda at: np.concatenate([weighted(rows[at[i : i + 2048]], table, norm[at[i : i + 2048]]) for i in range(0, len(at), 2048)])
    value, vector = np.linalg.eigh(features(marks))
    good = value > 1e-4 * value.max()
    white = vector[:, good] / np.sqrt(value[good])

    clean = np.flatnonzero((df[0] > 0) & usable)
    rng = np.random.default_rng(seed)
    negative = np.union1d(rng.choice(clean, min(len(clean), 6_000), replace=False), frequent[:2000][df[0][frequent[:2000]] > 0])
    clean = np.setdiff1d(clean, witness)
    negative = np.setdiff1d(negative, witness)
    folded, bias = None, 0.0
    mass = np.sqrt(times)
    for _ in range(ROUNDS):
        z = np.vstack([features(witness) @ white, features(negative) @ white])
        y = np.concatenate([np.ones(len(mass)), -np.ones(len(negative))])
        weight = np.concatenate([mass * 0.5 * len(negative) / mass.sum(), np.ones(len(negative))])
        w = _svm(z, y, weight)
        folded, bias = (table @ (white @ w[:-1])).astype(np.float32), float(w[-1])
        decision = bias + weighted(rows, folded, norm)
        hard = clean[np.argsort(-decision[clean], kind="stable")[:3000]]
        negative = np.union1d(negative, hard)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    worst = np.full(len(labels), bias)
    worst[doc[first]] = np.maximum(np.maximum.reduceat(decision[unit], first), bias)
    told = ~labels
    told[td] = True
    return Model(folded, bias, *_logistic(worst[told], labels[told].astype(float)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, t, y): at most ``per_label`` texts of each label, by hash order of doc_id, up to the one that reaches ``chars`` characters.

    A doc_id labelled twice counts as toxic if once so; of its rows the shortest text is taken.  Null texts take no part.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    there = docs.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h")).where("n IS NOT NULL").join(known, "doc_id")
    there = there.groupBy("doc_id").agg(F.min(F.struct("n", "h")).alias("x"), F.min("y").alias("y")).select("doc_id", "x.n", "x.h", "y")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = F.sum("n").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    some = there.where("y = 1").orderBy(*order).limit(per_label).unionByName(there.where("y = 0").orderBy(*order).limit(per_label))
    # at most 2 * per_label rows of numbers
    some = some.withColumn("before", F.coalesce(first, F.lit(0))).where(F.col("before") < chars).drop("before")
    rows = docs.select("doc_id", F.col("text").alias("t"), F.length("text").alias("n"), F.xxhash64("text").alias("h")).join(F.broadcast(some), ["doc_id", "n", "h"])
    return rows.groupBy("doc_id").agg(F.min("t").alias("t"), F.min("y").alias("y"))


def training_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """``training_rows`` in the driver: texts and labels by doc_id."""
    rows = sorted(training_rows(docs, labels, label, per_label, chars).collect(), key=lambda r: r["doc_id"])
    return [r["t"] for r in rows], np.array([r["y"] for r in rows])


def fitted(rows: DataFrame) -> Model:
    """Model of ``training_rows``, fitted in a task: neither texts nor the fit's tables take the driver's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b.rename_columns(["doc_id", "t", "y"])]) for b in batches]
        if parts:
            t = pa.concat_tables(parts).sort_by("doc_id").combine_chunks()
            texts = t.column("t").cast(pa.large_string()).combine_chunks()
            m = fit(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, t.column("y").to_numpy())
            yield pa.RecordBatch.from_pydict({"weights": pa.array([m.weights.tobytes()], pa.binary()), "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    # at most 2 * TRAIN_DOCS rows
    m = rows.coalesce(1).mapInArrow(run, "weights binary, bias double, slope double, offset double").first()
    return fit([], np.array([])) if m is None else Model(np.frombuffer(m["weights"], np.float32), m["bias"], m["slope"], m["offset"])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the column ``score``; null and empty texts score as texts without units.

    A column of ``docs`` named score is replaced.
    """
    base = [f for f in docs.schema.fields if f.name != "score"]
    source = docs.select(*[F.col(f"`{f.name}`") for f in base], F.col(f"`{text}`").alias(free_name(docs, "text_")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = X.flat(batch.column(batch.num_columns - 1))
            for i, j in X.slices(offsets):
                score = m.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], names=[f.name for f in base] + ["score"])

    return source.mapInArrow(run, T.StructType([*base, T.StructField("score", T.DoubleType())]))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """Model of the labelled rows that are not held out."""
    labels = documents(spark, sf_dir, "labels").where(bucket_of("doc_id", 3) != 1)
    bounded_batches(spark)
    return fitted(training_rows(docs, labels))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, trained(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; trained on this stage's own input."""
    rows, unpacked = packed(docs, "doc_id", "text")
    model = trained(spark, sf_dir, rows.select("doc_id", "text"))
    return unpacked(score_toxicity(rows, model).where(F.col("score") < THRESHOLD))
