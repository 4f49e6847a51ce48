"""LM scoring by a gated recurrent network, trained in numpy by truncated backpropagation.

Words are lower-cased (A-Z).  Counts of all words of all training documents are
exact, by 64-bit word hash.  Every word has a class.  The SHORT most frequent
words and the end token stand in classes of CLASS words by frequency, and the
network has an input and an output for each of them; all other words stand in
BANDS classes by the octave of their count, with one input a class.  The output
softmax is factored: a class given the state, then the word within its class:
given the state, or in a band by its smoothed share of the band's counts.  The
last band has the words that are too rare for the tasks' table, and one share
for all unknown words, so the probabilities sum to one.

Training: every training document is learnt from once.  Documents are dealt to
ROUNDS rounds and, in each, to replicas of about REPLICA_TOKENS tokens.  A
replica cuts its tokens into lanes of one length and goes through them in
windows of WINDOW steps, with the state carried on and set to zero where a
document begins; replicas are averaged by tokens after each round.  Biases start
at the counts, so the untrained network is the unigram model.  Scoring: every
document is one sequence; lanes of documents run window by window with their
states carried, so a text is scored to its end.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.common import bounded_batches, bucket_of, documents, staged

SHORT, CLASS, BANDS = 4096, 64, 16
#: Words, at most, whose counts every task gets (24 bytes each); the rest meet their counts in a join.
COMMON = 1 << 18
WIDTH = 24
REPLICA_TOKENS, ROUNDS, WINDOW, LANES = 1_200_000, 3, 24, 512
LEARN, CLIP = 0.01, 1.0
SCORE_TOKENS, SCORE_ROWS, SCORE_LANES = 2_000_000, 16_384, 512
#: Rows whose class probabilities are computed at once, so that they stay in a core's cache.
ROWS = 2048
#: Name of the end token among the word hashes.
END = np.uint64(0x5EEDE4D0FD0C0001)
ADD = 0.1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens of a (text) table, the end token of each document included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = n_docs = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        def batch_of(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

        for batch in batches:
            data, offsets = X.flat(batch.column(0))
            n_docs += batch.num_rows
            for i, j in X.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, _ = X.word_spans(part, offsets[i : j + 1] - offsets[i])
                held.append(np.unique(X.span_hashes(part, starts, ends, True), return_counts=True))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged())
        if n_docs:
            yield batch_of(np.array([END], np.uint64), np.array([n_docs], np.int64))

    return docs.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The common words in a hash table: their counts, and their ids in the network (a band's for most).

    An id below SHORT is a word's own; SHORT + k is band k, of which the last is all other words'.
    """

    table: np.ndarray
    slot: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    short_counts: np.ndarray
    band_counts: np.ndarray
    band_words: np.ndarray
    total: int
    distinct: int

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> Vocabulary:
        """From the common words, most frequent first."""
        if END not in words:
            words, counts = np.append(words, END), np.append(counts, 0)
        end = int(np.flatnonzero(words == END)[0])
        lead = np.arange(len(words))
        if end >= SHORT:
            lead = np.concatenate([lead[: SHORT - 1], [end], np.delete(lead, end)[SHORT - 1 :]])
        words, counts = words[lead], counts[lead].astype(np.int64)
        k = min(SHORT, len(words))
        octave = np.log2(np.maximum(counts, 1)).astype(np.int64)
        ids = SHORT + np.minimum(octave[k:].max(initial=0) - octave, BANDS - 2)
        ids[:k] = np.arange(k)
        short = np.zeros(SHORT, np.int64)
        short[:k] = counts[:k]
        band_counts, band_words = np.zeros(BANDS), np.zeros(BANDS)
        np.add.at(band_counts, ids[k:] - SHORT, counts[k:])
        np.add.at(band_words, ids[k:] - SHORT, 1)
        used = int((counts > 0).sum())
        band_counts[-1], band_words[-1] = total - counts.sum(), distinct - used + 1
        return cls(*cls.placed(words), words, counts, ids, short, band_counts, band_words, total, distinct)

    @staticmethod
    def placed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open hash table of at least four places a word: the hashes, and which word it is or -1."""
        size = 1 << max(8, int(4 * len(words) - 1).bit_length())
        table, slot = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        left, at = np.arange(len(words)), (words & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = slot[at] < 0
            slot[at[free]] = left[free]
            table[at[free]] = words[left[free]]
            lost = slot[at] != left
            table[at] = words[slot[at]]
            left, at = left[lost], (at[lost] + 1) & (size - 1)
        return table, slot

    @property
    def end_id(self) -> int:
        return int(self.ids[np.flatnonzero(self.words == END)[0]])

    @property
    def band_norms(self) -> np.ndarray:
        """What the smoothed counts of each band's words, and of the unknown ones, add up to."""
        return self.band_counts + ADD * self.band_words

    @property
    def base_norm(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network id of each word, and its count or -1 where it is none of the common words."""
        size = len(self.table)
        at = (hashes & np.uint64(size - 1)).astype(np.int64)
        found = self.slot[at]
        left = np.flatnonzero((found >= 0) & (self.table[at] != hashes))
        at = at[left]
        while len(left):
            at = (at + 1) & (size - 1)
            found[left] = self.slot[at]
            off = (self.slot[at] >= 0) & (self.table[at] != hashes[left])
            left, at = left[off], at[off]
        hit = found >= 0
        return np.where(hit, self.ids[found], SHORT + BANDS - 1), np.where(hit, self.counts[found], -1)


CLASSES = SHORT // CLASS
INPUTS = SHORT + BANDS + 1
SHAPES = {"emb": (INPUTS, WIDTH), "w": (WIDTH, 3 * WIDTH), "u": (WIDTH, 3 * WIDTH), "b": (3 * WIDTH,), "cw": (WIDTH, CLASSES + BANDS), "cb": (CLASSES + BANDS,), "ww": (SHORT, WIDTH), "wb": (SHORT,)}
#: The input before a document's first word.
BOS = SHORT + BANDS


def start_params(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.3 / np.sqrt(WIDTH) if k in ("w", "u") else 0.1)).astype(np.float32) for k, s in SHAPES.items()}
    p["b"] = np.zeros(SHAPES["b"], np.float32)
    p["b"][:WIDTH] = 1.0
    p["cw"] *= 0.1
    p["ww"] *= 0.1
    p["wb"] = np.log(v.short_counts + 0.05).astype(np.float32)
    mass = v.short_counts.reshape(CLASSES, CLASS).sum(1)
    p["cb"] = np.log(np.concatenate([mass, v.band_counts]) + 0.5).astype(np.float32)
    return p


def flat_params(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in SHAPES])


def shaped_params(x: np.ndarray) -> dict[str, np.ndarray]:
    out, i = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[i : i + n].reshape(s).astype(np.float32)
        i += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= x.dtype.type(0.5)
    np.tanh(x, out=x)
    x *= x.dtype.type(0.5)
    x += x.dtype.type(0.5)
    return x


def _class_of(target: np.ndarray) -> np.ndarray:
    """Class of each id: CLASS short words share one, a band is one."""
    return np.where(target < SHORT, target // CLASS, target - (SHORT - CLASSES))


def _sorted(h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the rows by target, the states in it with a column of ones, and (class, from, to) of the short words' classes."""
    order = np.argsort(target.astype(np.int16), kind="stable")
    states = np.empty((len(h), WIDTH + 1), h.dtype)
    states[:, :WIDTH], states[:, WIDTH] = h[order], 1
    ends = np.searchsorted(target[order], np.arange(CLASSES + 1) * CLASS)
    return order, states, [(int(c), int(ends[c]), int(ends[c + 1])) for c in np.flatnonzero(np.diff(ends))]


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([weights, bias[:, None]], axis=1)


def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the rows of ``x`` and their sums, up to a factor a row; overwrites ``x``."""
    with np.errstate(over="ignore"):
        e = np.exp(x)
    total = e @ np.ones(x.shape[1], x.dtype)
    if not (np.isfinite(total).all() and (total > 1e-30).all()):
        x -= x.max(1, keepdims=True)
        e = np.exp(x)
        total = e.sum(1)
    return e, total


def output(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target (of the class alone for a band)."""
    order, states, spans = _sorted(h, target)
    target = target[order]
    cls, outer = _class_of(target), _with_bias(p["cw"].T, p["cb"]).T
    share = np.empty(len(h), h.dtype)
    for i in range(0, len(h), ROWS):
        e, total = _exps(states[i : i + ROWS] @ outer)
        share[i : i + ROWS] = e[np.arange(len(e)), cls[i : i + ROWS]] / total
    words = _with_bias(p["ww"], p["wb"])
    for c, i, j in spans:
        e, total = _exps(states[i:j] @ words[c * CLASS : (c + 1) * CLASS].T)
        share[i:j] *= e[np.arange(j - i), target[i:j] - c * CLASS] / total
    out = np.empty(len(h))
    out[order] = np.log(np.maximum(share, np.finfo(share.dtype).tiny))
    return out


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the shortest lane; lanes by length, the longest first."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable"):
        n, k = heapq.heappop(heap)
        out[k].append(int(d))
        heapq.heappush(heap, (n + int(lengths[d]), k))
    total = [sum(int(lengths[d]) for d in x) for x in out]
    return [out[k] for k in sorted(range(len(out)), key=lambda k: -total[k])]


def _split(x: np.ndarray) -> list[np.ndarray]:
    """The columns of the update gate, the reset gate and the candidate, each in memory of its own."""
    return [np.ascontiguousarray(x[:, k * WIDTH : (k + 1) * WIDTH]) for k in range(3)]


def _gates(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What each input adds to the two gates and the candidate."""
    return _split(p["emb"] @ p["w"] + p["b"])


def _inputs(targets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, BOS at a document's first, and which these are."""
    inputs = np.concatenate([[BOS], targets[:-1]])
    first = np.zeros(len(targets), bool)
    first[offsets[:-1]] = True
    inputs[first] = BOS
    return inputs, first


def log_probs(p: dict[str, np.ndarray], targets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of every token; ``targets`` are the documents' ids, each with its end.

    Lanes stand one after the other in memory, so a long text among short ones takes no more than its own tokens.
    """
    lengths = np.diff(offsets)
    dealt = lanes_of(lengths, SCORE_LANES)
    size = np.array([lengths[x].sum() for x in dealt], np.int64)
    order = X.ragged(offsets[:-1][np.concatenate(dealt)], lengths[np.concatenate(dealt)])
    low = np.concatenate([[0], np.cumsum(size)[:-1]])
    inputs, first = (x[order] for x in _inputs(targets, offsets))
    wanted = targets[order]
    gates, u = _gates(p), _split(p["u"])
    h = np.zeros((len(dealt), WIDTH), np.float32)
    done = np.zeros(len(targets))
    states, places, held = [], [], 0
    alive = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # lanes go from the longest to the shortest
    for s, n in enumerate(alive.tolist()):
        at = low[:n] + s
        now = h[:n]
        now[first[at]] = 0
        word = inputs[at]
        z, r, m = (g.take(word, axis=0) for g in gates)
        z += now @ u[0]
        r += now @ u[1]
        np.multiply(_sigmoid(r), now @ u[2], out=r)
        m += r
        np.tanh(m, out=m)
        now -= m
        now *= _sigmoid(z)
        now += m
        states.append(now.copy())
        places.append(at)
        held += n
        if held >= SCORE_ROWS or s + 1 == len(alive):
            at = np.concatenate(places)
            done[at] = output(p, np.concatenate(states), wanted[at])
            states, places, held = [], [], 0
    out = np.empty(len(targets))
    out[order] = done
    return out


class Trainer:
    """Adam on windows of truncated backpropagation."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: x.copy() for k, x in p.items()}
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}
        self.steps = 0

    def window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, live: np.ndarray, new: np.ndarray) -> np.ndarray:
        """One update on (time, lane) arrays; returns the state after the window."""
        p = self.p
        kind, (steps, lanes) = p["emb"].dtype, x.shape
        u = _split(p["u"])
        z, r, m = (np.take(g, x, axis=0) for g in _gates(p))
        before, after, gm = (np.empty((steps, lanes, WIDTH), kind) for _ in range(3))
        for t in range(steps):
            now = before[t]
            now[:] = h
            now[new[t]] = 0
            z[t] += now @ u[0]
            _sigmoid(z[t])
            r[t] += now @ u[1]
            _sigmoid(r[t])
            np.matmul(now, u[2], out=gm[t])
            m[t] += r[t] * gm[t]
            np.tanh(m[t], out=m[t])
            h = after[t]
            np.subtract(now, m[t], out=h)
            h *= z[t]
            h += m[t]
        back, grad = self.loss(after.reshape(-1, WIDTH), y.reshape(-1), live.reshape(-1))
        back = back.reshape(steps, lanes, WIDTH)
        dz, dr, dm, dg = (np.empty((steps, lanes, WIDTH), kind) for _ in range(4))
        dh = np.zeros((lanes, WIDTH), kind)
        over = [np.ascontiguousarray(k.T) for k in u]
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            left = 1 - z[t]
            left *= dh
            np.subtract(before[t], m[t], out=dz[t])
            dz[t] *= z[t]
            dz[t] *= left
            np.multiply(m[t], m[t], out=dm[t])
            np.subtract(1, dm[t], out=dm[t])
            dm[t] *= left
            np.multiply(dm[t], r[t], out=dg[t])
            np.subtract(1, r[t], out=dr[t])
            dr[t] *= gm[t]
            dr[t] *= dg[t]
            dh *= z[t]
            for d, k in zip((dz, dr, dg), over, strict=True):
                dh += d[t] @ k
            dh[new[t]] = 0
        flat = lambda d: d.reshape(-1, WIDTH)
        grad["u"] = np.hstack([flat(before).T @ flat(d) for d in (dz, dr, dg)])
        order = np.argsort(x.reshape(-1).astype(np.int16), kind="stable")
        words, start = np.unique(x.reshape(-1)[order], return_index=True)
        by_word = np.hstack([np.add.reduceat(flat(d)[order], start, axis=0) for d in (dz, dr, dm)])
        grad["b"], grad["w"] = by_word.sum(0), p["emb"][words].T @ by_word
        grad["emb"] = np.zeros_like(p["emb"])
        grad["emb"][words] = by_word @ p["w"].T
        self.update({k: np.ascontiguousarray(grad[k]) for k in SHAPES})
        return h

    def loss(self, h: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the mean loss over the live steps: by state, and by the output's parameters."""
        p, rows = self.p, None if live.all() else np.flatnonzero(live)
        order, states, spans = _sorted(*((h, y) if rows is None else (h[rows], y[rows])))
        target = (y if rows is None else y[rows])[order]
        scale = h.dtype.type(1 / max(1, len(target)))

        def gradient(weights: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
            q, total = _exps(own @ weights.T)
            q *= (scale / total)[:, None]
            q[np.arange(len(q)), at] -= scale
            return q

        outer, words = _with_bias(p["cw"].T, p["cb"]), _with_bias(p["ww"], p["wb"])
        cls, over = _class_of(target), np.ascontiguousarray(p["cw"].T)
        by_class, back = np.zeros_like(outer), np.empty((len(target), WIDTH), h.dtype)
        for i in range(0, len(target), ROWS):
            own = states[i : i + ROWS]
            q = gradient(outer, own, cls[i : i + ROWS])
            by_class += q.T @ own
            np.matmul(q, over, out=back[i : i + ROWS])
        by_word = np.zeros_like(words)
        for c, i, j in spans:
            some = slice(c * CLASS, (c + 1) * CLASS)
            d = gradient(words[some], states[i:j], target[i:j] - c * CLASS)
            np.matmul(d.T, states[i:j], out=by_word[some])
            back[i:j] += d @ p["ww"][some]
        out = np.zeros_like(h)
        out[order if rows is None else rows[order]] = back
        return out, {"cw": by_class[:, :WIDTH].T, "cb": by_class[:, WIDTH], "ww": by_word[:, :WIDTH], "wb": by_word[:, WIDTH]}

    def update(self, grad: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        cut = min(1.0, CLIP / max(norm, 1e-12))
        rate = LEARN * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grad.items():
            kind = g.dtype.type
            m, s = self.m[k], self.s[k]
            g *= kind(cut)
            m *= kind(0.9)
            m += kind(0.1) * g
            g *= g
            g *= kind(0.001)
            s *= kind(0.999)
            s += g
            np.sqrt(s, out=g)
            g += kind(1e-8)
            np.divide(m, g, out=g)
            g *= kind(rate)
            self.p[k] -= g

    def train(self, targets: np.ndarray, offsets: np.ndarray) -> None:
        """Goes once through all tokens, cut into lanes of one length; a lane that begins inside a document begins with no state."""
        inputs, first = _inputs(targets, offsets)
        lanes = int(min(LANES, max(1, len(targets) // WINDOW)))
        size = -(-len(targets) // lanes)
        at = np.arange(lanes) * size
        lanes = int((at < len(targets)).sum())
        h = np.zeros((lanes, WIDTH), self.p["emb"].dtype)
        for t in range(0, size, WINDOW):
            place = at[None, :lanes] + np.arange(t, min(t + WINDOW, size))[:, None]
            live = place < len(targets)
            place = np.where(live, place, 0)
            h = self.window(h, inputs[place], targets[place], live, first[place] & live)


def _encoded(batch_text: pa.Array, v: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices: first row, ids with ends, their offsets, word hashes and counts of all tokens (-1: not common)."""
    data, offsets = X.flat(batch_text)
    end = v.end_id
    end_count = int(v.short_counts[end])
    for i, j in X.slices(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, of = X.word_spans(part, offs)
        hashes = X.span_hashes(part, starts, ends, True)
        ids, counts = v.find(hashes)
        size = np.bincount(of, minlength=j - i) + 1
        where = np.arange(len(of)) + of
        total = len(of) + (j - i)
        out_ids, out_counts, out_hash = np.full(total, end, np.int64), np.full(total, end_count, np.int64), np.full(total, END, np.uint64)
        out_ids[where], out_counts[where], out_hash[where] = ids, counts, hashes
        yield i, out_ids, np.concatenate([[0], np.cumsum(size)]), out_hash, out_counts


def trained(docs: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS rounds of replicas, which deal out all rows of (doc_id, text) between them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)
    p = start_params(v)
    blocks = 32
    flat = flat_params(p)
    size = -(-len(flat) // blocks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, offs, _, _ in _encoded(batch.column(1), shared.value):
                raw = ids.astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip(2 * offs[:-1], 2 * offs[1:], strict=True)], pa.binary())], names=["ids"])

    deal = F.xxhash64("ids")
    ids = staged(docs.mapInArrow(encode, "ids binary").withColumn("deal", deal).withColumn("round", F.pmod(F.xxhash64("deal"), F.lit(ROUNDS)).cast("int")))
    tokens = dict(ids.groupBy("round").agg(F.sum(F.length("ids") / 2)).collect())
    for k in sorted(tokens):
        replicas = int(-(-tokens[k] // REPLICA_TOKENS))
        now = spark.sparkContext.broadcast(flat)

        def train(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            trainer, done, texts, held = Trainer(shaped_params(now.value)), 0, [], 0

            def go() -> None:
                lengths = [len(x) for x in texts]
                trainer.train(np.concatenate(texts).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]))

            for batch in batches:
                for raw in batch.column(0):
                    texts.append(np.frombuffer(raw.as_buffer(), np.uint16))
                    held += len(texts[-1])
                    done += len(texts[-1])
                    if held > REPLICA_TOKENS:
                        go()
                        texts, held = [], 0
            if texts:
                go()
            if done:
                x = np.pad(flat_params(trainer.p), (0, blocks * size - len(flat))).reshape(blocks, size)
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([float(done)] * blocks), pa.array([zlib.compress(y.tobytes(), 1) for y in x], pa.binary())], names=["block", "n", "x"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for b, n, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    y = np.frombuffer(zlib.decompress(x), np.float32) * np.float64(n)
                    sums[b] = [sums[b][0] + n, sums[b][1] + y] if b in sums else [n, y]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()]), pa.array([zlib.compress(s[1].tobytes(), 1) for s in sums.values()], pa.binary())], names=["block", "n", "x"])

        schema = "block int, n double, x binary"
        part = ids.where(F.col("round") == k).repartitionById(replicas, F.pmod(F.col("deal"), F.lit(replicas)).cast("int")).select("ids").mapInArrow(train, schema)
        mean = np.zeros((blocks, size))
        for block, n, x in part.repartition("block").mapInArrow(add, schema).collect():
            mean[block] = np.frombuffer(zlib.decompress(x)) / n
        flat = mean.reshape(-1)[: len(flat)].astype(np.float32)
    return shaped_params(flat)


def _scored(docs: DataFrame, v: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """(uid, doc_id, n_tokens, log_p, known, base) of (doc_id, text), and its words that aren't common with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((v, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        norms = np.log10(v.band_norms.clip(1e-300))
        uid = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def go() -> pa.RecordBatch:
            nonlocal uid, held, size
            docs = pa.concat_arrays([x[0] for x in held])
            ids, hashes, counts = (np.concatenate([x[k] for x in held]) for k in (1, 3, 4))
            lengths = np.concatenate([np.diff(x[2]) for x in held])
            offs = np.concatenate([[0], np.cumsum(lengths)])
            n, of = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
            lp = log_probs(p, ids, offs) / np.log(10)
            common = counts >= 0
            base = np.where(common, np.log10(np.maximum(counts, 0) + ADD), 0.0)
            lp += np.where(ids >= SHORT, base - norms[np.maximum(ids - SHORT, 0)], 0.0)
            sums = lambda x: np.add.reduceat(x, offs[:-1])
            rare = ~common
            order = np.lexsort((hashes[rare], of[rare]))
            words, wof = hashes[rare][order], of[rare][order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (wof[1:] != wof[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(words)))
            rare_offs = np.concatenate([[0], np.cumsum(np.bincount(wof[at], minlength=n))]).astype(np.int32)
            out = [pa.array(np.arange(uid, uid + n)), docs, pa.array(lengths), pa.array(sums(lp)), pa.array(sums((counts > 0).astype(np.int64))), pa.array(sums(base))]
            out.append(pa.ListArray.from_arrays(pa.array(rare_offs), pa.array(words[at].view(np.int64))))
            out.append(pa.ListArray.from_arrays(pa.array(rare_offs), pa.array(times.astype(np.int32))))
            uid += n
            held, size = [], 0
            return pa.RecordBatch.from_arrays(out, names=["uid", "doc_id", "n_tokens", "log_p", "known", "base", "words", "times"])

        for batch in batches:
            for i, ids, offs, hashes, counts in _encoded(batch.column(1), v):
                held.append((batch.column(0).slice(i, len(offs) - 1), ids, offs, hashes, counts))
                size += len(ids)
                if size > SCORE_TOKENS:
                    yield go()
        if held:
            yield go()

    return docs.mapInArrow(run, "uid long, doc_id long, n_tokens long, log_p double, known long, base double, words array<long>, times array<int>")


def common_words(counts: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The words of at least 2 ** k tokens, for the least k that leaves ``most`` words or fewer; by count, then hash."""
    sizes = counts.agg(*[F.count_if(F.col("c") >= 2**k).alias(f"k{k}") for k in range(50)]).first()
    least = next((2**k for k in range(50) if (sizes[f"k{k}"] or 0) <= most), 2**50)
    top = counts.where(F.col("c") >= least).toPandas()
    words, numbers = top["word"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    order = np.lexsort((words, -numbers))
    return words[order], numbers[order]


def score_documents(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of (doc_id, text), learnt from ``train``.

    Null texts are empty: the end token alone.  Repeated rows are scored each.
    Without training documents every count is 0.
    """
    bounded_batches(docs.sparkSession)
    counts = staged(word_counts(train.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, numbers = common_words(counts)
    v = Vocabulary.build(words, numbers, int(total), int(distinct))
    p = trained(train, v)
    rows = staged(_scored(docs, v, p))
    rare = rows.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("m"))
    met = rare.join(counts, "word", "left")
    sums = met.groupBy("uid").agg(F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("part"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("met"))
    part = F.coalesce("part", F.lit(0.0))
    return rows.drop("words", "times").join(sums, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + part - F.col("n_tokens") * float(np.log10(v.base_norm))).alias("base_score"),
        (F.col("log_p") + part).alias("score"),
    )


def op4_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(bucket_of("doc_id", 10), F.lit(1)) == 0
    scored = score_documents(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
