"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can cross: before each run of
the space mark.  The distinct words of a batch stand in one flat array of
symbols.  Every round looks up the rank of each adjacent pair, takes the least
rank of each word (a segmented minimum), merges all its leftmost
non-overlapping occurrences at once, and compacts the array; a word without a
pair leaves.  Merging at once equals the library's one-at-a-time order unless a
merged piece is itself part of a piece of the same or a better rank; for such
pieces only the leftmost occurrence of a word is merged in a round.

A word of n symbols may need as many rounds as its pairs have ranks, and each is
a pass over the array.  So a long word (a run of base64, say) is compacted
lazily instead: its symbols are linked, its pairs lie in buckets by rank, a round
takes the least bucket, and only the pairs beside a merge are looked up again.
Its rounds are the same; all of them together touch a symbol about as often as
it is merged.

The model file is read with the sentencepiece library's own reader; encoding
and decoding do not call it.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textops as X
from tessera.llm.common import bounded_batches, documents, free_name

SPACE = "▁"
#: Words whose ids a worker keeps between batches, and symbols merged at once; only memory depends on them.
CACHED_WORDS, FLAT_SYMBOLS = 300_000, 400_000
#: Symbols from which a word is merged by buckets of rank; only time depends on it.
LONG = 4096
#: Pairs of a bucket that are merged one by one.
FEW = 12
#: Texts of a batch handled together, in bytes.
BYTES = 1_000_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Symbol and merge tables of a model with identity normalisation and byte fallback.

    Symbols are the model's ids, followed by the characters of pieces that are
    no pieces themselves.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int64)
        normal = {}
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                normal[p] = i
        if (self.bytes < 0).any() or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a model with byte fallback and words that start at the space mark is needed")
        score = {p: sp.get_score(i) for p, i in normal.items()}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        chars = sorted({c for p in normal for c in p})
        self.symbol = {c: normal.get(c, n + k) for k, c in enumerate(chars)}
        part = {**normal, **self.symbol}
        keys, merged, ranks = [], [], []
        alone = set()
        self.width = n + len(chars) + 1
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in part and b in part:
                    keys.append(part[a] * self.width + part[b])
                    merged.append(i)
                    ranks.append(rank[score[p]])
                    alone.update(x for x in (a, b) if len(x) > 1 and score[x] <= score[p])
        order = np.argsort(keys)
        self.keys, self.merged, self.ranks = (np.array(x, np.int64)[order] for x in (keys, merged, ranks))
        self.alone = np.zeros(self.width, bool)
        self.alone[[normal[p] for p in alone]] = True
        self.alone_ranks = {rank[score[p]] for p in alone}
        self.table_size = 1 << 20
        self.table = self._table()
        self.cache: dict[str, bytes] = {}
        has = set(normal.values())
        self.surface = [p.replace(SPACE, " ").encode() if i in has else b"" for i, p in enumerate(names)]
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])

    def _table(self) -> np.ndarray:
        """Positions of the pairs by a hash of their key; pairs that collide are found by bisection."""
        table = np.full(self.table_size, -1, np.int32)
        table[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        return table

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Position of each pair in the merge table, or -1."""
        keys = left * self.width + right
        at = self.table[self._slot(keys)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        if len(other):
            near = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            at[other] = np.where(self.keys[near] == keys[other], near, -1)
        return at

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words; ``word`` ascends."""
        done_s, done_w = [], []
        big = np.iinfo(np.int64).max
        edge = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(word)]])
        for k in np.flatnonzero(np.diff(edge) >= LONG):
            done_s.append(self.merge_long(symbols[edge[k] : edge[k + 1]]))
            done_w.append(np.full(len(done_s[-1]), word[edge[k]]))
        if done_s:
            short = np.repeat(np.diff(edge) < LONG, np.diff(edge))
            symbols, word = symbols[short], word[short]
        while len(symbols):
            at = np.full(len(symbols), -1, np.int64)
            same = np.flatnonzero(word[1:] == word[:-1])
            at[same] = self.find(symbols[same], symbols[same + 1])
            rank = np.where(at >= 0, self.ranks[at], big)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            active = least < big
            if not active.all():
                out = np.repeat(~active, length)
                done_s.append(symbols[out])
                done_w.append(word[out])
                if not active.any():
                    break
                keep = ~out
                symbols, word, at, rank = symbols[keep], word[keep], at[keep], rank[keep]
                length, least = length[active], least[active]
                first = np.concatenate([[0], np.cumsum(length)[:-1]])
            hit = rank == np.repeat(least, length)
            where = np.flatnonzero(hit)
            gap = np.concatenate([[True], np.diff(where) > 1])
            run = np.flatnonzero(gap)
            within = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
            where = where[within % 2 == 0]
            made = self.merged[at[where]]
            single = self.alone[made]
            if single.any():
                lead = np.concatenate([[True], word[where][1:] != word[where][:-1]])
                banned = np.zeros(int(word[-1]) + 1, bool)
                banned[word[where[single]]] = True
                ok = lead | ~banned[word[where]]
                where, made = where[ok], made[ok]
            symbols = symbols.copy()
            symbols[where] = made
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_s:
            return symbols, word
        symbols, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    @cached_property
    def place(self) -> dict[int, int]:
        """Position in the merge table by key, for single pairs."""
        return dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Final symbols of one word."""
        n = len(symbols)
        symbols = np.append(symbols, -1)
        # neighbours by place; place n is the end, and stands before place 0
        after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n - 1)
        before[0] = n
        none = np.iinfo(np.int64).max
        found, rank = np.full(n + 1, -1, np.int64), np.full(n + 1, none)
        buckets: dict[int, list] = {}
        waiting: list[int] = []

        def put(r: int, places) -> None:
            if r not in buckets:
                buckets[r] = []
                heapq.heappush(waiting, r)
            buckets[r].append(places)

        def look(at: np.ndarray) -> None:
            """Looks up the pairs that begin at these places and puts them in their buckets."""
            rank[at] = none
            at = at[after[at] < n]
            found[at] = self.find(symbols[at], symbols[after[at]])
            at = at[found[at] >= 0]
            rank[at] = self.ranks[found[at]]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else []:
                put(int(rank[part[0]]), part)

        def merge_one(i: int) -> None:
            gone = int(after[i])
            onward = int(after[gone])
            symbols[i] = self.merged[found[i]]
            rank[gone] = none
            after[i], before[onward] = onward, i
            for j in (i, int(before[i])):
                if j < n:
                    right = int(after[j])
                    k = self.place.get(int(symbols[j]) * self.width + int(symbols[right]), -1) if right < n else -1
                    found[j], rank[j] = k, self.ranks[k] if k >= 0 else none
                    if k >= 0:
                        put(int(rank[j]), (j,))

        def merge_all(where: np.ndarray) -> None:
            """The leftmost non-overlapping ones of these places at once."""
            run = np.flatnonzero(np.concatenate([[True], after[where[:-1]] != where[1:]]))
            within = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
            where = where[within % 2 == 0]
            gone = after[where]
            onward = after[gone]
            symbols[where] = self.merged[found[where]]
            rank[gone] = none
            after[where], before[onward] = onward, where
            ahead = before[where]
            look(np.unique(np.concatenate([where, ahead[ahead < n]])))

        look(np.arange(n))
        singles: dict[int, list[int]] = {}
        while waiting:
            least = heapq.heappop(waiting)
            parts = buckets.pop(least)
            if least in self.alone_ranks:
                # the leftmost one; better pairs that it makes go before the next
                heap = singles.setdefault(least, [])
                for i in itertools.chain.from_iterable(parts):
                    heapq.heappush(heap, int(i))
                while heap and rank[heap[0]] != least:
                    heapq.heappop(heap)
                if heap:
                    merge_one(heapq.heappop(heap))
                    put(least, ())
                continue
            if sum(map(len, parts)) <= FEW:
                for i in sorted({int(i) for part in parts for i in part}):
                    if rank[i] == least:
                        merge_one(i)
                continue
            where = np.unique(np.concatenate([np.asarray(part, np.int64) for part in parts]))
            where = where[rank[where] == least]
            if len(where):
                merge_all(where)
        out, at = [], 0
        while at < n:
            out.append(at)
            at = int(after[at])
        return symbols[np.array(out, np.int64)]

    def _encode_new(self, words: list[str]) -> None:
        """Adds the ids of words (with their space marks) to the cache."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, inverse = np.unique(code, return_inverse=True)
        extra: dict[int, str] = {}
        table = np.empty(len(distinct), np.int64)
        for k, c in enumerate(distinct.tolist()):
            s = self.symbol.get(chr(c))
            if s is None:
                s = self.width + c
                extra[s] = chr(c)
            table[k] = s
        symbols = table[inverse]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        known = symbols < self.width
        shown = np.where(known, symbols, self.width - 1)
        out, of = self.merge(shown, word) if known.all() else self._merge_around(symbols, word, known)
        wide = out >= self.size
        if wide.any():
            back = {s: c for c, s in self.symbol.items()} | extra
            parts = [[int(s)] if s < self.size else [int(self.bytes[b]) for b in back[int(s)].encode("utf-8", "surrogatepass")] for s in out]
            of = np.repeat(of, [len(p) for p in parts])
            out = np.array([i for p in parts for i in p], np.int64)
        raw = out.astype("<u4").tobytes()
        ends = np.searchsorted(of, np.arange(len(words)), side="right") * 4
        a = 0
        for w, b in zip(words, ends.tolist(), strict=True):
            self.cache[w] = raw[a:b]
            a = b

    def _merge_around(self, symbols: np.ndarray, word: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters in no piece take part in no pair: a place of their own that finds nothing."""
        shown = np.where(known, symbols, self.width - 1)
        unit = np.concatenate([[0], np.cumsum((~known[1:]) | (~known[:-1]) | (word[1:] != word[:-1]))])
        out, of = self.merge(shown, unit)
        lead = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        plain = ~known[lead][of]
        out = np.where(plain, symbols[lead][of], out)
        return out, word[lead][of]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        split = [_words(t) for t in texts]
        cache = self.cache
        new = list({w for ws in split for w in ws if w not in cache})
        if len(cache) + len(new) > CACHED_WORDS:
            cache.clear()
            new = list({w for ws in split for w in ws})
        i = 0
        while i < len(new):
            j, n = i, 0
            while j < len(new) and (j == i or n + len(new[j]) <= FLAT_SYMBOLS):
                n += len(new[j])
                j += 1
            self._encode_new(new[i:j])
            i = j
        get = cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; begin and end are nothing, and the first space is the encoder's."""
        get = self.surface.__getitem__
        raw = b"".join(map(get, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _words(text: str) -> list[str]:
    """Runs of space marks with the characters that follow them."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return [SPACE + p for p in parts]
    out, marks = [], ""
    for p in parts:
        marks += SPACE
        if p:
            out.append(marks + p)
            marks = ""
    return [*out, marks] if marks else out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The worker's own copy of a model."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, text: str = "text", path: str | None = None, ids: bool = True, digests: bool = True) -> DataFrame:
    """``docs`` with ids (array<int>, begin and end included) and the decoded text, or their digests.

    Null texts are empty: begin and end only.  Columns of ``docs`` by the names
    of the new ones are replaced.
    """
    path = path or model_path()
    bounded_batches(docs.sparkSession)
    new = [T.StructField("n_tokens", T.LongType())]
    if ids:
        new += [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    if digests:
        new += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = {f.name for f in new}
    base = [f for f in docs.schema.fields if f.name not in names]
    source = docs.select(*[F.col(f"`{f.name}`") for f in base], F.col(f"`{text}`").alias(free_name(docs, "text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        head, tail = np.array([m.bos], "<u4").tobytes(), np.array([m.eos], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
            for i, j in X.slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), BYTES):
                coded = [head + b + tail for b in m.encode_batch([t or "" for t in texts.slice(i, j - i).to_pylist()])]
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                cols.append(pa.array([len(b) // 4 for b in coded], pa.int64()))
                arrays = [np.frombuffer(b, "<u4") for b in coded]
                decoded = [m.decode(a) for a in arrays]
                if ids:
                    flat = np.concatenate(arrays).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)), pa.array(flat)))
                    cols.append(pa.array(decoded, pa.string()))
                if digests:
                    cols.append(pa.array([hashlib.sha256(b).hexdigest() for b in coded]))
                    cols.append(pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in base] + [f.name for f in new])

    return source.mapInArrow(run, T.StructType(base + new))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode_pieces(docs, ids=False).drop("text")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the documents that are left, with their digests."""
    return encode_pieces(docs.select("doc_id", "source", "text"), ids=False).drop("text")
