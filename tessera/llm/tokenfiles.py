"""Token-id files: independent zstandard frames with a trailing seek table.

A shard holds one frame per document, in ascending doc_id order, then a
directory frame (doc ids), and at the end a skippable frame with the seek table:
for every frame its compressed size, its size, and the low 32 bits of the
XXH64 of its content, then the number of frames, a descriptor byte and a magic
number.  That is zstd's seekable format, so any zstd reader can also read a
shard as a whole.  A reader fetches the table from the end of the file and
decompresses only the frames it is asked for.

Texts are encoded where they are read and travel as compressed frames: cut
points of doc_id (quantiles over all rows; a doc_id of very many rows has shards
of its own, by checksum) name each row's shard, and a shard is
written by one task to a name of its own attempt and moved into place, so a
repeated task leaves one file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import textops as X
from tessera.llm.common import bounded_batches, documents, shared_dir, staged

END_ID = 2
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Encoded pieces that a worker keeps between slices and places for them, pieces encoded per call, plain words joined to
#: one text, and bytes of text handled at once; only memory and time depend on them.
CACHED_WORDS, TABLE, WORDS_PER_CALL, JOINED, SLICE_BYTES = 800_000, 1 << 21, 20_000, 200, 2_000_000
#: Rows of a shard, about.
SHARD_ROWS = 16_384


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_INK = np.ones(256, bool)
_INK[[*range(9, 14), *range(0x1C, 0x21)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,!?;:"]] = True
#: First bytes of the characters among which the wide white space is.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _dense_ends(data: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte is surely no white space."""
    out = _INK[data]
    high = np.flatnonzero(data >= 0x80)
    lead = high.copy()
    for _ in range(3):
        lead -= (data[lead] & 0xC0) == 0x80
    out[high] = ~_WIDE[data[lead]]
    return out


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where flat texts are cut: the texts' starts, and inside them only where the tokenizer's pattern always cuts.

    That is before a space after a character that is no white space, around a
    line break between two such, and between a letter and a closing mark; what
    the pattern does on one side does not depend on the other.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        dense = _dense_ends(data)
        after = np.zeros(len(data), bool)  # a dense character stands before
        after[1:] = dense[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        after[starts] = False
        cut[:-1] = after & (data == 0x20)
        line = np.flatnonzero(after & (data == 0x0A))
        line = line[line + 1 < len(data)]
        line = line[_INK[data[line + 1]] & ~_WIDE[data[line + 1]]]
        line = line[~np.isin(line + 1, offsets)]
        cut[line] = cut[line + 1] = True
        letter = _LETTER[data]
        accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) + 1
        letter[accent] = True
        mark = np.flatnonzero(_CLOSING[data[1:]] & letter[:-1]) + 1
        cut[mark[~np.isin(mark, offsets)]] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts by the tokenizers library, distinct pieces once; pieces are known by 64-bit hashes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are found in whole texts, before the pattern cuts them.
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each id: a character of its name stands for one.
        self.width = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.width[list(names.values())] = [len(n) for n in names]
        self.clear()

    def clear(self, pieces: int = 0) -> None:
        """Forgets all, and takes places enough for so many pieces at once."""
        size = max(TABLE, 1 << (2 * pieces).bit_length())
        self.table, self.slot = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if it is new."""
        at = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        found = self.slot[at]
        left = np.flatnonzero((found >= 0) & (self.table[at] != hashes))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.table) - 1)
            found[left] = self.slot[at]
            off = (self.slot[at] >= 0) & (self.table[at] != hashes[left])
            left, at = left[off], at[off]
        return found

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self.encoded(words)
        number = np.arange(len(hashes)) + len(self.ends) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        left, at = np.arange(len(hashes)), (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]], self.table[at[free]] = number[left[free]], hashes[left[free]]
            lost = self.slot[at] != number[left]
            # of two that took one place, the last one has it
            self.table[at[~lost]] = hashes[left[~lost]]
            left, at = left[lost], (at[lost] + 1) & (len(self.table) - 1)

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has.

        Plain words that begin with a space are encoded many in one text, where
        the pattern cuts them apart; the ids' widths tell whose they are.
        """
        plain = np.array([w[:1] == b" " and w[1:].isalnum() for w in words], bool)
        sizes, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)] * len(words)
        joined = np.flatnonzero(plain)
        rest = np.flatnonzero(~plain).tolist()
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        for i in range(0, len(groups), WORDS_PER_CALL // JOINED):
            some = groups[i : i + WORDS_PER_CALL // JOINED]
            texts = [b"".join([words[k] for k in g]).decode() for g in some]
            for g, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                bounds = np.cumsum([len(words[k]) for k in g])
                to = np.searchsorted(np.cumsum(self.width[ids]), bounds) + 1
                if len(ids) != to[-1] or (np.cumsum(self.width[ids])[to - 1] != bounds).any():
                    rest += g.tolist()
                    continue
                sizes[g] = np.diff(to, prepend=0)
                for k, x in zip(g.tolist(), np.split(ids, to[:-1]), strict=True):
                    parts[k] = x
        for i in range(0, len(rest), WORDS_PER_CALL):
            some = rest[i : i + WORDS_PER_CALL]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([words[k].decode() for k in some], add_special_tokens=False), strict=True):
                parts[k] = np.array(e.ids, np.uint32)
                sizes[k] = len(e.ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of flat texts without added tokens, and their offsets."""
        cuts = pieces_of(data, offsets)
        starts, ends = cuts[:-1], cuts[1:]
        hashes = X.span_hashes(data, starts, ends, False)
        found = self.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            if len(self.ends) + len(fresh) > CACHED_WORDS:
                fresh, at = np.unique(hashes, return_index=True)
                self.clear(len(fresh))
                new = np.arange(len(hashes))
            raw, places = data.tobytes(), new[at]
            self.add(fresh, [raw[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            found = self.find(hashes)
        sizes = self.ends[found + 1] - self.ends[found]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[X.ragged(self.ends[found], sizes)], total[np.searchsorted(cuts, offsets)]

    def encode(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """Ids of each text as little-endian unsigned 32-bit integers, by slices; nulls are empty texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.zeros(len(texts), bool)
        for name in self.added:
            odd |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        data, offsets = X.flat(texts)
        for i, j in X.slices(offsets, SLICE_BYTES):
            ids, offs = self.encode_flat(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out = [ids[a:b].astype("<u4").tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            for k in np.flatnonzero(odd[i:j]):
                out[k] = np.array(self.tokenizer.encode(texts[i + int(k)].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
            yield out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass
class Cuts:
    """Where shards begin: ranges of doc_id, null first, and how many shards a range has.

    A doc_id (or null) with more rows than a shard takes is a range of its own,
    whose rows go to its shards by the order of their checksums.
    """

    after: np.ndarray
    shards: np.ndarray

    def of(self, doc_id: pa.Array, check: np.ndarray) -> np.ndarray:
        ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        part = np.where(doc_id.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(self.after, ids, side="left"))
        return np.concatenate([[0], np.cumsum(self.shards)])[part] + (check * self.shards[part] >> 32)

    @property
    def total(self) -> int:
        return int(self.shards.sum())


def shard_cuts(docs: DataFrame, shard_rows: int) -> Cuts:
    rows = docs.count()
    want = max(1, -(-rows // shard_rows), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 256)))
    often = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().where(F.col("count") > shard_rows).collect()}
    after = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [k / want for k in range(1, want)] or [0.5], 100_000).alias("q")).first()["q"] or []
    after = set(after if want > 1 else [])
    for x in often:
        if x is not None:
            after |= {x - 1, x}
    cuts = np.array(sorted(after), np.int64)
    shards = np.ones(len(cuts) + 2, np.int64)
    for x, n in often.items():
        shards[0 if x is None else 1 + int(np.searchsorted(cuts, x))] = -(-n // shard_rows)
    return Cuts(cuts, shards)


def frames_of(docs: DataFrame, path: str, end_id: int = END_ID, cuts: Cuts | None = None) -> DataFrame:
    """(doc_id, frame, size, check, shard) of (doc_id, text): each document's ids as a compressed frame."""
    cuts = docs.sparkSession.sparkContext.broadcast(cuts or Cuts(np.zeros(0, np.int64), np.ones(2, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end_id], "<u4").tobytes()
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            i = 0
            for coded in enc.encode(batch.column(1)):
                raw = [b + tail for b in coded]
                check = np.array([xxhash.xxh64_intdigest(b) & 0xFFFFFFFF for b in raw], np.int64)
                doc_id = batch.column(0).slice(i, len(raw))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array([press.compress(b) for b in raw], pa.binary()), pa.array([len(b) for b in raw], pa.int64()), pa.array(check), pa.array(cuts.value.of(doc_id, check).astype(np.int32))],
                    names=["doc_id", "frame", "size", "check", "shard"],
                )
                i += len(raw)

    return docs.mapInArrow(run, "doc_id long, frame binary, size long, check long, shard int")


class ShardWriter:
    """Writes frames one after the other, then the directory and the seek table."""

    def __init__(self, root: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        self.path, self.temp = f"{base}/{name}", f"{base}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.ids: list[int | None] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table.append((len(frame), size, check))

    def close(self) -> None:
        directory = np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], np.uint8).tobytes()
        frame = zstandard.ZstdCompressor(level=1).compress(directory)
        self.out.write(frame)
        self.table.append((len(frame), len(directory), xxhash.xxh64_intdigest(directory) & 0xFFFFFFFF))
        body = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(self.temp, self.path)


class ShardReader:
    """Random access to a shard; every frame that is read is held against its checksum."""

    def __init__(self, root: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.file = self.fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{name} has no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.press = zstandard.ZstdDecompressor()
        raw = self.frame(n - 1)
        ids, null = np.frombuffer(raw[: 8 * (n - 1)], "<i8"), np.frombuffer(raw[8 * (n - 1) :], np.uint8)
        self.ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]

    def frame(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        raw = self.press.decompress(self.file.read_at(int(packed), int(self.at[k])), max_output_size=int(size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, root: str, path: str | None = None, end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Encodes (doc_id, text) into shards under ``root``; returns (shard, name, docs, ids), a row per shard.

    Shards and the documents in them ascend by doc_id, null first; rows of one
    doc_id by checksum and size.  Null texts are empty and
    give the end id alone.  An empty table gives no shards.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounded_batches(docs.sparkSession)
    cuts = shard_cuts(docs, shard_rows)
    frames = frames_of(docs, path or vocabulary_path(), end_id, cuts)
    parted = frames.repartitionById(cuts.total, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "check", "size", "frame")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer, now = [], None, None
        for batch in batches:
            doc, frame, size, check, shard = (batch.column(k).to_pylist() for k in range(5))
            for row in zip(doc, frame, size, check, shard, strict=True):
                if row[4] != now:
                    if writer:
                        writer.close()
                    now = row[4]
                    writer = ShardWriter(root, f"shard-{now:06d}.zst")
                    done.append([now, f"shard-{now:06d}.zst", 0, 0])
                writer.add(*row[:4])
                done[-1][2] += 1
                done[-1][3] += row[2] // 4
        if writer:
            writer.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "name", "docs", "ids"])

    return staged(parted.mapInArrow(write, "shard int, name string, docs long, ids long"))


def read_token_files(shards: DataFrame, root: str, wanted: set[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the shards' documents; with ``wanted`` only theirs are decompressed."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # a row per shard
    placed = shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    parts = shards.sparkSession.createDataFrame(placed.select("shard", "name", "base").collect(), "shard int, name string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                reader = ShardReader(root, name)
                starts = base + np.concatenate([[0], np.cumsum(reader.table[:-1, 1] // 4)])
                chosen = [k for k, x in enumerate(reader.ids) if wanted is None or x in wanted]
                for i in range(0, len(chosen), 1024):
                    part = chosen[i : i + 1024]
                    raw = [reader.frame(k) for k in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([reader.ids[k] for k in part], pa.int64()),
                            pa.array(starts[part], pa.int64()),
                            pa.array([len(r) // 4 for r in raw], pa.int64()),
                            pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                            pa.array(raw, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )
                reader.close()

    return parts.repartitionById(max(1, parts.count()), F.col("shard")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark)
    shards = write_token_files(documents(spark, sf_dir), root)
    return read_token_files(shards, root).drop("ids")
