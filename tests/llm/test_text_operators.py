"""Quality, Jaccard, pieces, token files and the LM against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import gru, jaccard, pieces, quality, tokenfiles
from tessera.llm import textops as X
from tessera.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]


def test_word_spans(texts):
    some = [*texts[:50], "", " a", "b ", None, " x\x1c y"]
    data, offsets = X.flat(pa.array(some, pa.string()))
    starts, ends, docs = X.word_spans(data, offsets)
    got = [[] for _ in some]
    for a, b, d in zip(starts, ends, docs, strict=True):
        got[d].append(bytes(data[a:b]).decode())
    assert got == [WORD.findall(t or "") for t in some]


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(win)
    covered = {i + k for i, g in enumerate(win) if often[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs)
    out = quality.score_quality(docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(-1)))
    for r in out.collect():
        want = brute_quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and want[5])
    assert quality.score_quality(no_docs).count() == 0
    assert quality.quality_stage(spark, odd_docs, sf).columns == odd_docs.columns


def test_cascade_order_does_not_matter(texts):
    data, offsets = X.flat(pa.array(texts, pa.string()))
    names = [r.name for r in quality.RULES]
    want = quality._verdicts(quality.Texts(data, offsets), names).tolist()
    for seed in range(4):
        random.Random(seed).shuffle(names)
        assert quality._verdicts(quality.Texts(data, offsets), names).tolist() == want
    ranks = [x["rank"] for x in quality.plan(pa.array(texts))]
    assert ranks == sorted(ranks, reverse=True)


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)] = min(groups.get(find(i), d), d)
    return sorted((repr(d), len(sets[i]), repr(groups.get(find(i), d) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=6, copies=7):
    r = random.Random(seed)
    rows, k = [], 100
    passage = [f"common{i}" for i in range(60)]
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice((4, 30, 60, 90)))] + (passage if g % 2 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, make_docs, odd_docs, seed):
    rows = near_copies(seed)
    docs = make_docs([(d, t, "s") for d, t in rows]).unionByName(odd_docs).withColumn("cls", F.lit(0)).withColumn("n", F.lit("x"))
    all_rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    table, classes, links = jaccard.jaccard_classes(docs)
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in jaccard.with_components(table, classes).collect())
    assert got == brute_components(all_rows)
    assert links.count() == links.distinct().count()


@pytest.mark.parametrize(("block_rows", "heavy", "hot"), [(256, 64, 1 << 20), (256, 2, 1 << 20), (3, 3, 1 << 20), (4, 64, 3), (5, 4, 1)])
def test_jaccard_links(spark, make_docs, odd_docs, monkeypatch, block_rows, heavy, hot):
    for name, value in (("BLOCK_ROWS", block_rows), ("HEAVY", heavy), ("HOT", hot), ("PAIRS", 7 if heavy < 64 else 1 << 22)):
        monkeypatch.setattr(jaccard, name, value)
    docs = make_docs([(d, t, "s") for d, t in near_copies(5, 4, 12)]).unionByName(odd_docs)
    all_rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    table, classes, _ = jaccard.jaccard_classes(docs)
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["n_links"]) for r in jaccard.with_components(table, classes).collect())
    sets = [shingles(t) for _, t in all_rows]
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    want = [sum(bool(linked(x, y)) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    assert sorted((g[0], g[1], g[3]) for g in got) == sorted((repr(d), len(x), k) for (d, _), x, k in zip(all_rows, sets, want, strict=True))
    assert [g[:3] for g in got] == brute_components(all_rows)
    assert max(want) > 3


def test_jaccard_links_sql(spark, sf):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    out = jaccard.jaccard_links(spark, sf)
    want = duck.sql(jaccard.LINKS_SQL)
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(want.fetchall())


def test_jaccard_stage(spark, sf, make_docs, odd_docs, no_docs):
    docs = make_docs([(d, t, "s") for d, t in near_copies(3)]).unionByName(odd_docs)
    out = jaccard.jaccard_stage(spark, docs, sf)
    assert out.columns == docs.columns
    kept = sorted(repr(r["doc_id"]) for r in out.collect() if shingles(r["text"]))
    want = {(n, c) for _, n, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]) if n}
    assert kept == sorted(c for c in {c for _, c in want})
    assert out.where("text IS NULL OR text = ''").count() == 2
    assert jaccard.jaccard_stage(spark, no_docs, sf).count() == 0


def test_jaccard_stage_null_and_repeated_ids(spark, sf, make_docs):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcde")
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "t"), (None, c + " tail", "s"), (3, c, "s"), (7, d, "s"), (7, e, "s"), (7, a + " more", "s"), (2, d + " x", "s"), (None, "", "s"), (None, None, "s"), (9, " ", "s"), (9, " ", "s")]
    out = jaccard.jaccard_stage(spark, make_docs(rows), sf)
    # a + " more" names a's component by 7; d's by 2, c's by 3; b has null ids only
    want = [(None, b, "s"), (3, c, "s"), (7, e, "s"), (7, a + " more", "s"), (2, d + " x", "s"), *rows[9:]]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["source"]) for r in out.collect()))) == sorted(map(repr, want))
    alone = make_docs([(None, x, "s") for x in (a, b, c)])
    assert sorted(r["text"] for r in jaccard.jaccard_stage(spark, alone, sf).collect()) == [a, b, c]


def test_pieces(spark, sf, odd_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs).withColumn("n_tokens", F.lit("clash"))
    for r in pieces.encode_pieces(docs).collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["piece_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert pieces.encode_pieces(no_docs).count() == 0


def test_pieces_of_hard_strings():
    m, sp = pieces.model(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(4)
    names = [sp.id_to_piece(r.randrange(300, 31_999)) for _ in range(3000)]
    some = ["".join(r.choice(names).replace("▁", r.choice(" x")) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    some += [" " * k for k in range(40)] + ["a" * k for k in range(40)] + ["▁", "<s>", "é" * 70, "\x00\n", "中" * 30]
    assert [np.frombuffer(b, "<u4").tolist() for b in m.encode_batch(some)] == sp.encode(some)


def test_token_files(spark, sf, odd_docs, no_docs, make_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfiles.vocabulary_path())
    many = [(None, f"null {k % 90} <|endoftext|> x", "s") for k in range(150)] + [(70, f"seventy {k}", "s") for k in range(130)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs).unionByName(make_docs(many))
    root = shared_dir(spark)
    shards = tokenfiles.write_token_files(docs, root, shard_rows=40)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), (t.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    got = sorted(tokenfiles.read_token_files(shards, root).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [k for k, _ in rows]
    start = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += len(ids)
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(i for _, i in rows)
    assert max(r["docs"] for r in shards.collect()) <= 80
    some = tokenfiles.read_token_files(shards, root, wanted={3, 7}).collect()
    assert {r["doc_id"] for r in some} == {3, 7}
    empty = shared_dir(spark)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(no_docs, empty), empty).count() == 0


def test_damaged_frame_is_found(spark, make_docs):
    root = shared_dir(spark)
    name = tokenfiles.write_token_files(make_docs([(1, "some text here", "a"), (2, "more", "a")]), root).first()["name"]
    path = f"{root.removeprefix('file://')}/{name}"
    raw = bytearray(open(path, "rb").read())
    raw[12] ^= 1
    open(path, "wb").write(bytes(raw))
    reader = tokenfiles.ShardReader(root, name)
    with pytest.raises(Exception):  # noqa: B017
        reader.frame(0)
    assert np.frombuffer(reader.frame(1), "<u4")[-1] == 2


def test_added_tokens_stay_whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfiles.vocabulary_path())
    e = "<|endoftext|>"
    some = [f"a {e} b", e, e + e, f"x{e}y", f" {e}  {e}\n", f"one two.{e}\n three", f"<|{e}|>", f"{e[:-1]} {e}", "plain text", "", f"a\n\n {e} \n b  c"]
    assert t.encode(some[0], add_special_tokens=False).ids.count(50256) == 1
    got = [b for part in tokenfiles.Encoder(tokenfiles.vocabulary_path()).encode(pa.array(some)) for b in part]
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [x.ids for x in t.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("cached", [800_000, 500])
def test_words_encode_apart(monkeypatch, texts, cached):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "CACHED_WORDS", cached)
    monkeypatch.setattr(tokenfiles, "SLICE_BYTES", 20_000)
    plain = Tokenizer.from_file(tokenfiles.vocabulary_path())
    e = tokenfiles.Encoder(tokenfiles.vocabulary_path())
    r = random.Random(9)
    some = ["".join(r.choice("abc'st.,?;12!  \t\n\n\x1c\x85\xa0\u2003\u3000é×ñ中—“<|>") for _ in range(r.randint(0, 40))) for _ in range(6000)]
    some += [f" {a}{b}{c}" for a in ("x", "é", "中", "'", "1") for b in ("\n", "\n\n", " \n", "\n ", ".", "'s", ",\n", "\u2028", " ") for c in ("y", " y", ".", "\u00a0z", "—", "")]
    some += texts
    want = [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]
    got = [np.frombuffer(b, "<u4").tolist() for part in e.encode(pa.array(some)) for b in part]
    assert got == want


def test_gru_counts(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs).select("doc_id", "text")
    held = F.coalesce(gru.bucket_of("doc_id", 10), F.lit(1)) == 0
    train = docs.where(~held)
    got = gru.score_documents(docs, train).collect()
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    count = Counter(w for r in train.collect() for w in tokens(r["text"]))
    total, distinct = sum(count.values()), len(count)
    norm = math.log10(total + 0.1 * (distinct + 1))
    want = sorted((repr(r["doc_id"]), len(tokens(r["text"])), sum(count[w] > 0 for w in tokens(r["text"])), round(sum(math.log10(count[w] + 0.1) - norm for w in tokens(r["text"])), 3)) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_gru_learns_from_every_document(spark, make_docs):
    text = "the cat sat on the mat and the dog sat on the cat"
    counts = Counter({int(h): c for h, c in gru.word_counts(make_docs([(1, text, "s")]).select("text")).collect()})
    words, numbers = (np.array(x) for x in zip(*counts.most_common(), strict=True))
    v = gru.Vocabulary.build(words.astype(np.int64).view(np.uint64), numbers, int(numbers.sum()), len(words))
    start = gru.flat_params(gru.start_params(v))
    for k in (1, 2, 3, None):
        assert not np.array_equal(gru.flat_params(gru.trained(make_docs([(k, text, "s")], 1), v)), start)


def test_gru_probabilities_sum_to_one():
    v = gru.Vocabulary.build(np.arange(1, 9001, dtype=np.uint64), np.arange(9000, 0, -1), 9000 * 9001 // 2, 9000)
    p = gru.start_params(v)
    h = np.random.default_rng(0).standard_normal((1, gru.WIDTH)).astype(np.float32)
    ids = np.arange(gru.SHORT + gru.BANDS)
    share = np.exp(gru.output(p, np.repeat(h, len(ids), 0), ids))
    assert abs(share.sum() - 1) < 1e-4
    for band in range(gru.BANDS):
        own = v.counts[v.ids == gru.SHORT + band]
        unknown = band == gru.BANDS - 1
        assert math.isclose(sum(own + 0.1) + 0.1 * unknown, v.band_norms[band], abs_tol=1e-9)
    found, counts = v.find(np.arange(0, 9010, dtype=np.uint64))
    assert counts[1:9001].tolist() == list(range(9000, 0, -1)) and (counts[[0, 9001, 9009]] == -1).all()
    assert found[1 : gru.SHORT].tolist() == list(range(gru.SHORT - 1)) and (found[[0, 9001]] == gru.SHORT + gru.BANDS - 1).all()


def test_gru_score_step_by_step(spark, make_docs, monkeypatch):
    """The score of every document against one that is computed word by word in double precision."""
    r = random.Random(6)
    train = make_docs([(k, " ".join(f"w{int(r.paretovariate(0.7)) % 6000}" for _ in range(r.randint(0, 700))), "s") for k in range(60)])
    probe = make_docs([(1, "w1 W2 w3 w1 w5999", "s"), (2, None, "s"), (3, "never seen words w4", "s"), (4, " ".join(f"w{k % 50}" for k in range(400)), "s")])
    kept = {}
    monkeypatch.setattr(gru, "trained", lambda docs, v, real=gru.trained: kept.setdefault("p", kept.setdefault("v", v) and real(docs, v)))
    got = {x["doc_id"]: x["score"] for x in gru.score_documents(probe, train).collect()}
    p, v = {k: x.astype(np.float64) for k, x in kept["p"].items()}, kept["v"]
    count = Counter(w for x in train.collect() for w in [*WORD.findall(lower(x["text"])), None])
    hashes = lambda words: [int(h) for h in gru.X.span_hashes(*gru.X.flat(pa.array([" ".join(words)]))[:1], *gru.X.word_spans(*gru.X.flat(pa.array([" ".join(words)])))[:2], True)] if words else []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    size = gru.WIDTH
    for x in probe.collect():
        words = WORD.findall(lower(x["text"]))
        h, last, total = np.zeros(size), gru.BOS, 0.0
        for word, name in zip([*words, None], [*hashes(words), int(gru.END)], strict=True):
            a, g = p["emb"][last] @ p["w"] + p["b"], h @ p["u"]
            z, q = sigmoid(a[:size] + g[:size]), sigmoid(a[size : 2 * size] + g[size : 2 * size])
            h = z * h + (1 - z) * np.tanh(a[2 * size :] + q * g[2 * size :])
            last = int(v.find(np.array([name], np.uint64))[0][0])
            logits = h @ p["cw"] + p["cb"]
            cls = last // gru.CLASS if last < gru.SHORT else last - gru.SHORT + gru.CLASSES
            total += logits[cls] - np.log(np.exp(logits).sum())
            if last < gru.SHORT:
                inner = p["ww"][cls * gru.CLASS : (cls + 1) * gru.CLASS] @ h + p["wb"][cls * gru.CLASS : (cls + 1) * gru.CLASS]
                total += inner[last % gru.CLASS] - np.log(np.exp(inner).sum())
            else:
                total += np.log((count[word] + 0.1) / v.band_norms[last - gru.SHORT])
        assert math.isclose(got[x["doc_id"]], total / math.log(10), rel_tol=2e-4)


LONG_TEXT = """
import numpy as np
from tessera.llm import gru
v = gru.Vocabulary.build(np.arange(1, 9001, dtype=np.uint64), np.arange(9000, 0, -1), 9000 * 9001 // 2, 9000)
lengths = np.array([1_000_000, *[20] * 300])
ids = np.random.default_rng(4).integers(0, gru.SHORT + gru.BANDS, lengths.sum())
offsets = np.concatenate([[0], np.cumsum(lengths)])
trainer = gru.Trainer(gru.start_params(v))
trainer.train(ids, offsets)
assert all(np.isfinite(x).all() for x in trainer.p.values())
assert np.isfinite(gru.log_probs(trainer.p, ids, offsets)).all()
print(next(x.split()[1] for x in open("/proc/self/status") if x.startswith("VmHWM")))
"""


def test_gru_long_text_among_short_ones():
    """A text of a million words next to 300 short ones takes less than a GB."""
    done = subprocess.run([sys.executable, "-c", LONG_TEXT], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) < 1_000_000


def test_gru_gradient():
    v = gru.Vocabulary.build(np.arange(1, 9001, dtype=np.uint64), np.arange(9000, 0, -1), 9000 * 9001 // 2, 9000)
    rng = np.random.default_rng(1)
    p = {k: x.astype(np.float64) for k, x in gru.start_params(v).items()}
    x, y = rng.integers(0, gru.SHORT + 1, (5, 3)), rng.integers(0, gru.SHORT + 1, (5, 3))
    live, new = np.ones((5, 3), bool), np.zeros((5, 3), bool)
    new[0] = new[3, 1] = True
    held = {}
    t = gru.Trainer(p)
    t.update = lambda g: held.update(g)
    t.window(np.zeros((3, gru.WIDTH)), x, y, live, new)

    def loss(q):
        h, total = np.zeros((3, gru.WIDTH)), 0.0
        for s in range(5):
            h = np.where(new[s][:, None], 0, h)
            a, g = q["emb"][x[s]] @ q["w"] + q["b"], h @ q["u"]
            w = gru.WIDTH
            zr = 1 / (1 + np.exp(-(a[:, : 2 * w] + g[:, : 2 * w])))
            m = np.tanh(a[:, 2 * w :] + zr[:, w:] * g[:, 2 * w :])
            h = m + zr[:, :w] * (h - m)
            total -= gru.output(q, h, y[s]).sum()
        return total / 15

    for k in ("u", "w", "b", "cw"):
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        q = {n: z.copy() for n, z in p.items()}
        q[k][at] += 1e-4
        up = loss(q)
        q[k][at] -= 2e-4
        assert abs((up - loss(q)) / 2e-4 - held[k][at]) < 2e-4


def test_state_is_carried_across_windows():
    v = gru.Vocabulary.build(np.arange(1, 9001, dtype=np.uint64), np.arange(9000, 0, -1), 9000 * 9001 // 2, 9000)
    p = gru.start_params(v)
    ids = np.random.default_rng(2).integers(0, gru.SHORT, 500)
    alone = gru.log_probs(p, ids, np.array([0, 500]))
    among = gru.log_probs(p, np.concatenate([ids[:90], ids, ids[:7]]), np.array([0, 90, 590, 597]))
    assert np.allclose(alone, among[90:590], atol=1e-4)


def long_words():
    r = random.Random(1)
    low, base = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    yield "".join(r.choice(low) for _ in range(1_000_000))
    yield "".join(r.choice(base) for _ in range(300_000)) + " tail"
    yield "a" * 30_001 + "ab" * 9_000 + "the" * 7_000 + "中" * 5_000 + "." * 9_999 + "é" * 6_000 + "=-" * 8_000
    yield " " * 9_000 + "x" + " " * 70_000 + "y" * 5_000
    yield "".join(r.choice(["the", "ing", "tion", "ation", "...", "00", "000", "▁"]) for _ in range(20_000))


def test_pieces_of_long_words():
    """Up to a million characters without a space, as the library has them, in a time that grows with the length."""
    path = pieces.model_path()
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    began = time.perf_counter()
    for t in long_words():
        assert np.frombuffer(m.encode_batch([t])[0], "<u4").tolist() == sp.encode(t)
    assert time.perf_counter() - began < 60


def test_buckets_of_rank_and_rounds_agree(monkeypatch, texts):
    """Every word by both ways of bookkeeping."""
    path = pieces.model_path()
    by_rounds = pieces.PieceModel(path).encode_batch(texts[:40])
    monkeypatch.setattr(pieces, "LONG", 1)
    assert pieces.PieceModel(path).encode_batch(texts[:40]) == by_rounds
    monkeypatch.setattr(pieces, "FEW", 0)
    assert pieces.PieceModel(path).encode_batch(texts[:40]) == by_rounds
