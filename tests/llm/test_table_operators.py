"""Toxicity, chat, mixture, URLs, embeddings, components and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import caps, chat, mixture, toxicity, urlfilter
from tessera.llm import queries as registry
from tessera.llm import textops as X
from tessera.llm.components import components


def plain_rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: "~" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return [names[k] for k in order], sorted([show(r[k]) for k in order] for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, sf, duck, name):
    df, found = registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLE[name])
    assert plain_rows(df.columns, df.collect()) == plain_rows(found.columns, found.fetchall())


def brute_kernel(s, t, decay=toxicity.DECAY):
    def feature(x):
        out = defaultdict(float)
        for c in itertools.combinations(range(len(x)), 3):
            out[tuple(x[i] for i in c)] += decay ** (c[-1] - c[0] + 1)
        return out

    a, b = feature(s), feature(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_kernel():
    r = random.Random(3)
    for _ in range(30):
        s, t = ([r.randrange(1, 5) for _ in range(6)] for _ in range(2))
        assert math.isclose(toxicity.kernel(np.array([s]), np.array([t]))[0], brute_kernel(s, t), rel_tol=1e-5, abs_tol=1e-7)


def labelled():
    r = random.Random(1)
    clean = ["".join(r.choice(("an", "the", "or", "in", "wh", "st", "ou")) for _ in range(r.randint(1, 4))) for _ in range(400)]
    bad = ("wretchomund", "skrabblig", "fozzlewick")
    rows = []
    for k in range(500):
        w = [r.choice(clean) for _ in range(r.randint(4, 40))]
        toxic = k % 4 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((" ".join(w), int(toxic)))
    return rows


def test_toxicity_separates_and_tolerates():
    rows = labelled()
    m = toxicity.fit([t for t, _ in rows[:300]], np.array([y for _, y in rows[:300]]))
    data, offsets = X.flat(pa.array([t for t, _ in rows[300:]]))
    y = np.array([y for _, y in rows[300:]])
    assert ((m.scores(data, offsets) >= toxicity.THRESHOLD) == y).mean() > 0.98
    hidden = ["the s k r a b b l i g one", "an skrab-blig in", "or fozzlewwick the", "the wretchomundo"]
    assert (m.scores(*X.flat(pa.array(hidden))) > 0.5).all()
    assert (m.scores(*X.flat(pa.array(["", "the in or", "a b"]))) < 0.5).all()


def test_toxicity_without_labels_of_both_kinds():
    assert toxicity.fit([], np.array([])).scores(*X.flat(pa.array(["x"]))).tolist() == pytest.approx([0.0], abs=1e-6)
    assert toxicity.fit(["some text"], np.array([0])).scores(*X.flat(pa.array(["some text", ""]))).max() < 0.01


def test_toxicity_in_spark(spark, sf, odd_docs, no_docs):
    out = toxicity.op1_toxicity(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    m = toxicity.Model(np.zeros(toxicity.CODES**3, np.float32), -1.0, 1.0, 0.0)
    assert toxicity.score_toxicity(odd_docs.withColumn("score", F.lit("clash")), m).where("score IS NULL").count() == 0
    assert toxicity.score_toxicity(no_docs, m).count() == 0
    assert toxicity.toxicity_stage(spark, odd_docs, sf).columns == odd_docs.columns


def test_toxicity_uses_no_held_out_label(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    told = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    a = toxicity.training_texts(docs, told)
    ids = {r[0] for r in told.collect()}
    assert sorted(a[0]) == sorted(r["text"] for r in docs.collect() if r["doc_id"] in ids and r["text"] is not None)


def test_toxicity_is_fitted_in_a_task(spark, sf, no_docs, monkeypatch):
    """The model is that of the same texts fitted here, and the driver's process doesn't fit it."""
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    here = toxicity.fit(*toxicity.training_texts(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)))
    there = toxicity.trained(spark, sf, docs)
    assert np.allclose(here.weights, there.weights) and (here.bias, here.slope, here.offset) == pytest.approx((there.bias, there.slope, there.offset))
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: toxicity.Model(np.zeros(1, np.float32), float(os.getpid()), 1.0, 0.0))
    assert toxicity.trained(spark, sf, docs).bias != os.getpid()
    monkeypatch.undo()
    assert toxicity.trained(spark, sf, no_docs).bias == 0


def test_toxicity_sample_bounds(spark, make_docs):
    """Missing and repeated documents take no place of the sample, and a long text is learnt from like any other."""
    rows = [(k, "x" * (50_000 if k == 3 else 5 + k), "s") for k in range(40)] + [(5, "xy" * 40, "s")] * 30 + [(None, "x", "s"), (7, None, "s")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (8, None)], "doc_id long, toxic int")
    docs = make_docs(rows)
    texts, y = toxicity.training_texts(docs, labels, per_label=15)
    assert len(texts) == 30 and sum(y) == 15
    texts, y = toxicity.training_texts(docs, labels)
    assert len(texts) == 40 and "x" * 50_000 in texts and "x" * 10 in texts
    assert 2 <= len(toxicity.training_texts(docs, labels, chars=40)[0]) < 20


def test_toxicity_finds_a_long_disguise_at_every_place():
    rows = labelled()
    m = toxicity.fit([t for t, _ in rows], np.array([y for _, y in rows]))
    disguised = "wretxchoqmunzd"
    score = lambda texts: m.scores(*X.flat(pa.array(texts)))
    assert score([disguised])[0] > 0.5
    for size in (len(disguised), 20):
        hidden = disguised.ljust(size, "q")
        for k in range(30):
            text = "ou" * 12 + "o" * k + hidden + "an" * 20
            p = 24 + k
            around = [text[i : i + toxicity.WINDOW] for i in range(p + size - toxicity.WINDOW, p + 1)]
            assert score([text])[0] >= score(around).min() - 1e-9


TURNS = "conv_id long, turn long, role string, text string, window int, mask string"


def test_chat_round_trip(spark):
    rows = []
    r = random.Random(2)
    for conv in (1, 2, 3, None):
        if conv != 2:
            rows.append((conv, 0, "system", "be <|im_end|> brief & &amp; kind", 0, ""))
        for turn in range(1, r.randint(3, 40)):
            text = " ".join(r.choice(("a", "<|im_start|>", "&lt;|", "ñ中", "x<", "|y", "\n")) for _ in range(r.randint(0, 90)))
            rows.append((conv, turn, "assistant" if turn % 2 == 0 else "user", text, 0, ""))
    rows += [(7, 0, "system", "alone", 0, ""), (8, None, None, None, 0, ""), (9, 1, "to\nol", "t", 0, ""), (9, 1, "to\nol", "t", 0, "")]
    w = chat.format_chats(spark.createDataFrame(rows, TURNS))
    out = {x["conv_id"]: x for x in chat.read_chats(w).collect()}
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert out[c]["n_turns"] == len(turns)
        assert out[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert out[c]["loss_chars"] == len(loss) and out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for x in w.collect():
        assert x["tokens"] <= chat.BUDGET or x["n_new"] == 1
        assert all(x["formatted"][m["start"] - 1] == "\n" for m in x["mask"])
    assert w.where("window > 1 AND n_system = 1 AND n_history > 0").count() > 0
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_mixture(spark, sf, odd_docs, no_docs, make_docs):
    r = random.Random(5)
    docs = make_docs([(k, " ".join(["w"] * r.choice((1, 5, 40, 300))), None if k % 7 == 0 else f"s{k % 5}") for k in range(3000)])
    out = mixture.mix_copies(docs.withColumn("copies", F.lit("clash")))
    sums = out.groupBy("source").agg(F.sum("size").alias("s"), F.max("source_size").alias("ss"), F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken")).orderBy(F.col("source").asc_nulls_last()).collect()
    total = sum(x["s"] for x in sums)
    assert math.isclose(sum(x["t"] for x in sums), 1.5 * total)
    open_ = {round(x["t"] / w, 6) for x, w in zip(sums, itertools.cycle((3, 1, 2))) if x["t"] < 2 * x["s"]}
    assert len(open_) == 1
    for x in sums:
        assert x["s"] == x["ss"] and x["t"] <= 2 * x["s"] and abs(x["taken"] - x["t"]) <= 300
    assert {x[0] for x in out.select("copies").distinct().collect()} <= {0, 1, 2}
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, mixture.mix_copies(docs.repartition(5)).select(*out.columns).collect()), key=repr)
    assert mixture.mix_copies(odd_docs).count() == odd_docs.count()
    assert mixture.mixture_stage(spark, odd_docs, sf).columns == odd_docs.columns
    assert mixture.mix_copies(no_docs).count() == 0


URLS = [
    ("https://Example.COM/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1?x=/y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://a.com", "a.com", "", None, None),
    ("https://a.com?x=://b/c", "a.com", "", None, None),
    ("https://b.net/es/1#top", "b.net", "/es/1", "net/es/", "block"),
    ("https://b.net/es", "b.net", "/es", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_urls(spark):
    many = [(100 + k, f"https://h{k}.com/a{k}") for k in range(30)] + [(200 + k, f"http://free-bets{k}.net/fr/{k}?a=1&b=2") for k in range(30)]
    pages = spark.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)] + many, "page_id long, url string").withColumn("host", F.lit(3))
    out = {r["page_id"]: r for r in urlfilter.judge_urls(pages).collect()}
    assert len(out) == len(URLS) + 60
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == (host, path, rule)
        assert out[k]["verdict"] == verdict or (verdict is None and out[k]["verdict"] in ("allow", "block"))
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
    one = urlfilter.judge_urls(spark.createDataFrame([(1, "https://a.com/x"), (2, "zzz")], "page_id long, url string")).collect()
    assert {r["verdict"] for r in one} == {"allow"}


def plain_features(u, host, path):
    n, query = len(u), (re.search(r"\?([^#]*)", u) or ["", ""])[1]
    share = [u.count(c) / n for c in set(u)]
    return [
        n, len(host), len(path), len(re.findall("/[^/]", path)), len(re.findall("[^.]+", host)), sum(c in "0123456789" for c in u) / n if n else 0.0,
        -sum(x * math.log2(x) for x in share), 1 + query.count("&") if query else 0.0, len(query), sum(c in "-_" for c in u), float(u.startswith("https://")),
        float("#" in u), len(host.rsplit(".", 1)[-1]),
    ]


def test_url_verdicts_by_plain_features_and_trees(spark, sf):
    """Verdicts without a rule against features computed in Python and trees walked node by node."""
    clash = {c: F.lit(7.0) for c in ("f_length", "f_suffix_rate", "label", "features", "suffix", "rate", "prediction", "page", "verdict")}
    long = [(-1, "https://x.org/" + "a1/" * 30_000), (-2, None), (-3, ""), (-4, "https://x.org/"), (-5, "https://x.org/")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(long, "page_id long, url string")).withColumns(clash)
    out = urlfilter.judge_urls(pages)
    assert out.columns == [*[c for c in pages.columns if c != "verdict"], "host", "path", "rule", "verdict"]
    assert out.where("f_length <> 7 OR f_suffix_rate <> 7 OR label <> 7 OR page <> 7").count() == 0
    trees, rates, mean = urlfilter.train_trees(urlfilter._parsed(pages.select("url"), urlfilter.RULES))
    rate = {r["suffix"]: r["rate"] for r in rates.collect()}
    walk = []
    for tree in trees.trees:
        node = tree._call_java("rootNode")
        walk.append(node)

    def value(node, x):
        while node.subtreeDepth() > 0:
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    judged = out.where("rule IS NULL").collect()
    assert len(judged) > 20 and {r["verdict"] for r in judged if (r["page_id"] or 0) <= -4} != set()
    for r in judged[:40] + [r for r in judged if r["page_id"] < 0]:
        x = [*plain_features(r["url"] or "", r["host"], r["path"]), rate.get(r["host"].rsplit(".", 1)[-1], mean)]
        total = sum(w * value(n, x) for w, n in zip(trees.treeWeights, walk, strict=True))
        assert r["verdict"] == ("block" if total > 0 else "allow")
    assert len({r["verdict"] for r in judged if r["url"] == "https://x.org/"}) == 1


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    k = 100
    for v in base[:6]:
        for c in (0.97, 0.99, 0.999):
            for _ in range(9):
                noise = rng.standard_normal(24)
                noise -= noise @ v / (v @ v) * v
                rows.append((k, (c * v / np.linalg.norm(v) + math.sqrt(1 - c * c) * noise / np.linalg.norm(noise)).tolist()))
                k += 1
    rows += [(k + j, rows[0][1]) for j in range(40)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [math.nan] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [math.inf] * 24), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"])) for r in caps.embedding_groups(df).collect())
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links, root = defaultdict(int), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(ok, 2):
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((repr(d), links[i], repr(least.get(find(i)))) for i, (d, _) in enumerate(rows))
    found, whole = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found <= whole and found >= 0.99 * whole
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert caps.embedding_groups(df.limit(0)).count() == 0


def test_embeddings_of_few_components(spark):
    rng = np.random.default_rng(8)
    rows = []
    for dim in (2, 8, 16):
        base = rng.standard_normal((20, dim))
        rows += [v + e * 0.2 / math.sqrt(dim) * np.linalg.norm(v) for v in base for e in [np.zeros(dim), *rng.standard_normal((15, dim))]]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    want = [sum(len(a) == len(b) and i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95 for j, b in enumerate(rows)) for i, a in enumerate(rows)]
    got = {r["vec_id"]: r["n_links"] for r in caps.embedding_groups(df).collect()}
    assert [got[k] for k in range(len(rows))] == want and all(any(want[k : k + 320]) for k in (0, 320, 640))


def test_pipeline(spark, sf, odd_docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "jaccard_join", "mixture", "pieces"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    ids = [r["doc_id"] for r in out.collect()]
    assert 0 < len(ids) and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    step = docs.unionByName(odd_docs)
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, sf)
        assert step.columns == docs.columns and step.dtypes == docs.dtypes


def test_entry_without_llm():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert sum(n.startswith("op") for n in __spark_entry__.queries()) == 13


def test_embeddings_of_any_magnitude(spark):
    """Finite vectors whose squares over- or underflow link as their directions do."""
    rng = np.random.default_rng(4)
    for dim in (24, 8):
        v = rng.standard_normal(dim)
        rows = [(k, (v * s).tolist()) for k, s in enumerate((1.0, 1e-170, 1e200, 3e-308))] + [(9, rng.standard_normal(dim).tolist())]
        out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert out == {**{k: (3, 0) for k in range(4)}, 9: (0, 9)}


#: Names that the operators of the stages give to columns of their own, now or before.
OWN_NAMES = (
    "size", "source_size", "target", "copies", "words", "copy", "row", "alike", "other", "key", "i", "j", "score", "kept", "n_words", "base_failed", "cls", "root", "component_id", "n", "m",
    "n_links", "count", "text_", "text__", "__text", "__k", "__k2", "__i", "__i2", "__copy", "__cls", "__of", "__id", "__root", "__row", "__src", "__bits", "__x", "__bin", "level", "a.b", "h", "y", "p1", "hot", "token", "hub", "group",
)


def test_stages_keep_every_column(spark, sf, odd_docs):
    """Columns by every internal name come through all stages with their values."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs)
    mark = lambda name: F.concat(F.lit(name + "="), F.coalesce(F.md5("text"), F.lit("none")))
    step = docs.select("*", *[mark(c).alias(c) for c in OWN_NAMES])
    names, types = step.columns, step.dtypes
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, sf)
        assert step.columns == names and step.dtypes == types, name
        step = spark.createDataFrame(step.toArrow())
        wrong = [F.count_if(~F.col(f"`{c}`").eqNullSafe(mark(c))).alias(str(k)) for k, c in enumerate(OWN_NAMES)]
        assert sum(step.agg(*wrong).first()) == 0 and step.count() > 100, name
    out = corpus_pipeline.STAGES[-1][1](spark, step, sf)
    assert out.count() == step.count()
