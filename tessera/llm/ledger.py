"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a file is named by the SHA-256 of its text.  The ledger is a
folder of Parquet batches: a row says which rules (by name and version) have
looked at a blob, and what they found.  A scan

1. addresses all versions, without keeping their texts,
2. finds the pairs of blob and rule version that no batch holds, one version of
   each such blob being its reader,
3. reads the texts again, keeps the readers' and runs what their blobs lack,
4. appends the findings as one batch, which counts only once it is whole,
5. joins the findings back to all versions.

So a blob that stands in a thousand paths, commits or documents is scanned
once, a second scan of the same history scans nothing, and a rule that gets a
new version looks at every blob again while the others do not.

Spans are in code points, the end exclusive.  Null texts are empty ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textops as X
from tessera.llm.common import Scratch, bounded_batches, documents, shared_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters; the pattern means the same to re and to RE2."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the three base kinds, and public token formats.  In ``hex`` and ``access`` a match is a
#: whole run, so the least length stands in the pattern.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
)
BASE = ("assign", "access", "hex")

BATCH = "blob string, rules array<string>, found array<struct<rule:string,start:int,end:int>>"
SPANS = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """The rule's spans in one text."""
    found = re.compile(rule.pattern, re.ASCII).finditer(text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scanner(rules: tuple[Rule, ...]):
    """Rows (blob, rules, found) of (blob, rules, text); a blob that a task meets twice is scanned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            new = np.array([b not in seen and not seen.add(b) for b in blobs], bool)
            batch = batch.filter(pa.array(new, pa.bool_()))
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for i, j in X.slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])):
                part = batch.slice(i, j - i)
                asked, texts = part.column(1).to_pylist(), part.column(2)
                found: list[list[tuple]] = [[] for _ in asked]
                for rule in rules:
                    # RE2 finds the texts with a match in one linear pass; only these are searched for spans
                    for k in np.flatnonzero(pc.match_substring_regex(texts, rule.pattern).to_numpy(zero_copy_only=False)):
                        if rule.name in asked[k]:
                            found[k] += [(rule.name, *s) for s in spans(texts[k].as_py(), rule)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, SPANS)], names=["blob", "rules", "found"])

    return run


class BlobLedger:
    """Findings by blob under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[str]:
        """Folders of the batches that were written to their end."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def findings(self) -> DataFrame:
        """All rows (blob, rules, found); a blob has one for each batch that looked at it."""
        batches = self.batches()
        read = self.spark.read.schema(BATCH)
        return read.parquet(*batches) if batches else self.spark.createDataFrame([], BATCH)

    def missing(self, blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blobs`` (a row per blob) with ``rules``, the names of those that no batch has run on it; rows without any are left out."""
        asked = F.array(*[F.lit(r.name) for r in rules])
        if not self.batches():
            return blobs.withColumn("rules", asked)
        done = self.findings().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        lacks = F.array_except(asked, F.coalesce("done", F.array().cast("array<string>")))
        return blobs.join(done, "blob", "left").withColumn("rules", lacks).drop("done").where(F.size("rules") > 0)

    def scan(self, docs: DataFrame, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """A row per row of ``docs``: ``version`` (a struct of its keys), ``blob`` and ``found``.

        found is array<struct<start, kind, end, place>> by start, then by the place of the kind in ``rules``;
        only findings of the rules' present versions stand in it.  Repeated and null keys are rows like others.
        """
        spark = self.spark
        bounded_batches(spark)
        scratch = Scratch(spark)
        version = F.struct(*[F.col(f"`{k}`") for k in keys])
        pick = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
        whole = F.col(f"`{text}`")
        versions = scratch.staged(docs.select(version.alias("version"), blob_of(whole).alias("blob"), pick.alias("pick")))
        lacks = self.missing(versions.groupBy("blob").agg(F.min("pick").alias("pick")), rules)
        texts = docs.select(blob_of(whole).alias("blob"), pick.alias("pick"), F.coalesce(whole, F.lit("")).alias("text"))
        # the small side is hashed, so texts are dealt but not sorted
        todo = texts.join(lacks.hint("shuffle_hash"), ["blob", "pick"]).select("blob", "rules", "text")
        todo.mapInArrow(_scanner(rules), BATCH).write.parquet(f"{self.path}/{shared_dir(spark).rsplit('/', 1)[1]}")

        place = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
        kind = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
        now = F.filter("found", lambda s: s["rule"].isin(*[r.name for r in rules]))
        hits = self.findings().where(F.size("found") > 0).select("blob", now.alias("found")).where(F.size("found") > 0)
        # a blob that two scans looked at together has equal findings twice: a set of them
        hits = hits.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
        by_start = F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["rule"]).alias("place"), F.element_at(kind, s["rule"]).alias("kind"), s["end"].alias("end")))
        hits = hits.select("blob", F.array_sort(by_start).alias("found"))
        out = versions.join(hits, "blob", "left").select("version", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")).alias("found"))
        out = scratch.staged(out)
        scratch.paths.pop()
        scratch.clear()
        return out


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def op11_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new ledger at each call, so that no result depends on an earlier one."""
    ledger = BlobLedger(spark, shared_dir(spark))
    out = ledger.scan(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return out.select("version.doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _kind_sql(k: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (
        f"SELECT r, {k} AS place, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{pattern}') AS m, "
        f"regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d"
    )


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), k AS (
  {" UNION ALL ".join(_kind_sql(k, r) for k, r in enumerate(RULES))}
), i AS (
  SELECT r, place, kind, least, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM k
), s AS (
  SELECT r, place, kind, length(v[i]) >= least AS ok, length(m[i]) AS n,
    list_sum(list_transform(g[1 : i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)::BIGINT AS a FROM i
), f AS (
  SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place) AS spans
  FROM s WHERE ok GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)
"""
