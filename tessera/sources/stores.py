"""Stores of JSON documents as Spark sources and sinks.

Documents are kept as JSON text, so a store needs no schema; the predicates of
``tessera.operators.filters`` read them.  Text that isn't JSON gives no row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "source string, doc string"


def _shown(text: Column) -> Column:
    """The text where it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _kind(text: Column) -> Column:
    """"{" for objects, "[" for arrays."""
    return F.substring(F.ltrim(F.regexp_replace(text, r"[\t\r\n]", " ")), 1, 1)


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def json_folder(spark: SparkSession, path: str, suffix: str = ".json", prefix: str = "") -> DataFrame:
    """(source, doc) of the files of a folder, one document a file; what isn't an object stands under ``_data``."""
    text = spark.read.option("pathGlobFilter", f"{prefix}*{suffix}").text(path, wholetext=True)
    docs = text.select(_name(F.col("_metadata.file_path")).alias("source"), _shown(F.col("value")).alias("doc")).where("doc IS NOT NULL")
    return docs.withColumn("doc", F.when(_kind(F.col("doc")) == "{", F.col("doc")).otherwise(F.concat(F.lit('{"_data":'), "doc", F.lit("}"))))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """(doc) of one file: an object is one row, an array one for each element, and anything else none."""
    text = spark.read.text(path, wholetext=True).select(_shown(F.col("value")).alias("doc"))
    many = F.transform(F.try_variant_get(F.try_parse_json("doc"), "$", "array<variant>"), lambda x: F.to_json(x))
    rows = F.when(_kind(F.col("doc")) == "[", many).when(_kind(F.col("doc")) == "{", F.array("doc"))
    return text.select(F.explode(rows).alias("doc"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc) of the lines of a folder's .jsonl and .json parts, however deep; files are split between tasks."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(path)
    return text.select(_shown(F.trim("value")).alias("doc")).where("doc IS NOT NULL")


def federation(stores: dict[str, DataFrame], first: str = "") -> DataFrame:
    """(store, doc) of the store named by a path's first segment; without such a store, of all."""
    chosen = {first: stores[first]} if first in stores else stores
    parts = [df.select(F.lit(name).alias("store"), "doc") for name, df in chosen.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remote_stores(spark: SparkSession, roots: list[str], read) -> DataFrame:
    """(source_url, doc) over the roots; one that can't be read gives no rows and leaves the others."""
    out = spark.createDataFrame([], "source_url string, doc string")
    for root in roots:
        try:
            out = out.unionByName(read(spark, root).select(F.lit(root).alias("source_url"), "doc"))
        except AnalysisException:
            continue
    return out


def lookup(stores: list[DataFrame], key: str, value: str) -> DataFrame:
    """(doc) of the first store, in their order, that holds the key's value."""
    ranked = None
    for k, df in enumerate(stores):
        part = df.where(F.get_json_object("doc", f"$.{key}") == value).select(F.lit(k).alias("k"), "doc")
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.orderBy("k", "doc").limit(1).select("doc")


def append_log(df: DataFrame, path: str, ts: str = "ts", pattern: str = "yyyy-MM") -> None:
    """Appends rows as JSON lines, one folder for each period of their time."""
    df.withColumn("period", F.date_format(ts, pattern)).write.mode("append").partitionBy("period").json(path)


def replace_table(df: DataFrame, path: str, archive: str | None = None) -> None:
    """Rewrites a store; the archive, named by its day, is kept beside it."""
    df.write.mode("overwrite").json(path)
    if archive:
        df.write.mode("append").json(archive)


def new_lines(spark: SparkSession, path: str, checkpoint: str, sink: str) -> None:
    """Moves the lines of files that came since the last call to ``sink``; the checkpoint holds the positions.

    A writer adds files rather than bytes, so each file is read once, also after lost executors.
    """
    text = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(path)
    docs = text.select(_shown(F.trim("value")).alias("doc")).where("doc IS NOT NULL")
    docs.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Levels of the interchange format by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def sarif_results(findings: DataFrame, tool: str) -> DataFrame:
    """(repo, rule_id, level, uri, line, reason, fingerprint) of findings (repo, family, type, severity, file, line, reason)."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.lower("severity")), F.lit("warning"))
    rule = F.concat_ws("/", F.lit(tool), "family", "type")
    reason = F.coalesce("reason", "type")
    mark = F.sha2(F.concat_ws("|", rule, "file", "type", reason), 256)
    return findings.select("repo", rule.alias("rule_id"), level.alias("level"), F.col("file").alias("uri"), F.when(F.col("line") > 0, F.col("line")).otherwise(1).alias("line"), reason.alias("reason"), mark.alias("fingerprint"))


def sarif_documents(findings: DataFrame, tool: str) -> DataFrame:
    """(repo, doc): one document for each repository, so that none grows with the estate."""
    r = sarif_results(findings, tool)
    at = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("reason").alias("text")).alias("message"), F.array(at).alias("locations"), F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct("level").alias("defaultConfiguration"))
    g = r.groupBy("repo").agg(F.sort_array(F.collect_list(result)).alias("results"), F.sort_array(F.collect_set(rule)).alias("rules"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), F.col("results"))
    return g.select("repo", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("doc"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, line_no, line) that unified diffs (diff_id, diff) add.

    Within a file a line's number is the start of its hunk and the lines
    before it in the hunk that aren't removed; a diff's lines stay in their row.
    """
    part = F.posexplode(F.split(F.concat(F.lit("\n"), "diff"), "\ndiff --git "))
    files = diffs.select("diff_id", part.alias("file_no", "text")).where("file_no > 0")
    files = files.withColumn("path", F.regexp_extract("text", r"^[^\n]*\sb/([^\n]+)", 1)).where("path <> ''")
    rest = lambda a: F.slice(a, F.lit(2), F.size(a))
    hunks = files.select("diff_id", "path", F.explode(rest(F.split("text", r"\n(?=@@)"))).alias("hunk"))
    lines = F.split("hunk", "\n")
    start = F.regexp_extract("hunk", r"^[^\n]*?\+(\d+)", 1).cast("long")
    body = F.filter(rest(lines), lambda x: ~x.startswith("-"))
    numbered = hunks.select("diff_id", "path", start.alias("start"), F.posexplode(body).alias("k", "line"))
    return numbered.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++")).select("diff_id", "path", (F.col("start") + F.col("k")).alias("line_no"), F.substring("line", 2, 2**31 - 1).alias("line"))


def dispatch(stores: dict[str, DataFrame], name: str) -> DataFrame:
    """The store of a name; one that isn't there is an error that says which there are."""
    if name not in stores:
        raise KeyError(f"unknown store {name!r}; there are {', '.join(sorted(stores))}")
    return stores[name]


def write_manifest(actions: DataFrame, path: str, archive: str, day: str, by: str = "strategy") -> DataFrame:
    """Replaces the pending manifest, keeps a copy under its day in the archive, and returns (strategy, n) of what was written."""
    actions.write.mode("overwrite").json(path)
    spark = actions.sparkSession
    written = spark.read.schema(actions.schema).json(path)
    written.withColumn("day", F.lit(day)).write.mode("append").partitionBy("day").json(archive)
    return written.groupBy(F.col(by).alias("strategy")).agg(F.count("*").alias("n"))
