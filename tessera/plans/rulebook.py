"""Registered queries of the rule table: loading, filters, and the scan of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import rulebook as R
from tessera.plans.content import _quoted
from tessera.plans.queries import query
from tessera.plans.stores import _fresh
from tessera.sources import views as V

#: id, category, severity, whether a fix exists, pattern.
TEXT_RULES = (
    ("mail-address", "privacy", "medium", False, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"), ("phone-number", "privacy", "medium", False, r"\+\d{1,2} \(\d{3}\) \d{3}-\d{4}"), ("card-number", "privacy", "high", False, r"\b\d{16}\b"), ("host-number", "network", "info", False, r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("key-assigned", "secret", "high", False, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\s*[:=]"""), ("long-hex", "secret", "critical", False, r"\b[0-9a-f]{32,}\b"), ("licence-line", "licence", "low", True, r"(?i)(?:licen[cs]ed under|all rights reserved|SPDX-License-Identifier|copyright \(c\))"),
    ("shouted", "style", "info", False, r"\b[A-Z]{12,}\b"), ("hashes", "style", "low", True, r"#{3,}"), ("dollars", "style", "low", True, r"\${3,}"),
)
PAGE_RULES = (
    ("advert", "junk", "low", True, r"<!-- ad \d+ -->"), ("tracker", "privacy", "medium", True, r"<script>[^<]{0,40}</?[a-z]+>[^<]{0,40}track\(\d+\)"), ("inline-style", "style", "info", True, r"<style>"), ("own-link", "style", "info", False, r"""(?i)<a\s+href=["']/[^"']*["']"""), ("ad-block", "junk", "low", True, r"""class=["']ad["']"""),
    ("paragraph", "style", "info", False, r"</?p>"), ("doctype", "style", "info", False, r"(?i)<!doctype html>"), ("mail-address", "privacy", "medium", False, TEXT_RULES[0][4]),
)


def _table(spark, d) -> str:
    """A folder with each rule once for each source of documents, as JSON lines; beside it, one with lines that are no rules, as many to each source."""
    path = _fresh(spark, "rules")
    rows = [(i, c, s, a, p, "review" if k % 2 else "report_only", [("review", "touches a licence" if k % 3 == 0 else "touches code")] + ([("report_only", "SPDX header")] if k % 4 == 0 else [])) for k, (i, c, s, a, p) in enumerate(TEXT_RULES)]
    rules = spark.createDataFrame(rows, R.RULE)
    sources = V.table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source")).distinct()
    made = rules.crossJoin(F.broadcast(sources)).withColumn("id", F.concat("id", F.lit("/"), "source"))
    made.repartition("source").drop("source").write.json(path)
    broken = [("{cut off",), ('{"category":"none"}',), ('{"id":"x","pattern":"(open"}',), ("[1]",)]
    spark.createDataFrame(broken, "value string").crossJoin(F.broadcast(sources)).select("value").write.text(f"{path}-broken")
    return path


def _one_each(spark, rules=TEXT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "id string, category string, severity string, auto_fixable boolean, pattern string")


def _counts_sql(rules=TEXT_RULES, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    rows = ", ".join(f"{{'rule': {_quoted(i)}, 'n': len(regexp_extract_all({text}, {_quoted(p)}))}}" for i, _, _, _, p in rules)
    return f"c AS (SELECT {key}, x.rule, x.n FROM (SELECT {key}, unnest([{rows}]) AS x FROM {table} WHERE {text} IS NOT NULL) WHERE x.n > 0)"


_META = "r(rule, category, severity, auto_fixable) AS (VALUES " + ", ".join(f"({_quoted(i)}, '{c}', '{s}', {str(a).lower()})" for i, c, s, a, _ in TEXT_RULES) + ")"


@query("x11_rule_scan", f"WITH {_counts_sql()} SELECT doc_id, rule, n FROM c")
def x11_rule_scan(spark, d):
    """How often each rule's pattern stands in each whole text."""
    found = R.scan(V.table(spark, d, "documents"), _one_each(spark), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "rule", "n")


@query("x12_page_scan", f"WITH {_counts_sql(PAGE_RULES, 'pages', 'page_id', 'html')} SELECT page_id, rule, n FROM c")
def x12_page_scan(spark, d):
    """The rules for pages, over their whole markup."""
    found = R.scan(V.table(spark, d, "pages"), _one_each(spark, PAGE_RULES), "page_id", "html")
    return found.select(F.col("key").alias("page_id"), "rule", "n")


@query("x11_catalogue_findings", f"WITH {_counts_sql()}, {_META} SELECT category, severity, count(DISTINCT doc_id) AS documents, sum(n)::BIGINT AS findings, count(DISTINCT doc_id) FILTER (auto_fixable) AS fixable FROM c JOIN r USING (rule) WHERE severity IN ('critical', 'high', 'low') GROUP BY category, severity")
def x11_catalogue_findings(spark, d):
    """Findings by category for a choice of severities: the catalogue is filtered before anything is scanned."""
    rules = _one_each(spark).where(F.col("severity").isin("critical", "high", "low"))
    found = R.scan(V.table(spark, d, "documents"), rules, "doc_id", "text").join(F.broadcast(rules.drop("pattern")), F.col("rule") == F.col("id"))
    fixable = F.countDistinct(F.when(F.col("auto_fixable"), F.struct("key"))).alias("fixable")
    return found.groupBy("category", "severity").agg(F.countDistinct(F.struct("key")).alias("documents"), F.sum("n").alias("findings"), fixable)


@query("x12_rule_loader", f"WITH {_META}, s AS (SELECT DISTINCT coalesce(source, 'none') AS source FROM documents) SELECT category, severity, auto_fixable, count(*) AS n FROM r, s GROUP BY ALL")
def x12_rule_loader(spark, d):
    """Rules read from a folder of documents, by what the catalogue is asked for."""
    rules, _ = R.load_rules(spark, _table(spark, d))
    return rules.groupBy("category", "severity", "auto_fixable").agg(F.count("*").alias("n"))


_CAPPED = "(" + ", ".join(_quoted(i) for k, (i, *_) in enumerate(TEXT_RULES) if k % 3 == 0) + ")"


@query("x12_rule_errors", "WITH s AS (SELECT DISTINCT coalesce(source, 'none') AS source FROM documents), v(why) AS (VALUES ('bad pattern'), ('no id'), ('no object'), ('no object')) SELECT why, count(*) AS n FROM s, v GROUP BY why")
def x12_rule_errors(spark, d):
    """Lines of a rules folder that are no rules are told, not dropped."""
    _, errors = R.load_rules(spark, _table(spark, d) + "-broken")
    return errors.groupBy("why").agg(F.count("*").cast("int").alias("n"))


@query("x12_licence_caps", f"WITH {_META}, s AS (SELECT DISTINCT coalesce(source, 'none') AS source FROM documents) SELECT rule || '/' || source AS id, 'touches a licence' AS \"when\" FROM r, s WHERE rule IN {_CAPPED}")
def x12_licence_caps(spark, d):
    rules, _ = R.load_rules(spark, _table(spark, d))
    return R.licence_caps(rules)
