"""Domain views over the supplied tables: what the stores of a governance system hold.

Each view is a DataFrame here and a DuckDB common table expression in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("rust", "zig", "c", "cpp", "elixir", "erlang", "gleam", "haskell", "ocaml", "idris", "javascript", "typescript", "rescript", "python", "ruby", "julia")
FAMILIES = {"rust": "systems", "zig": "systems", "c": "systems", "cpp": "systems", "elixir": "beam", "erlang": "beam", "gleam": "beam", "haskell": "functional", "ocaml": "functional", "idris": "functional", "javascript": "web", "typescript": "web", "rescript": "web", "python": "scripting", "ruby": "scripting", "julia": "scripting"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "false_positive").otherwise("success")
    checks = F.array(*map(F.lit, ("verified", "still_present", "scan_failed", "unverified")))
    return e.select("event_id", "ts", F.concat(F.lit("recipe-"), k % 20).alias("recipe_id"), F.concat(F.lit("repo-"), "user_id").alias("repo"), F.concat(F.lit("bot-"), F.col("event_id") % 5).alias("bot"), kind.alias("outcome"), F.element_at(checks, (F.col("event_id") % 4 + 1).cast("int")).alias("verification"))


def weak_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_brand")
    flag = F.col("l_returnflag")
    severity = F.when(flag == "R", "Critical").when(flag == "A", "High").when(F.col("l_linestatus") == "O", "Medium").otherwise("Low")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("repo-"), "l_suppkey").alias("repo"), F.col("p_type").alias("category"), F.col("p_name").alias("description"), severity.alias("severity"), F.col("p_brand").alias("location"), (F.col("l_discount") >= 0.09).alias("suppressed"), F.col("l_shipdate").alias("ts"))


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey < 20")
    return p.select(F.concat(F.lit("recipe-"), "p_partkey").alias("id"), (F.col("p_partkey") * 37 % 100 / 100.0).alias("confidence"), F.col("p_type").alias("target_category"), (F.col("p_partkey") % 2 == 0).alias("auto_fixable"))


def fingerprint(text):
    """Lower case, other characters to single dashes, trimmed, first 30 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, 30)


def severity_rank(severity):
    return F.when(severity == "Critical", 4).when(severity == "High", 3).when(severity == "Medium", 2).when(severity == "Low", 1).otherwise(0)


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weak_points(spark, sf_dir).where("NOT suppressed")
    return w.groupBy("category", fingerprint(F.col("description")).alias("fingerprint")).agg(F.count("*").alias("occurrences"), F.countDistinct("repo").alias("repos_affected"), F.max(severity_rank(F.col("severity"))).cast("long").alias("severity_rank"))


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("repo-"), F.col("o_custkey") % 50).alias("repo"), F.to_date("o_orderdate").alias("cycle")).agg(F.count("*").alias("weak_point_count"))


def workflow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    conclusion = F.when(status == "F", "failure").when(status == "O", "success").otherwise("pending")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("workflow_id"), F.col("o_orderdate").alias("created_at"), conclusion.alias("conclusion"))


def repo_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("s_nationkey") % 16 + 1).cast("int"))
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return s.select(F.concat(F.lit("repo-"), "s_suppkey").alias("repo"), language.alias("language")).withColumn("family", F.element_at(family, F.col("language")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "fixed").otherwise("dismissed")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("low")
    return o.select(F.col("o_orderkey").alias("alert_id"), F.concat(F.lit("repo-"), F.col("o_custkey") % 50).alias("repo"), state.alias("state"), severity.alias("severity"), F.col("o_orderdate").alias("created_at"))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by line; the line number starts at 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "line"))
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


_family = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items())
SQL = {
    "outcomes": """outcomes AS (SELECT event_id, ts, 'recipe-' || (k % 20) AS recipe_id, 'repo-' || user_id AS repo, 'bot-' || (event_id % 5) AS bot,
      CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'false_positive' ELSE 'success' END AS outcome,
      (['verified', 'still_present', 'scan_failed', 'unverified'])[(event_id % 4 + 1)::INT] AS verification
      FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))""",
    "weak_points": """weak_points AS (SELECT l_orderkey, l_linenumber, l_partkey, 'repo-' || l_suppkey AS repo, p_type AS category, p_name AS description,
      CASE WHEN l_returnflag = 'R' THEN 'Critical' WHEN l_returnflag = 'A' THEN 'High' WHEN l_linestatus = 'O' THEN 'Medium' ELSE 'Low' END AS severity,
      p_brand AS location, l_discount >= 0.09::DOUBLE AS suppressed, l_shipdate AS ts FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "recipes": """recipes AS (SELECT 'recipe-' || p_partkey AS id, (p_partkey * 37 % 100) / 100.0::DOUBLE AS confidence, p_type AS target_category, p_partkey % 2 = 0 AS auto_fixable FROM part WHERE p_partkey < 20)""",
    "patterns": """patterns AS (SELECT category, substr(trim(regexp_replace(lower(description), '[^a-z0-9]+', '-', 'g'), '-'), 1, 30) AS fingerprint, count(*) AS occurrences,
      count(DISTINCT repo) AS repos_affected, max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END)::BIGINT AS severity_rank
      FROM weak_points WHERE NOT suppressed GROUP BY 1, 2)""",
    "scan_history": """scan_history AS (SELECT 'repo-' || (o_custkey % 50) AS repo, o_orderdate::DATE AS cycle, count(*) AS weak_point_count FROM orders GROUP BY 1, 2)""",
    "workflow_runs": """workflow_runs AS (SELECT o_orderkey, o_custkey % 100 AS workflow_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE 'pending' END AS conclusion FROM orders)""",
    "repo_language": f"""repo_language AS (SELECT *, CASE language {_family} END AS family FROM (SELECT 'repo-' || s_suppkey AS repo, ([{", ".join(f"'{x}'" for x in LANGUAGES)}])[(s_nationkey % 16 + 1)::INT] AS language FROM supplier))""",
    "alerts": """alerts AS (SELECT o_orderkey AS alert_id, 'repo-' || (o_custkey % 50) AS repo, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'fixed' ELSE 'dismissed' END AS state,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity, o_orderdate AS created_at FROM orders)""",
    "file_lines": """file_lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""",
}
_NEEDS = {"patterns": ("weak_points",)}


def with_views(*names: str) -> str:
    """"WITH ..." of the views, in an order that lets one use another; queries append their own expressions."""
    wanted: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, ()), n):
            if m not in wanted:
                wanted.append(m)
    return "WITH " + ",\n".join(SQL[n] for n in wanted)
