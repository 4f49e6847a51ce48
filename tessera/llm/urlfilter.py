"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

A rule names a host and the start of a path; it fits its host and all
subdomains, and the longest rule wins.  URLs that a rule judges are labelled by
it, and train the trees; the trees judge the rest.  Features are lexical:
lengths, depth, digit ratio, character entropy, parameter counts, and the
smoothed block rate of the host's last label among the training URLs.

Everything is DataFrame operations and JVM-side MLlib.  The fit uses at most
TRAIN_ROWS distinct labelled URLs, by hash order.  Null URLs, and URLs
without "://", have an empty host and path and are judged by the trees.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, staged

#: (rule, verdict) as the contract lists them; a rule is a host and a path's start.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
TRAIN_ROWS, TREES, DEPTH = 20_000, 12, 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The URL's host, A-Z lower-cased, and its path; both empty without a URL or "://"."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def features(url: Column, host: Column, path: Column) -> list[Column]:
    """The lexical features but the suffix's rate; a null URL is empty."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (n - F.length(F.replace(u, c))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    made = [
        n,
        F.length(host),
        F.length(path),
        count(path, "/[^/]"),
        count(host, "[^.]+"),
        F.when(n > 0, count(u, "[0-9]") / n).otherwise(0.0),
        F.when(n > 0, entropy).otherwise(0.0),
        F.when(query == "", 0.0).otherwise(1 + count(query, "&")),
        F.length(query),
        count(u, "[-_]"),
        u.startswith("https://"),
        u.contains("#"),
        F.length(suffix_of(host)),
    ]
    return [c.cast("double") for c in made]


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def _parsed(urls: DataFrame, rules: tuple) -> DataFrame:
    """``urls`` with host, path, rule, label (the rule's verdict) and suffix of the column url."""
    host, path = host_and_path(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, label = rule_for(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", rule).withColumn("label", label).withColumn("suffix", suffix_of(F.col("host")))


def _vectors(urls: DataFrame, rates: DataFrame, mean: float) -> DataFrame:
    """``urls`` with the column features; ``rates`` has (suffix, rate)."""
    filled = urls.join(rates, "suffix", "left")
    made = [*features(F.col("url"), F.col("host"), F.col("path")), F.coalesce("rate", F.lit(mean))]
    return filled.withColumn("features", array_to_vector(F.array(*made)))


def train_trees(urls: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[GBTClassificationModel | str, DataFrame | None, float]:
    """Trees, suffix rates and the share of blocked ones, from at most ``train_rows`` distinct URLs that a rule judges.

    With one verdict among them the trees are that verdict, and "allow" without any.
    """
    known = urls.where("label IS NOT NULL").groupBy("url").agg(*[F.first(c).alias(c) for c in ("host", "path", "suffix", "label")])
    known = known.withColumn("label", (F.col("label") == "block").cast("double"))
    # at most train_rows rows
    sample = staged(known.orderBy(F.xxhash64("url"), F.col("url")).limit(train_rows).coalesce(1))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return "block" if 1.0 in counts else "allow", None, 0.0
    mean = counts[1.0] / sum(counts.values())
    rates = staged(sample.groupBy("suffix").agg(((F.sum("label") + mean) / (F.count("*") + 1)).alias("rate")))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False)
    return trees.fit(_vectors(sample, rates, mean).select("label", "features")), rates, mean


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the rule's, or the trees' where no rule fits.

    Every row is judged by itself, so repeated URLs get one verdict; the trees learn each distinct URL once.
    URLs of any length are read whole.  Columns of ``pages`` by the names of the new ones are replaced; all
    others come back as they are.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    urls = _parsed(pages.select(F.struct(*kept).alias("page"), F.col(f"`{url}`").alias("url")), rules)
    trees, rates, mean = train_trees(urls, train_rows)
    if isinstance(trees, str):
        judged = urls.withColumn("verdict", F.coalesce("label", F.lit(trees)))
    else:
        judged = trees.transform(_vectors(urls, rates, mean))
        judged = judged.withColumn("verdict", F.coalesce("label", F.when(F.col("prediction") > 0, "block").otherwise("allow")))
    return judged.select("page.*", *new)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
