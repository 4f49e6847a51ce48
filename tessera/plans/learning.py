"""Registered queries of prover models and of synthesised recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import provers as M
from tessera.operators.similar import jaro_pairs
from tessera.plans.queries import query
from tessera.plans.routing import _BOOK, recipe_book
from tessera.sources import views as V
from tessera.sources.views import with_views

_TRIED = ("z3", "coq", "lean", "agda", "vampire", "mizar", "odd")
_CASES = (*M.CLASSES, "unseen")


def _quoted(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _score_sql(name: str, names: tuple[str, ...]) -> str:
    return f"CASE WHEN list_contains({_quoted(names)}, {name}) THEN list_position({_quoted(names)}, {name}) / {len(names) + 1}.0::DOUBLE ELSE 1.0::DOUBLE END"


# attempts: one to an order.  Classes by customer, but every 4999th order is of a class of its own; the claim's text is as long as the price says
_ATTEMPTS = f"""t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4999 = 7 THEN 'rare' ELSE ({_quoted(M.CLASSES[:9])})[(o_custkey % 9 + 1)::INT] END AS class, ({_quoted(_TRIED)})[(o_orderkey % 7 + 1)::INT] AS prover,
  least(floor(o_totalprice)::BIGINT % 2500, 2000) / 2000.0::DOUBLE AS size, (o_orderkey * 37 % 100) / 100.0::DOUBLE AS confidence, log10(floor(o_totalprice)::BIGINT + 1) / 5.0::DOUBLE AS took, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS parent,
  CASE o_orderstatus WHEN 'O' THEN 1.0::DOUBLE WHEN 'F' THEN 0.0::DOUBLE WHEN 'P' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS y FROM orders),
x AS (SELECT *, {_score_sql('class', M.CLASSES)} AS f1, {_score_sql('prover', M.PROVERS)} AS f2 FROM t)"""


def attempts(spark, d) -> DataFrame:
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(n % 4999 == 7, "rare").otherwise(F.element_at(F.array(*map(F.lit, M.CLASSES[:9])), (c % 9 + 1).cast("int")))
    prover = F.element_at(F.array(*map(F.lit, _TRIED)), (n % 7 + 1).cast("int"))
    price = F.floor("o_totalprice").cast("long")
    claim = F.repeat(F.lit("x"), (price % 2500).cast("int"))
    outcome = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "P", "timeout")
    x = M.attempt_features(kind, prover, claim, n * 37 % 100 / 100.0, price, F.when(n % 3 == 0, n))
    return V.table(spark, d, "orders").select(n.alias("id"), kind.alias("class"), prover.alias("prover"), x.alias("x"), M.target(F.coalesce(outcome, F.lit("odd"))).alias("y"))


_Z = ("1.0::DOUBLE", "f1", "f2", "size", "confidence", "took", "parent")


def _models_sql() -> str:
    size = len(_Z)
    rows = ", ".join("[" + ", ".join([f"avg({a} * {b})" + (f" + {M.RIDGE}::DOUBLE" if i == j else "") for j, b in enumerate(_Z)] + [f"avg({a} * y)"]) + "]" for i, a in enumerate(_Z))
    parts = [f"{_ATTEMPTS}, g0 AS (SELECT class, count(*) AS n, [{rows}] AS m FROM x GROUP BY class HAVING count(*) >= 5 UNION ALL SELECT NULL, count(*), [{rows}] FROM x HAVING count(*) > 0)"]
    for k in range(1, size + 1):
        parts.append(f"g{k} AS (SELECT class, n, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / r[{k}]) ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m FROM g{k - 1})")
    centre = ", ".join(f"avg({z})" for z in _Z[1:])
    spread = ", ".join(f"avg({z} * {z}) - avg({z}) * avg({z})" for z in _Z[1:])
    parts.append(f"s AS (SELECT class, [{centre}] AS centre, [{spread}] AS spread FROM x GROUP BY class UNION ALL SELECT NULL, [{centre}], [{spread}] FROM x)")
    parts.append(f"w AS (SELECT g.class, g.n, list_transform(g.m, lambda r: r[{size + 1}]) AS w, centre, spread FROM g{size} g JOIN s ON s.class IS NOT DISTINCT FROM g.class)")
    return "WITH " + ", ".join(parts)


@query("m01_attempt_features", f"WITH {_ATTEMPTS} SELECT id, round(f1, 6) AS f1, round(f2, 6) AS f2, round(size, 6) AS f3, confidence AS f4, round(took, 6) AS f5, parent AS f6, y FROM x")
def m01_attempt_features(spark, d):
    """The six features of every attempt, and its target."""
    return attempts(spark, d).select("id", *[F.round(F.get("x", F.lit(k)), 6).alias(f"f{k + 1}") for k in range(M.FEATURES)], "y")


@query("m06_prover_models", f"{_models_sql()} SELECT coalesce(class, '*') AS class, n, " + ", ".join(f"round(w[{k + 1}], 5) AS w{k}" for k in range(7)) + " FROM w")
def m06_prover_models(spark, d):
    """The weights of each class's model, and of the one of all rows (*)."""
    return M.class_models(attempts(spark, d)).select(F.coalesce("class", F.lit("*")).alias("class"), "n", *[F.round(F.get("weights", F.lit(k)), 5).alias(f"w{k}") for k in range(7)])


_OFFERED = ("z3", "lean", "mizar", "nothing")
_ASKED = f"""o AS (SELECT c_custkey AS obligation, ({_quoted(_CASES)})[(c_custkey % 12 + 1)::INT] AS class, (abs(floor(c_acctbal)::BIGINT) % 2500) AS length, CASE WHEN c_custkey % 4 = 0 THEN {_quoted(_OFFERED)} ELSE {_quoted(M.KNOWN)} END AS provers FROM customer),
p AS (SELECT *, unnest(provers) AS prover FROM o), f AS (SELECT obligation, class, prover, [{_score_sql('class', M.CLASSES)}, {_score_sql('prover', M.PROVERS)}, least(length, 2000) / 2000.0::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS x FROM p),
j AS (SELECT f.obligation, prover, x, coalesce(a.w, b.w) AS w, coalesce(a.centre, b.centre) AS centre, coalesce(a.spread, b.spread) AS spread, a.w IS NOT NULL AS own FROM f LEFT JOIN w a ON a.class = f.class CROSS JOIN (SELECT * FROM w WHERE class IS NULL) b),
r AS (SELECT obligation, prover, own, w[1] + list_sum(list_transform(x, lambda v, i: v * w[i + 1])) AS prediction, exp(-0.5::DOUBLE * list_sum(list_transform(x, lambda v, i: (v - centre[i]) * (v - centre[i]) / (spread[i] + 0.01::DOUBLE))) / 6) AS confidence FROM j),
q AS (SELECT *, row_number() OVER (PARTITION BY obligation ORDER BY prediction DESC, confidence DESC, prover) AS place FROM r)"""


@query("m06_prover_recommend", f"{_models_sql()}, {_ASKED} SELECT obligation, prover, round(prediction, 5) AS prediction, round(confidence, 5) AS confidence, own FROM q WHERE place = 1")
def m06_prover_recommend(spark, d):
    """The prover of the best predicted success for each obligation; classes without a model go by all attempts."""
    n = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, _CASES)), (n % 12 + 1).cast("int"))
    claim = F.repeat(F.lit("x"), (F.abs(F.floor("c_acctbal").cast("long")) % 2500).cast("int"))
    provers = F.when(n % 4 == 0, F.array(*map(F.lit, _OFFERED)))
    asked = V.table(spark, d, "customer").select(n.alias("obligation"), kind.alias("class"), claim.alias("claim"), provers.alias("provers"))
    none = F.lit(None)
    features = lambda prover: M.attempt_features(F.col("class"), prover, F.col("claim"), none.cast("double"), none.cast("long"), none)
    out = M.recommend(asked, M.class_models(attempts(spark, d)), features)
    return out.select("obligation", "prover", F.round("prediction", 5).alias("prediction"), F.round("confidence", 5).alias("confidence"), "own")


_NAMES = "c AS (SELECT DISTINCT lower(p_brand || ' ' || p_name) AS a FROM part WHERE p_partkey % 4 > 0), b AS (SELECT lower(p_name || '-' || p_type) AS b, min(p_partkey) AS first FROM part WHERE p_partkey % 4 = 0 GROUP BY 1), s AS (SELECT a, b, first FROM c, b WHERE jaro_similarity(a, b) > 0.6)"


@query("r06_similar_names", f"WITH {_NAMES} SELECT a AS name, count(*) AS n_similar, min(first) AS template FROM s GROUP BY a")
def r06_similar_names(spark, d):
    """For each category's name the recipes with a name above 0.6 in Jaro similarity, and the first of them."""
    p = V.table(spark, d, "part")
    names = p.where("p_partkey % 4 > 0").select(F.lower(F.concat("p_brand", F.lit(" "), "p_name")).alias("name")).distinct()
    known = p.where("p_partkey % 4 = 0").groupBy(F.lower(F.concat("p_name", F.lit("-"), "p_type")).alias("name")).agg(F.min("p_partkey").alias("first"))
    pairs = jaro_pairs(names, known, 0.6).join(known.withColumnRenamed("name", "b"), "b")
    return pairs.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("n_similar"), F.min("first").alias("template"))


def humanised(text):
    """Words apart before capitals, dashes and underscores as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "([A-Z])", " $1"), "[-_]+", " "))


_HUMAN = r"trim(regexp_replace(regexp_replace(category, '([A-Z])', ' \1', 'g'), '[-_]+', ' ', 'g'))"


@query(
    "r06_recipe_texts",
    f"""{with_views('patterns')}, {_BOOK}, u AS (SELECT * FROM patterns WHERE category NOT IN (SELECT category FROM book WHERE category IS NOT NULL)),
n AS (SELECT category, count(*) AS n FROM u GROUP BY 1), e AS (SELECT category, count(DISTINCT repo) AS repos FROM weak_points WHERE NOT suppressed GROUP BY 1),
w AS (SELECT category, unnest(string_split(fingerprint, '-')) AS word FROM u), k AS (SELECT category, word, row_number() OVER (PARTITION BY category ORDER BY c DESC, word) AS place FROM (SELECT category, word, count(*) AS c FROM w WHERE length(word) >= 4 GROUP BY ALL)),
t AS (SELECT category, string_agg(word, ', ' ORDER BY place) AS words FROM k WHERE place <= 5 GROUP BY 1),
s AS (SELECT n.category, min(substr(b.id, 8)::BIGINT) AS template FROM n JOIN book b ON b.category IS NOT NULL AND jaro_similarity(lower(b.category), lower(n.category)) > 0.6 GROUP BY 1)
SELECT n.category, 'Auto-generated: ' || {_HUMAN.replace('category', 'n.category')} AS name, {_HUMAN.replace('category', 'n.category')} || ' -- ' || n || ' patterns across ' || repos || ' repos. Auto-generated recipe for triage and tracking.' AS description,
  'Review ' || {_HUMAN.replace('category', 'n.category')} || ' findings. Common terms: ' || coalesce(words, '') || '. Create targeted fix script once remediation pattern is established.' AS replacement, 'recipe-' || template AS template
FROM n JOIN e USING (category) LEFT JOIN t USING (category) LEFT JOIN s USING (category)""",
)
def r06_recipe_texts(spark, d):
    """Name, description and remediation of the recipe for each category that none covers, and the recipe it takes after."""
    book = recipe_book(spark, d)
    covered = book.select(F.explode("categories").alias("category"), "id")
    u = V.patterns(spark, d).join(covered.select("category").distinct(), "category", "left_anti")
    n = u.groupBy("category").agg(F.count("*").alias("n"))
    repos = V.weak_points(spark, d).where("NOT suppressed").groupBy("category").agg(F.countDistinct("repo").alias("repos"))
    words = u.select("category", F.explode(F.split("fingerprint", "-")).alias("word")).where(F.length("word") >= 4).groupBy("category", "word").agg(F.count("*").alias("c"))
    # a category's words are counted first; the five best of the counts are kept
    top = words.groupBy("category").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "word"))), 1, 5).alias("top"))
    alike = jaro_pairs(n.select(F.lower("category").alias("name")), covered.select(F.lower("category").alias("name")), 0.6)
    number = F.substring("id", 8, 20).cast("long")
    first = alike.join(covered.select(F.lower("category").alias("b"), number.alias("number")), "b").groupBy("a").agg(F.min("number").alias("number"))
    human = humanised(F.col("category"))
    rows = n.join(repos, "category").join(top, "category", "left").join(first, F.lower("category") == F.col("a"), "left")
    return rows.select(
        "category", F.concat(F.lit("Auto-generated: "), human).alias("name"),
        F.concat(human, F.lit(" -- "), "n", F.lit(" patterns across "), "repos", F.lit(" repos. Auto-generated recipe for triage and tracking.")).alias("description"),
        F.concat(F.lit("Review "), human, F.lit(" findings. Common terms: "), F.coalesce(F.array_join("top.word", ", "), F.lit("")), F.lit(". Create targeted fix script once remediation pattern is established.")).alias("replacement"),
        F.concat(F.lit("recipe-"), "number").alias("template"),
    )
