"""Bayesian confidence, temperature annealing, and transfer between repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bayes(prior: Column, successes: Column, failures: Column) -> Column:
    """(10 p + s) / (10 + s + f), within 0.10 and 0.99."""
    return F.least(F.lit(0.99), F.greatest(F.lit(0.10), (10 * prior + successes) / (10 + successes + failures)))


def temperature(n: Column) -> Column:
    return F.greatest(F.exp(-0.05 * n), F.lit(0.01))


def stage(n: Column) -> Column:
    return F.when(n >= 50, "veteran").when(n >= 15, "mature").when(n >= 5, "adolescent").otherwise("nascent")


def anneal(raw: Column, heat: Column) -> Column:
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), raw))
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / (1 + heat)))


def strategy(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "auto_execute").when(confidence >= 0.85, "review").otherwise("report_only")


def clamp_strategy(wanted: Column, age: Column) -> Column:
    """A young recipe only reports, an adolescent one at most asks for review."""
    rank = lambda c: F.when(c == "auto_execute", 2).when(c == "review", 1).otherwise(0)
    most = F.when(age == "nascent", 0).when(age == "adolescent", 1).otherwise(2)
    return F.element_at(F.array(F.lit("report_only"), F.lit("review"), F.lit("auto_execute")), F.least(rank(wanted), most) + 1)


def outcome_counts(outcomes: DataFrame, *keys: str) -> DataFrame:
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.groupBy(*keys).agg(is_("success").alias("successes"), is_("failure").alias("failures"), is_("false_positive").alias("false_positives"), F.count("*").alias("total"))


def transferred(index: DataFrame, discount: float, least: int = 3) -> DataFrame:
    """(recipe_id, repo, transferred): other repositories' success rate, weighted by attempts, of (recipe_id, repo, successes, total).

    The sum over the others is the recipe's sum less the repository's own
    share, so no pairs of repositories are formed.
    """
    enough = F.col("total") >= least
    mine = lambda c: F.when(enough, F.col(c)).otherwise(0)
    by = Window.partitionBy("recipe_id")
    wins, tries = F.sum(mine("successes")).over(by) - mine("successes"), F.sum(mine("total")).over(by) - mine("total")
    return index.select("recipe_id", "repo", F.when(tries > 0, wins * discount / (tries * discount)).alias("transferred"))


def recent_window(outcomes: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` outcomes of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return outcomes.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)
