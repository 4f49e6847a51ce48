"""Predicates over JSON documents and typed columns, with the document language's coercions.

A field is a dotted path through objects; what is missing is the empty string
for equality, and less than anything for comparisons.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def field(json: Column, path: str) -> Column:
    """The field's JSON text, null if missing."""
    return F.get_json_object(json, f"$.{path}")


def field_equal(json: Column, path: str, value: str) -> Column:
    return F.coalesce(field(json, path), F.lit("")) == value


def field_compare(json: Column, path: str, op: str, value: str) -> Column:
    """Numbers compare with the literal's numeric prefix, strings by bytes; anything else, missing included, is less."""
    text, kind = field(json, path), F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{path}", "variant"))
    number = re.match(NUMBER, value)
    as_number = F.try_variant_get(F.try_parse_json(json), f"$.{path}", "double")
    numeric = F.coalesce(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))
    less_text = F.when(kind == "STRING", F.when(text < value, -1).when(text > value, 1).otherwise(0)).otherwise(-1)
    less_number = F.when(as_number < float(number[1]), -1).when(as_number > float(number[1]), 1).otherwise(0) if number else F.lit(-1)
    order = F.when(numeric, less_number).otherwise(less_text)
    return {">": order > 0, ">=": order >= 0, "<": order < 0, "<=": order <= 0}[op]


def field_contains(json: Column, path: str, value: str) -> Column:
    return F.coalesce(F.contains(field(json, path), F.lit(value)), F.lit(False))


def field_like(json: Column, path: str, value: str) -> Column:
    """Substring without regard to case; no wildcards."""
    return F.contains(F.lower(F.coalesce(field(json, path), F.lit(""))), F.lit(value.lower()))


def field_matches(text: Column, pattern: str) -> Column:
    """Search without regard to case; a pattern that doesn't compile matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def full_text(json: Column, value: str) -> Column:
    """Search in the document's canonical JSON, in lower case."""
    return F.contains(F.lower(F.to_json(F.parse_json(json))), F.lit(value.lower()))


def paged(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0, flipped: list[Column] | None = None) -> DataFrame:
    """Rows offset to offset + limit; a negative limit takes from the end, a negative offset drops from the end.

    ``flipped`` is the reverse of ``order``: with it the rows from the end are a top-k as well, and nothing is counted.
    """
    if offset < 0:
        df = df.orderBy(*order).limit(max(0, df.count() + offset))
    elif offset:
        df = df.orderBy(*order).offset(offset)
    if limit is None:
        return df
    if limit < 0 and flipped and not offset:
        return df.orderBy(*flipped).limit(-limit)
    if limit < 0:
        return df.orderBy(*order).offset(max(0, df.count() + limit))
    return df.orderBy(*order).limit(limit)


def policy_reason(severity_rank: Column, least_rank: int, age_days: Column, most_days: int, dismissed: Column) -> Column:
    """The first reason that drops a row: severity, then age, then dismissed; else accepted."""
    return F.when(severity_rank < least_rank, "severity").when(age_days > most_days, "age").when(dismissed, "dismissed").otherwise("accepted")
