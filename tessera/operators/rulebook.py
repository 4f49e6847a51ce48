"""Content rules as data: a table of patterns, loaded from documents, and joined to texts through their literals.

Running every pattern on every text costs rules times characters.  Most patterns can only match where one of a few
literals stands.  These are read off each pattern; one automaton finds all literals of all rules in one pass over a
text, and only the surviving pairs of text and rule run a regular expression.  A pattern without such a literal
survives everywhere, so the result is that of running all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a literal at least (one of marks alone may be shorter: they are rare), alternatives of a pattern at most, and rules of a table at most: tables are written by people.
LEAST_LITERAL, MOST_LITERALS, MOST_RULES = 3, 64, 20_000
RULE = "id string, category string, severity string, auto_fixable boolean, pattern string, default_strategy string, strategy_caps array<struct<cap:string,when:string>>"
LICENCE = r"(?i)SPDX|licen[cs]e|MPL-2|AGPL"


def _usable(s: frozenset[str] | None) -> bool:
    return bool(s) and len(s) <= MOST_LITERALS and all(len(x) >= LEAST_LITERAL or (x and not any(c.isalnum() or c.isspace() for c in x)) for x in s)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set that lets fewer texts through: longer literals, then fewer of them."""
    rank = lambda s: (min(map(len, s)), -len(s)) if _usable(s) else (0, 0)
    return a if rank(a) >= rank(b) else b


def _required(items) -> frozenset[str] | None:
    best, run = None, ""
    for op, value in [*items, (None, None)]:
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op is C.AT:
            continue
        best, run = _better(best, frozenset([run])), ""
        inner = None
        if op is C.SUBPATTERN:
            inner = _required(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        elif op is C.ATOMIC_GROUP:
            inner = _required(value)
        elif op is C.BRANCH:
            parts = [_required(x) for x in value[1]]
            inner = frozenset().union(*parts) if all(_usable(p) for p in parts) else None
        best = _better(best, inner)
    return best if _usable(best) else None


def required_literals(pattern: str) -> frozenset[str] | None:
    """Literals in lower case, one of which stands in the lower-cased text of every match; None where nothing is sure."""
    return _required(_parser.parse(pattern, re.ASCII))


class Rule(NamedTuple):
    id: str
    pattern: str


@lru_cache(maxsize=4)
def _automaton(rules: tuple[Rule, ...]):
    """The automaton of all literals (None without any), the rules that need none, and the compiled patterns."""
    tree, free, of = ahocorasick.Automaton(), [], {}
    for k, r in enumerate(rules):
        literals = required_literals(r.pattern)
        if literals is None:
            free.append(k)
        for x in literals or ():
            of.setdefault(x, []).append(k)
    for x, ks in of.items():
        tree.add_word(x, tuple(ks))
    if of:
        tree.make_automaton()
    return (tree if of else None), tuple(free), [re.compile(r.pattern, re.ASCII) for r in rules]


def candidates(text: str, rules: tuple[Rule, ...]) -> list[int]:
    """Places of the rules whose pattern may match."""
    tree, free, _ = _automaton(rules)
    # only ASCII letters change, so that no literal is lost to a letter that grows when lowered
    low = text.translate(_LOWER) if not text.isascii() else text.lower()
    found = set(free)
    if tree is not None:
        for _, ks in tree.iter(low):
            found.update(ks)
    return sorted(found)


_LOWER = {k: k + 32 for k in range(65, 91)}


def scan(files: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule, n): how often each rule's pattern matches in each text; pairs without a match have no row.

    Patterns mean what Python's ``re`` says, with ASCII classes.  Null texts match nothing.  The table of rules goes to
    every task; more than ``MOST_RULES`` are refused.
    """
    table = tuple(sorted(Rule(*r) for r in rules.where("pattern IS NOT NULL").select("id", "pattern").distinct().limit(MOST_RULES + 1).collect()))
    if len(table) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kind = files.schema[key].dataType
    shared = files.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        patterns = _automaton(known)[2]
        for batch in batches:
            rows, names, counts = [], [], []
            for i, t in enumerate(batch.column(1)):
                value = t.as_py()
                if not value:
                    continue
                for k in candidates(value, known):
                    n = sum(1 for _ in patterns[k].finditer(value))
                    if n:
                        rows.append(i)
                        names.append(known[k].id)
                        counts.append(n)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["key", "rule", "n"])

    return files.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind.simpleString()}, rule string, n long")


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules, and (source, why) of the lines of a folder's files that are none: no JSON object, no id, or no pattern that compiles."""
    read = spark.read.text(path).where(F.trim("value") != "")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    docs = read.select(name.alias("source"), F.col("value"), F.from_json(F.when(F.try_parse_json("value").isNotNull(), F.col("value")), RULE).alias("r"))
    whole = F.when(F.col("r").isNull() | (F.substring(F.trim("value"), 1, 1) != "{"), "no object").when(F.col("r.id").isNull(), "no id").when(F.col("r.pattern").isNotNull() & ~_compiles("r.pattern"), "bad pattern")
    docs = docs.withColumn("why", whole)
    return docs.where("why IS NULL").select("r.*"), docs.where("why IS NOT NULL").select("source", "why")


def _compiles(pattern: str) -> Column:
    @F.pandas_udf("boolean")
    def check(patterns):
        def good(p: str) -> bool:
            try:
                re.compile(p, re.ASCII)
            except re.error:
                return False
            return True

        return patterns.map(lambda p: p is None or good(p))

    return check(F.col(pattern))


def licence_caps(rules: DataFrame) -> DataFrame:
    """(id, when): conditions on licences that hold a finding at review."""
    caps = rules.select("id", F.explode("strategy_caps").alias("c"))
    return caps.where((F.col("c.cap") == "review") & F.col("c.when").rlike(LICENCE)).select("id", F.col("c.when").alias("when"))
