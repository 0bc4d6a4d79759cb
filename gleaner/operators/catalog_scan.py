"""The whole catalog over any texts, with built-in functions alone.

Every pattern has sets of literals; each of its matches holds one of each (`required`). Texts are looked through for these once, which gives
(text, literal set) rows; a join with the index from literal sets to patterns gives the candidates, and only those that hold all other literals, too, reach a
regular expression, which is a column. Contents don't cross a shuffle: what does are rows of matches, narrow ones, for their line numbers.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as regex
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.catalog import CATALOG, COMMENTS
from gleaner.operators.matching import FLAGS, Patterns, match_rows

INDEX = "also array<array<string>>, set int, language string, pattern int, framework string, kind string, method int, route int, label string, rx string"


def required(pattern: str) -> list[tuple[str, ...]]:
    """Sets of literals, in lower case: each match of a pattern holds one of each set. The longest literals, by the shortest of a set, come first."""

    def of(parts) -> list[tuple[str, ...]]:
        sets, run = [], ""
        for kind, value in parts:
            if kind is kinds.LITERAL:
                run += chr(value).lower()
                continue
            sets, run = [*sets, *([(run,)] if run else [])], ""
            if kind is kinds.SUBPATTERN:
                sets += of(value[3])
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
                sets += of(value[2])
            elif kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
                sets.append(tuple(sorted({chr(v).lower() for _, v in value})))
            elif kind is kinds.BRANCH:
                each = [max(of(branch), key=worth, default=()) for branch in value[1]]
                if all(each):
                    sets.append(tuple(sorted({x for one in each for x in one})))
        return [*sets, *([(run,)] if run else [])]

    worth = lambda literals: (min(map(len, literals), default=0), -len(literals))
    return sorted(dict.fromkeys(of(regex.parse(pattern))), key=worth, reverse=True)


def pattern_index(spark: SparkSession, patterns: Patterns = CATALOG) -> tuple[DataFrame, dict[tuple[str, ...], int]]:
    """INDEX rows, the patterns by the number of their first literal set, beside the other sets, and the numbers; patterns without a literal have the set -1."""
    sets: dict[tuple[str, ...], int] = {}
    rows = []
    for language, entries in patterns.items():
        for k, (framework, kind, method, route, label, rx) in enumerate(entries):
            first, *also = required(rx) or [()]
            number = sets.setdefault(first, len(sets)) if first else -1
            rows.append(([list(x) for x in also], number, language, k, framework, kind, method or 0, route or 0, label, FLAGS + rx))
            if not first:
                sets[()] = -1
    return spark.createDataFrame(rows, INDEX), sets


def candidates(texts: DataFrame, text: str, index: DataFrame, sets: dict[tuple[str, ...], int]) -> DataFrame:
    """`texts` beside each row of `index` whose literals they hold, the set -1 beside all."""
    low = F.lower(F.replace(F.col(text), F.lit("ſ"), F.lit("s")))  # the long s is an s to a pattern without case
    holds = lambda literals: reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(x)) for x in literals])
    found = F.array_compact(F.array(*[F.when(holds(literals) if literals else F.lit(True), F.lit(number)) for literals, number in sets.items()]))
    # A plain explode would have Spark filter texts by the size of the array first, and so look through them, each time lowered anew, twice. A null set meets nothing.
    met = texts.filter(F.col(text).isNotNull()).withColumn("_low", low).select("*", F.explode_outer(found).alias("set"))
    met = met.join(F.broadcast(index), "set")  # the catalog, a few hundred rows
    return met.filter(F.forall("also", lambda s: F.exists(s, lambda x: F.contains(F.col("_low"), x)))).drop("set", "also", "_low")


def count_catalog(texts: DataFrame, text: str, patterns: Patterns = CATALOG) -> DataFrame:
    """How many matches each pattern has in the column `text`: the other columns of `texts`, language, pattern and n, for each row and pattern with one.

    As many as `scan_catalog` has rows without `comments`, but a text is gone through once for a candidate, and nothing is shuffled.
    """
    index, sets = pattern_index(texts.sparkSession, patterns)
    keep = [c for c in texts.columns if c not in (text, "language", "pattern", "n", "rx", "set")]
    met = candidates(texts.select(*keep, F.col(text).alias("_text")), "_text", index.select("also", "set", "language", "pattern", "rx"), sets)
    return met.select(*keep, "language", "pattern", F.regexp_count("_text", F.col("rx")).cast("long").alias("n")).filter(F.col("n") > 0)


def scan_catalog(texts: DataFrame, text: str, patterns: Patterns = CATALOG, language: str | None = None, comments: dict[str, tuple[str, ...]] = COMMENTS) -> DataFrame:
    """Matches of all patterns in the column `text`: the other columns of `texts`, language, pattern (its number in its language), framework, kind, method, route, index, line, found.

    With a `language` (a column's name) only its patterns are tried on a text. Matches that begin on a line that begins a comment in the
    pattern's language (`comments`: its prefixes) don't count. Null and empty texts have none, columns of `texts` named like those of the result are replaced. Repeated rows have their own matches.
    """
    index, sets = pattern_index(texts.sparkSession, patterns)
    keep = [c for c in texts.columns if c not in (text, "language", "pattern", "framework", "kind", "method", "route", "label", "rx", "set", "index", "line", "found", "lead")]
    rows = texts.select(*keep, F.col(text).alias("_text"), *([F.col(language).alias("_language")] if language else []))
    met = candidates(rows, "_text", index, sets)
    if language:
        met = met.filter(F.col("_language") == F.col("language"))
    told = ["language", "pattern", "framework", "kind", "label", "_has_method"]
    met = met.filter(F.rlike("_text", F.col("rx"))).withColumn("_has_method", F.col("method") > 0)
    hits = match_rows(met, "_text", F.col("rx"), {"m": F.col("method"), "r": F.col("route")}, [*keep, *told, "method", "route"])
    comment = reduce(lambda c, kv: c.when(F.col("language") == kv[0], reduce(lambda a, b: a | b, [F.startswith(F.col("lead"), F.lit(p)) for p in kv[1]])), comments.items(), F.when(F.lit(False), F.lit(False)))
    hits = hits.filter(~F.coalesce(comment, F.lit(False)))
    method = F.upper(F.coalesce(F.when(F.col("_has_method"), F.col("m")), F.lit("ANY")))
    route = F.coalesce(F.when(F.col("route") > 0, F.col("r")), F.col("label"), F.col("framework"))
    return hits.select(*keep, *told[:4], method.alias("method"), route.alias("route"), "index", "line", "found")
