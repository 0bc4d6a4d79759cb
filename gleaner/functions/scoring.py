"""Column functions that classify and score endpoints."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes a text sensitive, and the points of a match of each category.
SENSITIVE = {
    "auth": [r"\bpassword\b", r"\btoken\b", r"\bsecret\b", r"\bauth\b", r"\bjwt\b", r"\bapi.?key\b"],
    "pii": [r"\bssn\b", r"\bemail\b", r"\bphone\b", r"\bcredit.?card\b", r"\baddress\b"],
    "financial": [r"\bpayment\b", r"\btransaction\b", r"\bbilling\b", r"\bcharge\b"],
    "admin": [r"\badmin\b", r"\broot\b", r"\binternal\b", r"\bdebug\b"],
}
POINTS = {"auth": 3, "pii": 4, "financial": 3, "admin": 5}
PRIVATE = [r"\[Authorize", r"@login_required", r"@auth", r"AuthGuard", r"@PreAuthorize", r"@Secured"]
PUBLIC = [r"/health", r"/ping", r"/public", r"/docs", r"\[AllowAnonymous\]"]
RANKS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
#: What a kind of evidence for a constraint weighs.
SIGNALS = {
    "pydantic_field_constraint": 0.50, "literal_type": 0.45, "pydantic_validator": 0.40, "annotated_constraint": 0.40, "inline_validation": 0.30, "ownership_pattern": 0.30,
    "docstring_constraint": 0.20, "path_param_id": 0.20, "type_hint_only": 0.10, "field_name_inference": 0.10,
}
COVERAGE = {"has_parameters": 0.20, "has_type_hints": 0.20, "has_docstring": 0.20, "has_auth": 0.15, "has_responses": 0.15, "has_method_info": 0.10}
SIMPLE = ["list", "get", "retrieve", "fetch", "find", "create", "add", "insert", "new", "update", "edit", "modify", "patch", "delete", "remove", "destroy"]
COMPLEX = ["calculate", "compute", "process", "validate", "analyze", "transform", "aggregate", "optimize", "generate", "predict", "classify", "recommend"]


def found(low: Column, pattern: str) -> Column:
    """Whether a text in lower case has the pattern, without regard to case. Plain words need no regular expression, and ASCII ones no flags."""
    if re.fullmatch(r"[\w /@-]+", pattern):
        return F.contains(low, F.lit(pattern.lower()))
    plain = pattern == pattern.lower() and not re.search(r"\\[a-z]", pattern)
    return low.rlike(pattern if plain else "(?iU)" + pattern)


def any_of(low: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [found(low, p) for p in patterns])


def with_flags(df: DataFrame, text: Column, groups: dict[str, list[str]] = SENSITIVE, private: list[str] = PRIVATE, public: list[str] = PUBLIC) -> DataFrame:
    """`df` with `_flags`, which the functions below read: a bit for PUBLIC, one for PRIVATE, one for each pattern of `groups`.

    Each pattern is looked for once; as one number the bits stay one projection, which the optimiser doesn't repeat for every use.
    """
    df = df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    hits = [any_of(F.col("_low"), public), any_of(F.col("_low"), private), *[found(F.col("_low"), p) for ps in groups.values() for p in ps]]
    return df.withColumn("_flags", reduce(lambda a, b: a + b, [F.when(h, F.lit(1 << k)).otherwise(F.lit(0)) for k, h in enumerate(hits)])).drop("_low")


def _bit(flags: Column, k: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << k)) != 0


def auth_status(flags: Column, given: Column | None = None) -> Column:
    """PUBLIC beats PRIVATE; a given status other than UNKNOWN stays."""
    seen = F.when(_bit(flags, 0), "PUBLIC").when(_bit(flags, 1), "PRIVATE").otherwise("UNKNOWN")
    return seen if given is None else F.when(given != "UNKNOWN", given).otherwise(seen)


def base_score(flags: Column, groups: dict[str, list[str]] = SENSITIVE, points: dict[str, int] = POINTS) -> Column:
    """Points for each pattern that is found."""
    worth = [points[c] for c, ps in groups.items() for _ in ps]
    return sum((F.when(_bit(flags, k), w).otherwise(0) for k, w in enumerate(worth, 2)), F.lit(0))


def risk_score(flags: Column, method: Column, auth: Column, groups: dict[str, list[str]] = SENSITIVE, points: dict[str, int] = POINTS) -> Column:
    score = base_score(flags, groups, points) + F.when(method.isin("DELETE", "PUT", "PATCH"), 1).otherwise(0) + F.when(auth == "UNKNOWN", 1).otherwise(0)
    return score + F.when((auth == "PUBLIC") & (score > 2), 2).otherwise(0)


def risk_level(score: Column) -> Column:
    return F.when(score >= 8, "CRITICAL").when(score >= 5, "HIGH").when(score >= 3, "MEDIUM").when(score >= 1, "LOW").otherwise("INFO")


def risk_reasons(flags: Column, method: Column, auth: Column, groups: dict[str, list[str]] = SENSITIVE, points: dict[str, int] = POINTS) -> Column:
    names = [f"{c}: {p}" for c, ps in groups.items() for p in ps]
    told = [F.when(_bit(flags, k), F.lit(n)) for k, n in enumerate(names, 2)]
    mutation = F.when(method.isin("DELETE", "PUT", "PATCH"), F.concat(F.lit("Mutation: "), method))
    before = base_score(flags, groups, points) + F.when(method.isin("DELETE", "PUT", "PATCH"), 1).otherwise(0)
    return F.array_compact(F.array(*told, mutation, F.when(auth == "UNKNOWN", "Shadow API"), F.when((auth == "PUBLIC") & (before > 2), "Sensitive PUBLIC")))


def rank(level: Column) -> Column:
    """0 for CRITICAL to 4 for INFO."""
    return F.array_position(F.array(*[F.lit(r) for r in RANKS]), level) - 1


def signal_confidence(signals: Column) -> Column:
    """The weights of the distinct signals summed, at most 1, to two places."""
    weights = F.create_map(*[x for k, v in SIGNALS.items() for x in (F.lit(k), F.lit(v))])
    return F.least(F.lit(1.0), F.round(F.aggregate(F.array_distinct(signals), F.lit(0.0), lambda a, s: a + F.coalesce(F.try_element_at(weights, s), F.lit(0.0))), 2))


def false_positive_risk(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "low").otherwise("medium")


def coverage_confidence(flags: dict[str, Column], full_auth: Column) -> Column:
    """How much of an endpoint is known without asking: weights of the flags, extra for documented and secured ones."""
    base = sum((F.when(flags[k], w).otherwise(0.0) for k, w in COVERAGE.items()), F.lit(0.0))
    extra = F.when(flags["has_docstring"] & flags["has_type_hints"], 0.10).otherwise(0.0) + F.when(flags["has_auth"] & full_auth, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(base + extra, 4))


def is_simple(route: Column, body: Column) -> Column:
    return (F.size(F.split(body, "\n")) < 20) & F.lower(F.concat_ws(" ", route, body)).rlike("|".join(SIMPLE))


def is_complex(route: Column, body: Column) -> Column:
    many = lambda word, n: (F.length(body) - F.length(F.replace(body, F.lit(word), F.lit("")))) / len(word) > n
    return F.lower(F.concat_ws(" ", route, body)).rlike("|".join(COMPLEX)) | (F.size(F.split(body, "\n")) > 50) | many("if ", 5) | many("for ", 3)


def needs_model(confidence: Column, simple: Column, complex_: Column, threshold: float = 0.7) -> Column:
    """Whether an endpoint is worth a call to a language model."""
    return F.when((confidence >= threshold) & (simple | ~complex_), False).otherwise(True)


def savings(confidence: Column, asks: Column) -> Column:
    return F.when(asks, F.round(50 + 20 * confidence, 2)).otherwise(100.0)
