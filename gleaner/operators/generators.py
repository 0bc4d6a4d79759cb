"""Row generators: values that break a field's constraints, templates for endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.routes import lookup

#: Words that give privileges away.
PRIVILEGES = ["admin", "root", "superuser", "administrator", "staff", "moderator", "manager"]


def _cases(*cases: tuple[Column, str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("violation"), v.cast("string").alias("value"))) for c, n, v in cases]))


def range_violations(fields: DataFrame) -> DataFrame:
    """Rows (all columns of `fields`, violation, value) that break gt, ge, lt or le; a null bound makes none. Bounds are doubles, is_int a boolean."""
    step = F.when(F.col("is_int"), F.lit(1.0)).otherwise(F.lit(0.01))
    show = lambda v: F.when(F.col("is_int"), v.cast("long").cast("string")).otherwise(F.round(v, 4).cast("string"))
    rows = _cases(
        (F.col("gt").isNotNull(), "at_lower_bound", show(F.col("gt"))), (F.col("gt").isNotNull(), "below_lower_bound", show(F.col("gt") - step)), (F.col("ge").isNotNull(), "below_minimum", show(F.col("ge") - step)),
        (F.col("lt").isNotNull(), "at_upper_bound", show(F.col("lt"))), (F.col("lt").isNotNull(), "above_upper_bound", show(F.col("lt") + step)), (F.col("le").isNotNull(), "above_maximum", show(F.col("le") + step)),
    )
    return fields.select("*", F.inline(rows))


def enum_violations(fields: DataFrame) -> DataFrame:
    """Rows for values outside `allowed`: an unknown one, the empty one, and the first privileged one that isn't allowed."""
    more = F.array_min(F.array_except(F.array(*[F.lit(p) for p in PRIVILEGES]), F.transform("allowed", F.lower)))
    return fields.select("*", F.inline(_cases((F.lit(True), "unknown_value", F.lit("invalid_value")), (F.lit(True), "empty_value", F.lit("")), (more.isNotNull(), "privileged_value", more))))


def length_violations(fields: DataFrame) -> DataFrame:
    """Rows with strings too short for min_length or too long for max_length, given by their lengths."""
    low, high = F.col("min_length"), F.col("max_length")
    return fields.select("*", F.inline(_cases((low > 0, "empty", F.lit(0)), (low > 1, "too_short", low - 1), (high.isNotNull(), "too_long", high + 1), (high.isNotNull(), "far_too_long", high * 10))))


def type_violations(fields: DataFrame) -> DataFrame:
    """Rows with values of another type than json_type."""
    t = F.col("json_type")
    return fields.select("*", F.inline(_cases((t == "integer", "text_for_integer", F.lit("not_a_number")), (t == "integer", "fraction_for_integer", F.lit("1.5")), (t == "number", "text_for_number", F.lit("not_a_number")), (t == "boolean", "text_for_boolean", F.lit("not_a_boolean")))))


def missing_required(fields: DataFrame, key: list[str]) -> DataFrame:
    """For each required field of an endpoint (`key`), a row with the other fields' names: what is sent without it."""
    others = fields.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.array_sort(F.collect_set("field")).alias("_all"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return fields.filter("required").join(others, on).select(*key, F.col("field").alias("missing"), F.array_join(F.array_remove("_all", F.col("field")), ",").alias("sent"))


def with_templates(endpoints: DataFrame, templates: DataFrame, per_category: int | None = 2) -> DataFrame:
    """Each endpoint with the first `per_category` templates (category, ordinal, payload) of each category, or with all.

    Endpoints are exploded by category and joined with its templates: an equi-join, of which Spark broadcasts the templates while they are few.
    """
    first = templates.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("ordinal")))
    if per_category is not None:
        first = first.filter(F.col("_n") <= per_category)
    named = first.select("category", F.concat_ws("_", "category", "_n").alias("name"), "payload")
    categories = first.agg(F.collect_set("category").alias("_cs"))  # one row: the categories
    wide = endpoints.join(F.broadcast(categories)).select(*endpoints.columns, F.explode("_cs").alias("category"))
    return wide.join(named, "category")


def ownership_violations(fields: DataFrame) -> DataFrame:
    """Rows with another owner's id and with id 0, for fields with idor_risk whose signals speak of ownership; expected holds the status codes that are due."""
    told = F.arrays_overlap("signals", F.array(F.lit("ownership_pattern"), F.lit("path_param_id"))) & F.col("idor_risk")
    codes = lambda *cs: F.array(*[F.lit(c) for c in cs])
    rows = F.array(
        F.struct(F.lit("other_owner").alias("violation"), F.lit("<OTHER_USER_ID>").alias("value"), codes(403, 404).alias("expected")),
        F.struct(F.lit("zero_id").alias("violation"), F.lit("0").alias("value"), codes(400, 403, 404).alias("expected")),
    )
    return fields.filter(told).select("*", F.inline(rows))


def confident(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows (confidence) that are sure enough to be tried."""
    return rows.filter(F.col("confidence") >= least)


def parameter_tests(endpoints: DataFrame, templates: DataFrame, per_category: int | None = None) -> DataFrame:
    """Each parameter (name, place) of `endpoints` (parameters, an array of these, and others) with each template.

    Endpoints without parameters are tried with `id` and `search` in the query.
    """
    usual = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("query").alias("place")) for n in ("id", "search")])
    own = F.when(F.size("parameters") > 0, F.col("parameters")).otherwise(usual)
    met = endpoints.select(*[c for c in endpoints.columns if c != "parameters"], F.inline(own).alias("parameter", "place"))
    return with_templates(met, templates, per_category)


#: What a field of a JSON type holds where nothing is tried, as JSON.
DEFAULTS = {"string": '"test"', "integer": "1", "number": "1.0", "boolean": "true", "array": "[]", "object": "{}"}


def default_value(json_type: Column) -> Column:
    return lookup(json_type, DEFAULTS, F.lit(DEFAULTS["string"]))


def injected_bodies(fields: DataFrame, key: list[str], templates: DataFrame, per_category: int | None = 5) -> DataFrame:
    """Bodies (JSON) with a template's payload in one string field and defaults in the others.

    `fields` is (key columns, field, json_type), one row for each field of an endpoint's body; a row comes out for each string
    field and template. Fields stand in order of their names. An endpoint's fields meet in one row, not those of others.
    """
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    bodies = fields.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("field", "json_type"))).alias("_f"))
    targets = bodies.select(*key, "_f", F.explode(F.filter("_f", lambda f: f["json_type"] == "string"))).select(*key, "_f", F.col("col.field").alias("field"))
    tried = with_templates(targets, templates, per_category).withColumn("_p", quoted(F.col("payload")))
    pair = lambda f: F.concat(quoted(f["field"]), F.lit(":"), F.when(f["field"] == F.col("field"), F.col("_p")).otherwise(default_value(f["json_type"])))
    return tried.withColumn("body", F.concat(F.lit("{"), F.array_join(F.transform("_f", pair), ","), F.lit("}"))).drop("_f", "_p")
