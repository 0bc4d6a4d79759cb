"""Enrichment: endpoints meet their code, a model is asked in batches, operations are checked and repaired."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.functions import detect, routes, scoring
from gleaner.functions.routes import surrounding
from gleaner.operators import parsers
from gleaner.operators.endpoints import cache_lookup, first_per
from gleaner.sources.shared import cut


#: So many paths with their lines are broadcast at most; more meet their files by a shuffle.
BROADCAST_PATHS = 200_000


def with_code(endpoints: DataFrame, files: DataFrame, around: int = 25) -> DataFrame:
    """`endpoints` (path, line) with the code near them; endpoints without a file have an empty one.

    The lines that are wanted go to the files, not contents to the endpoints: only code around them is joined. Of a path that is there twice the
    least code counts.
    """
    wanted = cut(endpoints.groupBy(F.col("path").alias("_p")).agg(F.collect_set("line").alias("_ls")))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_PATHS else wanted
    near = F.array_join(surrounding(F.split(F.coalesce("content", F.lit("")), "\n", -1), F.col("_l"), around), "\n")
    code = files.join(wanted, F.col("path") == F.col("_p")).select("_p", "content", F.explode("_ls").alias("_l")).groupBy("_p", "_l").agg(F.min(near).alias("code"))
    met = endpoints.join(code, (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")), "left")
    return met.withColumn("code", F.coalesce("code", F.lit(""))).drop("_p", "_l")


def function_window(content: Column, line: Column, above: int = 50, most: int = 100) -> Column:
    """The code of the function at a line number: from the nearest line above it, at most `above` lines up, that begins one, to the next that does, at most `most` lines."""
    lines = F.split(content, "\n", -1)
    starts = lambda x: x.rlike("def |function |async |public |private ")
    before = F.slice(lines, F.greatest(F.lit(1), line - above + 1), F.least(F.lit(above), line))
    up = F.array_position(F.transform(F.reverse(before), starts), True)
    first = F.when(up > 0, line - up + 1).otherwise(line).cast("int")
    rest = F.slice(lines, first + 1, F.lit(most - 1))
    down = F.array_position(F.transform(rest, lambda x: x.rlike("def |function |class ")), True)
    body = F.when(down > 0, F.slice(rest, F.lit(1), down.cast("int"))).otherwise(rest)
    return F.when((line < 1) | (line > F.size(lines)), F.lit("")).otherwise(F.array_join(F.concat(F.slice(lines, first, F.lit(1)), body), "\n"))


def described_endpoints(endpoints: DataFrame, files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Endpoints (path, line, method, route, code) with all that is known of them without a model, and whether and for what one is asked.

    Columns beside theirs: parameters (name, type, format, description), codes, summary, hints, scheme, confidence, asks, reason, tasks, savings. A Python
    endpoint's function is the nearest one that begins at its line or below, within three lines of decorators.
    """
    functions = parsers.python_functions(files)
    schemes = parsers.auth_schemes(functions).groupBy("path", "function").agg(F.min("scheme").alias("scheme"))
    f = functions.filter(F.col("bases").isNull()).join(schemes, ["path", "function"], "left")
    f = f.select(F.col("path").alias("_fp"), F.col("line").alias("_fl"), F.struct("summary", "hints", "scheme", "answer", "parameters").alias("_f"))
    near = f.select("_fp", "_fl", "_f", F.explode(F.sequence(F.col("_fl") - 4, F.col("_fl"))).alias("_at"))
    first = near.groupBy("_fp", "_at").agg(F.min_by("_f", "_fl").alias("_f"))
    e = endpoints.join(first, (F.col("path") == F.col("_fp")) & (F.col("line") == F.col("_at")), "left").drop("_fp", "_at")
    named = F.transform(routes.params(F.col("route")), lambda p: F.struct(p["name"].alias("name"), routes.param_type(p["name"], p["hint"]).alias("type"), routes.param_format(p["name"], p["hint"]).alias("format"), routes.param_description(p["name"], routes.param_type(p["name"], p["hint"])).alias("description")))
    e = e.withColumn("parameters", named).withColumn("codes", routes.status_codes(F.col("code"))).withColumn("summary", F.col("_f.summary")).withColumn("hints", F.col("_f.hints"))
    e = e.withColumn("scheme", F.coalesce("_f.scheme", detect.security_dependency(F.col("code"))))
    told = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "has_parameters": F.size("parameters") > 0, "has_type_hints": told(F.col("hints") != "{}"), "has_docstring": told(F.col("summary") != ""), "has_auth": F.col("scheme").isNotNull(),
        "has_responses": F.size("codes") > 0, "has_method_info": F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"),
    }
    e = e.withColumn("confidence", scoring.coverage_confidence(flags, F.col("scheme").isNotNull()))
    described = told(F.col("_f.parameters") != "{}")
    decided = detect.decision(F.col("confidence"), scoring.is_simple(F.col("route"), F.col("code")), scoring.is_complex(F.col("route"), F.col("code")), detect.model_tasks(flags, described), threshold)
    e = e.withColumn("_d", decided).select("*", "_d.asks", "_d.reason", "_d.tasks").withColumn("savings", scoring.savings(F.col("confidence"), F.col("asks")))
    return e.drop("_f", "_d")


def with_answers(endpoints: DataFrame, answers: DataFrame) -> DataFrame:
    """`endpoints` with the answers (method, route and others) that were given for their method and route; endpoints alike share one, those without have nulls. Of several answers the first in order of all their columns counts."""
    others = [c for c in answers.columns if c not in ("method", "route")]
    own = first_per(answers.select(F.col("method").alias("_m"), F.col("route").alias("_r"), *others), ["_m", "_r"], [F.asc_nulls_last(c) for c in others] or ["_m"])
    return endpoints.join(own, (F.col("method") == F.col("_m")) & (F.col("route") == F.col("_r")), "left").drop("_m", "_r")


def shared_prompt(endpoints: DataFrame, most: int = 100) -> DataFrame:
    """One row: n (all endpoints), sample (the first `most` as `METHOD route`, in order) and the resources that several of them share: what one question about the whole is asked of."""
    signature = F.concat_ws(" ", "method", "route")
    first = endpoints.select(signature.alias("s")).distinct().orderBy("s").limit(most).agg(F.array_sort(F.collect_list("s")).alias("sample"))  # the limit is what a prompt holds
    shared = endpoints.groupBy(detect.shared_resource(F.col("route")).alias("r")).agg(F.count("*").alias("n")).filter("r IS NOT NULL AND n > 1").orderBy(F.desc("n"), "r").limit(most).agg(F.array_sort(F.collect_list("r")).alias("resources"))
    return endpoints.agg(F.count("*").alias("n")).join(F.broadcast(first)).join(F.broadcast(shared))  # a row each


def ask_in_batches(rows: DataFrame, ask: Callable[[list[str]], list[str | None]], size: int = 20, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """`rows` (prompt and others) with status and answer: `ask` gets up to `size` prompts of a partition at a time.

    A batch that raises is tried again, with pauses that double, and then prompt by prompt; prompts without an
    answer are FAILED. `ask` runs within tasks, so partitions bound how many calls run at once.
    """
    schema = StructType([*rows.schema.fields, StructField("status", StringType()), StructField("answer", StringType())])

    def call(prompts: list[str]) -> list[str | None] | None:
        for k in range(tries):
            try:
                found = list(ask(prompts))
                if len(found) == len(prompts):
                    return found
            except Exception:  # noqa: BLE001
                time.sleep(wait * 2**k)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers: list[str | None] = []
            for at in range(0, len(pdf), size):
                prompts = list(pdf["prompt"].iloc[at : at + size])
                found = call(prompts)
                answers += found if found is not None else [(call([p]) or [None])[0] for p in prompts]
            yield pdf.assign(status=["FAILED" if a is None else "SUCCESS" for a in answers], answer=answers)

    return rows.mapInPandas(run, schema)


def _rest(json_text: Column, known: list[str]) -> Column:
    """The members of a JSON object other than `known`, as text without braces; null if there are none."""
    rest = F.map_filter(F.from_json(json_text, "map<string,variant>"), lambda k, v: ~k.isin(known))
    text = F.to_json(rest)
    return F.when(F.size(rest) > 0, F.substring(text, F.lit(2), F.length(text) - 2))


def repaired_operations(operations: DataFrame) -> DataFrame:
    """`operations` (operation, JSON) with status, error and the operation repaired: mended in place, all else that it has stays.

    Missing responses, summaries and bodies' contents get defaults; empty parameters and bodies go. What is
    no object, or has parameters without a name or a known place, is FAILED.
    """
    kind = "struct<parameters:string,requestBody:string,responses:string,summary:string>"
    o = F.from_json("operation", kind)
    places = F.from_json(o["parameters"], "array<struct<name:string,`in`:string>>")
    empty = lambda c: c.isNull() | c.isin("", "null")
    bad = F.exists(places, lambda p: p["name"].isNull() | p["in"].isNull() | ~p["in"].isin("path", "query", "header", "cookie"))
    error = (
        F.when(~F.coalesce(F.startswith(F.ltrim("operation"), F.lit("{")), F.lit(False)) | F.try_parse_json("operation").isNull(), "operation")
        .when(~empty(o["parameters"]) & (~F.startswith(o["parameters"], F.lit("[")) | F.coalesce(bad, F.lit(True))), "parameters")
        .when(~empty(o["requestBody"]) & ~F.startswith(o["requestBody"], F.lit("{")), "requestBody")
        .when(o["responses"].isNotNull() & ~F.startswith(o["responses"], F.lit("{")), "responses")
    )
    joined = lambda *parts: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
    content = F.lit('"content":{"application/json":{"schema":{"type":"object"}}}')
    body = F.when(F.get_json_object(o["requestBody"], "$.content").isNotNull(), o["requestBody"]).otherwise(joined(content, _rest(o["requestBody"], ["content"])))
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    fixed = joined(
        F.when(~empty(o["parameters"]), part("parameters", o["parameters"])), F.when(~empty(o["requestBody"]), part("requestBody", body)),
        part("responses", F.coalesce(o["responses"], F.lit('{"200":{"description":"Success"},"500":{"description":"Internal Server Error"}}'))),
        part("summary", routes.json_text(F.coalesce(o["summary"], F.lit("API endpoint operation")))), _rest(F.col("operation"), ["parameters", "requestBody", "responses", "summary"]),
    )
    return operations.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED")).withColumn("repaired", F.when(F.col("error").isNull(), fixed))


def cached_batches(wanted: DataFrame, batch: list[str], cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """`wanted` (key, batch columns) with value and `asks`: a batch is asked for as a whole unless all its keys have fresh entries."""
    met = cache_lookup(wanted, cache, now, ttl_seconds)
    return met.withColumn("asks", ~F.bool_and("hit").over(Window.partitionBy(*batch)))


def _without(key: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(~F.map_contains_key(x, key), F.lit(True))


def checked_lists(rows: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """`rows` (answer, JSON) with status, error, defaulted and a column for each of `lists`, its JSON (`[]` where it is missing).

    An answer must be an object, each list an array, and its items objects with the keys that `lists` names for it;
    else the answer is FAILED and `error` names the part. An answer without any of the lists gets all of them, empty.
    """
    whole = F.startswith(F.ltrim("answer"), F.lit("{")) & F.try_parse_json("answer").isNotNull()
    error, found = F.when(~F.coalesce(whole, F.lit(False)), "answer"), {n: F.get_json_object("answer", f"$.{n}") for n in lists}
    for n, keys in lists.items():
        items = F.from_json(found[n], "array<map<string,string>>")
        bad = ~F.startswith(found[n], F.lit("["))
        for k in keys:
            bad = bad | F.coalesce(F.exists(items, _without(k)), F.lit(True))
        error = error.when(found[n].isNotNull() & bad, n)
    out = rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED"))
    out = out.withColumn("defaulted", F.col("error").isNull() & F.coalesce(*found.values()).isNull())
    return out.select("*", *[F.when(F.col("error").isNull(), F.coalesce(c, F.lit("[]"))).alias(n) for n, c in found.items()])
