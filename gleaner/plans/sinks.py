"""Findings as SARIF, JUnit, Prometheus, OpenAPI and JSON: rows or lines of text, ready for any writer."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.detect import real_route
from gleaner.functions.routes import json_text, normalise, operation_id, param_type, params
from gleaner.sources.shared import cut


def sarif_results(endpoints: DataFrame, policies: list | None = None) -> DataFrame:
    """(rule, level, message, uri, line): high risks (API002), endpoints without known authentication (API001), violations of `policies` (API004).

    All results of an endpoint come from one pass over it.
    """
    from gleaner.operators.endpoints import conditions

    result = lambda rule, level, *words: F.struct(F.lit(rule).alias("rule"), level.alias("level"), F.concat_ws(" ", *words, "method", "route").alias("message"))
    grave = lambda c: F.when(c, F.lit("error")).otherwise("warning")
    risk = F.when(F.col("risk_level").isin("CRITICAL", "HIGH"), result("API002", grave(F.col("risk_level") == "CRITICAL"), F.col("risk_level"), F.lit("risk:")))
    shadow = F.when(F.col("auth_status") == "UNKNOWN", result("API001", F.lit("warning"), F.lit("No authentication found:")))
    broken = [F.when(c, result("API004", grave(F.lit(s == "CRITICAL")), F.lit(n), F.lit("broken by"))) for n, s, c in conditions(policies)]
    rows = endpoints.select(F.explode_outer(F.array_compact(F.array(risk, shadow, *broken))).alias("r"), F.replace("path", F.lit("\\"), F.lit("/")).alias("uri"), "line")
    return rows.filter(F.col("r").isNotNull()).select("r.*", "uri", "line")


def as_document(rows: DataFrame, header: str, footer: str, order: list[str]) -> DataFrame:
    """(value): a document of lines, the header, the rows' `value` in order with commas between, the footer. Written as text, its parts in order are the file.

    Lines are sorted over all tasks; no task or row holds the document. Rows are numbered and written once, so that equal ones are told apart: the
    first in order, and of equal ones that of the least number, has no comma before it. Rows whose value is null are left out.
    """
    numbered = cut(rows.filter(F.col("value").isNotNull()).select(*order, "value", F.monotonically_increasing_id().alias("_i")))
    key = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate([*order, "value"])], F.col("_i"))
    first = numbered.agg(F.min(key).alias("_f"))  # one row
    lines = numbered.join(F.broadcast(first)).select(F.lit(1).alias("_n"), key.alias("_k"), F.concat(F.when(F.col("_i") == F.col("_f._i"), "").otherwise(","), F.col("value")).alias("value"))
    ends = lines.sparkSession.createDataFrame([(0, header), (2, footer)], "_n int, value string").select("_n", F.lit(None).cast(lines.schema["_k"].dataType).alias("_k"), "value")
    return lines.unionByName(ends).orderBy("_n", "_k").select("value")


def sarif_document(results: DataFrame) -> DataFrame:
    """(value): the lines of the SARIF 2.1.0 document, a result each."""
    places = F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    one = F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), places.alias("locations")))
    return as_document(results.select("uri", "line", "rule", one.alias("value")), '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"gleaner"}},"results":[', "]}]}", ["uri", "line", "rule"])


def escape_xml(c):
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def junit_cases(endpoints: DataFrame, broken: DataFrame) -> DataFrame:
    """(suite, value): a <testcase> line for each endpoint, failed if its risk is high, and for each violation."""
    name = escape_xml(F.concat_ws(" ", "method", "route"))
    case = lambda failure: F.concat(F.lit('<testcase name="'), name, F.lit('" classname="'), escape_xml(F.col("path")), F.lit('">'), failure, F.lit("</testcase>"))
    risky = F.when(F.col("risk_level").isin("CRITICAL", "HIGH"), F.concat(F.lit('<failure message="'), F.col("risk_level"), F.lit('"/>'))).otherwise("")
    own = endpoints.select(F.lit("endpoints").alias("suite"), case(risky).alias("value"))
    return own.unionByName(broken.select(F.lit("policies").alias("suite"), case(F.concat(F.lit('<failure message="'), escape_xml(F.col("policy")), F.lit('"/>'))).alias("value")))


def prometheus(counters: DataFrame, prefix: str = "api_scan") -> DataFrame:
    """(value): a line of exposition text for each column of a one-row table of numbers."""
    lines = F.array(*[F.concat_ws(" ", F.lit(f"{prefix}_{c}"), F.col(c).cast("string")) for c in counters.columns])
    return counters.select(F.explode(lines).alias("value"))


#: What every operation may answer.
_ANSWERS = '"400":{"description":"Bad request"},"401":{"description":"Unauthorized"},"404":{"description":"Not found"},"500":{"description":"Internal server error"}'


def _joined(*parts: Column) -> Column:
    """A JSON object of the parts that aren't null."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _content(schema: Column) -> Column:
    return F.concat(F.lit('"content":{"application/json":{"schema":'), schema, F.lit("}}"))


def openapi_operations(endpoints: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(route, method, operation, body, returns): one operation for each route and verb, the first in order of path and line, as JSON.

    Parameters in the route, and of `details` (path, line, query, body, returns; see `parsers.action_details`) those in the query, the request body and what is
    answered. body and returns name the classes referred to.
    """
    from gleaner.operators.endpoints import first_per

    given = {c: F.col(c) if c in endpoints.columns else F.lit("").alias(c) for c in ("framework", "language", "auth_status")}
    e = endpoints.filter(F.col("kind").isin("ENDPOINT", "TOOL", "RESOURCE", "HANDLER") & real_route(given["framework"], F.col("method"), F.col("route"))).withColumn("route", normalise(F.col("route")))
    verb = F.lower("method")
    e = e.withColumn("verb", F.when(verb.isin("get", "post", "put", "delete", "patch", "options", "head", "trace"), verb).when(verb.isin("query", "mutation"), "post").otherwise("get"))
    e = first_per(e.select("*", *[v.alias(c) for c, v in given.items() if c not in endpoints.columns]), ["route", "verb"], ["path", "line", "method"])
    if details is not None:
        e = e.join(details.select(F.col("path").alias("_p"), F.col("line").alias("_l"), "query", "body", "returns"), (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")), "left")
    else:
        e = e.select("*", F.lit(None).cast("array<struct<name:string,type:string,required:boolean>>").alias("query"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("returns"))
    place = lambda where, name, required, kind: F.to_json(F.struct(name.alias("name"), F.lit(where).alias("in"), required.alias("required"), F.struct(kind.alias("type")).alias("schema")))
    named = params(F.col("route"))
    in_path = F.transform(named, lambda p: place("path", p["name"], F.lit(True), param_type(p["name"], p["hint"])))
    others = F.filter(F.coalesce("query", F.array().cast("array<struct<name:string,type:string,required:boolean>>")), lambda q: ~F.exists(params(F.col("route")), lambda p: p["name"] == q["name"]))
    all_params = F.concat(in_path, F.transform(others, lambda q: place("query", q["name"], q["required"], q["type"])))
    ref = lambda c: F.concat(F.lit('{"$ref":"#/components/schemas/'), c, F.lit('"}'))
    takes = F.when(F.col("verb").isin("post", "put", "patch"), F.concat(F.lit('"requestBody":{'), F.when(F.col("body").isNotNull(), F.concat(F.lit('"required":true,'), _content(ref(F.col("body"))))).otherwise(_content(F.lit('{"type":"object"}'))), F.lit("}")))
    ok = F.concat(F.lit('"200":{"description":"Successful response"'), F.when(F.col("returns").isNotNull(), F.concat(F.lit(","), _content(ref(F.col("returns"))))).otherwise(""), F.lit("},"))
    text = lambda name, c: F.concat(F.lit(f'"{name}":'), json_text(c))
    op = _joined(
        text("operationId", operation_id(F.col("verb"), F.col("route"))), F.concat(F.lit('"tags":'), F.to_json(F.array("framework", "language"))),
        F.when(F.size(all_params) > 0, F.concat(F.lit('"parameters":['), F.array_join(all_params, ","), F.lit("]"))), takes, F.concat(F.lit('"responses":{'), ok, F.lit(_ANSWERS), F.lit("}")),
        F.when(F.col("auth_status") == "PRIVATE", F.lit('"security":[{"bearerAuth":[]},{"apiKeyAuth":[]}]')).when(F.col("auth_status") == "PUBLIC", F.lit('"security":[]')),
        text("x-source-file", F.col("path")), F.concat(F.lit('"x-source-line":'), F.col("line").cast("string")), text("x-risk-level", F.col("risk_level")), F.when(F.col("auth_status") != "", text("x-auth-status", F.col("auth_status"))),
    )
    return e.select("route", F.col("verb").alias("method"), op.alias("operation"), F.when(F.col("verb").isin("post", "put", "patch"), F.col("body")).alias("body"), "returns")


def enriched_operations(operations: DataFrame, answers: DataFrame) -> DataFrame:
    """`openapi_operations` with a model's (method, route, repaired; see `enrichment.repaired_operations`) in their place where there is one.

    What the scan knows stays: x-fields, operationId, tags and security come from it. Of several answers for a route the least text counts.
    """
    own = answers.filter(F.col("repaired").isNotNull()).select(F.lower("method").alias("_m"), normalise(F.col("route")).alias("_r"), "repaired")
    own = own.groupBy("_m", "_r").agg(F.min("repaired").alias("repaired"))
    met = operations.join(own, (F.col("method") == F.col("_m")) & (F.col("route") == F.col("_r")), "left")
    kind = "map<string,variant>"
    mixed = F.map_concat(F.map_filter(F.from_json("repaired", kind), lambda k, v: ~F.array_contains(F.map_keys(F.map_filter(F.from_json("operation", kind), lambda a, b: a.rlike("^(x-.*|operationId|security|tags)$"))), k)), F.map_filter(F.from_json("operation", kind), lambda k, v: k.rlike("^(x-.*|operationId|security|tags)$")))
    return met.withColumn("operation", F.when(F.col("repaired").isNotNull(), F.to_json(mixed)).otherwise(F.col("operation"))).select(*operations.columns)


def openapi_document(operations: DataFrame, title: str = "API", schemas: DataFrame | None = None) -> DataFrame:
    """(value): the lines of the OpenAPI 3.0 document of `openapi_operations`, a route each, then its components.

    Of `schemas` (class, schema; see `parsers.dto_schemas`) those that operations refer to, directly or through others, are in it; classes without one are stubs.
    """
    verbs = operations.groupBy("route").agg(F.array_sort(F.collect_list(F.concat(json_text(F.col("method")), F.lit(":"), F.col("operation")))).alias("v"))
    paths = verbs.select("route", F.concat(json_text(F.col("route")), F.lit(":{"), F.array_join("v", ","), F.lit("}")).alias("value"))
    wanted = operations.select(F.explode(F.array("body", "returns")).alias("class")).filter(F.col("class").isNotNull()).distinct()
    if schemas is not None:
        from gleaner.operators.parsers import reachable_classes

        refs = schemas.select("class", F.explode(F.regexp_extract_all("schema", F.lit("#/components/schemas/([^\"]+)"), F.lit(1))).alias("ref"))
        wanted = reachable_classes(refs, wanted).join(schemas, "class", "left")
    else:
        wanted = wanted.withColumn("schema", F.lit(None).cast("string"))
    parts = wanted.select("class", F.concat(json_text(F.col("class")), F.lit(":"), F.coalesce("schema", F.lit('{"type":"object"}'))).alias("value"))
    begin = '{"openapi":"3.0.0","info":{"title":' + json.dumps(title) + ',"version":"1.0.0"},"paths":{'
    between = '},"components":{"securitySchemes":{"bearerAuth":{"type":"http","scheme":"bearer"},"apiKeyAuth":{"type":"apiKey","in":"header","name":"X-API-Key"}},"schemas":{'
    document = as_document(paths, begin, between, ["route"]).select(F.lit(0).alias("_d"), F.monotonically_increasing_id().alias("_i"), "value")
    return document.unionByName(as_document(parts, "", "}}}", ["class"]).select(F.lit(1).alias("_d"), F.monotonically_increasing_id().alias("_i"), "value")).orderBy("_d", "_i").select("value")


def report(endpoints: DataFrame, dimension_counts: DataFrame) -> DataFrame:
    """(section, value): the summary's counts and each endpoint as JSON lines."""
    rows = endpoints.select(F.lit("endpoint").alias("section"), F.to_json(F.struct(*[c for c in endpoints.columns if c != "context"])).alias("value"))
    return dimension_counts.select(F.lit("summary").alias("section"), F.to_json(F.struct("dimension", "value", "n")).alias("value")).unionByName(rows)


def report_document(endpoints: DataFrame, broken: DataFrame, about: dict[str, str]) -> DataFrame:
    """(value): the lines of the JSON report: timestamp, scan_id, target and version (`about`), summary, endpoints (without context), policy_violations."""
    counts = endpoints.agg(F.count("*").alias("total"), F.count_if(F.col("auth_status") == "UNKNOWN").alias("shadow_apis"), F.count_if(F.col("risk_level").isin("CRITICAL", "HIGH")).alias("critical"))
    groups = {"by_risk": "risk_level", "by_auth": "auth_status", "by_framework": "framework", "by_kind": "kind", "by_language": "language"}
    for name, c in groups.items():
        if c in endpoints.columns:
            by = endpoints.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).filter(F.col("k").isNotNull())
            counts = counts.join(F.broadcast(by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))))  # one row; as many entries as values
    one = lambda df, order: df.select(*order, F.to_json(F.struct(*[c for c in df.columns if c != "context"])).alias("value"))
    order = ["path", "line", "method", "route"]
    head = counts.select(F.concat(F.lit("{" + "".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in about.items()) + '"summary":'), F.to_json(F.struct("*")), F.lit(',"endpoints":[')).alias("value"))
    parts = [head, as_document(one(endpoints, order), "", '],"policy_violations":[', order), as_document(one(broken, [*order, "policy"]), "", "]}", [*order, "policy"])]
    numbered = [p.select(F.lit(k).alias("_d"), F.monotonically_increasing_id().alias("_i"), "value") for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered).orderBy("_d", "_i").select("value")


def metrics(counters: DataFrame, about: dict[str, str]) -> DataFrame:
    """(value): one line of JSON: `about` (scan_id, target, times) and the columns of a one-row table of numbers."""
    return counters.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], *counters.columns)).alias("value"))


def audit_lines(scan_id: str, at: Column, completed: DataFrame | None = None, critical: DataFrame | None = None, broken: DataFrame | None = None, started: DataFrame | None = None) -> DataFrame:
    """(value): a JSON line for each row of a scan's starts (target, user, config), summaries, critical findings and violations, ready to be appended as text."""
    kinds = [("SCAN_STARTED", "scan", started), ("SCAN_COMPLETED", "summary", completed), ("CRITICAL_FINDING", "endpoint", critical), ("POLICY_VIOLATION", "violation", broken)]
    line = lambda kind, name, df: df.select(F.to_json(F.struct(F.lit(kind).alias("event_type"), F.lit(scan_id).alias("scan_id"), at.alias("timestamp"), F.struct(*df.columns).alias(name))).alias("value"))
    return reduce(DataFrame.union, [line(*k) for k in kinds if k[2] is not None])


def series(counters: DataFrame, at: Column, tags: list[str], prefix: str = "api_scan") -> DataFrame:
    """(value): a JSON point for each column of a one-row table of numbers, for services that take series of gauges."""
    points = F.array(*[F.to_json(F.struct(F.lit(f"{prefix}.{c}").alias("metric"), F.array(F.array(at.cast("double"), F.col(c).cast("double"))).alias("points"), F.array(*[F.lit(t) for t in tags]).alias("tags"), F.lit("gauge").alias("type"))) for c in counters.columns])
    return counters.select(F.explode(points).alias("value"))
