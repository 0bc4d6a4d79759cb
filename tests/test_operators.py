"""The engine's operators against plain Python, on small inputs with nulls, ties and hot groups."""

import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.functions import detect, responses, routes, scoring
from gleaner.operators import endpoints as ep
from gleaner.operators import enrichment, generators, matching, parsers
from gleaner.operators.catalog import CATALOG, COMMENTS
from gleaner.plans import sinks
from gleaner.sources.snapshots import Snapshots
from tests import literal_cases
from gleaner.sources import files
from gleaner.streaming import incremental


def brute_matches(text, language):
    lines = text.split("\n")
    for k, (framework, kind, method, route, label, rx) in enumerate(CATALOG[language]):
        for n, m in enumerate(re.finditer(rx, text, re.M | re.I), 1):
            line = text.count("\n", 0, m.start()) + 1
            if not lines[line - 1].lstrip().startswith(COMMENTS[language]):
                yield line, framework, kind, ((m.group(method) if method else None) or "ANY").upper(), (m.group(route) if route else None) or label or framework, m.group(0)[:150], k, n


@pytest.mark.parametrize("language", sorted(CATALOG))
def test_patterns_match_as_python_does(spark, language):
    texts = [t for _, t in literal_cases.SOURCES] + [literal_cases.CATALOG_TEXT, "", '# @app.get("/x")\n@app.route("/é", methods=["GET"])\n\n"/health"', "router.get('/a/:b', f)\n\t// app.get('/c')"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("none", None)], "path string, content string")
    got = sorted(tuple(r) for r in matching.match_language(df, language).select("path", "line", "framework", "kind", "method", "route", "raw_match", "pattern", "match").collect())
    assert got == sorted((str(k), *m) for k, t in enumerate(texts) for m in brute_matches(t, language))


def test_catalog_is_whole():
    assert sum(map(len, CATALOG.values())) == 188


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_batches_are_exact_in_a_hot_group(spark, size):
    pdf = pd.DataFrame({"g": ["hot"] * 900 + [None] * 50 + ["b"] * 3, "x": [(k * 7919) % 953 for k in range(953)]})
    pdf["x"] = pdf["x"].where(pdf["x"] != 11)
    df = spark.createDataFrame([(g, None if x != x else int(x)) for g, x in pdf.itertuples(index=False)], "g string, x int")
    got = {(r.g, r.x): r.batch for r in ep.batches(df, ["g"], ["x"], size).collect()}
    want = {}
    for g in ("hot", None, "b"):
        xs = sorted((r.x for r in df.collect() if r.g == g), key=lambda v: (v is not None, v or 0))
        want |= {(g, x): k // size for k, x in enumerate(xs)}
    assert got == want
    assert ep.batches(df.limit(0), ["g"], ["x"], size).count() == 0


def test_diff_takes_the_last_row_of_a_key(spark):
    cols = "route string, method string, auth string, n int"
    old = spark.createDataFrame([("/a", "GET", "PRIVATE", 1), ("/a", "GET", "PUBLIC", 2), ("/b", "GET", "UNKNOWN", 3), ("/c", "GET", "PRIVATE", 4)], cols)
    new = spark.createDataFrame([("/a", "GET", "PRIVATE", 1), ("/c", "GET", "PUBLIC", 2), ("/d", "GET", None, 3)], cols)
    got = {r.route: (r.change, r.breaking) for r in ep.diff(old, new, ["route", "method"], "auth", ["n"]).collect()}
    assert got == {"/a": ("MODIFIED", True), "/b": ("REMOVED", True), "/c": ("MODIFIED", False), "/d": ("ADDED", False)}
    assert ep.change_summary(ep.diff(old, old, ["route", "method"], "auth", ["n"])).first().total == 0


def test_first_per_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 5, "c"), (None, 4, "d")], "k int, o int, v string")
    assert sorted(r.v for r in ep.first_per(df, ["k"], ["o"]).collect()) == ["a", "d"]


def test_policies_may_be_sql(spark):
    e = spark.createDataFrame([("GET", "/a", None), ("POST", "/b", "UNKNOWN")], "method string, route string, auth_status string")
    assert [(r.policy, r.route) for r in ep.violations(e, [("p", "LOW", "method = 'POST'"), ("q", "LOW", "auth_status = 'PUBLIC'")]).collect()] == [("p", "/b")]
    gate = ep.gate(e.withColumn("risk_level", F.lit("LOW")).limit(0), ep.violations(e)).first()
    assert (gate.critical_found, gate.policy_broken) == (False, False)


def test_scores(spark):
    rows = [("password token /health", "GET"), ("", "DELETE"), ("nothing", "GET")]
    d = scoring.with_flags(spark.createDataFrame(rows, "t string, m string"), F.col("t")).withColumn("a", scoring.auth_status(F.col("_flags")))
    d = d.withColumn("s", scoring.risk_score(F.col("_flags"), F.col("m"), F.col("a")))
    d = d.select("a", "s", scoring.risk_level(F.col("s")).alias("l"), F.size(scoring.risk_reasons(F.col("_flags"), F.col("m"), F.col("a"))).alias("n"))
    assert [tuple(r) for r in d.collect()] == [("PUBLIC", 8, "CRITICAL", 3), ("UNKNOWN", 2, "LOW", 2), ("UNKNOWN", 1, "LOW", 1)]


def test_expected_answers(spark):
    d = spark.createDataFrame([("get",), ("TRACE",)], "m string").select(responses.standard_codes(F.col("m")).alias("c"), responses.description(F.col("m"), F.lit("users")).alias("d"))
    assert [tuple(r) for r in d.collect()] == [([200, 206, 400, 401, 403, 404, 429, 500], "Retrieve users"), ([200, 400, 401, 403, 500], "Perform TRACE operation on users")]


def test_unknown_hints_and_doubled_names(spark):
    d = spark.createDataFrame([("/a/{x}/{x}/:x/<odd:y>",), ("",), (None,)], "r string").select(routes.params(F.col("r")).alias("p"))
    assert [None if r.p is None else [(x.name, x.hint) for x in r.p] for r in d.collect()] == [[("x", "string"), ("y", "odd")], [], None]


def test_asking_falls_back_to_single_prompts(spark):
    def ask(prompts):
        if "bad" in prompts:
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    d = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1)
    assert {r.prompt: (r.status, r.answer) for r in enrichment.ask_in_batches(d, ask, size=3, tries=1).collect()} == {"a": ("SUCCESS", "A"), "bad": ("FAILED", None), "c": ("SUCCESS", "C")}


def test_code_around_endpoints(spark):
    e = spark.createDataFrame([("a.py", 2), ("gone.py", 1)], "path string, line int")
    f = spark.createDataFrame([("a.py", "1\n2\n3\n4")], "path string, content string")
    assert {r.path: r.code for r in enrichment.with_code(e, f, around=1).collect()} == {"a.py": "1\n2\n3", "gone.py": ""}


def test_reachable_classes_end_in_cycles(spark):
    chain = [(f"K{k}", f"K{k + 1}") for k in range(12)]  # further than any fixed depth
    p = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("D", "A"), ("C", None), ("C", "K0"), *chain], "class string, ref string")
    assert sorted(r[0] for r in parsers.reachable_classes(p, spark.createDataFrame([("A",)], "class string")).collect()) == sorted(["A", "B", "C", *[f"K{k}" for k in range(13)]])


def test_broken_files_give_nothing(spark):
    df = spark.createDataFrame([("a.py", "def ("), ("b.cs", "class XController {"), ("c.java", None), ("d.py", None), ("e.cs", "")], "path string, content string")
    assert parsers.python_functions(df).count() == parsers.controllers(df).count() == parsers.dto_properties(df).count() == parsers.action_parameters(df).count() == 0


@pytest.mark.parametrize(("text", "summary", "found"), [
    ("Do it.\n\nArgs:\n    a: first\n    b (int): second\n", "Do it.", {"a": "first", "b": "second"}), ("Do it.\n\n:param a: first\n:param int b: second", "Do it.", {"a": "first", "b": "second"}),
    ("Do it.\n\nParameters\n----------\na : int\n    first\n", "Do it.", {"a": "first"}), ("Plain.", "Plain.", {}), (None, "", {}),
])
def test_docstrings(text, summary, found):
    assert parsers.docstring(text) == (summary, found)


def test_reports_are_whole(spark):
    e = spark.createDataFrame([("a\\b.py", 3, "GET", '/x"<1>', "UNKNOWN", "HIGH", "ENDPOINT"), ("c.py", 1, "POST", "/y", "PUBLIC", "CRITICAL", "ENDPOINT")], "path string, line int, method string, route string, auth_status string, risk_level string, kind string")
    v = ep.violations(e)
    whole = lambda df: json.loads("\n".join(r.value for r in df.collect()))
    doc = whole(sinks.sarif_document(sinks.sarif_results(e)))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 4 and {r["ruleId"] for r in doc["runs"][0]["results"]} == {"API001", "API002", "API004"}
    assert doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] in ("a/b.py", "c.py")
    assert all("<1>" not in r.value for r in sinks.junit_cases(e, v).collect())
    assert whole(sinks.sarif_document(sinks.sarif_results(e.limit(0))))["runs"][0]["results"] == []
    spec = whole(sinks.openapi_document(sinks.openapi_operations(e), title='A "B"'))
    assert sorted(spec["paths"]) == ['/x"<1>', "/y"] and "post" in spec["paths"]["/y"]
    assert json.loads(sinks.series(ep.counters(e), F.lit(5), ["t:1"]).first().value) == {"metric": "api_scan.total", "points": [[5.0, 2.0]], "tags": ["t:1"], "type": "gauge"}
    lines = [json.loads(r.value) for r in sinks.audit_lines("s", F.lit("now"), critical=e.limit(1), broken=v).collect()]
    assert {x["event_type"] for x in lines} == {"CRITICAL_FINDING", "POLICY_VIOLATION"} and all(x["scan_id"] == "s" for x in lines)
    assert sinks.report(e, ep.summary(e, ["method", "risk_level"])).count() == 6
    report = whole(sinks.report_document(e, v, {"scan_id": "s", "version": "1"}))
    assert report["scan_id"] == "s" and report["summary"]["total"] == 2 and report["summary"]["by_risk"] == {"CRITICAL": 1, "HIGH": 1} and len(report["endpoints"]) == 2 and len(report["policy_violations"]) == v.count()
    empty = whole(sinks.report_document(e.limit(0), v.limit(0), {"scan_id": "s"}))
    assert empty["endpoints"] == empty["policy_violations"] == [] and empty["summary"]["total"] == 0
    assert json.loads(sinks.metrics(ep.counters(e), {"scan_id": "s"}).first().value) == {"scan_id": "s", "total": 2, "shadow": 1, "critical": 2}
    started = sinks.audit_lines("s", F.lit("now"), started=spark.createDataFrame([("t", "u")], "target string, user string")).first().value
    assert json.loads(started)["event_type"] == "SCAN_STARTED" and json.loads(started)["scan"] == {"target": "t", "user": "u"}


def test_openapi_with_components_and_answers(spark):
    ops = literal_cases.controller_operations(spark)
    doc = json.loads("\n".join(r.value for r in sinks.openapi_document(ops, schemas=parsers.dto_schemas(parsers.dto_properties(literal_cases.code(spark)))).collect()))
    assert set(doc["components"]["schemas"]) == {"OrderDto", "LineDto"} and doc["components"]["schemas"]["OrderDto"]["required"] == ["name"]
    assert doc["paths"]["/api/Orders"]["post"]["requestBody"]["required"] is True
    answers = spark.createDataFrame([("POST", "/api/Orders", '{"summary":"Order","operationId":"mine","responses":{"201":{"description":"Made"}}}'), ("GET", "/none", "{}")], "method string, route string, repaired string")
    got = {r.method: json.loads(r.operation) for r in sinks.enriched_operations(ops, answers).collect()}
    assert got["post"]["summary"] == "Order" and got["post"]["operationId"] == "post_api_Orders" and got["post"]["x-source-line"] == 7 and list(got["post"]["responses"]) == ["201"]
    assert "summary" not in got["get"] and got["get"]["responses"]["200"]


def test_baseline_and_cache(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "base"), buckets=2)
    files_, old = kept.baseline()
    assert files_.count() == old.count() == 0
    now = spark.createDataFrame([("a.py", "@app.get('/a')", "1"), ("b.py", "@app.get('/b')", "2"), ("c.py", None, "3")], "path string, content string, md5 string")
    first = ep.incremental_scan(now, (files_, old))
    kept.save(now.select("path", "md5"), first)
    assert {r.route for r in first.filter("kind = 'ENDPOINT'").collect()} == {"/a", "/b"}
    later = spark.createDataFrame([("a.py", "@app.get('/new')", "9"), ("b.py", "unread", "2")], "path string, content string, md5 string")
    again = ep.incremental_scan(later, kept.baseline())
    assert {(r.path, r.route) for r in again.filter("kind = 'ENDPOINT'").collect()} == {("a.py", "/new"), ("b.py", "/b")}
    new = spark.createDataFrame([("k", 1), ("k", 3), ("k", 2), (None, 5)], "key string, value int")
    assert sorted(map(tuple, ep.cache_upsert(new.limit(0), new).collect()), key=str) == [("k", 3), (None, 5)]


def test_code_and_answers_are_joined(spark):
    e = spark.createDataFrame([("a.py", 2, "GET", "/x"), ("a.py", 1, "GET", "/x"), ("b.py", 9, "PUT", "/y")], "path string, line int, method string, route string")
    code = enrichment.with_code(e, spark.createDataFrame([("a.py", "1\n2\n3\n4"), ("a.py", "1\n2\n3\n5")], "path string, content string"), 1)
    assert sorted((r.path, r.line, r.code) for r in code.collect()) == [("a.py", 1, "1\n2"), ("a.py", 2, "1\n2\n3"), ("b.py", 9, "")]
    answers = spark.createDataFrame([("GET", "/x", "told")], "method string, route string, answer string")
    assert sorted((r.line, r.answer) for r in enrichment.with_answers(e, answers).collect()) == [(1, "told"), (2, "told"), (9, None)]
    asked = enrichment.shared_prompt(e).first()
    assert (asked.n, asked["sample"]) == (3, ["GET /x", "PUT /y"])


def test_own_patterns(spark):
    rows = [("x.lua", "route('/l', get)"), ("a.py", "@app.get('/a')")]
    own = {"lua": [("Lapis", "ENDPOINT", None, 1, None, r"route\('([^']*)'")]}
    got = ep.scan(spark.createDataFrame(rows, "path string, content string"), patterns=own, extensions={".lua": "lua"}).collect()
    assert [(r.path, r.framework, r.route, r.language) for r in got] == [("x.lua", "Lapis", "/l", "lua")]


def test_policy_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"policies": [{"name": "n", "severity": "LOW", "condition": "method = \'POST\'"}, {"name": "broken"}]}')
    policies = ep.read_policies(spark, str(tmp_path / "p.json"))
    e = spark.createDataFrame([("GET", "/a", None), ("POST", "/b", "UNKNOWN")], "method string, route string, auth_status string")
    assert policies == [("n", "LOW", "method = 'POST'")] and [r.route for r in ep.violations(e, policies).collect()] == ["/b"]


def test_likely_fields(spark):
    d = spark.createDataFrame([("ssrf",), ("other",)], "c string")
    assert [r[0] for r in d.select(detect.likely_field(F.col("c"))).collect()] == ["url", "input"]


def test_files_and_the_stream(spark, tmp_path):
    for name, text in [("tests/app/main.py", "@app.get('/a')\r\ndef f(): pass\n"), ("tests/app/node_modules/x.js", "app.get('/b')"), ("tests/app/readme.txt", "app.get('/c')"), ("tests/app/big.py", "#" * 200)]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    got = files.source_files(spark, str(tmp_path / "tests/app"), max_bytes=100).collect()
    assert [(r.path, r.content.count("\r"), r.length) for r in got] == [("main.py", 0, 30)]
    out, root = str(tmp_path / "out"), str(tmp_path / "tests/app")
    run = lambda: incremental.scan_stream(incremental.stream_files(spark, root), out, str(tmp_path / "ckpt")).awaitTermination(120)
    run()
    routes_of = lambda: sorted((r.path, r.route) for r in incremental.merged(spark, out).filter("kind = 'ENDPOINT'").collect())
    assert routes_of() == [("main.py", "/a")]
    (tmp_path / "tests/app/other.py").write_text("@app.get('/o')")
    run()
    assert routes_of() == [("main.py", "/a"), ("other.py", "/o")]


def test_generators_skip_what_has_no_bound(spark):
    d = spark.createDataFrame([(None, None, 5.0, None, True), (None, None, None, None, False)], "gt double, ge double, lt double, le double, is_int boolean")
    assert sorted((r.violation, r.value) for r in generators.range_violations(d).collect()) == [("above_upper_bound", "6"), ("at_upper_bound", "5")]
    assert generators.confident(spark.createDataFrame([(0.39,), (0.4,), (None,)], "confidence double")).count() == 1


def test_cache(spark):
    cache = spark.createDataFrame([("a", 1, 100), ("b", 2, 10), ("c", None, 100)], "key string, value int, t int").withColumn("created_at", F.timestamp_seconds("t")).drop("t")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "key string")
    got = {r.key: (r.hit, r.value) for r in ep.cache_lookup(wanted, cache, F.timestamp_seconds(F.lit(150)), 60).collect()}
    assert got == {"a": (True, 1), "b": (False, None), "c": (True, None), "d": (False, None), None: (False, None)}
