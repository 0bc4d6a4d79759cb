"""Ranks, documents, snapshots, reports, policies, questions, references and streams with state: edges and plans."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import endpoints as ep
from gleaner.operators import enrichment, matching
from gleaner.operators.asking import ask_ordered
from gleaner.operators.catalog import CATALOG
from gleaner.operators.catalog_scan import required, scan_catalog
from gleaner.operators.closure import closure
from gleaner.plans import sinks
from gleaner.plans.stream_queries import source
from gleaner.sources import report_sink
from gleaner.sources.snapshots import Snapshots, changed_between, gone_between
from gleaner.streaming.state import first_seen
from tests import literal_cases


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_group_is_ranked_by_all_tasks(spark, monkeypatch):
    """20,000 routes that begin alike in one group are spread over tasks, and ranks are exact; nulls and repeated rows have theirs."""
    rows = [("a", f"/api/v1/item{k:05d}") for k in range(20_000)] + [("b", "/x"), ("b", "/x"), ("b", None), (None, "/y"), (None, "/z")]
    random.Random(1).shuffle(rows)
    seen, real = [], ep.cut
    monkeypatch.setattr(ep, "cut", lambda df: seen.append(real(df)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ep.ranked(spark.createDataFrame(rows, "g string, route string").withColumn("rank", F.lit("clash")).drop("rank"), ["g"], ["route"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    in_range = [r["n"] for r in seen[0].groupBy("_at").agg(F.count("*").alias("n")).collect()]
    assert len(in_range) == 4 and max(in_range) < 8_000
    assert {r["route"]: r["rank"] for r in got if r["g"] == "a"} == {f"/api/v1/item{k:05d}": k + 1 for k in range(20_000)}
    assert sorted((r["route"] or "", r["rank"]) for r in got if r["g"] == "b") == [("", 1), ("/x", 2), ("/x", 3)]
    assert [r["rank"] for r in sorted((r for r in got if r["g"] is None), key=lambda r: r["route"])] == [1, 2]


def test_equal_results_are_one_document(spark):
    one = ("API001", "warning", "m", "a.py", 1)
    rows = spark.createDataFrame([one, one, ("API002", "error", "n", "b.py", 2), one], "rule string, level string, message string, uri string, line int")
    doc = json.loads("\n".join(r.value for r in sinks.sarif_document(rows).collect()))
    assert [x["ruleId"] for x in doc["runs"][0]["results"]] == ["API001", "API001", "API001", "API002"]
    assert json.loads("\n".join(r.value for r in sinks.sarif_document(rows.limit(0)).collect()))["runs"][0]["results"] == []


def test_repaired_operations_keep_what_they_have(spark):
    op = {"description": "d", "tags": ["a", "b"], "deprecated": True, "x-n": 1.5, "requestBody": {"required": True, "description": "b"}, "summary": 'a "b"'}
    got = json.loads(enrichment.repaired_operations(spark.createDataFrame([(json.dumps(op),)], "operation string")).first()["repaired"])
    assert {k: got[k] for k in op if k != "requestBody"} == {k: v for k, v in op.items() if k != "requestBody"}
    assert got["requestBody"] == op["requestBody"] | {"content": {"application/json": {"schema": {"type": "object"}}}} and set(got["responses"]) == {"200", "500"}


def test_incremental_scan_shuffles_no_content(spark):
    files = spark.createDataFrame([(p, c, str(hash(c))) for p, c in [("a.py", '@app.get("/a")'), ("b.py", '@app.get("/b")'), ("c.py", "")]], "path string, content string, md5 string")
    found = ep.scan(files)
    assert ep.incremental_scan(files, (files.select("path", "md5"), found)).count() == found.count()
    now = files.withColumn("content", F.when(F.col("path") == "b.py", '@app.post("/new")').otherwise(F.col("content"))).withColumn("md5", F.when(F.col("path") == "b.py", "other").otherwise(F.col("md5")))
    seen = []
    got = ep.incremental_scan(now, (files.select("path", "md5"), found), lambda f: seen.append(f) or ep.scan(f))
    assert {(r.path, r.method, r.route) for r in got.collect()} == {(r.path, r.method, r.route) for r in ep.scan(now).collect()}
    assert [r.path for r in seen[0].collect()] == ["b.py"] and "Exchange hashpartitioning" not in plan(seen[0])


def test_snapshots(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "base"), buckets=3)
    assert kept.versions() == [] and kept.read("files") is None
    files = spark.createDataFrame([("a", "1", "text"), ("b", "2", "text"), ("c", None, None)], "path string, md5 string, content string")
    ends = spark.createDataFrame([("a", "GET")], "path string, method string")
    assert kept.save(files, ends) == 1
    later = spark.createDataFrame([("a", "1", "text"), ("b", "3", "other"), ("d", "4", None), ("c", None, None)], "path string, md5 string, content string")
    assert kept.save(later, ends) == 2 and kept.versions() == [1, 2]
    with pytest.raises(FileExistsError):  # another writer started from version 1
        kept.save(files, ends, seen=1)
    assert kept.versions() == [1, 2]
    again = Snapshots(spark, str(tmp_path / "base"))
    changed = changed_between(again.read("files"), again.read("files", 1))
    assert {(r.path, r.content, r.state) for r in changed.collect()} == {("b", "other", "changed"), ("d", None, "new")}
    assert "Exchange" not in plan(changed) and "SortMergeJoin" in plan(changed)
    assert gone_between(again.read("files", 1), again.read("files", 2)).collect()[0].path == "d" and again.read("files", 7) is None


def test_reports(spark, tmp_path):
    place = str(tmp_path / "report")
    rows = spark.createDataFrame([(k % 5, json.dumps({"k": k % 5, "t": "a,\nb"})) for k in range(40)] + [(9, None)], "k int, value string").repartition(6)
    report_sink.write_report(rows, place, ["k"], '{"rows":[', "]}")
    assert [x["k"] for x in report_sink.check_report(place)["rows"]] == sorted(k % 5 for k in range(40))
    assert report_sink.read_report(spark, place).count() == 40
    with pytest.raises(Exception, match="report"):
        report_sink.write_report(rows, place, ["k"])
    assert len(report_sink.check_report(place)["rows"]) == 40
    report_sink.write_report(rows.limit(0), place, ["k"], overwrite=True)
    assert report_sink.check_report(place) == []
    failing = rows.withColumn("value", F.when(F.col("k") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        report_sink.write_report(failing, str(tmp_path / "other"), ["k"])
    assert not [x for x in (tmp_path / "other").glob("*")] if (tmp_path / "other").exists() else True


def test_policies_as_a_table(spark):
    e = spark.createDataFrame([("/api/users/1", 5.0), ("/api/users", 25.0), ("/admin", -3.0), (None, 1.0), ("/x", None)], "route string, score double")
    p = spark.createDataFrame([("a", "LOW", "/api/users", 0.0, 10.0), ("b", "LOW", "/api/", 20.0, None), ("c", "HIGH", "/ad", -10.0, 0.0), ("d", "HIGH", "/api/users", 10.0, 0.0), ("e", "LOW", None, 25.0, 25.1), ("f", "LOW", "/ad", None, 0.0)], "policy string, severity string, prefix string, low double, high double")
    got = ep.policy_violations(e, p)
    assert {(r.policy, r.route) for r in got.collect()} == {("a", "/api/users/1"), ("b", "/api/users"), ("c", "/admin"), ("e", "/api/users"), ("f", "/admin")}
    bounded = plan(ep.policy_violations(e, p.filter("policy <> 'f'")))
    assert "NestedLoop" not in bounded and "Cartesian" not in bounded


def test_questions_in_order(spark):
    rows = spark.createDataFrame([(1, k, None if k == 3 else "bad" if k == 5 else f"p{k}") for k in range(7)] + [(2, 0, "p")], "conv int, turn int, prompt string").repartition(3)

    def ask(prompts):
        if "bad" in prompts:
            raise ValueError
        return [p.upper() for p in prompts]

    got = {(r.conv, r.turn): (r.batch, r.tried, r.status, r.answer) for r in ask_ordered(rows, "conv", "turn", "prompt", ask, size=3, tries=2).collect()}
    assert got[1, 0] == (0, 1, "SUCCESS", "P0") and got[1, 3] == (1, 0, "FAILED", None) and got[1, 4] == (1, 3, "SUCCESS", "P4") and got[1, 5] == (1, 4, "FAILED", None) and got[1, 6] == (2, 1, "SUCCESS", "P6")
    assert got[2, 0] == (0, 1, "SUCCESS", "P") and len(got) == 8 and ask_ordered(rows.limit(0), "conv", "turn", "prompt", ask).count() == 0


def test_references(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(30, 0), (3, 3), (None, 1), (1, None), (5, 6)], "a int, b int")
    got = {(r.origin, r.node): r.steps for r in closure(edges, spark.createDataFrame([(0,), (29,), (99,), (None,), (0,)], "node int")).collect()}
    assert got == {(0, k): k for k in range(31)} | {(29, (29 + k) % 31): k for k in range(31)} | {(99, 99): 0}
    few = {(r.origin, r.node) for r in closure(edges, spark.createDataFrame([(0,)], "node int"), most_steps=8).collect()}
    assert few == {(0, k) for k in range(9)}


def test_catalog_scan_is_the_scan_within_tasks(spark):
    texts = [t for _, t in literal_cases.SOURCES] + [literal_cases.CATALOG_TEXT, "", '# @app.get("/x")\n@app.route("/é", methods=["GET"])\n\n"/health"', "router.get('/a/:b', f)\n\t// app.get('/c')", None]
    for language in ("python", "javascript", "go", "java", "rust"):
        files = spark.createDataFrame([(str(k), t, language) for k, t in enumerate(texts)], "path string, content string, language string")
        want = {(r.path, r.pattern, r.match, r.line, r.method, r.route, r.framework) for r in matching.match_language(files.filter("content IS NOT NULL"), language).collect()}
        got = {(r.path, r.pattern, r["index"], r.line, r.method, r.route, r.framework) for r in scan_catalog(files, "content", language="language").collect()}
        assert got == want
    assert "Python" not in plan(scan_catalog(files, "content"))


def test_literals_are_in_every_match(spark):
    for entries in CATALOG.values():
        for *_, rx in entries:
            sets = required(rx)
            assert sets
            for m in re.finditer(rx, literal_cases.CATALOG_TEXT, re.M | re.I):
                assert all(any(x in m[0].lower() for x in s) for s in sets), (rx, m[0])


def test_first_seen_goes_on_after_a_stop(spark, tmp_path):
    """The stream stops after its first file; a new query goes on from the checkpoint and still knows the keys."""
    at = F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, n)")
    place = str(tmp_path)

    def add(k, rows):
        spark.createDataFrame(rows, "key string, id bigint, n int").select("key", "id", at.alias("at")).coalesce(1).write.parquet(f"{place}/in/{k}")

    def run():
        q = first_seen(source(spark, f"{place}/in", "key string, id bigint, at timestamp"), 10**7).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.key, r.id) for r in spark.read.parquet(f"{place}/out").collect())

    add(1, [("a", 2, 5), ("a", 1, 5), ("b", 3, 1), ("b", 4, 0)])
    assert run() == [("a", 1), ("b", 4)]
    add(2, [("a", 0, 9), ("c", 7, 9)])
    assert run() == [("a", 1), ("b", 4), ("c", 7)]


def test_references_take_few_rounds(spark, monkeypatch):
    """A chain of 300 and a cycle: the rounds that are written grow as the logarithm of the steps; where walks would multiply, they stay single steps and results are the same."""
    from gleaner.operators import closure as module

    cuts, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: cuts.append(1) or real(df))
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(300, 290)], "a int, b int")
    got = {(r.origin, r.node): r.steps for r in closure(edges, spark.createDataFrame([(0,), (295,)], "node int")).collect()}
    assert got == {(0, k): k for k in range(301)} | {(295, 290 + (5 + k) % 11): k for k in range(11)}
    assert len(cuts) < 30
    full = [(a, b) for a in range(12) for b in range(12)] + [(11, 12), (12, 13)]
    got = {(r.origin, r.node): r.steps for r in closure(spark.createDataFrame(full, "a int, b int"), spark.createDataFrame([(0,)], "node int")).collect()}
    assert got == {(0, 0): 0} | {(0, k): 1 for k in range(1, 12)} | {(0, 12): 2, (0, 13): 3}


def test_policies_meet_few_endpoints_in_vain(spark):
    """Endpoints that no number of a policy without an upper bound fits don't meet it; numbers without an end, wide bounds and prefixes that end within a segment are right."""
    inf, nan = float("inf"), float("nan")
    e = spark.createDataFrame([(f"/a/{k % 3}", float(k)) for k in range(1_000)] + [("/a/0", inf), ("/a/1", -inf), ("/b", nan), ("/b", 9e7)], "route string, score double")
    rows = [("top", "LOW", "/a/", 990.0, None), ("low", "LOW", "/a/1", None, 4.0), ("wide", "LOW", "/", -1e9, 9e8), ("any", "LOW", "", None, None), ("none", "LOW", "/a/012345", None, None), ("high", "LOW", None, 1e8, None)]
    p = spark.createDataFrame(rows, "policy string, severity string, prefix string, low double, high double")
    holds = "startswith(route, coalesce(prefix, '')) AND (low IS NULL OR low <= score) AND (high IS NULL OR score < high)"
    key = lambda df: sorted(map(str, df.select("policy", "route", "score").collect()))
    assert key(ep.policy_violations(e, p)) == key(e.crossJoin(p).filter(holds))
    met = plan(ep.policy_violations(e, p))
    assert "NestedLoop" not in met and "Cartesian" not in met


def test_many_policies_stay_away_from_the_driver(spark, tmp_path):
    """A small file of policies over many bins makes many rows: they are not broadcast, whatever Spark makes of the file's size. A few policies are."""
    n = F.col("id")
    made = spark.range(3_000).select(F.concat(F.lit("p"), n % 7).alias("policy"), F.lit("LOW").alias("severity"), F.concat(F.lit("/"), n % 3).alias("prefix"), F.when(n % 2 == 0, n % 5).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    made.write.parquet(str(tmp_path / "p"))
    e = spark.range(40).select(F.concat(F.lit("/"), n % 4, F.lit("/x")).alias("route"), (n * 60).cast("double").alias("score"))
    p = spark.read.parquet(str(tmp_path / "p"))
    holds = "startswith(route, prefix) AND (low IS NULL OR low <= score)"
    met = ep.policy_violations(e, p)
    rows = lambda df: sorted((r["policy"], r["route"], r["score"], r["count"]) for r in df.groupBy("policy", "route", "score").count().collect())
    assert rows(met) == rows(e.crossJoin(p).filter(holds))
    last = lambda df: plan(df).split("Initial Plan")[-1].split("Join")[0]
    assert "SortMerge" in last(met) and "BroadcastHash" not in last(met)
    few = ep.policy_violations(e, p.distinct())
    assert rows(few) == rows(e.crossJoin(p.distinct()).filter(holds)) and "BroadcastHash" in last(few)
