"""Queries of detection, decisions, tests of parameters and checks of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import detect
from gleaner.operators import enrichment, generators
from gleaner.plans.query import query, table, values

_NOW, _TTL = "2024-01-25 00:00:00", 10 * 86400


@query("SELECT doc_id, coalesce(regexp_matches(lower(text), 'auth|login|token|jwt|bearer|permission|role|session|api_key|credential|password'), false) AS auth_code FROM documents")
def auth_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that speak of authentication."""
    return table(spark, sf_dir, "documents").select("doc_id", detect.auth_code(F.col("text")).alias("auth_code"))


@query("""SELECT resource, count(*) AS n FROM (SELECT regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^/([^/?#]+)', 1) AS resource FROM pages) WHERE resource <> '' GROUP BY resource""")
def resource_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first segment of their paths."""
    path = F.regexp_extract(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "^([^?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(detect.batch_resource(path).alias("resource")).agg(F.count("*").alias("n")).filter("resource <> 'default'")


@query("""WITH e AS (SELECT event_id, value / 100 AS c, user_id % 2 = 0 AS simple, user_id % 3 = 0 AS complex, event_type FROM events)
SELECT event_id, c < 0.7 OR (NOT simple AND complex) AS asks, CASE WHEN c >= 0.7 THEN CASE WHEN simple THEN 'simple' WHEN NOT complex THEN 'documented' ELSE 'complex' END WHEN complex THEN 'complex_and_incomplete' ELSE 'incomplete' END AS reason,
CASE WHEN c < 0.7 THEN CASE WHEN event_type = 'click' THEN 'parameter_extraction,' ELSE '' END || CASE WHEN event_type = 'view' THEN 'description_generation,' ELSE 'parameter_descriptions,' END || 'auth_detection,example_generation'
WHEN NOT simple AND complex THEN 'description_enhancement' ELSE '' END AS tasks FROM e""")
def decision_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as endpoints: their values as confidence, their types as what is known of them."""
    t, yes = F.col("event_type"), F.lit(True)
    tasks = detect.model_tasks({"has_parameters": t != "click", "has_type_hints": yes, "has_docstring": t != "view", "has_responses": yes, "has_auth": F.lit(False)}, F.lit(False))
    d = detect.decision(F.col("value") / 100, F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0, tasks)
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).select("event_id", "d.asks", "d.reason", F.array_join("d.tasks", ",").alias("tasks"))


_TEMPLATES = [("quotes", 1, 'a"b'), ("quotes", 2, "c"), ("long", 1, "d")]


@query(f"""WITH t AS ({values('category, ordinal, payload', _TEMPLATES)}), p AS (SELECT c_custkey, 'segment' AS parameter, 'path' AS place FROM customer WHERE c_nationkey < 10
UNION ALL SELECT c_custkey, n, 'query' FROM customer, (VALUES ('id'), ('search')) AS u(n) WHERE c_nationkey >= 10) SELECT c_custkey, parameter, place, category || '_' || ordinal AS name, payload FROM p CROSS JOIN t""")
def parameter_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as endpoints, some with a parameter."""
    own = F.when(F.col("c_nationkey") < 10, F.array(F.struct(F.lit("segment").alias("name"), F.lit("path").alias("place")))).otherwise(F.array().cast("array<struct<name:string,place:string>>"))
    templates = spark.createDataFrame(_TEMPLATES, "category string, ordinal int, payload string")
    tests = generators.parameter_tests(table(spark, sf_dir, "customer").select("c_custkey", own.alias("parameters")), templates)
    return tests.select("c_custkey", "parameter", "place", "name", "payload")


@query(f"""WITH t AS ({values('category, ordinal, payload', _TEMPLATES)}) SELECT c_custkey, field, category || '_' || ordinal AS name,
'{{"age":1,"name":' || CASE field WHEN 'name' THEN to_json(payload) ELSE '"test"' END || ',"note":' || CASE field WHEN 'note' THEN to_json(payload) ELSE '"test"' END || ',"ok":true}}' AS body
FROM customer CROSS JOIN (VALUES ('name'), ('note')) AS f(field) CROSS JOIN t""")
def injected_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as endpoints whose bodies have four fields."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(t).alias("json_type")) for n, t in (("name", "string"), ("age", "integer"), ("ok", "boolean"), ("note", "string"))])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.inline(fields))
    return generators.injected_bodies(rows, ["c_custkey"], spark.createDataFrame(_TEMPLATES, "category string, ordinal int, payload string")).select("c_custkey", "field", "name", "body")


@query(f"""WITH e AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id), m AS (SELECT c_custkey AS key, c_custkey // 3 AS batch, e.user_id IS NOT NULL AS hit FROM customer LEFT JOIN e ON e.user_id = c_custkey AND ts + INTERVAL {_TTL} SECOND >= TIMESTAMP '{_NOW}')
SELECT key, NOT bool_and(hit) OVER (PARTITION BY batch) AS asks FROM m""")
def batch_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in batches of three: a batch is asked for unless each has a recent event."""
    cache = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("value"), F.max("ts").alias("created_at"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.floor(F.col("c_custkey") / 3).alias("batch"))
    return enrichment.cached_batches(wanted, ["batch"], cache, F.lit(_NOW).cast("timestamp_ntz"), _TTL).select("key", "asks")


