"""Queries over the tables of orders, parts, events and conversations: aggregates, differences, caches, batches, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import responses, scoring
from gleaner.functions.routes import join_path
from gleaner.operators import endpoints as ep
from gleaner.operators import generators
from gleaner.operators.parsers import robust_json
from gleaner.plans.query import query, table
from gleaner.sources.files import json_members

_SIGNALS = {"click": "literal_type", "view": "type_hint_only", "error": "inline_validation", "signup": "path_param_id", "purchase": "field_name_inference"}
_CASE = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in d.items()) + " END"


@query("""SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus""")
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS n_high, count(*) FILTER (WHERE user_id < 10) AS n_first, bool_or(value > 100) AS any_huge FROM events GROUP BY event_type")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"n_high": F.col("value") > 10, "n_first": F.col("user_id") < 10}
    return ep.counts_where(table(spark, sf_dir, "events"), ["event_type"], where, {"any_huge": F.col("value") > 100})


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' priorities before 1998-05-01 and since then, as two snapshots."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("route"), F.col("o_orderpriority").alias("method"), F.when(F.col("o_orderstatus") == "O", "PUBLIC").when(F.col("o_orderstatus") == "F", "PRIVATE").otherwise("UNKNOWN").alias("auth_status"), "o_orderkey",
        (F.col("o_orderdate") < F.lit("1998-05-01").cast("timestamp_ntz")).alias("old"),
    )
    return ep.diff(o.filter("old"), o.filter("NOT old"), ["route", "method"], "auth_status", ["o_orderkey"])


_DIFF = """WITH o AS (SELECT o_custkey AS route, o_orderpriority AS method, CASE o_orderstatus WHEN 'O' THEN 'PUBLIC' WHEN 'F' THEN 'PRIVATE' ELSE 'UNKNOWN' END AS auth, o_orderkey, o_orderdate < TIMESTAMP '1998-05-01' AS old FROM orders),
p AS (SELECT route, method, arg_max(auth, o_orderkey) AS was FROM o WHERE old GROUP BY ALL), c AS (SELECT route, method, arg_max(auth, o_orderkey) AS now FROM o WHERE NOT old GROUP BY ALL),
diff AS (SELECT route, method, 'REMOVED' AS change, true AS breaking, 'endpoint_removed' AS reason FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.route = p.route AND c.method = p.method)
UNION ALL SELECT route, method, 'ADDED', false, 'endpoint_added' FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE c.route = p.route AND c.method = p.method)
UNION ALL SELECT p.route, p.method, 'MODIFIED', was = 'PUBLIC', CASE was WHEN 'PUBLIC' THEN 'auth_required' ELSE 'auth_removed' END FROM p JOIN c ON c.route = p.route AND c.method = p.method WHERE (was, now) IN (('PUBLIC', 'PRIVATE'), ('PRIVATE', 'PUBLIC')))
"""


@query(_DIFF + "SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_changes(spark, sf_dir)


@query(_DIFF + "SELECT count(*) AS total, count(*) FILTER (WHERE change = 'ADDED') AS added, count(*) FILTER (WHERE change = 'REMOVED') AS removed, count(*) FILTER (WHERE change = 'MODIFIED') AS modified, count(*) FILTER (WHERE breaking) AS breaking FROM diff")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.change_summary(order_changes(spark, sf_dir))


@query(_DIFF + "SELECT coalesce(bool_or(breaking), false) AS has_breaking FROM diff")
def has_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_changes(spark, sf_dir).agg(F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("has_breaking"))


@query("""SELECT key, side FROM (SELECT DISTINCT c_custkey AS key, 'added' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'removed' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT DISTINCT c_custkey, 'unchanged' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))""")
def spec_except_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two tables: only in one, only in the other, in both; one full join instead of three set operations."""
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return ep.set_changes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), now, ["key"])


_NOW, _TTL = "2024-01-25 00:00:00", 5 * 86400


@query(f"""SELECT c.c_custkey AS key, e.user_id IS NOT NULL AS hit, e.value FROM customer c LEFT JOIN
(SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey AND e.ts + INTERVAL {_TTL} SECOND >= TIMESTAMP '{_NOW}'""")
def ttl_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest event as a cache entry, if it isn't too old at a given time."""
    cache = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("created_at"))
    return ep.cache_lookup(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), cache, F.lit(_NOW).cast("timestamp_ntz"), _TTL).select("key", "hit", "value")


@query(f"SELECT count(*) AS entries, CAST(sum(length(props)) AS BIGINT) AS size, round(count(*) FILTER (WHERE ts + INTERVAL {_TTL} SECOND >= TIMESTAMP '{_NOW}') / count(*), 6) AS hit_rate FROM events")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.cache_stats(table(spark, sf_dir, "events").withColumnRenamed("ts", "created_at"), "props", F.lit(_NOW).cast("timestamp_ntz"), _TTL)


@query("""SELECT o_custkey AS key, max(o_orderkey) AS value FROM orders GROUP BY o_custkey
UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of customers, replaced by those of their orders."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("value"))
    return ep.cache_upsert(old, new)


@query(f"""WITH l AS (SELECT event_id AS key, value, ts AS created_at, ts AS accessed_at, CAST(user_id AS BIGINT) AS access_count FROM events WHERE ts + INTERVAL {_TTL} SECOND >= TIMESTAMP '{_NOW}')
SELECT key, value, created_at, CASE WHEN key IN (SELECT o_orderkey FROM orders) THEN TIMESTAMP '{_NOW}' ELSE accessed_at END AS accessed_at, access_count + CASE WHEN key IN (SELECT o_orderkey FROM orders) THEN 1 ELSE 0 END AS access_count FROM l""")
def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cache, read by the keys of orders: expired entries go, those found count one access more."""
    cache = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "value", F.col("ts").alias("created_at"), F.col("ts").alias("accessed_at"), F.col("user_id").cast("long").alias("access_count"))
    return ep.cache_read(cache, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), F.lit(_NOW).cast("timestamp_ntz"), _TTL)


@query("SELECT o_custkey AS key, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS value FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def cache_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with many new ones for a key: the last by price wins."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"), F.lit(0.0).alias("price"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_totalprice").alias("price"))
    return ep.cache_upsert(old, new, ["price", "value"]).select("key", "value")


@query("SELECT p_partkey, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) // 7 AS BIGINT) AS batch FROM part")
def batch_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of seven parts of a brand in order of their names: groups are cut by the names' first bytes."""
    return ep.batches(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand"], ["p_name", "p_partkey"], 50, largest=7).select("p_partkey", "batch")


@query("SELECT n_nationkey, rtrim('/' || r_name || '/', '/') || '/' || ltrim('/' || n_name, '/') AS route FROM nation JOIN region ON r_regionkey = n_regionkey")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below the prefix of their region."""
    prefixes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("/"), "r_name", F.lit("/")).alias("prefix"))
    met = table(spark, sf_dir, "nation").join(prefixes, "n_regionkey")
    return met.select("n_nationkey", join_path(F.col("prefix"), F.concat(F.lit("/"), "n_name")).alias("route"))


@query("SELECT conv_id, turn, last_value(CASE role WHEN 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def line_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the last one before it, or itself, that a user took."""
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return ep.forward_filled(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], asked, "asked_at").select("conv_id", "turn", "asked_at")


@query("SELECT event_id, k AS key, CAST(json_extract_string(props, '$.' || k) AS INT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_members(table(spark, sf_dir, "events").select("event_id", "props"), "props", "int")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type <> 'error' AS readable FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL, false FROM events WHERE event_type = 'error'")
def robust_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as a model might give them: as they are, fenced, with comments and final commas, and as no JSON at all."""
    t, p = F.col("event_type"), F.col("props")
    damaged = (
        F.when(t == "click", F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```\n"))).when(t == "view", F.concat(F.lit("Result: "), F.replace(p, F.lit("}"), F.lit(",}"))))
        .when(t == "signup", F.concat(F.lit("// see https://example.org\n"), p)).when(t == "error", F.lit("no result")).otherwise(p)
    )
    return table(spark, sf_dir, "events").select("event_id", robust_json(damaged).alias("_j")).select("event_id", F.get_json_object("_j", "$.k").cast("int").alias("k"), F.col("_j").isNotNull().alias("readable"))


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 20 AS BIGINT) AS batch FROM events")
def batch_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of twenty events of a type, in order of their ids."""
    return ep.batches(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], 20).select("event_id", "batch")


@query("SELECT string_agg(event_type || ': ' || n, ', ' ORDER BY event_type) AS summary FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events there are of each type, in one text."""
    return ep.batch_summary(table(spark, sf_dir, "events"), "event_type")


@query(f"SELECT user_id, CAST(least(1.0, round(sum({_CASE('event_type', {k: scoring.SIGNALS[v] for k, v in _SIGNALS.items()})}), 2)) AS DOUBLE) AS confidence FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def signal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types as signals: weights of the distinct ones, summed."""
    names = F.create_map(*[F.lit(x) for kv in _SIGNALS.items() for x in kv])
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    return seen.select("user_id", scoring.signal_confidence(F.transform("t", lambda x: names[x])).alias("confidence"))


@query("""WITH f AS (SELECT p_partkey, p_size, p_retailprice FROM part)
SELECT p_partkey, 'size' AS field, 'at_lower_bound' AS violation, CAST(p_size AS VARCHAR) AS value FROM f UNION ALL SELECT p_partkey, 'size', 'below_lower_bound', CAST(p_size - 1 AS VARCHAR) FROM f
UNION ALL SELECT p_partkey, 'size', 'above_maximum', CAST(p_size + 11 AS VARCHAR) FROM f
UNION ALL SELECT p_partkey, 'price', 'below_minimum', CAST(round(p_retailprice - 0.01, 4) AS VARCHAR) FROM f UNION ALL SELECT p_partkey, 'price', 'at_upper_bound', CAST(round(p_retailprice * 2, 4) AS VARCHAR) FROM f
UNION ALL SELECT p_partkey, 'price', 'above_upper_bound', CAST(round(p_retailprice * 2 + 0.01, 4) AS VARCHAR) FROM f""")
def range_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, none = table(spark, sf_dir, "part"), F.lit(None).cast("double")
    size = p.select("p_partkey", F.lit("size").alias("field"), F.lit(True).alias("is_int"), F.col("p_size").cast("double").alias("gt"), none.alias("ge"), none.alias("lt"), (F.col("p_size") + 10.0).alias("le"))
    price = p.select("p_partkey", F.lit("price").alias("field"), F.lit(False).alias("is_int"), none.alias("gt"), F.col("p_retailprice").alias("ge"), (F.col("p_retailprice") * 2).alias("lt"), none.alias("le"))
    return generators.range_violations(size.union(price)).select("p_partkey", "field", "violation", "value")


@query("""SELECT c_custkey, 'unknown_value' AS violation, 'invalid_value' AS value FROM customer UNION ALL SELECT c_custkey, 'empty_value', '' FROM customer
UNION ALL SELECT c_custkey, 'privileged_value', CASE WHEN c_nationkey < 10 THEN 'administrator' ELSE 'admin' END FROM customer""")
def enum_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.col("c_mktsegment"), F.when(F.col("c_nationkey") < 10, "ADMIN").otherwise("user"))
    return generators.enum_violations(table(spark, sf_dir, "customer").select("c_custkey", allowed.alias("allowed"))).select("c_custkey", "violation", "value")


@query("""SELECT p_partkey, 'empty' AS violation, '0' AS value FROM part WHERE p_size // 10 > 0 UNION ALL SELECT p_partkey, 'too_short', CAST(p_size // 10 - 1 AS VARCHAR) FROM part WHERE p_size // 10 > 1
UNION ALL SELECT p_partkey, 'too_long', CAST(p_size + 1 AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'far_too_long', CAST(p_size * 10 AS VARCHAR) FROM part""")
def length_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_size") / 10).cast("int").alias("min_length"), F.col("p_size").alias("max_length"))
    return generators.length_violations(fields).select("p_partkey", "violation", "value")


@query("""WITH f AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'integer' WHEN 'ECONOMY' THEN 'number' WHEN 'STANDARD' THEN 'boolean' ELSE 'string' END AS t FROM part)
SELECT p_partkey, 'text_for_' || t AS violation, CASE t WHEN 'boolean' THEN 'not_a_boolean' ELSE 'not_a_number' END AS value FROM f WHERE t <> 'string'
UNION ALL SELECT p_partkey, 'fraction_for_integer', '1.5' FROM f WHERE t = 'integer'""")
def type_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    fields = table(spark, sf_dir, "part").select("p_partkey", F.when(t == "SMALL", "integer").when(t == "ECONOMY", "number").when(t == "STANDARD", "boolean").otherwise("string").alias("json_type"))
    return generators.type_violations(fields).select("p_partkey", "violation", "value")


@query("SELECT p_partkey, 'other_owner' AS violation, '<OTHER_USER_ID>' AS value, '403,404' AS expected FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'zero_id', '0', '400,403,404' FROM part WHERE p_size > 25")
def ownership_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("idor_risk"), F.array(F.lit("path_param_id")).alias("signals"))
    return generators.ownership_violations(fields).select("p_partkey", "violation", "value", F.array_join(F.transform("expected", lambda x: x.cast("string")), ",").alias("expected"))


@query("""WITH f AS (SELECT DISTINCT p_brand AS endpoint, p_type AS field FROM part)
SELECT a.endpoint, a.field AS missing, coalesce(string_agg(b.field, ',' ORDER BY b.field), '') AS sent FROM f a LEFT JOIN f b ON a.endpoint = b.endpoint AND a.field <> b.field GROUP BY a.endpoint, a.field""")
def missing_required_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "part").select(F.col("p_brand").alias("endpoint"), F.col("p_type").alias("field"), F.lit(True).alias("required")).distinct()
    return generators.missing_required(fields, ["endpoint"])


@query("""WITH t AS (SELECT p_brand AS category, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_name AS payload FROM part QUALIFY n <= 2)
SELECT n_nationkey, category || '_' || n AS name, payload FROM nation CROSS JOIN t""")
def template_cross_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as endpoints, the first two parts of each brand as templates."""
    templates = table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("payload"))
    return generators.with_templates(table(spark, sf_dir, "nation"), templates).select("n_nationkey", "name", "payload")


@query("SELECT o_orderkey, 'GET' AS method, true AS sent FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'POST', true FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'POST', false FROM orders WHERE o_orderstatus = 'P'")
def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders given to a (mock) model in batches; those that it has no answer for are failures."""
    from gleaner.operators.enrichment import ask_in_batches

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "GET").otherwise("POST").alias("method"), F.col("o_orderstatus").alias("prompt"))
    asked = ask_in_batches(o, lambda prompts: [None if p == "P" else p.lower() for p in prompts], size=20)
    return asked.select(F.col("id").cast("long").alias("o_orderkey"), "method", (F.col("status") == "SUCCESS").alias("sent"))


@query("""WITH m AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'DELETE' ELSE 'TRACE' END AS method FROM orders)
SELECT method, code FROM m JOIN (VALUES ('GET', [200, 206, 400, 401, 403, 404, 429, 500]), ('DELETE', [204, 200, 401, 403, 404, 429, 500]), ('TRACE', [200, 400, 401, 403, 500])) AS t(name, codes) ON name = method, unnest(codes) AS u(code)""")
def standard_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status codes that are usual for each method."""
    s = F.col("o_orderstatus")
    m = table(spark, sf_dir, "orders").select(F.when(s == "F", "GET").when(s == "O", "DELETE").otherwise("TRACE").alias("method")).distinct()
    return m.select("method", F.explode(responses.standard_codes(F.col("method"))).alias("code"))


@query("SELECT 'SCAN_COMPLETED' AS event_type, count(*) AS n FROM region UNION ALL SELECT 'CRITICAL_FINDING', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'POLICY_VIOLATION', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines: scans (regions), critical findings (urgent orders), violations (pending urgent orders)."""
    from gleaner.plans.sinks import audit_lines

    scans = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("total"))
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_orderstatus")
    lines = audit_lines("scan-1", F.lit("2024-01-01T00:00:00Z"), completed=scans, critical=urgent, broken=urgent.filter(F.col("o_orderstatus") == "P"))
    return lines.groupBy(F.get_json_object("value", "$.event_type").alias("event_type")).agg(F.count("*").alias("n"))
