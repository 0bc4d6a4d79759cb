"""Queries over documents and pages: matching, scoring, policies, reports, cache keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import routes, scoring
from gleaner.operators import endpoints as ep
from gleaner.operators.catalog import IGNORED_DIRS
from gleaner.operators.matching import FLAGS, lines_with, match_rows
from gleaner.plans import sinks
from gleaner.plans.query import query, quoted, table
from gleaner.sources.files import allowed

#: What the documents hold that is worth a look, by category; the points of a match of each.
GROUPS = {
    "legal": ["copyright", "licen[cs]e"],
    "network": [r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "https?://"],
    "contact": [r"[a-z0-9]@[a-z0-9-]+\.", r"\+[0-9][0-9() -]{7}"],
    "secret": ["password", "secret", "token"],
}
POINTS = {"legal": 3, "network": 4, "contact": 4, "secret": 5}
PRIVATE, PUBLIC = ["password", "secret", "token"], ["copyright", "licen[cs]e"]
METHODS = {"en": "GET", "fr": "POST", "de": "DELETE", "es": "PUT"}


def doc_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an endpoint: path, line, method, route, auth_status, risk_score, risk_level."""
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), "doc_id").alias("path"), F.lit(1).alias("line"), routes.lookup(F.col("lang"), METHODS, F.lit("ANY")).alias("method"),
        F.concat(F.lit("/"), F.coalesce("source", F.lit("none"))).alias("route"), F.coalesce("text", F.lit("")).alias("text"),
    )
    d = scoring.with_flags(d, F.col("text"), GROUPS, PRIVATE, PUBLIC).withColumn("auth_status", scoring.auth_status(F.col("_flags")))
    d = d.withColumn("risk_score", scoring.risk_score(F.col("_flags"), F.col("method"), F.col("auth_status"), GROUPS, POINTS))
    return d.select("path", "line", "method", "route", "auth_status", "risk_score", scoring.risk_level(F.col("risk_score")).alias("risk_level"))


_any = lambda ps: "regexp_matches(text, " + quoted("(?i)" + "|".join(ps)) + ")"
_BASE = " + ".join(f"CASE WHEN {_any([p])} THEN {POINTS[c]} ELSE 0 END" for c, ps in GROUPS.items() for p in ps)
EP = f"""WITH d AS (SELECT 'docs/' || doc_id AS path, 1 AS line, CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items())} ELSE 'ANY' END AS method,
  '/' || coalesce(source, 'none') AS route, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, CASE WHEN {_any(PUBLIC)} THEN 'PUBLIC' WHEN {_any(PRIVATE)} THEN 'PRIVATE' ELSE 'UNKNOWN' END AS auth_status, {_BASE} AS base FROM d),
b AS (SELECT *, base + CASE WHEN method IN ('DELETE', 'PUT', 'PATCH') THEN 1 ELSE 0 END + CASE WHEN auth_status = 'UNKNOWN' THEN 1 ELSE 0 END AS s FROM a),
c AS (SELECT *, s + CASE WHEN auth_status = 'PUBLIC' AND s > 2 THEN 2 ELSE 0 END AS risk_score FROM b),
ep AS (SELECT path, line, method, route, auth_status, risk_score, CASE WHEN risk_score >= 8 THEN 'CRITICAL' WHEN risk_score >= 5 THEN 'HIGH' WHEN risk_score >= 3 THEN 'MEDIUM' WHEN risk_score >= 1 THEN 'LOW' ELSE 'INFO' END AS risk_level FROM c)
"""
_LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)"
_PATTERN = "copyright|licen[cs]e|password"


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, n, l, unnest(regexp_extract_all(l, '(?i){_PATTERN}')) AS found, generate_subscripts(regexp_extract_all(l, '(?i){_PATTERN}'), 1) AS k FROM lines)
SELECT doc_id, n AS line, found, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS match FROM m
QUALIFY NOT (ltrim(l) LIKE '#%' OR ltrim(l) LIKE '//%')""")
def pattern_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match in each document with its line; matches on comment lines don't count."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.lower("text").rlike(_PATTERN))  # most texts are done with so
    found = match_rows(d, "text", F.lit(FLAGS + _PATTERN), {}, ["doc_id"])
    return found.filter(~(F.startswith("lead", F.lit("#")) | F.startswith("lead", F.lit("//")))).select("doc_id", "line", "found", F.col("index").alias("match"))


@query("""SELECT page_id, k AS match, coalesce(nullif(r, ''), 'link') AS route FROM
(SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS r, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS k FROM pages)""")
def pattern_match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page: a group of each match, a label where it is empty."""
    p = match_rows(table(spark, sf_dir, "pages"), "html", F.lit(FLAGS + 'href="([^"]*)"'), {"link": F.lit(1)}, ["page_id"])
    return p.select("page_id", F.col("index").alias("match"), F.coalesce("link", F.lit("link")).alias("route"))


@query(f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM s)
SELECT doc_id, n AS line, array_to_string(ls[greatest(1, n - 3):n + 3], '~') AS context, len(ls[greatest(1, n - 3):n + 3]) AS n_lines FROM l WHERE regexp_matches(l, '(?i){_PATTERN}')""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines before and after each line with a match."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.lower("text").rlike(_PATTERN))  # most texts are done with so
    found = d.select("doc_id", F.split("text", "\n", -1).alias("ls")).select("doc_id", "ls", F.explode(lines_with(F.col("ls"), FLAGS + _PATTERN)).alias("line"))
    around = routes.surrounding(F.col("ls"), F.col("line"), 3)
    return found.select("doc_id", "line", F.array_join(around, "~").alias("context"), F.size(around).alias("n_lines"))


_PATH = r"^[a-z]+://[^/]+([^?#]*)"


@query(f"""SELECT * FROM (SELECT page_id, regexp_extract(url, '{_PATH}', 1) AS path, lower(regexp_extract(regexp_extract(url, '{_PATH}', 1), '(\\.[A-Za-z]+)$', 1)) AS ext FROM pages)
WHERE ext IN ('', '.html', '.htm') AND NOT list_has_any(string_split(path, '/'), [{", ".join(map(quoted, IGNORED_DIRS))}])""")
def ext_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by extension, without folders left out of scans."""
    path = F.regexp_extract("url", _PATH, 1)
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)).alias("ext"))
    return p.filter(F.col("ext").isin("", ".html", ".htm") & allowed(F.col("path")))


@query(EP + "SELECT path, auth_status FROM ep")
def auth_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_endpoints(spark, sf_dir).select("path", "auth_status")


@query(EP + "SELECT path, method, auth_status, risk_score, risk_level FROM ep")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_endpoints(spark, sf_dir).select("path", "method", "auth_status", "risk_score", "risk_level")


@query(EP + "SELECT risk_level, count(*) AS n, count(*) FILTER (WHERE auth_status = 'UNKNOWN') AS n_shadow FROM ep GROUP BY risk_level")
def risk_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_endpoints(spark, sf_dir).groupBy("risk_level").agg(F.count("*").alias("n"), F.count_if(F.col("auth_status") == "UNKNOWN").alias("n_shadow"))


@query(EP + "SELECT path, route, risk_level FROM ep ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, path LIMIT 100")
def risk_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first hundred, the worst first (the limit is the feature)."""
    return ep.sort_by_risk(doc_endpoints(spark, sf_dir)).limit(100).select("path", "route", "risk_level")


def doc_policies() -> list[tuple]:
    """The default policies and one in SQL."""
    return [*ep.default_policies(), ("risky-public", "CRITICAL", "auth_status = 'PUBLIC' AND risk_level IN ('CRITICAL', 'HIGH')")]


_VIOLATIONS = """, v AS (
SELECT 'no-shadow-mutation' AS policy, 'HIGH' AS severity, * FROM ep WHERE method IN ('POST', 'PUT', 'DELETE', 'PATCH') AND auth_status = 'UNKNOWN'
UNION ALL SELECT 'auth-coverage', 'MEDIUM', * FROM ep WHERE auth_status = 'UNKNOWN'
UNION ALL SELECT 'risky-public', 'CRITICAL', * FROM ep WHERE auth_status = 'PUBLIC' AND risk_level IN ('CRITICAL', 'HIGH'))
"""


@query(EP + _VIOLATIONS + "SELECT policy, severity, path, method FROM v")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.violations(doc_endpoints(spark, sf_dir), doc_policies()).select("policy", "severity", "path", "method")


@query(EP + _VIOLATIONS + "SELECT severity, count(*) AS n, count(DISTINCT policy) AS n_policies FROM v GROUP BY severity")
def violations_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ep.violations(doc_endpoints(spark, sf_dir), doc_policies())
    return v.groupBy("severity", "policy").agg(F.count("*").alias("n")).groupBy("severity").agg(F.sum("n").alias("n"), F.count("*").alias("n_policies"))


@query(EP + _VIOLATIONS + """SELECT 'API002' AS rule, CASE risk_level WHEN 'CRITICAL' THEN 'error' ELSE 'warning' END AS level, risk_level || ' risk: ' || method || ' ' || route AS message, path AS uri, line FROM ep WHERE risk_level IN ('CRITICAL', 'HIGH')
UNION ALL SELECT 'API001', 'warning', 'No authentication found: ' || method || ' ' || route, path, line FROM ep WHERE auth_status = 'UNKNOWN'
UNION ALL SELECT 'API004', CASE severity WHEN 'CRITICAL' THEN 'error' ELSE 'warning' END, policy || ' broken by ' || method || ' ' || route, path, line FROM v""")
def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = doc_endpoints(spark, sf_dir)
    return sinks.sarif_results(e, doc_policies())


@query(EP + _VIOLATIONS + "SELECT (SELECT count(*) FROM ep) + (SELECT count(*) FROM v) AS tests, (SELECT count(*) FROM ep WHERE risk_level IN ('CRITICAL', 'HIGH')) + (SELECT count(*) FROM v) AS failures")
def junit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = doc_endpoints(spark, sf_dir)
    return sinks.junit_cases(e, ep.violations(e, doc_policies())).agg(F.count("*").alias("tests"), F.count_if(F.contains("value", F.lit("<failure"))).alias("failures"))


@query(EP + """SELECT unnest(['api_scan_total ' || count(*), 'api_scan_shadow ' || count(*) FILTER (WHERE auth_status = 'UNKNOWN'), 'api_scan_critical ' || count(*) FILTER (WHERE risk_level IN ('CRITICAL', 'HIGH'))]) AS value FROM ep""")
def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.prometheus(ep.counters(doc_endpoints(spark, sf_dir)))


@query(EP + _VIOLATIONS + "SELECT (SELECT count(*) FROM ep WHERE risk_level = 'CRITICAL') > 0 AS critical_found, (SELECT count(*) FROM v WHERE severity = 'CRITICAL') > 0 AS policy_broken")
def exit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = doc_endpoints(spark, sf_dir)
    return ep.gate(e, ep.violations(e, doc_policies()))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first = ep.first_per(d, ["key"], ["doc_id"])
    return first.join(d.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n")), F.col("key").eqNullSafe(F.col("_k"))).select("doc_id", "n")


@query("SELECT 'docs/' || doc_id AS path FROM documents WHERE lang = 'fr' OR lang = 'de' OR lang IS NULL")
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ from a baseline which has no French ones and other German ones."""
    now = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"), "lang")
    baseline = now.filter(F.col("lang") != "fr").select("path", F.when(F.col("lang") == "de", F.md5("md5")).otherwise(F.col("md5")).alias("md5"))
    return ep.changed_files(now, baseline).select("path")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang NOT IN ('fr', 'de')")
def incremental_cached_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of unchanged documents: their labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("docs/"), "doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    baseline = docs.filter(F.col("lang") != "fr").select("path", F.when(F.col("lang") == "de", F.md5("md5")).otherwise(F.col("md5")).alias("md5"))
    return ep.unchanged_files(docs, baseline).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, sha256('docs:' || lang || ':' || source || ':' || md5(coalesce(text, ''))) AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ep.cache_key(F.lit("docs"), F.col("lang"), F.col("source"), F.md5(F.coalesce("text", F.lit("")))).alias("key"))


_CODES = "[^0-9]([1-5][0-9][0-9])[^0-9]"


@query(f"SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(text, '{_CODES}', 1)) AS INT) AS code FROM documents")
def status_codes_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct three-digit codes of every document."""
    d = table(spark, sf_dir, "documents")
    named = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(_CODES), F.lit(1)), lambda c: F.concat(F.lit("status_code="), c)), "\n")  # as code would have them
    return d.select("doc_id", F.explode(routes.status_codes(named)).alias("code"))


@query(f"""WITH c AS (SELECT CAST(unnest(regexp_extract_all(text, '{_CODES}', 1)) AS INT) AS code FROM documents)
SELECT code, CASE code // 100 WHEN 1 THEN 'informational' WHEN 2 THEN 'success' WHEN 3 THEN 'redirection' WHEN 4 THEN 'client_error' WHEN 5 THEN 'server_error' ELSE 'unknown' END AS category,
CASE code {" ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in routes.STATUS_TEXTS.items())} ELSE 'HTTP ' || code END AS description, count(*) AS n FROM c GROUP BY code""")
def status_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_CODES), F.lit(1))).alias("code")).select(F.col("code").cast("int").alias("code"))
    return d.groupBy("code").agg(F.count("*").alias("n")).select("code", routes.status_category(F.col("code")).alias("category"), routes.status_text(F.col("code")).alias("description"), "n")


@query(f"""WITH r AS (SELECT page_id, regexp_extract(url, '{_PATH}', 1) AS route FROM pages),
s AS (SELECT *, list_filter(string_split(route, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^[{{:<]') AND lower(x) NOT IN ('api', 'v1', 'v2', 'v3')) AS parts, trim(regexp_replace(route, '[^a-zA-Z0-9]+', '_', 'g'), '_') AS name FROM r)
SELECT page_id, coalesce(parts[-1], 'resource') AS resource, 'get_' || CASE WHEN name = '' THEN 'root' ELSE name END AS operation_id FROM s""")
def route_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.regexp_extract("url", _PATH, 1)
    return table(spark, sf_dir, "pages").select("page_id", routes.resource(route).alias("resource"), routes.operation_id(F.lit("GET"), route).alias("operation_id"))


@query("""WITH f AS (SELECT d.doc_id, contains(text, '(') AS params, contains(text, ':') AS hints, contains(text, '"') AS doc, quality = 1 AS auth, contains(text, '?') AS responses, source IS NOT NULL AS method,
  len(string_split(text, chr(10))) AS n_lines FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT *, least(1.0, round(CASE WHEN params THEN 0.2 ELSE 0 END + CASE WHEN hints THEN 0.2 ELSE 0 END + CASE WHEN doc THEN 0.2 ELSE 0 END + CASE WHEN auth THEN 0.15 ELSE 0 END + CASE WHEN responses THEN 0.15 ELSE 0 END
  + CASE WHEN method THEN 0.1 ELSE 0 END + CASE WHEN doc AND hints THEN 0.1 ELSE 0 END + CASE WHEN auth THEN 0.05 ELSE 0 END, 4)) AS confidence FROM f)
SELECT doc_id, CAST(confidence AS DOUBLE) AS confidence, NOT (confidence >= 0.7 AND n_lines <= 50) AS asks FROM c""")
def hybrid_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a document is known, and whether a model is asked."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("auth", F.col("quality") == 1)
    has = lambda c: F.contains("text", F.lit(c))
    flags = {"has_parameters": has("("), "has_type_hints": has(":"), "has_docstring": has('"'), "has_auth": F.col("auth"), "has_responses": has("?"), "has_method_info": F.col("source").isNotNull()}
    confidence = scoring.coverage_confidence(flags, F.col("auth"))
    return d.select("doc_id", confidence.alias("confidence"), scoring.needs_model(confidence, F.lit(False), F.size(F.split("text", "\n", -1)) > 50).alias("asks"))


@query("SELECT category, count(*) AS n, CAST(sum(n_found) AS BIGINT) AS n_found FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS category, {' + '.join(f'CASE WHEN {_any([p])} THEN 1 ELSE 0 END' for p in ps)} AS n_found FROM documents" for c, ps in GROUPS.items()) + ") WHERE n_found > 0 GROUP BY category")
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each category marks, and by how many reasons."""
    reasons = scoring.risk_reasons(F.col("_flags"), F.lit("GET"), F.lit("PRIVATE"), GROUPS, POINTS)
    d = scoring.with_flags(table(spark, sf_dir, "documents"), F.col("text"), GROUPS).select("doc_id", F.explode(F.transform(reasons, lambda r: F.substring_index(r, ":", 1))).alias("category"))
    return d.groupBy("doc_id", "category").agg(F.count("*").alias("n_found")).groupBy("category").agg(F.count("*").alias("n"), F.sum("n_found").alias("n_found"))
