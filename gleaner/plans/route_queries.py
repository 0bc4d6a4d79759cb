"""Routes, specs and SDL made of the pages' addresses and links: what is told of a route, and what readers of specs find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import detect, responses, routes
from gleaner.operators import endpoints as ep
from gleaner.plans.query import query, quoted, table
from gleaner.sources import files

METHODS = {0: "GET", 1: "POST", 2: "PUT", 3: "PATCH", 4: "DELETE"}
DIALECTS = {0: "{id:int}", 1: "<int:id>", 2: ":id"}
ENDS = {0: "items", 1: "admin", 2: "Token", 3: "debug", 4: "health", 5: "login", 6: "orders", 7: "swagger"}
STATUS = {0: "PUBLIC", 1: "PRIVATE", 2: "UNKNOWN"}
_PATH = "^[a-z]+://([a-z]+)"


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, method, route, auth_status): each page's address as a route: version, first label of its host, a parameter in one of three dialects, and an end that its id picks; some without a slash before."""
    k = F.col("page_id")
    pick = lambda values: routes.lookup(F.pmod(k, F.lit(len(values))), values, F.lit(""))
    route = F.concat(F.when(k % 4 == 0, "").otherwise("/"), F.lit("api/v"), F.pmod(k, F.lit(3)) + 1, F.lit("/"), F.regexp_extract("url", _PATH, 1), F.lit("/"), pick(DIALECTS), F.lit("/"), pick(ENDS))
    return table(spark, sf_dir, "pages").select("page_id", pick(METHODS).alias("method"), route.alias("route"), pick(STATUS).alias("auth_status"))


def _sql_pick(values: dict[int, str]) -> str:
    return f"CASE page_id % {len(values)} " + " ".join(f"WHEN {n} THEN {quoted(v)}" for n, v in values.items()) + " END"


ROUTES = f"""r AS (SELECT page_id, {_sql_pick(METHODS)} AS method, CASE WHEN page_id % 4 = 0 THEN '' ELSE '/' END || 'api/v' || (page_id % 3 + 1) || '/' || regexp_extract(url, '{_PATH}', 1) || '/' || {_sql_pick(DIALECTS)} || '/' || {_sql_pick(ENDS)} AS route,
{_sql_pick(STATUS)} AS auth_status, regexp_extract(url, '{_PATH}', 1) AS host, {_sql_pick(ENDS)} AS ends FROM pages)"""


@query(f"""WITH {ROUTES} SELECT page_id, regexp_replace(CASE WHEN route LIKE '/%' THEN route ELSE '/' || route END, ':([a-zA-Z_][a-zA-Z0-9_]*)', '{{\\1}}', 'g') AS normalised,
lower(method) || '_' || trim(regexp_replace(route, '[^a-zA-Z0-9]+', '_', 'g'), '_') AS operation_id,
CASE method WHEN 'GET' THEN 'read' WHEN 'POST' THEN 'create' WHEN 'DELETE' THEN 'delete' ELSE 'update' END AS operation,
CASE method WHEN 'GET' THEN 'Retrieve ' WHEN 'POST' THEN 'Create new ' WHEN 'PUT' THEN 'Update ' WHEN 'PATCH' THEN 'Partially update ' ELSE 'Delete ' END || ends AS description, method IN ('POST', 'PUT', 'PATCH') AS has_body FROM r""")
def route_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a method and a route tell without any code."""
    m, r = F.col("method"), F.col("route")
    told = page_routes(spark, sf_dir)
    return told.select(
        "page_id", routes.normalise(r).alias("normalised"), routes.operation_id(m, r).alias("operation_id"), routes.crud(m, r).alias("operation"),
        responses.description(m, routes.resource(r)).alias("description"), responses.has_body(m).alias("has_body"),
    )


@query(f"WITH {ROUTES} SELECT page_id, 'id' AS name, 'integer' AS type, 'Id identifier' AS description FROM r")
def route_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of routes in three dialects, with what their names and hints tell."""
    p = page_routes(spark, sf_dir).select("page_id", F.explode(routes.params(F.col("route"))).alias("p"))
    kind = routes.param_type(F.col("p.name"), F.col("p.hint"))
    return p.select("page_id", "p.name", kind.alias("type"), routes.param_description(F.col("p.name"), kind).alias("description"))


_HOLDS = lambda *words: "(" + " OR ".join(f"contains(lower(route), '{w}')" for w in words) + ")"


@query(f"""WITH {ROUTES} SELECT page_id, 'no-public-admin' AS policy, 'CRITICAL' AS severity FROM r WHERE {_HOLDS('admin')} AND auth_status = 'PUBLIC'
UNION ALL SELECT page_id, 'no-shadow-mutation', 'HIGH' FROM r WHERE method IN ('POST', 'PUT', 'DELETE', 'PATCH') AND auth_status = 'UNKNOWN'
UNION ALL SELECT page_id, 'no-sensitive-public', 'CRITICAL' FROM r WHERE {_HOLDS('password', 'token', 'secret', 'key', 'credential')} AND auth_status = 'PUBLIC'
UNION ALL SELECT page_id, 'no-debug-endpoints', 'HIGH' FROM r WHERE {_HOLDS('debug', 'test', 'swagger', 'graphql-playground')}
UNION ALL SELECT page_id, 'auth-coverage', 'MEDIUM' FROM r WHERE auth_status = 'UNKNOWN' AND NOT {_HOLDS('health', 'ping', 'ready', 'live', 'metrics')}""")
def default_policies_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five default policies over every page's route."""
    return ep.violations(page_routes(spark, sf_dir)).select("page_id", "policy", "severity")


@query(f"""WITH {ROUTES} SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'v3' ELSE host END AS batch, host AS shared, CASE WHEN length(route) > 40 THEN substr(route, 1, 37) || '...' ELSE route END AS shown FROM r""")
def route_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What routes are batched by, what they share, and how they are shown."""
    r = F.col("route")
    return page_routes(spark, sf_dir).select("page_id", detect.batch_resource(r).alias("batch"), detect.shared_resource(r).alias("shared"), detect.short_route(r).alias("shown"))


def _links() -> Column:
    return F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[A-Za-z]+)"'), F.lit(1)))


_SQL_LINKS = """l AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1)) AS links FROM pages), e AS (SELECT page_id, unnest(links) AS route FROM l)"""


@query(f"WITH {_SQL_LINKS} SELECT page_id, route, m AS method FROM e, (VALUES ('GET'), ('POST')) AS t(m)")
def spec_paths_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links as the paths of an OpenAPI document in JSON, read again."""
    verbs = F.struct(F.struct(F.lit("x").alias("summary")).alias("get"), F.struct(F.lit("y").alias("summary")).alias("post"), F.lit("z").alias("x-note"))
    paths = F.map_from_entries(F.transform(_links(), lambda x: F.struct(x, verbs)))
    specs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), paths.alias("paths"))).alias("content"))
    return files.spec_json(specs).withColumnRenamed("path", "page_id")


@query(f"WITH {_SQL_LINKS}, n AS (SELECT page_id, unnest(links) AS route, generate_subscripts(links, 1) AS k FROM (SELECT page_id, list_sort(links) AS links FROM l)) SELECT page_id, CAST(4 * k AS INT) AS line, route, 'DELETE' AS method FROM n")
def spec_paths_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links as the paths of an OpenAPI document in YAML, read line by line: four lines for a path, its verb on the third after two of the head."""
    lines = F.transform(F.array_sort(_links()), lambda x: F.concat(F.lit('  "'), x, F.lit('":\n    summary: s\n    delete:\n      responses: {}')))
    specs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.concat(F.lit("paths:\n"), F.array_join(lines, "\n")).alias("content"))
    return files.spec_lines(specs).withColumnRenamed("path", "page_id")


@query(f"WITH {_SQL_LINKS} SELECT page_id, o AS operation, lower(substr(route, 2)) AS field FROM e, (VALUES ('query'), ('mutation')) AS t(o)")
def sdl_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links as the fields of SDL queries and mutations."""
    fields = F.array_join(F.transform(_links(), lambda x: F.concat(F.lit("  "), F.lower(F.substring(x, 2, 1000)), F.lit("(n: Int): Page"))), "\n")
    sdl = F.concat(F.lit("type Query {\n"), fields, F.lit("\n}\n\ntype Page { n: Int }\ntype Mutation {\n"), fields, F.lit("\n}\n"))
    return files.graphql(table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), sdl.alias("content"))).withColumnRenamed("path", "page_id")
