"""The whole catalog over pages and documents, and over source code made of the pages' links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.routes import lookup
from gleaner.operators.catalog import CATALOG, COMMENTS
from gleaner.operators.catalog_scan import count_catalog, scan_catalog
from gleaner.operators.endpoints import deduplicate, summary
from gleaner.plans.query import query, quoted, table

#: Lines that a link becomes, by language: `{}` is the link; one of them is a comment.
LINES = {
    "crystal": ['get "{}" do', '# get "{}"', "Kemal.run"], "dotnet": ["app.MapGet('{}', handler);", "// app.MapPost('{}')", 'endpoints.MapHub<Chat>("{}");'],
    "elixir": ['get "{}", PageController', 'scope "{}" do', '# match "{}"'], "go": ['r.GET("{}", list)', 'http.HandleFunc("{}", serve)', '// r.POST("{}")'],
    "java": ['@GetMapping("{}")', '@Path("{}") @GET public', ' * @PostMapping("{}")'], "javascript": ["app.get('{}', list)", "router.post(`{}`, add)", "// app.delete('{}')"],
    "kotlin": ['get("{}") {', 'route("{}") { post("{}/new") }', '// put("{}")'], "php": ["Route::get('{}', 'Page@show');", "#[Get('{}')]", "// Route::post('{}')"],
    "python": ['@app.get("{}")', '  @router.delete("{}")', '# @app.post("{}")', 'urlpatterns = [path("{}", view)]'], "ruby": ["get '{}', to: 'page#show'", "namespace :api", "# post '{}'"],
    "rust": ['#[get("{}")]', '.route("{}", web::post())', '// #[put("{}")]'], "scala": ["GET  {}", 'path("{}") { get {', "// POST {}"], "swift": ['app.get("{}")', 'router.add("{}", method: .post)', '// app.put("{}")'],
}
LANGUAGES = sorted(LINES)


def linked_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, language, code): each page's links as lines of source code, in a language that its id picks."""
    p = table(spark, sf_dir, "pages").select("page_id", lookup(F.pmod("page_id", F.lit(len(LANGUAGES))), dict(enumerate(LANGUAGES)), F.lit("")).alias("language"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("_links"))
    lines = lookup(F.col("language"), {k: "\n".join(v) for k, v in LINES.items()}, F.lit(""))
    return p.select("page_id", "language", F.array_join(F.transform("_links", lambda x: F.replace(lines, F.lit("{}"), x)), "\n").alias("code"))


def _sql_patterns() -> str:
    """(language, pattern, rx, times): DuckDB's expressions know no lookahead; what one excludes is counted off."""
    rows = []
    for language, entries in CATALOG.items():
        for k, (*_, rx) in enumerate(entries):
            before, ahead, after = rx.partition("(?!")
            rows.append((language, k, f"(?im){before}", 1))
            if ahead:
                rows.append((language, k, f"(?im){before}{after[:-1]}", -1))
    return "p AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ") AS t(language, pattern, rx, times))"


_CODE = f"""t AS (SELECT * FROM (VALUES {", ".join(f"({k}, {quoted(n)}, {quoted(chr(10).join(LINES[n]))})" for k, n in enumerate(LANGUAGES))}) AS t(k, language, lines)),
code AS (SELECT page_id, language, array_to_string(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: replace(lines, '{{}}', x)), chr(10)) AS code FROM pages JOIN t ON k = page_id % {len(LANGUAGES)}),
l AS (SELECT page_id, language, unnest(string_split(code, chr(10))) AS l, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM code),
own AS (SELECT * FROM l WHERE NOT ({" OR ".join(f"language = {quoted(n)} AND ({' OR '.join(f'starts_with(ltrim(l), {quoted(c)})' for c in cs)})" for n, cs in COMMENTS.items())})),
hits AS (SELECT page_id, language, pattern, CAST(line AS INT) AS line, unnest(regexp_extract_all(l, rx)) AS found FROM own JOIN p USING (language) WHERE times = 1 AND NOT (language = 'java' AND regexp_matches(rx, 'HEAD.OPTIONS') AND regexp_matches(l, '@(GET|POST)\\s*\\(')))"""


@query(f"""WITH {_sql_patterns()}, {_CODE}, x AS (SELECT 'documents' AS part, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'code', page_id, code FROM code),
m AS (SELECT part, id, language, pattern, times * len(regexp_extract_all(text, rx)) AS n FROM x, p)
SELECT part, language, pattern, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE n > 0) AS n_texts FROM (SELECT part, id, language, pattern, sum(n) AS n FROM m GROUP BY ALL) GROUP BY ALL HAVING sum(n) > 0""")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns over every document and page as they are, and over the code of links, whatever its language: matches and texts with one."""
    texts = table(spark, sf_dir, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), "text")
    texts = texts.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("part"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    texts = texts.unionByName(linked_code(spark, sf_dir).select(F.lit("code").alias("part"), F.col("page_id").alias("id"), F.col("code").alias("text")))
    hits = count_catalog(texts, "text").groupBy("part", "id", "language", "pattern").agg(F.sum("n").alias("n"))
    return hits.groupBy("part", "language", "pattern").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))


@query(f"WITH {_sql_patterns()}, {_CODE} SELECT * FROM hits")
def catalog_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's patterns over its code, with lines; comment lines don't count."""
    return scan_catalog(linked_code(spark, sf_dir), "code", language="language").select("page_id", "language", "pattern", "line", "found")


@query(f"""WITH {_sql_patterns()}, {_CODE}, r AS (SELECT page_id, line, regexp_extract(found, '\\("([^"]*)"', 1) AS route, upper(regexp_extract(found, '\\.([a-z]+)', 1)) AS verb, pattern FROM hits WHERE language = 'python')
SELECT 'method' AS dimension, method AS value, count(*) AS n FROM (SELECT DISTINCT page_id, line, route, CASE WHEN pattern IN (4, 14) THEN 'ANY' ELSE verb END AS method FROM r WHERE route <> '') GROUP BY ALL""")
def catalog_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python's routes, one for each line, route and method, by method."""
    found = scan_catalog(linked_code(spark, sf_dir).filter("language = 'python'"), "code", language="language")
    one = deduplicate(found.filter(F.col("route") != "").select(F.col("page_id").alias("path"), "line", "route", "method", "pattern", F.col("index").alias("match"), "framework"))
    return summary(one, ["method"])
