"""Cases over small pieces of source code and routes, given as literal rows here and in their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import detect, responses, routes
from gleaner.operators import endpoints as ep
from gleaner.operators import enrichment, matching, parsers
from gleaner.operators.catalog import CATALOG, COMMENTS, EXTENSIONS
from gleaner.plans import sinks
from gleaner.plans.query import quoted, values
from gleaner.sources import files
from tests.literal_registry import query

PY = '''from fastapi import FastAPI, APIRouter
app = FastAPI()
# @app.get("/old")
orders = APIRouter()
app.include_router(orders, prefix="/api/orders/")

@app.get("/users/{user_id}")
def read_user(user_id: int) -> dict:
    """Find a user.

    Args:
        user_id: whose it is
    """
    if user_id < 1:
        raise ValueError("user_id")
    return {}

@app.delete("/users/{user_id}/token")
@login_required
def drop_token(user_id: int, scope: Literal["all", "own"] = "own"):
    return {}

@orders.post("/new")
def new_order(size: int = Field(gt=0, le=10)):
    assert size <= 8
    return {}, 201
'''
JS = """const app = express();
app.use('/v1', people);
people.get('/list', (req, res) => {});
people.post('add', (req, res) => {});
app.use(`/v2`, people);
"""
GO = """package main
v1 := r.Group("/api/")
v1.GET("/ping", ping)
other.GET("/none", none)
"""
CS = """[Authorize]
[Route("api/[controller]")]
public class OrdersController : ControllerBase {
    [HttpGet("{id}")]
    public IActionResult Find(int id) { return Ok(); }

    [HttpPost]
    public ActionResult<OrderDto> Add([FromBody] OrderDto order, int copies = 1) { if (true) { } return Ok(); }
}
public class OrderDto {
    [Required] public string Name { get; set; }
    public int? Count { get; set; }
    [JsonProperty("when")] public DateTime At { get; set; }
    public List<LineDto> Lines { get; set; }
}
"""
JAVA = """@RestController
@RequestMapping("/shop")
public class ShopController {
    @GetMapping("/items/{id}")
    public Item find(int id) { return null; }
    @PostMapping
    @PreAuthorize("hasRole('A')")
    public Item add() { return null; }
}
"""
YAML = """openapi: 3.0.0
paths:
  /pets:
    get:
      summary: all
    post:
      summary: new
  "/pets/{id}":
    delete:
      summary: gone
"""
JSON = '{"openapi": "3.0.0", "paths": {"/a": {"get": {}, "post": {"x": 1}}, "/b": {"parameters": []}}}'
SDL = """type Query {
  users(limit: Int): [User]
  me: User
}
type Mutation {
  addUser(name: String): User
}
type User { id: ID }
"""
HANDLER = """class UserHandler(Base):
    def get(self, key):
        return call("/api/v2/users/")
app.register_blueprint(admin, url_prefix="/adm")
app.register_blueprint(shop)
"""
#: Lines in the manner of many frameworks; each language's patterns are tried on all of them.
CATALOG_TEXT = """@app.route('/flask', methods=['GET'])
@router.get("/fast/{id}")
@api.post('/fast')
path('django/', views.index)
re_path(r'^old/$', views.old)
url(r'^older/$', views.older)
class ItemView(APIView):
class ItemSet(viewsets.ModelViewSet):
@action(detail=True, methods=['post'])
router.register(r'items', ItemSet)
app.add_url_rule('/rule', 'rule', rule)
app.router.add_get('/aio', handle)
(r"/tornado", MainHandler),
config.add_route('home', '/pyramid')
@mcp.tool()
@app.task
uvicorn.run(app)
app.run(host='0.0.0.0')
http.HandleFunc("/go", handler)
r.GET("/gin/:id", get)
e.POST("/echo", post)
r.HandleFunc("/mux", h).Methods("GET")
app.Get("/fiber", h)
http.ListenAndServe(":8080", nil)
app.get('/express/:id', (req, res) => {})
router.delete("/express", f)
fastify.put('/fastify', f)
@Controller('nest')
@Get('all')
@Post()
app.listen(3000)
server.route({ method: 'GET', path: '/hapi' })
@GetMapping("/spring/{id}")
@PostMapping(value = "/spring")
@RequestMapping("/base")
@Path("/jaxrs")
@GET
get("/spark", (q, s) -> "x");
app.MapGet("/minimal", () => 1);
endpoints.MapPost("/endpoints", f);
app.MapHub<ChatHub>("/chat");
app.MapGrpcService<Greeter>();
app.MapHealthChecks("/healthz");
Route::get('/laravel', [C::class, 'i']);
$app->post('/slim', f);
#[Route('/symfony', methods: ['GET'])]
get '/sinatra' do
  resources :photos, only: [:index]
  namespace :admin do
#[get("/rocket/<id>")]
.route("/actix", web::get().to(index))
.route("/axum", get(handler))
warp::path("warp")
get("/ktor") { call.respond(1) }
routing { route("/nested") { } }
app.get("/vapor") { req in 1 }
app.get("hello", "vapor") { req in 1 }
GET     /play/:id    controllers.Items.show(id: Long)
path("akka" / Segment) { id => get { complete(id) } }
get "/phoenix", PageController, :index
  scope "/api", AppWeb do
    resources "/users", UserController
live "/live", HomeLive
get "/kemal" do |env|
"""
SOURCES = [("app/main.py", PY), ("web/server.js", JS), ("svc/main.go", GO), ("src/Orders.cs", CS), ("src/Shop.java", JAVA), ("spec/pets.yaml", YAML), ("spec/a.json", JSON), ("s/schema.graphql", SDL), ("web/handlers/users.py", HANDLER)]
ROUTES = [("GET", "/api/v1/users/{id:int}"), ("PUT", "/files/<uuid:key>/parts/<name>"), ("DELETE", "/x/:item_id/:is_ok"), ("POST", "plain/new"), ("PATCH", "/"), ("GET", "/api/v2")]


def code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "path string, content string")


def route_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "method string, route string")


@query(values("path, line, method, route, framework", [
    ("app/main.py", 23, "POST", "/api/orders/new", "FastAPI"), ("web/server.js", 3, "GET", "/v2/list", "Express"), ("web/server.js", 4, "POST", "/v2/add", "Express"), ("svc/main.go", 3, "GET", "/api/ping", "Gin"),
]))
def prefix_join_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes below the prefix of their variable; the last prefix counts."""
    return matching.with_prefixes(matching.extract(code(spark), ["python", "javascript", "go"], steps=("prefixes",))).select("path", "line", "method", "route", "framework")


@query(values("path, line, method, route, framework", [
    ("web/handlers/users.py", 1, "HANDLER", "/handlers.users.UserHandler", "Legacy-Handler"), ("web/handlers/users.py", 2, "GET", "/users", "Legacy-Handler"), ("web/handlers/users.py", 1, "CLASS", "UserHandler", "Custom-Class"),
    ("web/handlers/users.py", 3, "ANY", "/api/v2/users/", "Dynamic-Route"), ("web/handlers/users.py", 4, "BLUEPRINT", "/adm", "Flask-Blueprint"), ("web/handlers/users.py", 5, "BLUEPRINT", "/shop", "Flask-Blueprint"),
]))
def python_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_heuristics(code(spark)).select("path", "line", "method", "route", "framework")


def _catalog_text(language: str) -> str:
    """The sample without lines that are comments in the language."""
    return "".join(x for x in CATALOG_TEXT.splitlines(True) if not x.lstrip().startswith(COMMENTS[language]))


#: The one pattern that DuckDB can't run (it looks ahead), and how often it is found.
_BEYOND_SQL = [(k, i) for k, rows in CATALOG.items() for i, r in enumerate(rows) if "(?!" in r[5]]
_TRIED = ", ".join(f"({quoted(k)}, {i}, {quoted(r[5])}, {quoted(_catalog_text(k))})" for k, rows in CATALOG.items() for i, r in enumerate(rows) if (k, i) not in _BEYOND_SQL)


@query(f"SELECT language, pattern, n FROM (SELECT language, pattern, CAST(len(regexp_extract_all(t, '(?im)' || rx)) AS BIGINT) AS n FROM (VALUES {_TRIED}) AS v(language, pattern, rx, t)) WHERE n > 0")
def catalog_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the catalog's patterns is found, in one pass over a file of each language."""
    extension = {language: e for e, language in reversed(EXTENSIONS.items())}
    rows = [(f"sample{extension[k]}", _catalog_text(k)) for k in CATALOG]
    found = matching.extract(spark.createDataFrame(rows, "path string, content string"), steps=("patterns",))
    beyond = [(F.col("language") == k) & (F.col("pattern") == i) for k, i in _BEYOND_SQL]
    return found.filter(~reduce(lambda a, b: a | b, beyond, F.lit(False))).groupBy("language", "pattern").agg(F.count("*").alias("n"))


@query(values("path, line, framework, method, route, auth_status", [
    ("src/Orders.cs", 4, "ASP.NET", "GET", "/api/Orders/{id}", "PRIVATE"), ("src/Orders.cs", 7, "ASP.NET", "POST", "/api/Orders", "PRIVATE"),
    ("src/Shop.java", 4, "Spring", "GET", "/shop/items/{id}", "PRIVATE"), ("src/Shop.java", 6, "Spring", "POST", "/shop", "PRIVATE"),
    ("spec/a.json", 1, "OpenAPI-Spec", "GET", "/a", "UNKNOWN"), ("spec/a.json", 1, "OpenAPI-Spec", "POST", "/a", "UNKNOWN"), ("spec/a.json", 1, "OpenAPI-Spec", "ANY", "/b", "UNKNOWN"),
    ("spec/pets.yaml", None, "OpenAPI-Spec", "GET", "/pets", "UNKNOWN"), ("spec/pets.yaml", None, "OpenAPI-Spec", "POST", "/pets", "UNKNOWN"), ("spec/pets.yaml", None, "OpenAPI-Spec", "DELETE", "/pets/{id}", "UNKNOWN"),
    ("s/schema.graphql", 2, "GraphQL-Schema", "QUERY", "Query.users", "UNKNOWN"), ("s/schema.graphql", 3, "GraphQL-Schema", "QUERY", "Query.me", "UNKNOWN"), ("s/schema.graphql", 6, "GraphQL-Schema", "MUTATION", "Mutation.addUser", "UNKNOWN"),
    ("web/server.js", 3, "Express", "GET", "/v2/list", "UNKNOWN"), ("web/server.js", 4, "Express", "POST", "/v2/add", "UNKNOWN"), ("svc/main.go", 3, "Gin", "GET", "/api/ping", "PUBLIC"),
]))
def scan_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over files of all kinds: what controllers, specs, SDL and prefixes give (a pattern's bare routes left aside)."""
    e = ep.scan(code(spark)).filter((F.col("pattern") == -1) | ((F.col("pattern") == 1000) & (F.col("language") != "python")))
    line = F.when(~F.endswith("path", F.lit(".yaml")), F.col("line"))  # a YAML library gives the path's line, without one the verb's counts
    return e.select("path", line.alias("line"), "framework", "method", "route", "auth_status")


@query(values("language, n", [("dotnet", 2), ("java", 6), ("unknown", 9)]))
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was extracted by language, before anything is deduplicated."""
    rows = matching.with_prefixes(matching.extract(code(spark), ["dotnet", "java", "spec"]))
    return ep.language_counts(rows)


@query(values("path, line, method, route, auth_status", [
    ("app/main.py", 7, "GET", "/users/{user_id}", "UNKNOWN"), ("app/main.py", 18, "DELETE", "/users/{user_id}/token", "PRIVATE"), ("app/main.py", 23, "POST", "/api/orders/new", "UNKNOWN"),
]))
def scan_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan over a Python file: patterns of all frameworks and prefixes, scored, each route once."""
    return ep.scan(code(spark).filter(F.col("path") == "app/main.py"), ["python"]).filter(F.col("kind") == "ENDPOINT").select("path", "line", "method", "route", "auth_status").filter(F.startswith("route", F.lit("/")))


@query(values("path, line, controller, action, method, route, auth_status", [
    ("src/Orders.cs", 4, "Orders", "Find", "GET", "/api/Orders/{id}", "PRIVATE"), ("src/Orders.cs", 7, "Orders", "Add", "POST", "/api/Orders", "PRIVATE"),
    ("src/Shop.java", 4, "ShopController", "find", "GET", "/shop/items/{id}", "PRIVATE"), ("src/Shop.java", 6, "ShopController", "add", "POST", "/shop", "PRIVATE"),
]))
def controller_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.controllers(code(spark)).drop("returns")


@query(values("path, action, position, name, type, place, required", [
    ("src/Orders.cs", "Find", 0, "id", "int", "query", True), ("src/Orders.cs", "Add", 0, "order", "OrderDto", "body", True), ("src/Orders.cs", "Add", 1, "copies", "int", "query", False),
]))
def action_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.action_parameters(code(spark)).select("path", "action", "position", "name", "type", "place", "required")


@query(values("class, property, json_type, format, nullable, required, ref", [
    ("OrderDto", "name", "string", None, False, True, None), ("OrderDto", "count", "integer", "int32", True, False, None), ("OrderDto", "when", "string", "date-time", False, False, None), ("OrderDto", "lines", "array", None, False, False, "LineDto"),
]))
def dto_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.dto_properties(code(spark)).select("class", "property", "json_type", "format", "nullable", "required", "ref")


@query(values("function, line, hints, returns, summary, parameters, constraints", [
    ("read_user", 8, '{"user_id": "int"}', "dict", "Find a user.", '{"user_id": "whose it is"}', '{"user_id": {"ge": 1, "signals": ["inline_validation"]}}'),
    ("drop_token", 20, '{"user_id": "int", "scope": "Literal[\'all\', \'own\']"}', None, "", "{}", '{"scope": {"enum": ["all", "own"], "signals": ["literal_type"]}}'),
    ("new_order", 24, '{"size": "int"}', None, "", "{}", '{"size": {"gt": 0, "le": 8, "signals": ["inline_validation", "pydantic_field_constraint"]}}'),
]))
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.python_functions(code(spark).filter(F.col("path") == "app/main.py")).select("function", "line", "hints", "returns", "summary", "parameters", "constraints")


@query(values("function, scheme", [("drop_token", "session")]))
def auth_decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.auth_schemes(parsers.python_functions(code(spark))).select("function", "scheme")


@query(values("path, line, route, method", [("spec/pets.yaml", 4, "/pets", "GET"), ("spec/pets.yaml", 6, "/pets", "POST"), ("spec/pets.yaml", 9, "/pets/{id}", "DELETE")]))
def spec_yaml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spec_lines(code(spark).filter(F.endswith("path", F.lit(".yaml"))))


@query(values("path, route, method", [("spec/a.json", "/a", "GET"), ("spec/a.json", "/a", "POST"), ("spec/a.json", "/b", "ANY")]))
def spec_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spec_json(code(spark).filter(F.endswith("path", F.lit(".json"))))


@query(values("path, operation, field", [("s/schema.graphql", "query", "users"), ("s/schema.graphql", "query", "me"), ("s/schema.graphql", "mutation", "addUser")]))
def graphql_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.graphql(code(spark).filter(F.endswith("path", F.lit(".graphql"))))


@query(values("route, name, type, format, description", [
    ("/api/v1/users/{id:int}", "id", "integer", None, "Id identifier"), ("/files/<uuid:key>/parts/<name>", "key", "string", "uuid", "Key"), ("/files/<uuid:key>/parts/<name>", "name", "string", None, "Name"),
    ("/x/:item_id/:is_ok", "item_id", "integer", None, "Item Id identifier"), ("/x/:item_id/:is_ok", "is_ok", "boolean", None, "Flag indicating is ok"),
]))
def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = route_rows(spark).select("route", F.explode(routes.params(F.col("route"))).alias("p"))
    kind = routes.param_type(F.col("p.name"), F.col("p.hint"))
    return p.select("route", "p.name", kind.alias("type"), routes.param_format(F.col("p.name"), F.col("p.hint")).alias("format"), routes.param_description(F.col("p.name"), kind).alias("description"))


_ROUTES_SQL = f"WITH r AS ({values('method, route', ROUTES)}) "


@query(_ROUTES_SQL + r"SELECT route, regexp_replace(CASE WHEN route LIKE '/%' THEN route ELSE '/' || route END, ':([a-zA-Z_][a-zA-Z0-9_]*)', '{\1}', 'g') AS normalised FROM r")
def route_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_rows(spark).select("route", routes.normalise(F.col("route")).alias("normalised"))


@query(_ROUTES_SQL + r"""SELECT method, route, CASE method WHEN 'GET' THEN CASE WHEN regexp_matches(route, '[{<]|/:') THEN 'read' ELSE 'list' END WHEN 'POST' THEN 'create' WHEN 'DELETE' THEN 'delete' ELSE 'update' END AS operation,
CASE method WHEN 'GET' THEN 'Retrieve ' WHEN 'POST' THEN 'Create new ' WHEN 'PUT' THEN 'Update ' WHEN 'PATCH' THEN 'Partially update ' ELSE 'Delete ' END || CASE route WHEN '/api/v1/users/{id:int}' THEN 'users' WHEN '/files/<uuid:key>/parts/<name>' THEN 'parts' WHEN '/x/:item_id/:is_ok' THEN 'x' WHEN 'plain/new' THEN 'new' ELSE 'resource' END AS description,
method IN ('POST', 'PUT', 'PATCH') AS has_body FROM r""")
def crud_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, r = F.col("method"), F.col("route")
    return route_rows(spark).select("method", "route", routes.crud(m, r).alias("operation"), responses.description(m, routes.resource(r)).alias("description"), responses.has_body(m).alias("has_body"))


@query(_ROUTES_SQL + "SELECT route, lower(method) || '_' || coalesce(nullif(trim(regexp_replace(route, '[^a-zA-Z0-9]+', '_', 'g'), '_'), ''), 'root') AS operation_id FROM r")
def operation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_rows(spark).select("route", routes.operation_id(F.col("method"), F.col("route")).alias("operation_id"))


@query(values("policy, severity, route", [
    ("no-public-admin", "CRITICAL", "/admin"), ("no-sensitive-public", "CRITICAL", "/Token"), ("no-shadow-mutation", "HIGH", "/items"), ("auth-coverage", "MEDIUM", "/items"), ("no-debug-endpoints", "HIGH", "/swagger"),
    ("no-shadow-mutation", "HIGH", "/health"),
]))
def policies_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("GET", "/admin", "PUBLIC"), ("GET", "/Token", "PUBLIC"), ("POST", "/items", "UNKNOWN"), ("GET", "/swagger", "PRIVATE"), ("PUT", "/health", "UNKNOWN"), ("GET", "/fine", "PRIVATE")]
    return ep.violations(spark.createDataFrame(rows, "method string, route string, auth_status string")).select("policy", "severity", "route")


_CODE = "status_code=201\nreturn x, 404\nResponse(body, status=302)\nHTTP_401_UNAUTHORIZED\nraise HTTPException(status 500)\nreturn y, 404"


@query(values("code, found", [(201, True), (302, True), (401, True), (404, True), (500, True), (202, False), (200, False), (400, False), (403, False), (409, False), (422, False), (429, False)]))
def responses_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status codes of a piece of code, then those that are usual for its method."""
    d = spark.createDataFrame([(_CODE,)], "code string").select(F.inline(responses.merged(routes.status_codes(F.col("code")), F.lit("POST"))))
    return d.select("code", "found")


@query(values("n, status, error, repaired", [
    (1, "SUCCESS", None, '{"responses":{"200":{"description":"Success"},"500":{"description":"Internal Server Error"}},"summary":"API endpoint operation"}'),
    (2, "SUCCESS", None, '{"parameters":[{"name":"a","in":"path"}],"requestBody":{"content":{"application/json":{"schema":{"type":"object"}}}},"responses":{"200":{}},"summary":"s"}'),
    (3, "FAILED", "parameters", None), (4, "FAILED", "parameters", None), (5, "FAILED", "operation", None), (6, "FAILED", "operation", None),
]))
def operations_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "{}"), (2, '{"parameters":[{"name":"a","in":"path"}],"requestBody":{"x":1},"responses":{"200":{}},"summary":"s"}'), (3, '{"parameters":{"a":1}}'), (4, '{"parameters":[{"name":"a","in":"moon"}]}'), (5, "[1]"), (6, None)]
    return enrichment.repaired_operations(spark.createDataFrame(rows, "n int, operation string")).select("n", "status", "error", "repaired")


_REST = '"400":{"description":"Bad request"},"401":{"description":"Unauthorized"},"404":{"description":"Not found"},"500":{"description":"Internal server error"}}'
_OK = '"responses":{"200":{"description":"Successful response"},' + _REST
_ORDER = '{"application/json":{"schema":{"$ref":"#/components/schemas/OrderDto"}}}'


@query(values("route, method, operation", [
    ("/users/{id}", "get", '{"operationId":"get_users_id","tags":["",""],"parameters":[{"name":"id","in":"path","required":true,"schema":{"type":"string"}}],' + _OK + ',"x-source-file":"a.py","x-source-line":1,"x-risk-level":"LOW"}'),
    ("/login", "post", '{"operationId":"post_login","tags":["",""],"requestBody":{"content":{"application/json":{"schema":{"type":"object"}}}},' + _OK + ',"x-source-file":"b.py","x-source-line":2,"x-risk-level":"HIGH"}'),
]))
def openapi_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a.py", 1, "GET", "users/:id", "ENDPOINT", "LOW"), ("b.py", 1, "GET", "/users/{id}", "ENDPOINT", "HIGH"), ("b.py", 2, "MUTATION", "/login", "ENDPOINT", "HIGH"), ("b.py", 3, "ANY", "/", "ENDPOINT", "LOW"), ("b.py", 4, "ANY", "/x", "CONFIG", "LOW")]
    return sinks.openapi_operations(spark.createDataFrame(rows, "path string, line int, method string, route string, kind string, risk_level string")).select("route", "method", "operation")


def controller_operations(spark: SparkSession) -> DataFrame:
    cs = code(spark).filter(F.endswith("path", F.lit(".cs")))
    return sinks.openapi_operations(ep.scan(cs), parsers.action_details(parsers.controllers(cs), parsers.action_parameters(cs)))


@query(values("route, method, operation, body, returns", [
    ("/api/Orders/{id}", "get", '{"operationId":"get_api_Orders_id","tags":["ASP.NET","dotnet"],"parameters":[{"name":"id","in":"path","required":true,"schema":{"type":"string"}}],' + _OK + ',"security":[{"bearerAuth":[]},{"apiKeyAuth":[]}],"x-source-file":"src/Orders.cs","x-source-line":4,"x-risk-level":"INFO","x-auth-status":"PRIVATE"}', None, None),
    ("/api/Orders", "post", '{"operationId":"post_api_Orders","tags":["ASP.NET","dotnet"],"parameters":[{"name":"copies","in":"query","required":false,"schema":{"type":"integer"}}],"requestBody":{"required":true,"content":' + _ORDER + '},"responses":{"200":{"description":"Successful response","content":' + _ORDER + "}," + _REST + ',"security":[{"bearerAuth":[]},{"apiKeyAuth":[]}],"x-source-file":"src/Orders.cs","x-source-line":7,"x-risk-level":"INFO","x-auth-status":"PRIVATE"}', "OrderDto", "OrderDto"),
]))
def openapi_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of C# actions: path and query parameters, body and answer by reference, security."""
    return controller_operations(spark)


_SCHEMA = '{"type":"object","properties":{"count":{"type":"integer","format":"int32","nullable":true},"lines":{"type":"array","items":{"$ref":"#/components/schemas/LineDto"}},"name":{"type":"string"},"when":{"type":"string","format":"date-time"}},"required":["name"]}'


@query(values("class, schema", [("OrderDto", _SCHEMA), ("LineDto", '{"type":"object"}')]))
def dto_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.dto_schemas(parsers.dto_properties(code(spark)))


@query(values("kind, name", [("path", "/api/Orders"), ("path", "/api/Orders/{id}"), ("schema", "LineDto"), ("schema", "OrderDto")]))
def openapi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the document's lines hold: routes, and schemas that operations refer to, directly or through others."""
    lines = sinks.openapi_document(controller_operations(spark), schemas=parsers.dto_schemas(parsers.dto_properties(code(spark))))
    name = F.regexp_extract("value", r'^,?"([^"]*)":', 1)
    return lines.select(F.when(F.startswith(name, F.lit("/")), "path").otherwise("schema").alias("kind"), name.alias("name")).filter("name != ''")


@query(values("n, found", [
    (1, '{"a":1}'), (2, '{"a":"x // y"}'), (3, '{"a":1}'), (4, '{"a": [1,2]}'), (5, None), (6, '{"a":{"b":"}"}}'), (7, None), (8, "[1]"), (9, None),
]))
def robust_json_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in texts with more around it, comments, braces in strings, and none at all."""
    texts = ['{"a":1} and then {"b":2}', 'note {"a":"x // y"} end', '// see {x}\n{"a":1,}', 'Here:\n```json\n{"a": [1,2,],}\n```\n', "no", '{"a":{"b":"}"}} tail', '{"a":1', "[1]", None]
    d = spark.createDataFrame(list(enumerate(texts, 1)), "n int, t string")
    return d.select("n", parsers.robust_json(F.col("t")).alias("found"))


_TYPED = '''
@permission_required("orders.read")
class Shop:
    pass

def f(a: Optional[int], b: Union[int, str], c: List[Item], d: Dict[str, float], e: "UUID" = None) -> Item | None:
    """Sum up.

    More of it.

    Args:
        a: first

    Returns:
        The sum.

    Raises:
        ValueError: when bad
    """
'''


@query(values("function, schemas, summary, description, parameters, answer, raises", [
    ("f", '{"a": {"type": "integer", "nullable": true}, "b": {"oneOf": [{"type": "integer"}, {"type": "string"}]}, "c": {"type": "array", "items": {"$ref": "#/components/schemas/Item"}}, "d": {"type": "object", "additionalProperties": {"type": "number"}}, "e": {"type": "string", "format": "uuid"}, "return": {"$ref": "#/components/schemas/Item", "nullable": true}}',
     "Sum up.", "More of it.", '{"a": "first"}', "The sum.", '{"ValueError": "when bad"}'),
]))
def annotation_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("t.py", _TYPED)], "path string, content string")
    return parsers.python_functions(d).filter("bases IS NULL").select("function", "schemas", "summary", "description", "parameters", "answer", "raises")


@query(values("function, scheme, permission", [("Shop", "session", "orders.read")]))
def class_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.auth_schemes(parsers.python_functions(spark.createDataFrame([("t.py", _TYPED)], "path string, content string"))).drop("path")


@query(values("path, python", [("app/main.py", True), ("web/server.js", False), ("src/Orders.cs", False), ("src/Shop.java", False), ("web/handlers/users.py", True)]))
def python_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether code looks like Python, without parsing it."""
    return code(spark).filter(F.col("path").rlike(r"\.(py|js|cs|java)$")).select("path", detect.is_python(F.col("content")).alias("python"))


@query(values("line, first, n_lines", [(7, "def read_user(user_id: int) -> dict:", 13), (14, "def read_user(user_id: int) -> dict:", 13), (20, "def drop_token(user_id: int, scope: Literal[\"all\", \"own\"] = \"own\"):", 5)]))
def function_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of the function at a line: from where it begins to the next one."""
    d = code(spark).filter(F.col("path") == "app/main.py").select("content", F.explode(F.array(F.lit(8), F.lit(14), F.lit(20))).alias("line"))
    w = F.split(enrichment.function_window(F.col("content"), F.col("line")), "\n", -1)
    return d.select(F.when(F.col("line") == 8, 7).otherwise(F.col("line")).alias("line"), w[0].alias("first"), F.size(w).alias("n_lines"))


@query(values("path, line, method, route, summary, scheme, confidence, asks", [
    ("app/main.py", 7, "GET", "/users/{user_id}", "Find a user.", None, 0.8, False), ("app/main.py", 18, "DELETE", "/users/{user_id}/token", "", "session", 0.7, False), ("app/main.py", 23, "POST", "/api/orders/new", "", None, 0.45, True),
]))
def described_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain without a model: code, function, parameters, codes, authentication, confidence, decision."""
    files_ = code(spark).filter(F.col("path") == "app/main.py")
    e = ep.scan(files_, ["python"]).filter((F.col("kind") == "ENDPOINT") & F.startswith("route", F.lit("/")))
    known = enrichment.described_endpoints(enrichment.with_code(e, files_, 3), files_)
    return known.select("path", "line", "method", "route", "summary", "scheme", "confidence", "asks")
