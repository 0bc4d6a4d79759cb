"""Cases of detection, checks and constraints over literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import detect
from gleaner.operators import constraints, enrichment, parsers
from gleaner.plans.query import values
from tests.literal_registry import query


@query(values("path, language, framework", [
    ("app/flask_main.py", "python", "flask"), ("App/Fast_API/x.py", "python", "fastapi"), ("a/b.py", "python", "unknown"), ("Api/Startup.cs", "csharp", "aspnet"), ("gin/main.go", "go", "gin"), ("web/fastify.ts", "typescript", "fastify"),
    ("src/A.java", "java", "spring"), ("README", "unknown", "unknown"),
]))
def path_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["app/flask_main.py", "App/Fast_API/x.py", "a/b.py", "Api/Startup.cs", "gin/main.go", "web/fastify.ts", "src/A.java", "README"]
    p = F.col("path")
    return spark.createDataFrame([(x,) for x in paths], "path string").select("path", detect.path_language(p).alias("language"), detect.path_framework(p).alias("framework"))


@query(values("n, login, jwt, security", [(1, True, False, None), (2, False, True, "oauth2"), (3, False, False, "bearer"), (4, False, False, "api_key"), (5, False, False, None)]))
def auth_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "from flask_login import LoginManager"), (2, "@JWT_required()\nx = OAuth2PasswordBearer(y); get_current_user"), (3, "Depends(get_current_user)"), (4, "APIKeyHeader(name='k')"), (5, None)]
    c = F.col("code")
    return spark.createDataFrame(rows, "n int, code string").select("n", detect.login_library(c).alias("login"), detect.jwt_library(c).alias("jwt"), detect.security_dependency(c).alias("security"))


@query(values("n, kind", [(1, "OpenAPI3"), (2, "OpenAPI2"), (3, "Swagger"), (4, "OpenAPI3")]))
def spec_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, '{"openapi":"3.1.0"}'), (2, '{"openapi":"2.0"}'), (3, '{"swagger":"2.0"}'), (4, "{}")]
    return spark.createDataFrame(rows, "n int, spec string").select("n", detect.spec_type(F.col("spec")).alias("kind"))


@query(values("route, batch, shared, is_auth, shown", [
    ("/api/v1/Users/{id}", "Users", "users", False, "/api/v1/Users/{id}"), ("/v3/orders", "v3", "orders", False, "/v3/orders"), ("/Login", "Login", None, True, "/Login"), ("/{id}/:x", "default", ":x", False, "/{id}/:x"),
    ("/api/" + "s" * 40, "s" * 40, "s" * 40, False, "/api/" + "s" * 32 + "..."),
]))
def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("/api/v1/Users/{id}",), ("/v3/orders",), ("/Login",), ("/{id}/:x",), ("/api/" + "s" * 40,)]
    r = F.col("route")
    return spark.createDataFrame(rows, "route string").select("route", detect.batch_resource(r).alias("batch"), detect.shared_resource(r).alias("shared"), detect.auth_route(r).alias("is_auth"), detect.short_route(r).alias("shown"))


@query(values("route", [("/users",), ("/a/B",), ("x/y",)]))
def real_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Flask", "GET", "/users"), ("Flask", "GET", "/"), ("Flask", "GET", "/UserView"), ("Custom-Class", "CLASS", "/a/b"), ("Custom-Class", "GET", "/a/B"), ("Legacy-Handler", "GET", "/users"), (None, "GET", "x/y")]
    return spark.createDataFrame(rows, "framework string, method string, route string").filter(detect.real_route(F.col("framework"), F.col("method"), F.col("route"))).select("route")


@query(values("n, status, error, defaulted, valid, fuzz", [
    (1, "SUCCESS", None, True, "[]", "[]"), (2, "SUCCESS", None, False, '[{"name":"a"}]', "[]"), (3, "FAILED", "valid", False, None, None), (4, "FAILED", "valid", False, None, None), (5, "FAILED", "answer", False, None, None), (6, "FAILED", "answer", False, None, None),
]))
def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "{}"), (2, '{"valid":[{"name":"a"}]}'), (3, '{"valid":{"name":"a"}}'), (4, '{"valid":[{"x":1}],"fuzz":[]}'), (5, "[]"), (6, None)]
    return enrichment.checked_lists(spark.createDataFrame(rows, "n int, answer string"), {"valid": ["name"], "fuzz": []}).select("n", "status", "error", "defaulted", "valid", "fuzz")


_MODELS = "class Order(BaseModel):\n    n: int\n\nclass Other:\n    pass\n\ndef add(key: int, order: Order):\n    pass\n\ndef put(self, data: dict, o: Order):\n    pass\n\ndef get(k: List[int]):\n    pass\n"


@query(values("name, body", [("Order", None), ("add", "Order"), ("put", "dict")]))
def body_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model classes of a Python file, and the functions that take a body."""
    f = parsers.python_functions(spark.createDataFrame([("a.py", _MODELS)], "path string, content string"))
    return parsers.model_classes(f).select(F.col("class").alias("name"), F.lit(None).cast("string").alias("body")).union(parsers.body_types(f).select("function", "body"))


_CHECKS = """@validator("email")
def book(user_id, size: int = Field(gt=0)):
    '''Book.

    :param size: at least 2 and at most 9
    :param note: any text
    :param rate: must be between 0.5 and 3 (positive)
    '''
    if current_user.id != user_id:
        raise ValueError("Username must be known")
    raise Error("no")
"""


@query(values("field, signal, ge, le, gt", [("email", "pydantic_validator", None, None, None), ("username", "inline_validation", None, None, None), ("size", "docstring_constraint", 2.0, 9.0, None), ("rate", "docstring_constraint", 0.5, 3.0, 0.0)]))
def code_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a function's text says of its fields."""
    code = spark.createDataFrame([("a.py", _CHECKS), ("b.py", ""), ("c.py", None)], "path string, code string")
    return constraints.code_constraints(code).drop("path")


@query(values("path, field, signals, ge, gt, idor_risk, required, inferred_positive, confidence", [
    ("a.py", "email", "pydantic_validator", None, None, False, False, False, 0.4), ("a.py", "username", "inline_validation", None, None, False, False, False, 0.3),
    ("a.py", "size", "docstring_constraint,pydantic_field_constraint", 2.0, 0.0, False, False, False, 0.7), ("a.py", "rate", "docstring_constraint", 0.5, 0.0, False, False, False, 0.2),
    ("a.py", "user_id", "ownership_pattern,path_param_id", None, None, True, True, False, 0.5), ("b.py", "owner_id", "path_param_id", None, None, False, True, False, 0.2), ("b.py", "count", "field_name_inference", None, None, False, True, True, 0.1),
]))
def field_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs from the text, the syntax tree and the route of each endpoint, by field."""
    rows = [("a.py", "/book/{user_id:int}", _CHECKS.split("\n", 1)[1]), ("b.py", "/own/:owner_id/:count", "x = 1"), ("c.py", "/{user_id}", " ")]
    e = spark.createDataFrame(rows, "path string, route string, code string")
    text = constraints.code_constraints(spark.createDataFrame([("a.py", _CHECKS)], "path string, code string"))
    tree = constraints.syntax_constraints(parsers.python_functions(e.select("path", F.col("code").alias("content")))).drop("function")
    out = constraints.field_constraints(text.unionByName(tree), e, ["path"])
    return out.select("path", "field", F.array_join("signals", ",").alias("signals"), "ge", "gt", "idor_risk", "required", "inferred_positive", "confidence")
