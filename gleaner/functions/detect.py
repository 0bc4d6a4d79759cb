"""Column functions that tell what a file, a route or a piece of code is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.routes import lookup

#: Languages by suffix, and the words in a path that tell its framework.
LANGUAGES = {".py": "python", ".cs": "csharp", ".csx": "csharp", ".go": "go", ".js": "javascript", ".ts": "typescript", ".java": "java"}
FRAMEWORKS = {
    "python": {"flask": "flask", "fastapi": "fastapi", "fast_api": "fastapi", "django": "django"},
    "go": {"gin": "gin", "echo": "echo"},
    "javascript": {"express": "express", "fastify": "fastify"},
    "typescript": {"express": "express", "fastify": "fastify"},
    "csharp": {"": "aspnet"},
    "java": {"": "spring"},
}
#: Words of routes and of code that have to do with authentication.
AUTH_ROUTES = ["auth", "login", "logout", "token", "oauth", "signin", "signout", "register", "signup"]
AUTH_CODE = ["auth", "login", "token", "jwt", "oauth", "bearer", "permission", "role", "authorize", "authenticate", "session", "api_key", "credential", "password"]
#: What shows that a module uses a library for authentication.
LOGIN_LIBRARY = ["from flask_login import", "import flask_login", r"LoginManager\(", "@login_required"]
JWT_LIBRARY = ["from flask_jwt", "import flask_jwt", r"JWTManager\(", "@jwt_required"]
SECURITY = {"oauth2": "OAuth2PasswordBearer|OAuth2AuthorizationCodeBearer", "bearer": "HTTPBearer|get_current_user", "api_key": "APIKeyHeader|APIKeyQuery|APIKeyCookie"}


def path_language(path: Column) -> Column:
    return lookup(F.regexp_extract(F.lower(path), r"(\.[a-z]+)$", 1), LANGUAGES, F.lit("unknown"))


def path_framework(path: Column) -> Column:
    """The framework that a path speaks of; the first of its language's words that it holds."""
    low, language = F.lower(path), path_language(path)
    hits = [F.when((language == k) & F.contains(low, F.lit(word)), name) for k, words in FRAMEWORKS.items() for word, name in words.items()]
    return F.coalesce(*hits, F.lit("unknown"))


def _holds(text: Column, words: list[str], flags: str = "(?i)") -> Column:
    return F.coalesce(text.rlike(flags + "|".join(words)), F.lit(False))


def auth_route(route: Column) -> Column:
    return _holds(route, AUTH_ROUTES)


def auth_code(code: Column) -> Column:
    return _holds(code, AUTH_CODE)


def login_library(code: Column) -> Column:
    return _holds(code, LOGIN_LIBRARY)


def jwt_library(code: Column) -> Column:
    return _holds(code, JWT_LIBRARY)


def security_dependency(code: Column) -> Column:
    """oauth2 before bearer before api_key; null where there is none."""
    return F.coalesce(*[F.when(_holds(code, [rx], ""), name) for name, rx in SECURITY.items()])


def spec_type(spec: Column) -> Column:
    """What a spec (JSON) says that it is; OpenAPI3 where it says nothing."""
    version = F.get_json_object(spec, "$.openapi")
    return F.when(F.startswith(version, F.lit("3")), "OpenAPI3").when(version.isNotNull(), "OpenAPI2").when(F.get_json_object(spec, "$.swagger").isNotNull(), "Swagger").otherwise("OpenAPI3")


def _first_segment(route: Column, passed: list[str], parameter: str) -> Column:
    parts = F.filter(F.split(F.regexp_replace(route, "^/+|/+$", ""), "/"), lambda s: (s != "") & ~F.lower(s).isin(passed) & ~s.rlike(parameter))
    return F.try_element_at(parts, F.lit(1))


def batch_resource(route: Column) -> Column:
    """What a route's batch is named after: its first segment that is no version and no parameter."""
    return F.coalesce(_first_segment(route, ["api", "v1", "v2"], "^[:{]"), F.lit("default"))


def shared_resource(route: Column) -> Column:
    """The resource that routes depend on each other by, in lower case; null for routes of one segment and those without any."""
    return F.when(F.contains(F.regexp_replace(route, "^/+|/+$", ""), F.lit("/")), F.lower(_first_segment(route, ["api", "v1", "v2", "v3"], r"\{")))


def real_route(framework: Column, method: Column, route: Column) -> Column:
    """Whether an endpoint has a route that a spec can name: found classes and bare class names have none."""
    guessed = F.coalesce(framework, F.lit("")).isin("Custom-Class", "Legacy-Handler")
    inner = F.contains(F.substring(route, 2, 1 << 30), F.lit("/")) & ~method.isin("CLASS", "HANDLER")
    return ~route.isin("", "/") & ~route.rlike("^/?[A-Z][a-zA-Z0-9]*$") & (~guessed | inner)


def short_route(route: Column, width: int = 40) -> Column:
    """A route that fits a column of a report."""
    return F.when(F.length(route) > width, F.concat(F.substring(route, 1, width - 3), F.lit("..."))).otherwise(route)


def place(path: Column, line: Column) -> Column:
    """file:line, without folders."""
    return F.concat_ws(":", F.element_at(F.split(path, "/"), -1), line.cast("string"))


def model_tasks(flags: dict[str, Column], described: Column) -> Column:
    """What is left for a language model to do, in a fixed order; examples always."""
    return F.array_compact(F.array(
        F.when(~flags["has_parameters"], "parameter_extraction"), F.when(~flags["has_type_hints"], "type_inference"),
        F.when(~flags["has_docstring"], "description_generation").when(~described, "parameter_descriptions"),
        F.when(~flags["has_responses"], "response_codes"), F.when(~flags["has_auth"], "auth_detection"), F.lit("example_generation"),
    ))


def decision(confidence: Column, simple: Column, complex_: Column, tasks: Column, threshold: float = 0.7) -> Column:
    """(asks, reason, tasks) of an endpoint: whether a language model is asked, why, and for what."""
    told = lambda asks, reason, t: F.struct(F.lit(asks).alias("asks"), F.lit(reason).alias("reason"), t.alias("tasks"))
    none, sure = F.array().cast("array<string>"), confidence >= threshold
    return (
        F.when(sure & simple, told(False, "simple", none)).when(sure & ~complex_, told(False, "documented", none)).when(sure, told(True, "complex", F.array(F.lit("description_enhancement"))))
        .when(complex_, told(True, "complex_and_incomplete", tasks)).otherwise(told(True, "incomplete", tasks))
    )


#: What speaks for JavaScript, for C#, for a body in braces and for Python.
SCRIPT_SIGNS = ["function(", "const ", "let ", "var ", ") {", "};", "async function", "module.exports", "router.", "app.use("]
CSHARP_SIGNS = ["public ", "private ", "protected ", " Task<", "IActionResult", "[Route", "[Http", "namespace ", "using System"]
BRACE_SIGNS = ["function ", ") {", "if (", "for ("]
PYTHON_SIGNS = ["def ", "class ", "import ", "from ", "__init__", "self.", "@", ":"]


def is_python(code: Column) -> Column:
    """Whether code looks like Python: signs of it, and not two of another language, nor bodies in braces."""
    count = lambda signs: sum((F.contains(code, F.lit(x)).cast("int") for x in signs), F.lit(0))
    braces = F.contains(code, F.lit("{")) & F.contains(code, F.lit("}")) & (count(BRACE_SIGNS) > 0)
    return F.coalesce((count(SCRIPT_SIGNS) < 2) & (count(CSHARP_SIGNS) < 2) & ~braces & (count(PYTHON_SIGNS) > 0), F.lit(False))


#: The field that each kind of template is tried on first.
FIRST_FIELD = {
    "sql_injection": "username", "xss": "name", "command_injection": "filename", "path_traversal": "file", "nosql_injection": "username", "ldap_injection": "username", "header_injection": "redirect_url", "ssrf": "url",
    "template_injection": "template", "xxe": "xml",
}


def likely_field(category: Column) -> Column:
    return lookup(category, FIRST_FIELD, F.lit("input"))
