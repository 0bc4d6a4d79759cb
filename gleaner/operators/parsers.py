"""Structure that patterns can't find: balanced braces and Python syntax, a file at a time within tasks."""

from __future__ import annotations

import ast
import inspect
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.routes import json_text
from gleaner.sources.shared import cut

ROUTES = "path string, line int, controller string, action string, method string, route string, auth_status string, returns string"
FUNCTIONS = "path string, function string, line int, decorators string, hints string, returns string, summary string, parameters string, constraints string, bases string, description string, answer string, raises string, schemas string"


def block_end(text: str, start: int) -> int:
    """Where the block that opens at or after `start` closes."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def combine(base: str, own: str) -> str:
    """A method's route below its class's; one that begins with a slash or ~/ stands alone."""
    if own.startswith(("/", "~/")):
        return "/" + own.lstrip("~/")
    return "/" + "/".join(x.strip("/") for x in (base, own) if x.strip("/"))


def csharp_actions(text: str) -> Iterator[tuple]:
    """(line, controller, action, method, route, auth, raw match, response type) of C# controllers."""
    for c in re.finditer(r"class\s+(\w+)Controller\b[^{]*\{", text):
        before, name = text[max(0, c.start() - 500) : c.start()], c.group(1)
        base = (re.findall(r'\[Route(?:Prefix)?\(\s*"([^"]*)"', before) or [""])[-1].replace("[controller]", name)
        end = block_end(text, c.end() - 1)
        for m in re.finditer(r'\[Http(Get|Post|Put|Delete|Patch|Head|Options)(?:\(\s*"([^"]*)"[^\]]*\))?\]', text[:end]):
            if m.start() < c.end():
                continue
            after = text[m.end() : min(end, m.end() + 500)]
            signature = re.sub(r"\[[^\]]*\]", "", after)
            action = re.search(r"\b(\w+)\s*\(", signature)
            returns = re.search(r"(?:ActionResult|Task)<(?:ActionResult<)?(?:I?List<|IEnumerable<)?(\w+)", signature[: action.start()] if action else "")
            around = text[max(0, m.start() - 200) : m.end() + 200]
            auth = "PUBLIC" if "[AllowAnonymous" in around else "PRIVATE" if re.search(r"\[(Api)?Authorize", around + before) else "UNKNOWN"
            own = m.group(2) or next(iter(re.findall(r'^\s*\[Route\(\s*"([^"]*)"', after)), "")
            route = combine(base, own).replace("[action]", action.group(1) if action else "")
            yield text.count("\n", 0, m.start()) + 1, name, action.group(1) if action else None, m.group(1).upper(), route, auth, m.group(0), returns.group(1) if returns else None


def spring_actions(text: str) -> Iterator[tuple]:
    """(line, controller, action, method, route, auth, raw match, response type) of Spring controllers; the type is not looked for."""
    for c in re.finditer(r"@(?:Rest)?Controller\b.*?\bclass\s+(\w+)[^{]*\{", text, re.S):
        base = (re.findall(r'@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]*)"', text[max(0, c.start() - 500) : c.end()]) or [""])[-1]
        end = block_end(text, c.end() - 1)
        for m in re.finditer(r'@(Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?(?:"([^"]*)")?[^)]*\))?', text[c.end() : end]):
            at = c.end() + m.start()
            action = re.search(r"\b(\w+)\s*\(", re.sub(r"@\w+(\([^)]*\))?", "", text[c.end() + m.end() : c.end() + m.end() + 500]))
            auth = "PRIVATE" if re.search(r"@(PreAuthorize|Secured|RolesAllowed)", text[max(0, at - 200) : at + 200]) else "UNKNOWN"
            yield text.count("\n", 0, at) + 1, c.group(1), action.group(1) if action else None, m.group(1).upper(), combine(base, (m.group(2) or "").lstrip("/")), auth, m.group(0), None


VERBS = ["get", "post", "put", "delete", "patch", "options", "head", "trace"]


def sdl_fields(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, Query or Mutation, field, raw match) of GraphQL SDL."""
    for block in re.finditer(r"\btype\s+(Query|Mutation)\s*\{([^}]*)\}", text, re.I):
        for m in re.finditer(r"^[ \t]*(\w+)\s*(?:\([^)]*\))?\s*:", block[2], re.M):
            yield text.count("\n", 0, block.start(2) + m.start(1)) + 1, block[1].capitalize(), m[1], m[0]


def _spec(path: str, text: str):
    """A spec as Python values; ValueError where it can't be read as a whole."""
    if path.lower().endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise ValueError("no YAML library") from None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from None


def spec_paths(path: str, text: str) -> Iterator[tuple[int, str, str]]:
    """(line, route, method) of an OpenAPI or Swagger spec: the line where the route stands first; ANY for a path without a verb.

    What can't be read as a whole is gone through line by line: a verb belongs to the last path above it, with the verb's line.
    """
    if not re.search(r"[\"']?\b(openapi|swagger|paths)[\"']?\s*:", text, re.I):
        return
    try:
        spec = _spec(path, text)
    except (ValueError, RecursionError):
        route = None
        for n, line in enumerate(text.split("\n"), 1):
            if m := re.match(r"\s*[\"']?(/[^\s\"':]*)[\"']?\s*:", line):
                route = m[1]
            elif route and (m := re.match(rf"\s+[\"']?({'|'.join(VERBS)})[\"']?\s*:", line)):
                yield n, route, m[1].upper()
        return
    paths = spec.get("paths") if isinstance(spec, dict) else None
    for route, verbs in (paths.items() if isinstance(paths, dict) else ()):
        if isinstance(verbs, dict):
            line = text.count("\n", 0, max(0, text.find(str(route)))) + 1
            for verb in [v for v in verbs if str(v).lower() in VERBS] or ["any"]:
                yield line, str(route), str(verb).upper()


def controllers(files: DataFrame) -> DataFrame:
    """Routes of C# and Spring controllers in `files` (path, content): a row for each action with a verb.

    Columns: path, line, controller, action, method, route, auth_status, returns (the class that a C# action answers with).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r[:6], r[7]) for p, t in zip(pdf["path"], pdf["content"], strict=True) if t for r in (csharp_actions(t) if p.endswith(".cs") else spring_actions(t))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ROUTES.split(", ")])

    return files.select("path", "content").filter(F.col("path").rlike(r"\.(cs|java)$")).mapInPandas(run, ROUTES)


_GOOGLE = r"^[ \t]*(?:{})[ \t]*:[ \t]*\n((?:[ \t]+\S.*\n?|[ \t]*\n)+)"
_NUMPY = r"^[ \t]*(?:{})[ \t]*\n[ \t]*-{{3,}}[ \t]*\n(.*?)(?=\n[ \t]*\n|\n[ \t]*\w+[ \t]*\n[ \t]*-{{3,}}|\Z)"


def _section(text: str, names: str) -> tuple[str, str]:
    """The body of a section in the manner of Google, and of NumPy; empty where there is none."""
    g, n = re.search(_GOOGLE.format(names), text + "\n", re.M), re.search(_NUMPY.format(names), text, re.M | re.S)
    return g[1] if g and not n else "", n[1] if n else ""


def docstring_sections(text: str | None) -> dict:
    """summary, description, parameters, returns and raises of a Google, NumPy, Sphinx or plain docstring."""
    text = inspect.cleandoc(text or "")
    google, numpy = _section(text, "Args|Arguments|Parameters")
    parameters = dict(re.findall(r":param\s+(?:\w+\s+)?(\w+)\s*:\s*(.+)", text))
    parameters |= {k: d.strip() for k, d in re.findall(r"^\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*(.+)$", google, re.M)}
    parameters |= {k: d.strip() for k, d in re.findall(r"^\s*(\w+)\s*:\s*[^\n]*\n\s+(.+)$", numpy, re.M)}
    google, numpy = _section(text, "Returns?|Yields?")
    returns = " ".join(google.split()) or " ".join(numpy.split("\n", 1)[-1].split())
    if m := re.search(r":returns?:\s*(.+)", text):
        returns = m[1].strip()
    google, numpy = _section(text, "Raises")
    raises = dict(re.findall(r":raises?\s+(\w+)\s*:\s*(.+)", text)) | {k: d.strip() for k, d in re.findall(r"^\s+(\w+)\s*:\s*(.+)$", google, re.M)}
    raises |= {k: d.strip() for k, d in re.findall(r"^(\w+)[ \t]*\n[ \t]+(.+)$", numpy, re.M)}
    head = re.split(r"^\s*(?::\w+|(?:Args|Arguments|Parameters|Returns?|Yields?|Raises|Examples?|Notes?)\s*(?::\s*$|\n\s*-{3,}))", text, maxsplit=1, flags=re.M)[0].strip()
    summary, _, description = head.partition("\n")
    return {"summary": summary.strip(), "description": " ".join(description.split()), "parameters": parameters, "returns": returns, "raises": raises}


def docstring(text: str | None) -> tuple[str, dict[str, str]]:
    """The summary and the parameters' descriptions."""
    found = docstring_sections(text)
    return found["summary"], found["parameters"]


#: JSON types of Python types.
PYTHON_TYPES = {"int": "integer", "float": "number", "str": "string", "bool": "boolean", "list": "array", "dict": "object", "bytes": "string", "None": "null", "Any": "object", "tuple": "array", "set": "array"}
_FORMATS = {"UUID": "uuid", "datetime": "date-time", "date": "date", "time": "time", "bytes": "binary", "EmailStr": "email", "AnyUrl": "uri", "HttpUrl": "uri"}


def annotation_schema(node: ast.AST | None) -> dict:
    """The JSON schema of a type annotation; classes are references."""
    if node is None or (isinstance(node, ast.Constant) and node.value is None):
        return {"type": "null"}
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return annotation_schema(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return {"type": "string"}
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return _union([annotation_schema(node.left), annotation_schema(node.right)])
    if isinstance(node, ast.Subscript):
        kind = getattr(node.value, "id", getattr(node.value, "attr", ""))
        parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        if kind in ("Optional", "Union"):
            return _union([annotation_schema(p) for p in parts] + ([{"type": "null"}] if kind == "Optional" else []))
        if kind == "Literal":
            return {"enum": [p.value for p in parts if isinstance(p, ast.Constant)]}
        if kind == "Annotated":
            return annotation_schema(parts[0])
        if kind in ("Dict", "dict", "Mapping"):
            return {"type": "object", "additionalProperties": annotation_schema(parts[-1])}
        if kind in ("List", "list", "Set", "set", "Sequence", "Iterable", "Tuple", "tuple", "FrozenSet", "frozenset"):
            return {"type": "array", "items": annotation_schema(parts[0])}
        return annotation_schema(node.value)
    name = getattr(node, "id", getattr(node, "attr", ""))
    if name in _FORMATS:
        return {"type": "string", "format": _FORMATS[name]}
    if name in PYTHON_TYPES:
        return {"type": PYTHON_TYPES[name]}
    lists = {"List": "array", "Dict": "object", "Tuple": "array", "Set": "array"}
    return {"type": lists[name]} if name in lists else {"$ref": f"#/components/schemas/{name}"}


def _union(parts: list[dict]) -> dict:
    """oneOf, flat and each once; a null makes it nullable."""
    flat = [q for p in parts for q in (p["oneOf"] if "oneOf" in p else [{k: v for k, v in p.items() if k != "nullable"}])]
    nullable = any(p == {"type": "null"} or p.get("nullable") for p in parts)
    flat = [p for k, p in enumerate(flat) if p != {"type": "null"} and p not in flat[:k]]
    out = flat[0] if len(flat) == 1 else {"oneOf": flat} if flat else {"type": "null"}
    return {**out, "nullable": True} if nullable and flat else out


_OPPOSITE = {ast.Lt: "ge", ast.LtE: "gt", ast.Gt: "le", ast.GtE: "lt"}
_SAME = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge"}


def _constraints(fn: ast.AST) -> dict[str, dict]:
    """What arguments may be: from Field(...), Literal[...], `if ...: raise` (turned round) and assert."""
    out: dict[str, dict] = {}

    def note(name: str, signal: str, **found) -> None:
        c = out.setdefault(name, {"signals": []})
        c |= found
        c["signals"] = sorted({*c["signals"], signal})

    def field(name: str, call: ast.AST, signal: str) -> None:
        if isinstance(call, ast.Call) and getattr(call.func, "id", getattr(call.func, "attr", "")) in ("Field", "Query", "Path", "Body"):
            got = {k.arg: k.value.value for k in call.keywords if k.arg and isinstance(k.value, ast.Constant) and k.arg in ("gt", "ge", "lt", "le", "min_length", "max_length", "multiple_of", "pattern")}
            if got:
                note(name, signal, **got)

    def annotation(name: str, node: ast.AST | None, default: ast.AST | None) -> None:
        if default is not None:
            field(name, default, "pydantic_field_constraint")
        if isinstance(node, ast.Subscript):
            kind = getattr(node.value, "id", getattr(node.value, "attr", ""))
            parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            if kind == "Literal":
                note(name, "literal_type", enum=[p.value for p in parts if isinstance(p, ast.Constant)])
            elif kind == "Annotated":
                for p in parts[1:]:
                    field(name, p, "annotated_constraint")

    if isinstance(fn, ast.ClassDef):
        for s in fn.body:
            if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                annotation(s.target.id, s.annotation, s.value)
        return out
    args = [*fn.args.posonlyargs, *fn.args.args]
    for a, d in zip(args, [None] * (len(args) - len(fn.args.defaults)) + list(fn.args.defaults), strict=True):
        annotation(a.arg, a.annotation, d)
    for s in ast.walk(fn):
        test, table = (s.test, _OPPOSITE) if isinstance(s, ast.If) and any(isinstance(x, ast.Raise) for x in s.body) else (s.test, _SAME) if isinstance(s, ast.Assert) else (None, {})
        if isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and len(test.ops) == 1 and isinstance(test.comparators[0], ast.Constant) and type(test.ops[0]) in table:
            note(test.left.id, "inline_validation", **{table[type(test.ops[0])]: test.comparators[0].value})
    return out


def _python(text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(n, ast.ClassDef)
            hints = {s.target.id: ast.unparse(s.annotation) for s in n.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)} if is_class else {a.arg: ast.unparse(a.annotation) for a in n.args.args if a.annotation}
            told = docstring_sections(ast.get_docstring(n))
            typed = {s.target.id: s.annotation for s in n.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)} if is_class else {a.arg: a.annotation for a in n.args.args if a.annotation}
            schemas = {k: annotation_schema(v) for k, v in typed.items()} | ({"return": annotation_schema(n.returns)} if not is_class and n.returns else {})
            returns = None if is_class or n.returns is None else ast.unparse(n.returns)
            yield n.name, n.lineno, json.dumps([ast.unparse(d) for d in n.decorator_list]), json.dumps(hints), returns, told["summary"], json.dumps(told["parameters"]), json.dumps(_constraints(n), sort_keys=True), json.dumps([ast.unparse(b) for b in n.bases]) if is_class else None, told["description"], told["returns"], json.dumps(told["raises"]), json.dumps(schemas)


def python_functions(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files: decorators, type hints, docstring sections, constraints and the hints' JSON schemas, the maps as JSON.

    Each file is parsed once; files that are not Python give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["content"], strict=True) if t for r in _python(t)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FUNCTIONS.split(", ")])

    return files.select("path", "content").filter(F.endswith("path", F.lit(".py"))).mapInPandas(run, FUNCTIONS)


#: What a decorator says of authentication.
AUTH_DECORATORS = {"login_required": "session", "jwt_required": "bearer", "token_required": "bearer", "require_auth": "bearer", "auth_required": "bearer", "api_key_required": "apiKey", "basic_auth": "basic", "permission_required": "session", "roles_required": "session", "requires_auth": "bearer"}


def auth_schemes(functions: DataFrame) -> DataFrame:
    """(path, function, scheme, permission) for each decorator of `python_functions` (of functions and classes) that asks for authentication.

    permission is the first argument in quotes of a decorator that speaks of a permission or of roles, else null.
    """
    d = functions.select("path", "function", F.explode(F.from_json("decorators", "array<string>")).alias("_d"))
    name = F.regexp_extract("_d", r"(\w+)\s*(?:\(.*)?$", 1)
    scheme = F.when(F.lit(False), F.lit(None))
    for k, v in AUTH_DECORATORS.items():
        scheme = scheme.when(name == k, v)
    asked = F.when(name.rlike("(?i)permission|role"), F.nullif(F.regexp_extract("_d", r"\(\s*[\"']([^\"']*)[\"']", 1), F.lit("")))
    return d.withColumn("scheme", scheme).withColumn("permission", asked).filter(F.col("scheme").isNotNull()).drop("_d")


def model_classes(functions: DataFrame) -> DataFrame:
    """(path, class) of `python_functions` for each class right below BaseModel."""
    return functions.filter(F.array_contains(F.from_json("bases", "array<string>"), "BaseModel")).select("path", F.col("function").alias("class"))


#: Names of arguments that take a request's body.
BODY_NAMES = ["body", "data", "payload", "request", "dto", "model"]


def body_types(functions: DataFrame) -> DataFrame:
    """(path, function, body) of `python_functions`: the type of the first argument that takes a body.

    That is one with such a name, or whose type is a plain name in capitals that isn't generic.
    """
    plain = lambda e: e["value"].rlike(r"^\w+$")
    model = lambda e: e["value"].rlike("^[A-Z]") & ~e["value"].isin("Dict", "List", "Optional", "Union")
    args = F.filter(F.map_entries(F.from_json("hints", "map<string,string>")), lambda e: plain(e) & (F.lower(e["key"]).isin(BODY_NAMES) | model(e)))
    found = functions.filter(F.col("bases").isNull()).select("path", "function", F.try_element_at(args, F.lit(1))["value"].alias("body"))
    return found.filter(F.col("body").isNotNull())


_STRING = r'"(?:\\.|[^"\\])*"'


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _balanced(text: str) -> str:
    """From the first brace or bracket to the one that closes it; strings don't count. All the rest where none does."""
    start, depth = re.search(r"[{\[]", text), 0
    if not start:
        return ""
    for m in re.compile(rf"{_STRING}|[{{}}\[\]]", re.S).finditer(text, start.start()):
        depth += (m[0] in "{[") - (m[0] in "}]")
        if depth == 0:
            return text[start.start() : m.end()]
    return text[start.start() :]


def mended_json(text: str | None) -> str | None:
    """JSON of a text that holds some: as it is, in a fence, the first balanced object or array, that without comments and final commas, or with the commas that lines lack; else null."""
    if text is None:
        return None
    parts = [text, *re.findall(r"```(?:\w+)?[ \t]*\n?(.*?)```", text, re.S)]
    outside = lambda rx, t: re.sub(rf"({_STRING})|{rx}", lambda m: m[1] or "", t, flags=re.S)
    tries = [p.strip() for p in parts]
    for p in reversed(parts):
        bare = _balanced(outside(r"//[^\n]*|/\*.*?\*/", p))
        neat = outside(r",(?=\s*[}\]])", bare)
        tries += [_balanced(p), bare, neat, re.sub(r"([\"\d}\]el])([ \t]*\n\s*)(?=[\"{\[])", r"\1,\2", neat)]
    return next((t for t in tries if t and _is_json(t)), None)


@F.pandas_udf(StringType())
def robust_json(text: pd.Series) -> pd.Series:
    """`mended_json` of each text."""
    return text.map(lambda t: mended_json(t) if isinstance(t, str) else None)


#: JSON type and format of C# types, by name in lower case.
CSHARP_TYPES = {
    "int": ("integer", "int32"), "int32": ("integer", "int32"), "short": ("integer", "int32"), "int16": ("integer", "int32"), "byte": ("integer", "int32"), "long": ("integer", "int64"), "int64": ("integer", "int64"),
    "float": ("number", "float"), "single": ("number", "float"), "double": ("number", "double"), "decimal": ("number", "double"), "bool": ("boolean", None), "boolean": ("boolean", None), "string": ("string", None),
    "guid": ("string", "uuid"), "datetime": ("string", "date-time"), "datetimeoffset": ("string", "date-time"), "timespan": ("string", "duration"),
}
_SIMPLE = {*CSHARP_TYPES, "char", "uint", "uint32", "uint64", "object", "dynamic"}
_LIST = re.compile(r"^(?:I?List|IEnumerable|ICollection|HashSet|Array)<(.+)>$|^(.+)\[\]$", re.I)


def csharp_schema(name: str) -> tuple[str, str | None, bool, str | None]:
    """(JSON type, format, nullable, class referred to) of a C# type; lists refer to the class of their items."""
    bare = name.replace("?", "")
    if m := _LIST.match(bare):
        return "array", None, "?" in name, csharp_schema(m.group(1) or m.group(2))[3]
    if bare.lower() in CSHARP_TYPES:
        return *CSHARP_TYPES[bare.lower()], "?" in name, None
    if re.match(r"^I?Dictionary<", bare):
        return "object", None, "?" in name, None
    return "object", None, "?" in name, bare.split(".")[-1]


def _is_complex(name: str) -> bool:
    bare = name.replace("?", "")
    m = _LIST.match(bare)
    return _is_complex(m.group(1) or m.group(2)) if m else bare.lower() not in _SIMPLE


def _split_top(text: str) -> list[str]:
    """The parts between commas outside of angle brackets."""
    depth, parts = 0, [""]
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def _per_file(files: DataFrame, extension: str, schema: str, rows) -> DataFrame:
    """Rows that a function finds in the text of each file of an extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(pdf["path"], pdf["content"], strict=True) if t for r in rows(t)], columns=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content").filter(F.endswith("path", F.lit(extension))).mapInPandas(run, schema)


def _actions(text: str) -> Iterator[tuple]:
    for m in re.finditer(r"\[Http\w+(?:\([^)]*\))?\]\s*(?:\[[^\]]*\]\s*)*(?:public|private|protected)\s+[^(;{]*?(\w+)\s*\(((?:[^()]|\([^()]*\))*)\)", text):
        for k, p in enumerate(_split_top(m.group(2))):
            source = (re.findall(r"\[From(Body|Query|Route|Uri|Header)\b", p, re.I) or [""])[0].lower()
            if q := re.match(r"^([\w<>,\[\]?.]+)\s+(\w+)(?:\s*=\s*(.+))?$", re.sub(r"\[[^\]]+\]\s*", "", p).strip()):
                place = {"uri": "query", "route": "path", "": "body" if _is_complex(q.group(1)) else "query"}.get(source, source)
                yield m.group(1), k, q.group(2), q.group(1), place, q.group(3) is None, csharp_schema(q.group(1))[0]


def action_parameters(files: DataFrame) -> DataFrame:
    """(path, action, position, name, type, place, required, json_type) for each parameter of C# actions; classes are bodies unless said otherwise."""
    return _per_file(files, ".cs", "path string, action string, position int, name string, type string, place string, required boolean, json_type string", _actions)


def _properties(text: str) -> Iterator[tuple]:
    for c in re.finditer(r"(?:public|internal)\s+(?:sealed\s+|partial\s+|abstract\s+)*(?:class|record|struct)\s+(\w+)(?:\s*<[^>]+>)?(?:\s*:\s*[^{]+)?\s*\{", text):
        body = text[c.end() : block_end(text, c.end() - 1)]
        for p in re.finditer(r"((?:\[[^\]]*\]\s*)*)(?:public|internal)\s+(?:virtual\s+|required\s+)?([\w<>,\[\]?.]+)\s+(\w+)\s*\{\s*get;", body):
            name = (re.findall(r"Json(?:Property|PropertyName)\s*\(\s*\"([^\"]+)\"", p.group(1)) or [p.group(3)])[0]
            kind, fmt, nullable, ref = csharp_schema(p.group(2))
            yield c.group(1), name[:1].lower() + name[1:], kind, fmt, nullable, "Required" in p.group(1), ref


def dto_properties(files: DataFrame) -> DataFrame:
    """(path, class, property, json_type, format, nullable, required, ref) for each property of C# classes; `ref` names a class that joins to `class`."""
    return _per_file(files, ".cs", "path string, class string, property string, json_type string, format string, nullable boolean, required boolean, ref string", _properties)


def reachable_classes(properties: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class) of `wanted` and all that they refer to, however far: a join a level, none seen twice, each level cut off in the checkpoint folder."""
    refs = cut(properties.filter(F.col("ref").isNotNull()).select("class", "ref").distinct())
    seen = frontier = cut(wanted.select("class").distinct())
    while not frontier.isEmpty():
        frontier = cut(refs.join(frontier, "class", "left_semi").select(F.col("ref").alias("class")).distinct().join(seen, "class", "left_anti"))
        seen = cut(seen.union(frontier))
    return seen


def dto_schemas(properties: DataFrame) -> DataFrame:
    """(class, schema) of `dto_properties`: a JSON schema for each class, and a stub for each class that is referred to but not there.

    Of a class in several files the first path counts. Properties stand in order of their names.
    """
    first = properties.groupBy("class").agg(F.min("path").alias("path"))
    own = properties.join(first, ["class", "path"])
    ref = F.concat(F.lit('{"$ref":"#/components/schemas/'), F.col("ref"), F.lit('"}'))
    plain = F.to_json(F.struct(F.col("json_type").alias("type"), "format", F.when(F.col("nullable"), F.lit(True)).alias("nullable")))
    kind = F.when((F.col("json_type") == "array") & F.col("ref").isNotNull(), F.concat(F.lit('{"type":"array","items":'), ref, F.lit("}"))).when(F.col("ref").isNotNull(), ref).otherwise(plain)
    pair = F.struct("property", F.concat(json_text(F.col("property")), F.lit(":"), kind).alias("p"))
    needed = F.array_sort(F.collect_set(F.when(F.col("required"), json_text(F.col("property")))))
    whole = own.groupBy("class").agg(F.array_sort(F.collect_set(pair)).alias("_p"), needed.alias("_r"))
    body = F.concat(F.lit('{"type":"object","properties":{'), F.array_join(F.transform("_p", lambda x: x["p"]), ","), F.lit("}"), F.when(F.size("_r") > 0, F.concat(F.lit(',"required":['), F.array_join("_r", ","), F.lit("]"))).otherwise(""), F.lit("}"))
    known = whole.select("class", body.alias("schema"))
    missing = properties.filter(F.col("ref").isNotNull()).select(F.col("ref").alias("class")).distinct().join(known.select("class"), "class", "left_anti")
    return known.union(missing.select("class", F.lit('{"type":"object"}')))


def action_details(controllers: DataFrame, parameters: DataFrame) -> DataFrame:
    """(path, line, query, body, returns) of C# actions: what `controllers` and `action_parameters` tell for an OpenAPI operation.

    query is an array of (name, type, required), sorted; body and returns name classes. An action's name stands for all its overloads in a file.
    """
    told = parameters.groupBy("path", "action").agg(
        F.array_sort(F.collect_set(F.when(F.col("place") == "query", F.struct("name", F.col("json_type").alias("type"), "required")))).alias("query"), F.min(F.when(F.col("place") == "body", F.col("type"))).alias("body")
    )
    return controllers.filter(F.endswith("path", F.lit(".cs"))).select("path", "line", "action", "returns").join(told, ["path", "action"], "left").drop("action")
