"""What is usual for an HTTP method: bodies, status codes, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.routes import lookup, status_text

#: Fixed values: (codes of success, codes of errors, what is done to a resource) by method; DEFAULT for any other.
EXPECTED = {
    "GET": ([200, 206], [400, 401, 403, 404, 429, 500], "Retrieve {resource}"),
    "POST": ([201, 202, 200], [400, 401, 403, 409, 422, 429, 500], "Create new {resource}"),
    "PUT": ([200, 204], [400, 401, 403, 404, 409, 422, 429, 500], "Update {resource}"),
    "PATCH": ([200, 204], [400, 401, 403, 404, 422, 429, 500], "Partially update {resource}"),
    "DELETE": ([204, 200], [401, 403, 404, 429, 500], "Delete {resource}"),
    "HEAD": ([200], [401, 403, 404, 500], "Get {resource} metadata"),
    "OPTIONS": ([200, 204], [401, 403, 500], "Get allowed methods for {resource}"),
}
DEFAULT = ([200], [400, 401, 403, 500])


def standard_codes(method: Column) -> Column:
    """The codes of success and of errors that are usual for a method, in that order."""
    pack = lambda ok, bad: F.array(*[F.lit(c) for c in ok + bad])
    out = F.when(F.lit(False), pack(*DEFAULT))
    for m, (ok, bad, _) in EXPECTED.items():
        out = out.when(F.upper(method) == m, pack(ok, bad))
    return out.otherwise(pack(*DEFAULT))


def has_body(method: Column) -> Column:
    return F.upper(method).isin("POST", "PUT", "PATCH")


def description(method: Column, resource: Column) -> Column:
    """What the method does to a resource, in words."""
    said = lookup(F.upper(method), {m: d for m, (_, _, d) in EXPECTED.items()}, F.concat(F.lit("Perform "), F.upper(method), F.lit(" operation on {resource}")))
    return F.replace(said, F.lit("{resource}"), resource)


def merged(found: Column, method: Column) -> Column:
    """An array of (code, description, found): the codes found in the source, then the usual ones that are missing there."""
    row = lambda there: lambda c: F.struct(c.alias("code"), status_text(c).alias("description"), F.lit(there).alias("found"))
    return F.concat(F.transform(found, row(True)), F.transform(F.array_except(standard_codes(method), found), row(False)))
