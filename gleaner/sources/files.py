"""Readers: source trees, API specs, SDL, snapshots."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.catalog import IGNORED_DIRS
from gleaner.operators.endpoints import forward_filled
from gleaner.operators.matching import FLAGS, language_of, match_rows
from gleaner.operators.parsers import VERBS


def allowed(relative: Column) -> Column:
    """No folder of a path below the scanned root is one of those left out."""
    return ~F.exists(F.split(relative, "/"), lambda p: p.isin(IGNORED_DIRS))


def decode(content: Column) -> Column:
    """UTF-8 without what isn't, and with line feeds alone."""
    text = F.replace(F.call_function("make_valid_utf8", content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def below(path: Column, root: str) -> Column:
    """A file's path relative to the folder that was read."""
    base = root.rstrip("/").split("://")[-1]
    return F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), "^.*?" + re.escape(base) + "/", "")


def source_files(spark: SparkSession, root: str, max_bytes: int = 10 << 20) -> DataFrame:
    """(path, content, length, md5) of the files of known extensions below `root`, without folders left out and large files.

    Paths are relative to `root`, so a root below a folder named `tests` is scanned. Bytes that are not UTF-8 are left out.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= max_bytes)
    out = df.select(below(F.col("path"), root).alias("path"), F.col("content").alias("_raw"), "length").filter(allowed(F.col("path")) & language_of(F.col("path")).isNotNull())
    return out.select("path", decode(F.col("_raw")).alias("content"), "length", F.md5("_raw").alias("md5"))


def spec_json(files: DataFrame) -> DataFrame:
    """(path, route, method) of OpenAPI or Swagger JSON in `files` (path, content); a path without verbs has method ANY."""
    like = files.filter(F.col("content").rlike('"(openapi|swagger)"') & F.contains("content", F.lit('"paths"')))
    paths = like.select("path", F.explode(F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,string>>")).alias("route", "verbs"))
    methods = F.filter(F.transform(F.map_keys("verbs"), F.lower), lambda v: v.isin(VERBS))
    return paths.select("path", "route", F.explode(F.when(F.size(methods) > 0, methods).otherwise(F.array(F.lit("any")))).alias("_m")).select("path", "route", F.upper("_m").alias("method"))


def json_members(rows: DataFrame, text: str, kind: str = "string") -> DataFrame:
    """`rows` with a row for each member of the JSON object in a column: key and value (of type `kind`) in the column's place. What is no object has none."""
    rest = [c for c in rows.columns if c not in (text, "key", "value")]
    return rows.select(*rest, F.explode(F.from_json(text, f"map<string,{kind}>")).alias("key", "value"))


def spec_lines(files: DataFrame) -> DataFrame:
    """(path, line, route, method) of YAML specs, line by line: a verb belongs to the last path line above it."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("_i", "_l"))
    route = F.nullif(F.regexp_extract("_l", r"^\s*[\"']?(/[^\s\"':]*)[\"']?\s*:\s*$", 1), F.lit(""))
    verb = F.nullif(F.regexp_extract("_l", rf"^\s+({'|'.join(VERBS)})\s*:", 1), F.lit(""))
    filled = forward_filled(lines, ["path"], ["_i"], route, "route").select("path", (F.col("_i") + 1).alias("line"), "route", verb.alias("_v"))
    return filled.filter(F.col("_v").isNotNull() & F.col("route").isNotNull()).select("path", "line", "route", F.upper("_v").alias("method"))


def yaml_documents(files: DataFrame) -> DataFrame:
    """`files` with content turned from YAML to JSON (null where it isn't YAML, or where no YAML library is there)."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError:
            yaml = None
        for pdf in batches:
            out = []
            for text in pdf["content"]:
                try:
                    out.append(json.dumps(yaml.safe_load(text), default=str) if yaml else None)
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pdf.assign(content=out)

    return files.select("path", "content").mapInPandas(convert, "path string, content string")


def graphql(files: DataFrame) -> DataFrame:
    """(path, operation, field) of the Query and Mutation types of SDL files."""
    blocks = match_rows(files, "content", F.lit(FLAGS + r"\btype\s+(Query|Mutation)\s*\{([^}]*)\}"), {"operation": F.lit(1), "body": F.lit(2)}, ["path"])
    fields = blocks.select("path", F.lower("operation").alias("operation"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\s*(\w+)\s*(?:\([^)]*\))?\s*:"), F.lit(1))).alias("field"))
    return fields


def previous_scan(spark: SparkSession, path: str) -> DataFrame:
    """The endpoints of a JSON report."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("endpoints").alias("e")).select("e.*")
