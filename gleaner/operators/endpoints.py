"""From matches to scored, deduplicated endpoints; summaries, policies, differences, batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import scoring
from gleaner.operators.catalog import CATALOG, EXTENSIONS
from gleaner.operators.matching import Patterns, extract, with_prefixes
from gleaner.sources.shared import cut


def first_per(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row for each key: deterministic, unlike dropDuplicates. `order` must tell any two rows of a key apart."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") == 1).drop("_n")


def enrich(matches: DataFrame) -> DataFrame:
    """auth_status, risk_score, risk_level and risk_reasons beside the columns of `matches` (context, route, raw_match, method).

    An auth_status that `matches` has, other than null and UNKNOWN, stays. The patterns are looked for once, in `_flags`.
    """
    text = F.lower(F.concat_ws(" ", F.concat_ws("\n", "context"), "route", "raw_match"))
    given = F.coalesce(F.col("auth_status"), F.lit("UNKNOWN")) if "auth_status" in matches.columns else F.lit("UNKNOWN")
    scored = scoring.with_flags(matches.withColumn("_given", given).withColumn("_text", text), F.col("_text"))
    scored = scored.withColumn("auth_status", scoring.auth_status(F.col("_flags"), F.col("_given"))).withColumn("risk_score", scoring.risk_score(F.col("_flags"), F.col("method"), F.col("auth_status")))
    scored = scored.withColumn("risk_level", scoring.risk_level(F.col("risk_score"))).withColumn("risk_reasons", scoring.risk_reasons(F.col("_flags"), F.col("method"), F.col("auth_status")))
    return scored.drop("_text", "_flags", "_given")


def deduplicate(endpoints: DataFrame) -> DataFrame:
    """One endpoint for each file, line, route (without a final slash) and method: the first in order of patterns and matches."""
    route = F.regexp_replace("route", "/+$", "")
    return first_per(endpoints, ["path", "line", F.when(route == "", "/").otherwise(route), "method"], ["pattern", "match", "framework"])


def scan(files: DataFrame, languages: list[str] | None = None, patterns: Patterns = CATALOG, extensions: dict[str, str] = EXTENSIONS) -> DataFrame:
    """Endpoints of `files` (path, content): structure first, then patterns, prefixes and heuristics, deduplicated and scored.

    `languages` says which files to look at, all by default; `patterns` and `extensions` may be the caller's own. Each file is
    read once, contents don't cross a shuffle, and what is extracted crosses one, by path.
    """
    return enrich(deduplicate(with_prefixes(extract(files, languages, patterns, extensions))))


def language_counts(rows: DataFrame) -> DataFrame:
    """(language, n) of what was extracted (`matching.with_prefixes`), before deduplication."""
    return rows.groupBy("language").agg(F.count("*").alias("n"))


def summary(endpoints: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) for each value of each dimension, in one pass by grouping sets."""
    sets = endpoints.groupingSets([[d] for d in dimensions], *dimensions).agg(F.count("*").alias("n"), F.grouping_id(*dimensions).alias("_g"))
    names, value, k = F.lit(None).cast("string"), F.lit(None).cast("string"), len(dimensions)
    for i, d in enumerate(dimensions):
        here = F.col("_g") == (1 << k) - 1 - (1 << (k - 1 - i))
        names, value = F.when(here, d).otherwise(names), F.when(here, F.col(d).cast("string")).otherwise(value)
    return sets.select(names.alias("dimension"), value.alias("value"), "n")


def counts_where(rows: DataFrame, by: list[str], where: dict[str, Column], any_of: dict[str, Column] | None = None) -> DataFrame:
    """`by`, n (all rows), for each of `where` how many rows it holds for, and for each of `any_of` whether it holds for any; one pass."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in where.items()], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (any_of or {}).items()])


def counters(endpoints: DataFrame) -> DataFrame:
    """One row: total, shadow and critical endpoints."""
    return endpoints.agg(F.count("*").alias("total"), F.count_if(F.col("auth_status") == "UNKNOWN").alias("shadow"), F.count_if(F.col("risk_level").isin("CRITICAL", "HIGH")).alias("critical"))


def default_policies() -> list[tuple[str, str, Column]]:
    """(name, severity, condition) over the columns method, route and auth_status."""
    route = F.lower("route")
    holds = lambda *words: reduce(lambda a, b: a | b, [F.contains(route, F.lit(w)) for w in words])
    public, unknown = F.col("auth_status") == "PUBLIC", F.col("auth_status") == "UNKNOWN"
    return [
        ("no-public-admin", "CRITICAL", holds("admin") & public),
        ("no-shadow-mutation", "HIGH", F.col("method").isin("POST", "PUT", "DELETE", "PATCH") & unknown),
        ("no-sensitive-public", "CRITICAL", holds("password", "token", "secret", "key", "credential") & public),
        ("no-debug-endpoints", "HIGH", holds("debug", "test", "swagger", "graphql-playground")),
        ("auth-coverage", "MEDIUM", unknown & ~holds("health", "ping", "ready", "live", "metrics")),
    ]


def conditions(policies: list[tuple[str, str, Column | str]] | None = None) -> list[tuple[str, str, Column]]:
    """Policies with their conditions as columns; the default ones where none are given."""
    return [(n, s, F.expr(c) if isinstance(c, str) else c) for n, s, c in (default_policies() if policies is None else policies)]


def read_policies(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(name, severity, condition) of a JSON policy file, {"policies": [{name, severity, condition}]}; conditions are SQL expressions. A file of a few policies."""
    rows = spark.read.option("multiLine", True).schema("policies array<struct<name:string,severity:string,condition:string>>").json(path)
    return [(r["name"], r["severity"], r["condition"]) for r in rows.select(F.inline("policies")).filter("name IS NOT NULL AND condition IS NOT NULL").collect()]


#: Policies over more bins than this go to wider ones.
BINS = 256
#: Tables of more bytes than this are not broadcast.
FEW = 8 << 20


def _bytes(*strings: str) -> Column:
    """About what a row with these strings takes."""
    return F.octet_length(F.concat_ws("", *strings)).cast("long") + 64


def _measured(df: DataFrame, size: int | None) -> DataFrame:
    """`df` of so many bytes, to be joined: broadcast where they are few. Spark's own estimate is of files, before rows are made from rows, so it broadcasts what the driver has no room for."""
    return df.hint("broadcast" if (size or 0) <= FEW else "merge")


def policy_violations(endpoints: DataFrame, policies: DataFrame, route: str = "route", number: str = "score", width: float = 10.0) -> DataFrame:
    """A row for each endpoint and policy of a table that it breaks: policy, severity and the endpoint's columns.

    `policies` (policy, severity, prefix, low, high): broken by endpoints whose route begins with prefix and whose `number` is at least low and below high; null
    bounds bound nothing, a null prefix is the empty one. Each different route meets the different prefixes first, by equality with its beginnings of the lengths that prefixes have. Numbers come
    in bins of `width`, between the least and the largest of all endpoints, wider ones for policies over more than BINS of them: a policy goes to the bins that it covers, an endpoint to its own, and they meet by equality of prefix and bin;
    only bounds are checked then. There is no nested loop, and few meet that are no rows of the result. What is broadcast is measured before: the driver holds neither policies nor routes where they are many. Endpoints with a null route or number break none.
    """
    p = policies.select("policy", "severity", F.coalesce("prefix", F.lit("")).alias("_prefix"), F.col("low").cast("double").alias("_low"), F.col("high").cast("double").alias("_high"))
    p = p.filter(F.col("_low").isNull() | F.col("_high").isNull() | (F.col("_low") < F.col("_high")))
    e = endpoints.select(F.struct(*endpoints.columns).alias("_e"), F.col(route).alias("_route"), F.col(number).cast("double").alias("_n")).filter(F.col("_route").isNotNull() & F.col("_n").isNotNull())
    finite = F.when(F.abs("_n") < float("inf"), F.col("_n"))
    least, most = e.agg(F.coalesce(F.min(finite), F.lit(0.0)), F.coalesce(F.max(finite), F.lit(0.0))).first()
    wide = max(width, (most - least) / BINS)
    # Bounds and numbers beyond the ends are drawn to them, so order is kept: what lies within bounds lies within their bins.
    bin_ = lambda x, w: F.floor(F.least(F.greatest(x, F.lit(least)), F.lit(most)) / w)
    first, last = F.coalesce("_low", F.lit(least)), F.coalesce("_high", F.lit(most))
    bins = lambda w: F.sequence(bin_(first, w), bin_(last, w))
    narrow = bin_(last, width) - bin_(first, width) <= BINS
    p = p.withColumn("_wide", ~narrow).withColumn("_bin", F.when(narrow, bins(width)).otherwise(bins(wide)))
    prefixes = p.groupBy("_prefix").agg(F.sum(F.size("_bin") * _bytes("policy", "severity", "_prefix")).alias("_size"))
    lengths, size, binned = prefixes.agg(F.collect_set(F.length("_prefix")), F.sum(_bytes("_prefix")), F.sum("_size")).first()  # as many lengths as the longest prefix has letters, at most
    begins = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda k: k <= F.length("_route")), lambda k: F.substring(F.col("_route"), F.lit(1), k))
    met = cut(e.select("_route").distinct().select("_route", F.explode(begins).alias("_prefix")).join(_measured(prefixes.select("_prefix"), size), "_prefix"))
    p = p.withColumn("_bin", F.explode("_bin"))
    at = [F.struct(F.lit(False).alias("_wide"), bin_(F.col("_n"), width).alias("_bin"))] + ([F.struct(F.lit(True).alias("_wide"), bin_(F.col("_n"), wide).alias("_bin"))] if wide > width else [])
    e = e.join(_measured(met, met.agg(F.sum(_bytes("_route", "_prefix"))).first()[0]), "_route").select("_e", "_n", "_prefix", F.inline(F.array(*at)))
    holds = (F.coalesce("_low", F.col("_n")) <= F.col("_n")) & (F.col("_high").isNull() | (F.col("_n") < F.col("_high")))
    return e.join(_measured(p, binned), ["_prefix", "_wide", "_bin"]).filter(holds).select("policy", "severity", "_e.*")


def violations(endpoints: DataFrame, policies: list[tuple[str, str, Column | str]] | None = None) -> DataFrame:
    """A row for each endpoint and policy that it breaks: policy, severity and the endpoint's columns.

    Conditions are columns or SQL expressions. They are evaluated side by side and exploded, so there is no join.
    """
    hits = [F.when(c, F.struct(F.lit(n).alias("policy"), F.lit(s).alias("severity"))) for n, s, c in conditions(policies)]
    # Outer, and filtered after: from an inner explode the optimiser infers a filter that evaluates all of it a second time.
    return endpoints.select("*", F.explode_outer(F.array_compact(F.array(*hits))).alias("_v")).filter(F.col("_v").isNotNull()).select("_v.policy", "_v.severity", *endpoints.columns)


def sort_by_risk(endpoints: DataFrame) -> DataFrame:
    return endpoints.orderBy(scoring.rank(F.col("risk_level")), "path", "line", "route", "method")


def diff(before: DataFrame, after: DataFrame, keys: list[str], status: str, order: list[str]) -> DataFrame:
    """Changes between two snapshots: keys, change, breaking, reason. Of rows with equal keys the last by `order` counts.

    Removed is breaking; a status change from PUBLIC to PRIVATE is breaking, the reverse is not; others are none.
    """
    last = lambda df, name: df.groupBy(*keys).agg(F.max_by(status, F.struct(*order)).alias(name), F.lit(True).alias(f"{name}_there"))
    met = last(before, "was").join(last(after, "now"), keys, "full_outer")
    gone, new = F.col("now_there").isNull(), F.col("was_there").isNull()
    closed, opened = (F.col("was") == "PUBLIC") & (F.col("now") == "PRIVATE"), (F.col("was") == "PRIVATE") & (F.col("now") == "PUBLIC")
    change = F.when(gone, "REMOVED").when(new, "ADDED").when(closed | opened, "MODIFIED")
    reason = F.when(gone, "endpoint_removed").when(new, "endpoint_added").when(closed, "auth_required").otherwise("auth_removed")
    return met.withColumn("change", change).filter(F.col("change").isNotNull()).select(*keys, "change", F.coalesce(gone | (closed & ~new), F.lit(False)).alias("breaking"), reason.alias("reason"))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("total"), *[F.count_if(F.col("change") == c).alias(c.lower()) for c in ("ADDED", "REMOVED", "MODIFIED")], F.count_if("breaking").alias("breaking"))


def changed_files(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """The files of `now` (path, md5) that are new or differ from `baseline`."""
    b = baseline.select(F.col("path").alias("_p"), F.col("md5").alias("_m"))
    return now.join(b, now["path"] == F.col("_p"), "left").filter(~F.col("md5").eqNullSafe(F.col("_m"))).drop("_p", "_m")


def unchanged_files(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """The files of `now` (path, md5) that `baseline` has as they are."""
    b = baseline.select(F.col("path").alias("_p"), F.col("md5").alias("_m"))
    return now.join(b, (now["path"] == F.col("_p")) & (F.col("md5") == F.col("_m")), "left_semi")


def gate(endpoints: DataFrame, broken: DataFrame) -> DataFrame:
    """One row, critical_found and policy_broken: whether a scan should fail its caller."""
    risky = endpoints.agg(F.coalesce(F.bool_or(F.col("risk_level") == "CRITICAL"), F.lit(False)).alias("critical_found"))
    return risky.join(F.broadcast(broken.agg(F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("policy_broken"))))  # a row each


def set_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of two tables with side: added, removed or unchanged."""
    met = before.select(*keys, F.lit(True).alias("_b")).distinct().join(after.select(*keys, F.lit(True).alias("_a")).distinct(), keys, "full_outer")
    return met.select(*keys, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("unchanged").alias("side"))


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`df` with `rank`, from 1: the exact place of a row in its group by `order`, whatever the sizes of groups and however alike their keys begin.

    Rows are dealt to ranges of the whole order (group first), sorted, numbered in their range and written once; a range begins where sampled
    rows say, so a group of any size is spread over ranges. What a group has in the ranges before, a row for each group and range, is added. Rows
    equal in `order` are ranked in any order. Null groups are groups.
    """
    taken = {"_at": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}  # the second rises with the place in the range
    placed = cut(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).select("*", *[c.alias(n) for n, c in taken.items()]))
    counts = placed.groupBy(*group, "_at").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_at").alias("_p"), (before - F.col("_first") + 1).alias("_add")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PATHS else counts
    met = placed.join(counts, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_at") == F.col("_p")])
    return met.select(*df.columns, (F.col("_i") + F.col("_add")).alias("rank"))


def batches(df: DataFrame, group: list[str], order: list[str], size: int, largest: int | None = None) -> DataFrame:
    """`batch`: the number of the row's chunk of at most `size` rows (within 1 and `largest`) within its group, from 0, by `ranked`."""
    size = max(1, size if largest is None else min(size, largest))
    return ranked(df, group, order).select(*df.columns, F.floor((F.col("rank") - 1) / size).cast("long").alias("batch"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """`wanted` (key) with hit and value: entries of `cache` (key, value, created_at) no older than the limit."""
    entries = fresh(cache, now, ttl_seconds).select(F.col("key").alias("_k"), F.col("value"))
    return wanted.join(entries, wanted["key"] == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull()).drop("_k")


def fresh(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """`cache` (created_at) without expired entries."""
    return cache.filter(F.col("created_at") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS") >= now)


def cache_stats(cache: DataFrame, value: str, now: Column, ttl_seconds: int) -> DataFrame:
    """One row: entries, size (characters of their values) and hit_rate, the share that is no older than the limit (null without entries)."""
    alive = F.col("created_at") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS") >= now
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length(value)), F.lit(0)).alias("size"), F.round(F.try_divide(F.count_if(alive), F.count("*")), 6).alias("hit_rate"))


def batch_summary(rows: DataFrame, group: str) -> DataFrame:
    """(summary): one text, `group: n` for each value of a column with few, in order. Nulls are left out."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col(group).isNotNull())
    return counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(group).cast("string"), F.lit(": "), F.col("n").cast("string")))), ", ").alias("summary"))


def forward_filled(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`rows` with `name`: of the rows up to each within its keys, by `order`, the last value that isn't null."""
    above = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(above))


def cache_read(cache: DataFrame, wanted: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The cache (key, value, created_at, accessed_at, access_count) after `wanted` (key) was looked up: expired entries are gone, those found are marked as read once more."""
    keys = wanted.select(F.col("key").alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    met = fresh(cache, now, ttl_seconds).join(keys, F.col("key") == F.col("_k"), "left")
    read = F.col("_k").isNotNull()
    return met.withColumn("accessed_at", F.when(read, now).otherwise(F.col("accessed_at"))).withColumn("access_count", F.col("access_count") + read.cast("int")).select(*cache.columns)


def cache_upsert(cache: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Entries of `new` replace those of `cache` with the same key; of several in `new` the last by `order` (created_at, if it is there, and then all columns)."""
    order = order or [*[c for c in ("created_at",) if c in new.columns], *[c for c in new.columns if c not in ("key", "created_at")]]
    last = first_per(new, ["key"], [F.desc(c) for c in order])
    return cache.join(last.select("key"), "key", "left_anti").unionByName(last)


#: So many paths are broadcast at most.
BROADCAST_PATHS = 500_000


def incremental_scan(files: DataFrame, baseline: tuple[DataFrame, DataFrame], scan_files: Callable[[DataFrame], DataFrame] = scan) -> DataFrame:
    """Endpoints of `files` (path, content, md5): only files that are new or changed are scanned; the others' come from the baseline.

    Which those are is found from paths and hashes alone, and written. Then they pick the files: by a broadcast of up to BROADCAST_PATHS of them,
    so no content crosses a shuffle; more of them mean a scan of much, and pick by a join. For baselines of any size see `snapshots`, where
    neither side is shuffled. Of a path that is there twice all rows count, if one of them is new.
    """
    old_files, old = baseline
    names = files.select("path", "md5")
    changed = cut(changed_files(names, old_files).select(F.col("path").alias("_p")).distinct())
    same = unchanged_files(names, old_files).select("path")
    wanted = F.broadcast(changed) if changed.count() <= BROADCAST_PATHS else changed
    fresh_files = files.join(wanted, F.col("path") == F.col("_p"), "left_semi")
    kept = old.join(same, "path", "left_semi").join(changed, F.col("path") == F.col("_p"), "left_anti")
    return scan_files(fresh_files).unionByName(kept, allowMissingColumns=True)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)
