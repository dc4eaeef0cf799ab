"""Integrity checks, coverage, and the audit that gates an export."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.num import ratio_or_zero
from .diff import field_diff, orphans, present_only_in


def _filled(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def unique_key(df: DataFrame, key: Sequence[str], nonblank_only: bool = False) -> DataFrame:
    """Keys that occur more than once."""
    if nonblank_only:
        for k in key:
            df = df.filter(_filled(F.col(k)))
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def foreign_keys(specs: Sequence[tuple[str, DataFrame, str | Column, DataFrame, str]]) -> DataFrame:
    """(check, key) for every child key the parent lacks; a child column may be an array of keys."""
    parts = []
    for name, child, column, parent, parent_key in specs:
        c = F.col(column) if isinstance(column, str) else column
        keys = child.select(c.alias("k"))
        if keys.dtypes[0][1].startswith("array"):
            keys = keys.select(F.explode("k").alias("k"))
        parts.append(orphans(keys, parent, "k", parent_key).select(F.lit(name).alias("check"), F.col("key").cast("string").alias("key")))
    return reduce(DataFrame.unionByName, parts)


def cardinality(df: DataFrame, group: str, n: int, groups: DataFrame | None = None) -> DataFrame:
    """Groups whose size is not ``n``; with ``groups``, those of its groups that have no row too, at 0."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    if groups is not None:
        sizes = groups.select(group).distinct().join(sizes, group, "full").fillna(0, subset=["rows"])
    return sizes.filter(F.col("rows") != n)


def group_count(df: DataFrame, group: str, n: int) -> DataFrame:
    """One row (expected, found) where the number of distinct groups is not ``n``, else none."""
    return df.agg(F.lit(n).alias("expected"), F.count_distinct(group).alias("found")).filter("expected <> found")


def banned_values(df: DataFrame, column: str, retired: DataFrame) -> DataFrame:
    """Retired ids still in use, with replacement and use count; ``retired`` is (old_id, new_id)."""
    used = df.groupBy(F.col(column).alias("old_id")).agg(F.count(F.lit(1)).alias("uses"))
    return used.join(retired, "old_id")


def baseline_drift(current: DataFrame, baseline: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(field differences, rows the baseline lacks). The latter are pending, not failures."""
    return field_diff(baseline, current, [key], fields, missing_equals_blank=True), present_only_in(current, baseline, key).select(key)


def check_row(name: str, df: DataFrame, fails: bool = True) -> DataFrame:
    n = F.count(F.lit(1))
    status = F.when(n == 0, "PASS").otherwise("FAIL" if fails else "PENDING")
    return df.agg(n.alias("rows"), status.alias("status")).select(F.lit(name).alias("check"), "rows", "status")


def audit(checks: dict[str, DataFrame], pending: dict[str, DataFrame] | None = None, strict: bool = False) -> DataFrame:
    """One row per check. ``strict`` runs the report and raises when any check fails."""
    parts = [check_row(n, d) for n, d in checks.items()] + [check_row(n, d, fails=False) for n, d in (pending or {}).items()]
    report = reduce(DataFrame.unionByName, parts)
    if strict:
        failed = [r["check"] for r in report.filter("status = 'FAIL'").collect()]  # one row per check
        if failed:
            raise ValueError(f"integrity checks failed: {', '.join(failed)}")
    return report


def manifest_matches(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Entities whose counted rows differ from the manifest."""
    counts = reduce(
        DataFrame.unionByName,
        [d.agg(F.count(F.lit(1)).alias("counted")).select(F.lit(n).alias("entity"), "counted") for n, d in tables.items()],
    )
    return manifest.select("entity", "rows").join(counts, "entity", "full").withColumn("matches", F.col("rows").eqNullSafe(F.col("counted")))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-blank count, total and share per column, from one aggregate."""
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(_filled(F.col(c))).alias(c) for c in columns])
    long = wide.unpivot(["total"], list(columns), "field", "filled")
    return long.withColumn("share", ratio_or_zero(F.col("filled"), F.col("total")))


def quality_summary(measures: Sequence[tuple[DataFrame, Sequence[tuple[str, Column, str | None]]]],
                    fixed: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows (key, status, count, total, pct).

    Each measure is a frame with (key, condition, fixed status or None); None means available when
    every row qualifies, else missing. ``fixed`` rows carry a status and no numbers. A frame with
    several measures is scanned once.
    """
    parts = []
    for df, specs in measures:
        wide = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(cond).alias(k) for k, cond, _ in specs])
        long = wide.unpivot(["total"], [k for k, _, _ in specs], "key", "count")
        status = F.when(F.col("count") == F.col("total"), "available").otherwise("missing")
        for k, _, s in specs:
            if s:
                status = F.when(F.col("key") == k, s).otherwise(status)
        parts.append(long.select("key", status.alias("status"), "count", "total", ratio_or_zero(F.col("count"), F.col("total")).alias("pct")))
    out = reduce(DataFrame.unionByName, parts)
    if fixed:
        spark = out.sparkSession
        out = out.unionByName(spark.createDataFrame(list(fixed), "key string, status string"), allowMissingColumns=True)
    return out


def metric_summary(df: DataFrame, keys: Sequence[str], total: str = "rows") -> DataFrame:
    """``metric, value`` rows: the total, then ``<column>__<value>`` counts for each column; a missing value counts as an empty one.

    One scan for any number of columns: each row is spread over the grouping sets of the single columns and of none, and combined before the shuffle.
    """
    every = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{i}") for i, k in enumerate(keys)]
    names = [f"_{i}" for i in range(len(keys))]
    sets = [[F.col(n)] for n in names] + [[]]
    counts = df.select(*every).groupingSets(sets, *[F.col(n) for n in names]).agg(F.count(F.lit(1)).alias("value"), F.grouping_id().alias("_set"))
    metric = F.lit(total)
    for i, k in enumerate(keys):  # the bit of a column is 0 in its own set
        metric = F.when(F.col("_set") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)), F.concat(F.lit(f"{k}__"), F.col(f"_{i}"))).otherwise(metric)
    return counts.select(metric.alias("metric"), "value") if keys else df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(total).alias("metric"), "value")


def overlap_count(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Number of distinct values that occur in both columns."""
    both = a.select(F.col(a_col).alias("v")).filter("v is not null").intersect(b.select(F.col(b_col).alias("v")))
    return both.agg(F.count(F.lit(1)).alias("overlap"))


def pre_step_audit(measures: dict[str, tuple[DataFrame, Column, Column, str]]) -> DataFrame:
    """PASS or WARN per check: (frame, aggregate value, aggregate condition, note)."""
    parts = [
        df.agg(value.cast("long").alias("value"), F.when(ok, "PASS").otherwise("WARN").alias("status")).select(
            F.lit(n).alias("check"), "status", "value", F.lit(note).alias("notes")
        )
        for n, (df, value, ok, note) in measures.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def missing_and_dupe_checks(df: DataFrame, group: str, name: str, entity: str) -> DataFrame:
    """Review rows for blank names and for a name that repeats inside a group."""
    blank = df.filter(~_filled(F.col(name)) | F.col(name).isNull()).select(
        F.col(entity).cast("string").alias("entity_id"), F.lit("missing_name").alias("issue_type"), F.lit("row has no name").alias("issue_detail")
    )
    dupes = df.filter(_filled(F.col(name))).groupBy(group, name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("").alias("entity_id"), F.lit("duplicate_name").alias("issue_type"),
        F.concat_ws(" ", name, F.lit("appears"), F.col("n").cast("string"), F.lit("times for"), F.col(group).cast("string")).alias("issue_detail"),
    )
    return blank.unionByName(dupes)
