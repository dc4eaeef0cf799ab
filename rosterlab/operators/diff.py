"""Snapshots against each other: orphans, diffs, precedence, status updates, logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ids import make_id
from ..functions.text import fold
from ..skew import cut_lineage, first_per_key, number_rows

TASK_ROWS = 1_000_000  # rows of a group that one task numbers


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Distinct non-null child keys the parent lacks."""
    keys = child.select(F.col(child_key).alias("key")).filter("key is not null").distinct()
    return keys.join(parent.select(F.col(parent_key or child_key).alias("key")), "key", "left_anti")


def present_only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def agreement_check(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "MISSING").when(a == b, "OK").otherwise("MISMATCH")


def exact_pairs(ours: DataFrame, theirs: DataFrame, block: str, key: str, our_id: str, their_id: str) -> DataFrame:
    """1:1 pairs of rows with equal (block, key); copies pair in id order, extra copies stay over.

    Copies are numbered inside (block, key). A group of copies larger than a task is numbered from
    a range partitioning instead of a window: see ``numbered_copies``.
    """
    a, b = numbered_sides(ours.select(block, key, our_id), theirs.select(block, key, their_id), [block, key], our_id, their_id)
    return a.join(b, [block, key, "copy_no"]).select(block, our_id, their_id)


def numbered_sides(ours: DataFrame, theirs: DataFrame, group: Sequence[str], our_id: str, their_id: str) -> tuple[DataFrame, DataFrame]:
    """Both frames, of the columns ``group`` and their id, with ``copy_no``.

    A window numbers them if no group has more than ``TASK_ROWS`` rows; else one range partitioning serves both sides and its result is written.
    """
    side = lambda df, n: df.select(F.lit(n).alias("_side"), *group, our_id if n == 0 else their_id)
    both, own = side(ours, 0).unionByName(side(theirs, 1), allowMissingColumns=True), ["_side", *group]
    if (both.groupBy(*own).count().agg(F.max("count")).first()[0] or 0) > TASK_ROWS:
        both = cut_lineage(numbered_copies(both, own, our_id, their_id))
    else:
        both = both.withColumn("copy_no", F.row_number().over(W.partitionBy(*own).orderBy(our_id, their_id)))
    return both.filter("_side = 0").select(*group, our_id, "copy_no"), both.filter("_side = 1").select(*group, their_id, "copy_no")


def numbered_copies(df: DataFrame, group: Sequence[str], *order: str) -> DataFrame:
    """``copy_no`` 1..n inside each group in id order, with no group bound to one task.

    Rows get a global number in (group, id) order; the number inside the group is its distance
    from the group's first, an aggregate.
    """
    numbered = number_rows(df, [F.col(c) for c in (*group, *order)], out="_no")
    first = numbered.groupBy(*group).agg(F.min("_no").alias("_first"))
    return numbered.join(first, list(group)).withColumn("copy_no", F.col("_no") - F.col("_first") + 1).drop("_no", "_first")


def reconcile_summary(ours: DataFrame, theirs: DataFrame, matched: DataFrame, block: str) -> DataFrame:
    """Per block: rows on each side, matched pairs, cut (only ours) and new (only theirs)."""
    n = lambda df, name: df.groupBy(block).agg(F.count(F.lit(1)).alias(name))
    out = n(ours, "ours").join(n(theirs, "theirs"), block, "full").join(n(matched, "matched"), block, "full").fillna(0)
    return out.withColumn("cut", F.col("ours") - F.col("matched")).withColumn("new", F.col("theirs") - F.col("matched"))


def reconcile_overall(ours: DataFrame, theirs: DataFrame, matched: DataFrame, date_mismatches: DataFrame | None = None) -> DataFrame:
    """The whole run in one row: rows of both sides, matches, fuzzy ones among them, what only one side has, dates that differ."""
    n = lambda df, name, of=F.lit(1): df.agg(F.count(of).alias(name)).scalar()
    fuzzy = F.when(F.col("method") == "fuzzy", 1) if "method" in matched.columns else F.lit(None)
    one = ours.sparkSession.range(1).select(
        n(ours, "a").alias("ours"), n(theirs, "b").alias("theirs"), n(matched, "c").alias("matched"), n(matched, "d", fuzzy).alias("matched_fuzzy"),
        (n(date_mismatches, "e") if date_mismatches is not None else F.lit(0).cast("long")).alias("date_mismatches"),
    )
    return one.withColumns({"cut": F.col("ours") - F.col("matched"), "new": F.col("theirs") - F.col("matched")})


def merge_precedence(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Union where a later input wins per key."""
    tagged = [d.withColumn("_prio", F.lit(-i)) for i, d in enumerate(dfs)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(union, [key], ["_prio"]).drop("_prio")


def field_diff(a: DataFrame, b: DataFrame, key: Sequence[str], fields: Sequence[str], missing_equals_blank: bool = False) -> DataFrame:
    """(key, field, old, new) for rows in both frames whose values differ, NULL-safe."""
    s = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit("")) if missing_equals_blank else F.col(f"{side}.{f}").cast("string")
    changed = [
        F.when(~s("a", f).eqNullSafe(s("b", f)), F.struct(F.lit(f).alias("field"), s("a", f).alias("old_value"), s("b", f).alias("new_value")))
        for f in fields
    ]
    joined = a.select(*key, *fields).alias("a").join(b.select(*key, *fields).alias("b"), list(key))
    return joined.select(*key, F.explode(F.array_compact(F.array(*changed))).alias("d")).select(*key, "d.*")


def snapshot_diff(prev: DataFrame, curr: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Change-log rows: added, removed, and one row per changed field, from a single full join."""
    p = prev.select(*key, *fields).withColumn("_in", F.lit(True)).alias("p")
    c = curr.select(*key, *fields).withColumn("_in", F.lit(True)).alias("c")
    row = lambda kind, f, old, new: F.struct(
        F.lit(kind).alias("change_type"), f.alias("field_changed"), old.alias("old_value"), new.alias("new_value")
    )
    none = F.lit(None).cast("string")
    old, new = (lambda f: F.col(f"p.{f}").cast("string")), (lambda f: F.col(f"c.{f}").cast("string"))
    fields_changed = F.array_compact(F.array(*[F.when(~old(f).eqNullSafe(new(f)), row("changed", F.lit(f), old(f), new(f))) for f in fields]))
    changes = (
        F.when(F.col("p._in").isNull(), F.array(row("added", none, none, none)))
        .when(F.col("c._in").isNull(), F.array(row("removed", none, none, none)))
        .otherwise(fields_changed)
    )
    return p.join(c, list(key), "full").select(*key, F.explode(changes).alias("d")).select(*key, "d.*")


def status_updates(matched: DataFrame, cut: DataFrame, key: str, carried: Sequence[str]) -> DataFrame:
    """Active rows with the matched attributes and removed rows with none."""
    return matched.select(key, F.lit("active").alias("squad_status"), *carried).unionByName(
        cut.select(key, F.lit("removed").alias("squad_status")), allowMissingColumns=True
    )


def new_entity_rows(new: DataFrame, dims: DataFrame, name: str, dim_name: str, dim_id: str, id_prefix: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a dimension id, minted dimension rows).

    A name resolves by its folded spelling to the smallest known id, else to one id minted from
    the smallest raw spelling of that fold.
    """
    k = F.nullif(fold(F.col(name), "words_spelled"), F.lit(""))
    known = dims.withColumn("_k", fold(F.col(dim_name), "words_spelled")).groupBy("_k").agg(F.min(dim_id).cast("string").alias("_known"))
    keyed = new.withColumn("_k", k)
    fresh = keyed.filter("_k is not null").groupBy("_k").agg(F.min(name).alias(dim_name)).join(known, "_k", "left_anti")
    minted = fresh.withColumn(dim_id, make_id(id_prefix, F.col(dim_name), [F.col(dim_name)], clean=False))
    rows = keyed.join(known, "_k", "left").join(minted.select("_k", F.col(dim_id).alias("_new")), "_k", "left")
    return rows.withColumn(dim_id, F.coalesce("_known", "_new")).drop("_k", "_known", "_new"), minted.drop("_k")


def append_missing(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append the rows whose key is not there yet."""
    return df.unionByName(rows.join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def append_change_log(log: DataFrame, entries: DataFrame, order_by: Sequence[str], prefix: str = "chg_") -> DataFrame:
    """Append entries under ids that go on from the log's largest number."""
    top = log.agg(F.coalesce(F.max(F.regexp_extract("change_id", r"(\d+)$", 1).try_cast("long")), F.lit(0)).alias("_top")).scalar()
    numbered = number_rows(entries, [F.col(c) for c in order_by], out="_no")
    digits = (F.col("_no") + top).cast("string")  # longer numbers stay whole
    ids = F.concat(F.lit(prefix), F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits))
    return log.unionByName(numbered.withColumn("change_id", ids).drop("_no"), allowMissingColumns=True)


def resume_pending(todo: DataFrame, done: DataFrame, key: str, resolved: Column | None = None) -> DataFrame:
    """What is still to do: rows with no resolved row in the earlier output."""
    finished = done if resolved is None else done.filter(resolved)
    return todo.join(finished.select(key), key, "left_anti")
