"""Building blocks that stay balanced when one key holds a large share of the rows.

Everything here either reduces on the map side before it shuffles, or spreads a group over many
tasks and puts the parts together from a small per-part summary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .session import cut_lineage

PART_BYTES = 128 << 20  # of a range, as the plan estimates it
UNPACKED = 8  # times the bytes of a table that its rows may take
UNKNOWN_BYTES = 1 << 60


def cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key: the smallest under ``order_by``. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*cols(order_by))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key: the largest under ``order_by`` (an index built by overwriting)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*cols(order_by))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """At most ``n`` rows per key. The filter on row_number lets Spark trim each task's groups first."""
    w = W.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def range_parts(df: DataFrame, rows: int = 1) -> int:
    """Partitions for a range partitioning: the session's number, or more where the tables read ask for it. ``rows``: how many each row makes, where the plan cannot know.

    The plan's own estimate multiplies the sizes of what it joins, so it is taken only up to ``UNPACKED`` times the size of the tables below it.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda node: int(str(node.stats().sizeInBytes()))
    leaves, read = plan.collectLeaves().iterator(), 0
    while leaves.hasNext():
        read += size(leaves.next())
    expected = rows * min(size(plan), UNPACKED * read)
    wanted = -(-expected // PART_BYTES) if read < UNKNOWN_BYTES else 0  # a table without statistics claims to be endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def in_ranges(df: DataFrame, order_by: Sequence[Column], parts: int | None = None) -> DataFrame:
    """The rows in order as a written table: ``_pid`` numbers its ranges, ``_pos`` the rows inside each. The one place where rows get a total order."""
    return cut_lineage(
        df.repartitionByRange(parts or range_parts(df), *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )


def group_median(df: DataFrame, keys: Sequence[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Exact median per key, however many rows or values one key holds.

    (key, value) counts are put in ranges of (key, value), so that a large group lies in many of them. The sums of the ranges tell in which one or two
    the middle of each group stands, and only these are counted along. The counts are written once.
    """
    counted = df.groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_v").isNotNull())
    ranged = in_ranges(counted, [*cols(keys), F.col("_v")], parts).drop("_pos")
    group = W.partitionBy(*keys)
    sums = ranged.groupBy(*keys, "_pid").agg(F.sum("_n").alias("_s"))  # a row per group and range
    sums = sums.withColumns({"_t": F.sum("_s").over(group), "_before": F.sum("_s").over(group.orderBy("_pid").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")})
    sums = sums.withColumns({"_lo": F.floor((F.col("_t") + 1) / 2), "_hi": F.floor(F.col("_t") / 2) + 1})
    inside = lambda place: (F.col("_before") < F.col(place)) & (F.col(place) <= F.col("_before") + F.col("_s"))
    middle = sums.filter(inside("_lo") | inside("_hi")).select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate([*keys, "_pid"])], "_before", "_lo", "_hi")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate([*keys, "_pid"])])
    met = ranged.join(middle, same)
    along = met.withColumn("_c", F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    at = lambda place: F.min(F.when(F.col("_c") >= F.col(place), F.col("_v"))).cast("double")
    return along.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(out))


def number_rows(df: DataFrame, order_by: Sequence[Column], start: int | Column = 1, out: str = "row_no") -> DataFrame:
    """Consecutive numbers in a total order without a one-task window.

    Each range adds the number of rows before it. Only one count per range meets in the offset window.
    """
    pinned = in_ranges(df, order_by)
    offsets = (
        pinned.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("_pid", "_before")
    )
    first = F.lit(start) if isinstance(start, int) else start
    # one row per range, so the broadcast is bounded by their number
    return (
        pinned.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_before") + F.col("_pos") + first).cast("long"))
        .drop("_pid", "_pos", "_before")
    )


def carry_down(df: DataFrame, file: str, pos: str, values: Sequence[str], parts: int | None = None) -> DataFrame:
    """Fill each value with the last non-null one above it in the file; ``pos`` rises down the file.

    The rows are put in ranges of (file, position) and written, so the input is computed once and a file may be arbitrarily long. The fill
    works inside a range; what a file carries across is one row per range, and at most one file goes on from a range into the next.
    """
    ranged = in_ranges(df, [F.col(file), F.col(pos)], parts).drop("_pos")
    inside = W.partitionBy(file, "_pid").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(file).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    ends = ranged.groupBy(file, "_pid").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(pos))).alias(f"_end_{v}") for v in values])
    enter = ends.select(file, "_pid", *[F.last(f"_end_{v}", ignorenulls=True).over(across).alias(f"_in_{v}") for v in values])
    # a file enters a range from another only as its first one: at most one row per range, which bounds the broadcast
    enter = enter.filter(reduce(lambda a, b: a | b, [F.col(f"_in_{v}").isNotNull() for v in values]))
    filled = ranged.withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in values})
    filled = filled.join(F.broadcast(enter), [file, "_pid"], "left")
    return filled.withColumns({v: F.coalesce(v, f"_in_{v}") for v in values}).drop("_pid", *[f"_in_{v}" for v in values])


def explode_dim(dim: DataFrame, copies: int, salt: str = "_salt") -> DataFrame:
    return dim.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def salted_left_join(df: DataFrame, dim: DataFrame, on: str, copies: int) -> DataFrame:
    """Left join that spreads each key of ``df`` over ``copies`` tasks; for a hot key whose other
    side is too large to broadcast and where the adaptive skew split cannot apply."""
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(copies)).cast("int"))
    return spread.join(explode_dim(dim, copies), [on, "_salt"], "left").drop("_salt")
