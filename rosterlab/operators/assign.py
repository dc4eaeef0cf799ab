"""One-to-one assignment over scored pairs, best first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..skew import cut_lineage

SMALL = 100_000  # pairs of a group or component that one task takes in order


def components(edges: DataFrame) -> DataFrame:
    """(u, v) longs to (node, root): the least node reachable from each node that has an edge.

    Every round each node's neighbours move to the least of them, first the larger neighbours and then the smaller ones, which halves
    long chains. Nodes reduce to their least neighbour by an aggregate, so a node with very many edges is no large group. Rounds end when the edges no longer change.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    e = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = least(e)
        moved = e.join(lows, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(moved.unionByName(lows.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _taken(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs in order, group by group, to those that are taken. What is held is how much of each node of one group is used."""
    group, used = None, {}
    for batch in batches:
        keep, start_a, start_b, take = [], [], [], []
        names = [batch.column(c).to_pylist() for c in ("_g", "_ka", "_kb", "cap_a", "cap_b")]
        for i, (g, a, b, cap_a, cap_b) in enumerate(zip(*names)):
            if g != group:
                group, used = g, {}
            ua, ub = used.get((0, a), 0), used.get((1, b), 0)
            n = min(cap_a - ua, cap_b - ub)
            if n > 0:
                keep.append(i)
                start_a.append(ua)
                start_b.append(ub)
                take.append(n)
                used[0, a], used[1, b] = ua + n, ub + n
        if keep:
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("a", "b", "score")), *(pa.array(x, pa.int64()) for x in (start_a, start_b, take))], schema=out)


def _in_order(edges: DataFrame, group: DataFrame | str) -> DataFrame:
    """Takes the pairs of each ``group`` in order, as a stream of sorted rows."""
    keyed = edges.withColumn("_g", F.col(group).cast("string")).withColumn("_ka", F.to_json(F.struct("a"))).withColumn("_kb", F.to_json(F.struct("b")))
    rows = keyed.repartition("_g").sortWithinPartitions("_g", F.col("score").desc(), "a", "b")
    kinds = [f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("a", "b", "score")]
    schema = ", ".join([*kinds, "start_a long", "start_b long", "take long"])
    arrow = to_arrow_schema(edges.select("a", "b", "score", *[F.lit(0).cast("long").alias(c) for c in ("start_a", "start_b", "take")]).schema)
    return rows.mapInArrow(lambda it: _taken(it, arrow), schema)


def _by_components(edges: DataFrame, small: int) -> DataFrame:
    """Components of at most ``small`` pairs go in order; of larger ones mutual bests are taken, which breaks them up, and so on."""
    out, rest = None, edges.withColumn("used_a", F.lit(0).cast("long")).withColumn("used_b", F.lit(0).cast("long"))
    while True:
        node = lambda c: F.xxhash64(F.lit(c), c)  # noqa: E731  two nodes of one hash only share a component
        parts = components(rest.select(node("a").alias("u"), node("b").alias("v")))
        rest = cut_lineage(rest.withColumn("node", node("a")).join(parts, "node").drop("node"))
        sizes = rest.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.filter(F.col("_n") > small).select("root")
        fit = rest.join(large, "root", "left_anti")
        left = fit.withColumn("cap_a", F.col("cap_a") - F.col("used_a")).withColumn("cap_b", F.col("cap_b") - F.col("used_b"))
        done = _in_order(left, "root").join(fit.select("a", "b", "used_a", "used_b"), ["a", "b"])
        done = done.select("a", "b", "score", (F.col("start_a") + F.col("used_a")).alias("start_a"), (F.col("start_b") + F.col("used_b")).alias("start_b"), "take")
        out = done if out is None else out.unionByName(done)
        rest = rest.join(large, "root", "left_semi").drop("root")
        if not rest.limit(1).count():
            return out
        order = F.struct((-F.col("score")).alias("s"), "a", "b")
        best_a = rest.groupBy("a").agg(F.min(order).alias("_r")).select("a", F.col("_r.b").alias("b"))
        best_b = rest.groupBy("b").agg(F.min(order).alias("_r")).select("b", F.col("_r.a").alias("a"))
        now = rest.join(best_a, ["a", "b"]).join(best_b, ["a", "b"]).withColumn("take", F.least(F.col("cap_a") - F.col("used_a"), F.col("cap_b") - F.col("used_b")))
        now = cut_lineage(now.select("a", "b", "score", F.col("used_a").alias("start_a"), F.col("used_b").alias("start_b"), "take"))
        out = out.unionByName(now)
        used = lambda c: F.col(f"used_{c}") + F.coalesce(f"_t{c}", F.lit(0))
        rest = cut_lineage(
            rest.join(now.select("a", F.col("take").alias("_ta")), "a", "left").join(now.select("b", F.col("take").alias("_tb")), "b", "left")
            .withColumns({"used_a": used("a"), "used_b": used("b")}).filter("used_a < cap_a and used_b < cap_b").drop("_ta", "_tb")
        )


def greedy_assign(edges: DataFrame, group: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """Best-first assignment over pairs (a, b, score, cap_a, cap_b): highest score first, ties by (a, b).

    Nodes carry capacities; a pair takes as many units as both its ends have left. Returns (a, b, score, start_a, start_b, take): units
    ``start+1 .. start+take`` of both ends. ``group`` names columns of ``edges`` that a pair's ends share, such as their block; pairs of different groups never compete.

    A group of at most ``small`` pairs is taken in order by one task. Larger ones are cut into connected components, and those taken alike; only inside a component
    with more than ``small`` pairs are there rounds, in which pairs that are the best of both their ends are taken at once. The pairs are written once and counted.
    """
    columns = ["a", "b", "score", "cap_a", "cap_b"]
    named = F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.lit(0).alias("_")))
    edges = cut_lineage(edges.withColumn("_group", named).select(*columns, "_group"))
    if edges.count() <= small:
        return _in_order(edges, "_group")
    large = edges.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small).select("_group")
    few = _in_order(edges.join(large, "_group", "left_anti"), "_group")
    many = edges.join(large, "_group", "left_semi").select(*columns)
    return few if not many.limit(1).count() else few.unionByName(_by_components(many, small))
