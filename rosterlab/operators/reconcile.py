"""Two rosters against each other, and stat rows linked to a roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import concat_key, token_key
from ..skew import cut_lineage
from .assign import greedy_assign
from .diff import numbered_sides
from .similar import similar_names


def reconcile(ours: DataFrame, theirs: DataFrame, block: str, key: str, our_id: str, their_id: str, date: str | None = None,
              threshold: float = 0.88, date_score: float = 0.95, measure: str = "edit") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, cut, new): 1:1 inside each block.

    Passes, best score first: equal key; similarity over ``date_score``; equal date; similarity
    from ``threshold`` up to ``date_score``. Ties go by the two keys, copies of a key and pairs of equal date by id, which needs numbering
    and no pair list. ``measure`` is that of ``similar_names``. The order by score differs from a scan in file order:
    there an early row may take a partner that fits a later row better.
    """
    ours, theirs = ours.select(block, key, our_id, *([date] if date else [])), theirs.select(block, key, their_id, *([date] if date else []))
    on, tn = numbered_sides(ours, theirs, [block, key], our_id, their_id)
    found = on.join(tn, [block, key, "copy_no"]).select(block, our_id, their_id, F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    found = cut_lineage(found)

    def rest(o: DataFrame, t: DataFrame):
        return o.join(found.select(our_id), our_id, "left_anti"), t.join(found.select(their_id), their_id, "left_anti")

    # names left after the exact pass meet once; later passes only narrow this list
    o, t = rest(ours, theirs)
    near = cut_lineage(similar_names(o.withColumnRenamed(key, "a"), t.withColumnRenamed(key, "b"), [block], "a", "b", threshold, measure))

    def fuzzy(found: DataFrame, which: Column, on: DataFrame, tn: DataFrame) -> DataFrame:
        """``on`` and ``tn`` are numbered by copies; a distinct name of a block is one node, and its copies are the node's units."""
        def units(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
            df = df.withColumnRenamed(key, c)
            return df, df.groupBy(block, c).agg(F.min("copy_no").alias(f"from_{c}"), F.count(F.lit(1)).alias(f"cap_{c}"))

        (o, our_caps), (t, their_caps) = units(on, "a"), units(tn, "b")
        node = lambda c: F.struct(F.col(block).alias("block"), F.col(c).alias("key"), F.col(f"from_{c}").alias("first"))
        edges = near.filter(which).join(our_caps, [block, "a"]).join(their_caps, [block, "b"])
        edges = edges.withColumn("_block", F.col(block)).withColumns({"a": node("a"), "b": node("b")})
        taken = greedy_assign(edges.select("a", "b", "score", "cap_a", "cap_b", "_block"), ["_block"]).select("*", F.explode(F.sequence(F.lit(0), F.col("take") - 1)).alias("_u"))
        number = lambda c: (F.col(f"{c}.first") + F.col(f"start_{c}") + F.col("_u")).alias(f"_n{c}")
        taken = taken.select(F.col("a.block").alias(block), F.col("a.key").alias("a"), F.col("b.key").alias("b"), "score", number("a"), number("b"))
        more = taken.join(o.withColumnRenamed("copy_no", "_na"), [block, "a", "_na"]).join(t.withColumnRenamed("copy_no", "_nb"), [block, "b", "_nb"])
        more = more.select(block, our_id, their_id, F.lit("fuzzy").alias("method"), "score")
        return cut_lineage(found.unionByName(more))

    # the exact pass took the first copies of each name, so those left are still numbered without gaps
    if date:
        found = fuzzy(found, F.col("score") > date_score, *rest(on, tn))
        dated = [d.filter(F.col(date).isNotNull()).withColumn(date, F.col(date).cast("string")) for d in rest(ours, theirs)]
        od, td = numbered_sides(*dated, [block, date], our_id, their_id)
        same_day = od.join(td, [block, date, "copy_no"]).select(block, our_id, their_id, F.lit("date").alias("method"), F.lit(date_score).alias("score"))
        found = cut_lineage(found.unionByName(same_day))
        found = fuzzy(found, F.col("score") <= date_score, *numbered_sides(*rest(ours, theirs), [block, key], our_id, their_id))
    else:
        found = fuzzy(found, F.lit(True), *rest(on, tn))
    cut, new = rest(ours, theirs)
    return found, cut, new


def link_by_keys(rows: DataFrame, roster: DataFrame, block: str, name: str, roster_name: str, roster_id: str, order: str,
                 threshold: float = 0.80) -> DataFrame:
    """Each row with the roster id it links to in its block, how, and the score; unlinked rows stay.

    Equal token or squeezed key first (the earliest roster row by ``order``), then the most similar
    name at or over the threshold. Roster names reduce to one row each before any join, and only
    the distinct names left over reach the similarity join.
    """
    keys = lambda c: {"_tk": token_key(F.col(c)), "_ck": concat_key(F.col(c))}
    both = lambda df: df.withColumn("_e", F.explode(F.array(
        F.struct(F.lit("token").alias("_kind"), F.col("_tk").alias("_key")), F.struct(F.lit("squeezed").alias("_kind"), F.col("_ck").alias("_key"))
    ))).select("*", "_e.*").drop("_e")
    keyed = rows.withColumns(keys(name))
    wanted = both(keyed.select(block, "_tk", "_ck").distinct())
    first = F.min(F.struct(F.col(order).alias("o"), F.col(roster_id).alias("i"))).alias("_f")
    have = both(roster.withColumns(keys(roster_name)).groupBy(block, "_tk", "_ck").agg(first)).groupBy(block, "_kind", "_key").agg(F.min("_f").alias("_f"))

    found = wanted.join(have, [block, "_kind", "_key"], "left").groupBy(block, "_tk", "_ck").agg(F.min("_f").alias("_exact"))
    left_over = both(found.filter("_exact is null").select(block, "_tk", "_ck"))
    pairs = similar_names(left_over.withColumnRenamed("_key", "a"), have.withColumnRenamed("_key", "b"), [block, "_kind"], "a", "b", threshold)
    best = (
        left_over.join(pairs.withColumnRenamed("a", "_key"), [block, "_kind", "_key"]).drop("_key")
        .join(have.withColumnRenamed("_key", "b"), [block, "_kind", "b"])
        .groupBy(block, "_tk", "_ck").agg(F.min(F.struct((-F.col("score")).alias("s"), "_f")).alias("_best"))
    )
    out = keyed.join(found.join(best, [block, "_tk", "_ck"], "left"), [block, "_tk", "_ck"], "left")
    linked = F.coalesce("_exact", "_best._f")
    return out.select(
        *rows.columns, linked["i"].alias(roster_id),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_best").isNotNull(), "fuzzy").otherwise("unmatched").alias("link_method"),
        F.when(F.col("_exact").isNotNull(), 1.0).otherwise(-F.col("_best.s")).alias("link_score"),
    )
