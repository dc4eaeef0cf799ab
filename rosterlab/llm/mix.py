"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the rate at which its documents are copied. The whole part is certain; the fraction
is rounded so that each document keeps its probability and the words of a source stay what they were. Two documents
meet; words of probability move from one to the other, in a random direction that is right on average, until one of
them is 0 or 1 and decided; the other meets the next. Chunks of a source do this apart, each leaving at most one
document open; these meet in chunks again, level by level, until a source is in one chunk. There the last open document is drawn by its own fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .common import WORD, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
CHUNK = 128  # documents a chunk holds on average
SEED = 20


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) to the same with ``target``: by repeating weights in code-point order, null last.

    The sources share ``share`` of all words; one that would exceed ``most`` times its size stops there, and the excess
    goes to the others by weight until none is above. That is a water level: with sources in the order in which they fill, it is the
    largest of (words left) / (weights left), so one sort replaces the rounds.
    """
    everything = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    filled = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")))
    filled = filled.withColumns({"cap": F.col("source_size") * F.lit(most), "budget": F.sum("source_size").over(everything) * F.lit(share)})
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("budget") - before) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    filled = filled.withColumn("level", level)
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("w"))
    return filled.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _key(x: Column) -> list[Column]:
    return [x["doc_id"], x["th"], x["i"]]


def _meet(state: Column, b: Column, level: int) -> Column:
    """One step of a chunk: the open document of ``state`` meets ``b``; one of them is decided."""
    a = state["open"]
    sa, sb = a["size"].cast("double"), b["size"].cast("double")
    gain = F.least((1 - a["p"]) * sa, b["p"] * sb)  # words a can win from b
    loss = F.least(a["p"] * sa, (1 - b["p"]) * sb)
    up = _uniform(*_key(a), *_key(b), F.lit(level), F.lit(SEED)) * (gain + loss) < loss
    pa = F.when(up, a["p"] + gain / sa).otherwise(a["p"] - loss / sa)
    pb = F.when(up, b["p"] - gain / sb).otherwise(b["p"] + loss / sb)
    a_done = F.when(up, (1 - a["p"]) * sa <= b["p"] * sb).otherwise(a["p"] * sa <= (1 - b["p"]) * sb)
    took = F.when(a_done, up).otherwise(~up)  # the winner reached 1, the loser 0
    done = F.when(a_done, a).otherwise(b).withField("x", took.cast("int"))
    rest = F.when(a_done, b.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), pb)))).otherwise(a.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), pa))))
    return F.struct(rest.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))


def _level(rows: DataFrame, level: int) -> DataFrame:
    """(open, done) per chunk of the open documents ``rows`` of one level of the tree."""
    chunks = F.ceil(F.col("n_docs") / F.lit(float(CHUNK**level)))
    chunk = F.pmod(F.xxhash64("doc_id", "th", "i", F.lit(level), F.lit(SEED + 1)), chunks)
    fields = [c for c in rows.columns if c not in ("source", "n_docs")]
    # the largest first, so that what stays open is small
    held = rows.groupBy("source", "n_docs", chunk.alias("chunk")).agg(F.collect_list(F.struct((-F.col("size")).alias("o"), *fields)).alias("items"))
    items = F.transform(F.sort_array("items"), lambda t: F.struct(*[t[c].alias(c) for c in fields]))
    held = held.select("source", "n_docs", items.alias("items"))
    none = F.slice(F.col("items"), 1, 0)
    state = F.aggregate(F.slice("items", 2, F.size("items")), F.struct(F.get("items", F.lit(0)).alias("open"), none.alias("done")), lambda s, b: _meet(s, b, level))
    return held.select("source", "n_docs", state.alias("state")).select("source", "n_docs", "state.open", "state.done")


def _settle(state: Column) -> Column:
    """The last chunk of a source, all decided: the open document is drawn, and what it takes too much or too little goes to others.

    From the largest down, a decision is turned where that brings the words closer to what they were, so the source ends within about its smaller documents of
    its target.
    """
    last = state["open"]
    drawn = (_uniform(*_key(last), F.lit(SEED + 2)) < last["p"]).cast("int")
    over = (drawn - last["p"]) * last["size"]
    order = F.transform(F.sort_array(F.transform(state["done"], lambda d: F.struct((-d["size"]).alias("o"), d.alias("d")))), lambda t: t["d"])

    def turn(s: Column, d: Column) -> Column:
        change = F.when(d["x"] == 1, -d["size"]).otherwise(d["size"])
        better = F.abs(s["over"] + change) < F.abs(s["over"])
        return F.struct(F.when(better, s["over"] + change).otherwise(s["over"]).alias("over"), F.concat(s["done"], F.array(d.withField("x", F.when(better, 1 - d["x"]).otherwise(d["x"])))).alias("done"))

    start = F.struct(over.cast("double").alias("over"), F.array(last.withField("x", drawn)).alias("done"))
    return F.aggregate(order, start, turn)["done"]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs``.

    size: words of the text, null 0; taken = copies * size. A source's taken words differ from its target by about a small document.
    A source without words has target 0. Repeated rows are numbered and
    drawn each; null ids and sources are values like others, null the last source. Draws are hashes of the row, so reruns agree. An
    empty table gives an empty result.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("th"))
    # repeated rows meet as a count, and get numbers, without a group of them in one task
    counted = sized.groupBy("doc_id", "source", "size", "th").agg(F.count("*").alias("c"))
    rows = cut_lineage(counted.select("doc_id", "source", "size", "th", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("i")))
    aims = cut_lineage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, most))
    longest = aims.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    aims = aims.withColumn("p", F.when(F.col("p") > 1e-12, F.col("p")).otherwise(0.0)).drop("rate").withColumnRenamed("source", "aim")
    rows = rows.join(aims, rows.source.eqNullSafe(aims.aim)).drop("aim").withColumn("x", F.lit(0))
    fields = [c for c in rows.columns if c not in ("source", "n_docs")]
    open_, decided = rows.filter("p > 0 AND size > 0"), [rows.filter("NOT (p > 0 AND size > 0)").select("source", *fields)]
    level = 0
    while longest:
        level += 1
        step = cut_lineage(_level(open_, level))
        final = F.col("n_docs") <= CHUNK**level  # the source is in one chunk: this ends it
        decided.append(step.filter(~final).select("source", F.inline("done")).select("source", *fields))
        decided.append(step.filter(final).select("source", F.inline(_settle(F.struct("open", "done")))).select("source", *fields))
        if CHUNK**level >= longest:
            break
        open_ = step.filter(~final).select("source", "n_docs", "open.*").select(*rows.columns)
    every = decided[0]
    for more in decided[1:]:
        every = every.unionByName(more)
    copies = (F.col("base") + F.col("x")).cast("long")
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_source_mix": op2_source_mix}
ORACLES: dict[str, str] = {}
