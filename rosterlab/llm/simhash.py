"""Near-duplicates by SimHash, with a hierarchical index in Gray order.

The index has its upper nodes on the cluster and its lower ones inside tasks. An upper node is a masked bit pattern: the mask is a choice of segments of
the fingerprint, and every pair within ``max_diff`` bits agrees on at least one mask, so no link is lost. Inside a node the
fingerprints are sorted by Gray rank and eight at a time share a node that keeps the bits they all have; a pair of nodes is
pruned, with all below it, once the shared bits accumulated so far differ in more than ``max_diff`` places.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .common import bytes_of, map_batches, table
from .graph import components

SHINGLE = 4
MAX_DIFF = 4
FANOUT = 8
TILE = 4096  # a larger upper node is worked on in pairs of tiles
GROUP = 1024  # fingerprints wanted in an upper node when masks are chosen
BLOCK = 1 << 18  # pairs looked at together in a task


def simhash(text: bytes | memoryview, shingle: int = SHINGLE) -> int:
    """Bit is 1 if set in over half of the XXH64 (seed 42) of the shingles of lower-cased words, repeats included; as a signed long."""
    from xxhash import xxh64_intdigest

    words = bytes(text).lower().split()  # bytes: A-Z and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), 65536):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[i: i + 65536], ends[i: i + 65536])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp) per row, th a hash of the text; null and empty texts have fingerprint 0."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("d"), "th": batch.column("th"), "fp": [simhash(t, shingle) for t in bytes_of(batch, "t")]}

    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    return map_batches(rows, run, f"doc_id {kind}, th long, fp long")


def masks_for(n: int, max_diff: int = MAX_DIFF) -> list[int]:
    """Masks such that any two fingerprints within ``max_diff`` bits agree on all bits of one of them.

    64 bits are cut into s segments, and a mask is a choice of s - max_diff of them. s grows with ``n`` until an
    upper node of evenly spread fingerprints holds about ``GROUP``.
    """
    if max_diff < 1:
        return [(1 << 64) - 1]
    for s in range(max_diff + 1, max_diff + 5):
        if n / 2 ** (64 * (s - max_diff) // s) <= GROUP:
            break
    cut = [64 * i // s for i in range(s + 1)]
    segments = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(segments, s - max_diff)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each unsigned fingerprint in the reflected Gray sequence, in which neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(fp: np.ndarray, group: np.ndarray) -> list[dict]:
    """From single fingerprints (level 0) up to one node per group: pattern of the shared bits, their mask, first child, children, group."""
    levels = [{"pattern": fp, "shared": np.full(len(fp), ~np.uint64(0)), "group": group}]
    while True:
        low = levels[-1]
        g = low["group"]
        heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        if len(heads) == len(g) and len(levels) > 1:
            return levels
        sizes = np.diff(np.append(heads, len(g)))
        place = np.arange(len(g)) - np.repeat(heads, sizes)
        first = np.flatnonzero(place % FANOUT == 0)
        count = np.diff(np.append(first, len(g)))
        lead = np.repeat(low["pattern"][first], count)
        differ = np.bitwise_or.reduceat(~low["shared"] | (low["pattern"] ^ lead), first)
        levels.append({"pattern": low["pattern"][first], "shared": ~differ, "group": g[first], "first": first, "count": count})


def _expand(level: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All child pairs of node pairs; within one node each pair once, a child with itself included."""
    na, nb = level["count"][a], level["count"][b]
    n = na * nb
    start = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(n.sum()) - start
    nb_, same = np.repeat(nb, n), np.repeat(a == b, n)
    ia, ib = k // nb_, k % nb_
    i, j = np.repeat(level["first"][a], n) + ia, np.repeat(level["first"][b], n) + ib
    keep = ~same | (ia <= ib)
    return i[keep], j[keep]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked positions the least label reachable; labels are positions, and a label's own label is itself."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # shorten paths
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def linked(fp: np.ndarray, group: np.ndarray, max_diff: int = MAX_DIFF) -> np.ndarray:
    """Position of the least member of each position's component, among links inside its group.

    ``fp`` (uint64) must come sorted by group and Gray rank.
    """
    label = np.arange(len(fp))
    if len(fp) < 2:
        return label
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= max_diff))
    _unite(label, near, near + 1)  # neighbours in Gray order first, so that most other pairs need no look
    levels = _levels(fp, group)
    top = np.arange(len(levels[-1]["pattern"]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        if depth == 0:
            _unite(label, a, b)
            continue
        most = max(1, BLOCK // FANOUT**2)
        if len(a) > most:
            stack += [(depth, a[i: i + most], b[i: i + most]) for i in range(0, len(a), most)]
            continue
        low = levels[depth - 1]
        i, j = _expand(levels[depth], a, b)
        if depth == 1:
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
        differ = np.bitwise_count((low["pattern"][i] ^ low["pattern"][j]) & low["shared"][i] & low["shared"][j])
        near = differ <= max_diff
        stack.append((depth - 1, i[near], j[near]))
    return label


def _links_of(batches: Iterator[pa.RecordBatch], max_diff: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, p, ta, tb, fp) sorted by the first four: to a link from each fingerprint to the least of its group-local component."""
    def solve(block: pa.Table) -> pa.RecordBatch:
        fp = block["fp"].to_numpy().view(np.uint64)
        keys = [block[c].to_numpy() for c in ("k", "p", "ta", "tb")]
        new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in keys], axis=0)))
        group = np.cumsum(new)
        order = np.lexsort((gray_rank(fp), group))
        fp = fp[order]
        label = linked(fp, group, max_diff)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < 16 * TILE:  # at least two tiles, so that a group never stays incomplete for ever
            continue
        block = pa.Table.from_batches(held)
        keys = [block[c].to_numpy() for c in ("k", "p", "ta", "tb")]
        last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0))
        if not len(last):
            continue
        cut = int(last[-1]) + 1  # the last group may go on in the next batch
        yield solve(block.slice(0, cut))
        held = block.slice(cut).to_batches()
        rows = block.num_rows - cut
    if rows:
        yield solve(pa.Table.from_batches(held))


def links(fps: DataFrame, max_diff: int = MAX_DIFF, tile: int = TILE) -> DataFrame:
    """Distinct ``fp`` longs to (u, v): links that connect exactly what pairs within ``max_diff`` bits connect.

    An upper node with more than ``tile`` fingerprints is dealt into tiles by hash, and every pair of tiles is a task's
    group of its own: at most two tiles meet, whatever the node holds.
    """
    spark = fps.sparkSession
    n = fps.count()
    masks = [_signed(m) for m in masks_for(n, max_diff)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "p"))
    sizes = keyed.groupBy("k", "p").agg(F.count("*").alias("n")).filter("n > 1")  # alone in its node: no partner
    tiles = sizes.select("k", "p", F.ceil(F.col("n") / tile).cast("int").alias("t"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("t")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda o: F.struct(F.least(mine, o).alias("ta"), F.greatest(mine, o).alias("tb")))
    dealt = keyed.join(tiles, ["k", "p"]).select("k", "p", "fp", F.inline(pairs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "k", "p", "ta", "tb").sortWithinPartitions("k", "p", "ta", "tb")
    return dealt.mapInArrow(lambda it: _links_of(it, max_diff), "u long, v long")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, max_diff: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) per row and (fp, root) per fingerprint."""
    fp = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    nodes = cut_lineage(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp"), max_diff))
    return fp, nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_diff: int = MAX_DIFF) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: component_id is the smallest doc_id reachable over links.

    Rows with equal fingerprints are one node of the graph, so a group of copies is never a set of pairs. Null, empty
    and blank texts share fingerprint 0. Repeated rows come out once each; a null doc_id gets the component's smallest
    non-null id, or null where there is none. An empty table gives an empty result.
    """
    fp, rooted = _grouped(docs, doc_id, text, shingle, max_diff)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fp.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_diff: int = MAX_DIFF) -> DataFrame:
    """The rows of ``docs``, all columns, with one document left of each near-duplicate group: the smallest doc_id.

    A group without any id keeps the row with the least text hash; of rows that repeat the kept id and text one stays.
    """
    fp, rooted = _grouped(docs, doc_id, text, shingle, max_diff)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    # a fingerprint reduces to its least row before it meets its group, so copies never crowd a join
    least = fp.groupBy("fp").agg(F.min(order).alias("o"))
    best = least.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.doc_id").alias("kd"), F.col("o.th").alias("kt"))
    rows = docs.select(F.struct("*").alias("r"), F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"))
    kept = rows.join(best, rows.d.eqNullSafe(best.kd) & (rows.th == best.kt), "left_semi")
    once = kept.withColumn("n", F.row_number().over(W.partitionBy("d", "th").orderBy("d"))).filter("n = 1")
    return once.select("r.*")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_groups": op8_simhash_groups}
ORACLES: dict[str, str] = {}
