"""Similarity joins that lose no pair.

Distinct names join, not rows. How many edits d a pair may need follows from its two lengths, and two kinds of join keys find all such pairs.

*Pieces*, for up to ``MOST_EDITS`` edits: the shorter name is cut into d+k pieces; d edits leave k of them unchanged, each near its place. A key is the text of k such pieces
at known places. More pieces in a key make it rarer and its places more, so k is chosen from the number of names and how often two of their letters are equal:
as names grow in number, keys get longer, and the pairs that meet do not grow with their square.

*Grams*, beyond: d edits leave at least one of the d*q+1 globally rarest q-letter stretches of each name in both of them, so only these are keys. Pairs that share several
meet as hashes and are made distinct before their names join them.

*Tiles*, instead of grams where the threshold leaves stretches of at most three letters, which nearly all names share: the names of a block are dealt into tiles, and every pair of
tiles is a group. Inside it each name is held against all others of a fit length at once, by the letters they have in common in order, 64 of them in a machine word. Nothing
but the names is shuffled, and only pairs with enough letters in common come out.

Pairs that meet are checked by edit distance, stopped at its bound.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.match import bag, block_ratio, similarity, token_overlap
from ..functions.text import tokens
from ..skew import cut_lineage, top_per_key

MOST_EDITS = 8  # up to here pieces are keys
MOST_TOGETHER = {1: 8, 2: 8, 3: 6}  # k to the most edits for which k pieces are worth their places
PAIR_COST = 4.0  # of a pair that meets, in keys
DENSE = {"edit": 0.75, "blocks": 0.875}  # up to this threshold the stretches of a pair with many edits have at most three letters
TILE, MOST_TILE, TILES = 8192, 65536, 32  # words of 64 letters in a tile: least and most, between which a block has so many tiles of names of one size
SLICES = 4  # of a tile, each of which meets the other tiles on its own
TOGETHER, ROOM = 8192, 1 << 23  # names that one is held against at once, and words that tell where their letters stand
TASK = 1 << 24  # pairs of words in a task


@lru_cache
def placements(d: int, k: int) -> list[tuple[int, list[int], list[int]]]:
    """(letters more, pieces, shifts): which k of d+k pieces to look for, and how far from their places, in a name with that many more letters.

    Among d+k pieces with d edits there are k unchanged ones such that before, between and after them stand no more edits than pieces: the places
    where the edits so far, less the pieces so far, first reach -1, -2, ... -k. Edits bound the shift of what follows them.
    """
    out = []

    def go(more: int, first: int, shift: int, pieces: list[int], shifts: list[int]) -> None:
        if len(pieces) == k:
            if abs(more - shift) <= d + k - first:
                out.append((more, pieces, shifts))
            return
        for i in range(first, d + k):
            for x in range(shift - (i - first), shift + (i - first) + 1):
                go(more, i + 1, x, pieces + [i], shifts + [x])

    for more in range(d + 1):
        go(more, 0, 0, [], [])
    return out


class Bound:
    """Most edits between names of two lengths; ``longest``: the length up to which a longer partner may go."""

    def __init__(self, threshold: float, measure: str):
        self.threshold, self.measure = threshold, measure

    def edits(self, shorter: Column, longer: Column) -> Column:
        t, e = self.threshold, F.lit(1e-9)
        # blocks: a ratio of t means that t * (n + m) letters of both stay, and the others are taken out or put in
        most = longer * F.lit(1 - t) if self.measure == "edit" else (shorter + longer) * F.lit(1 - t)
        return F.floor(most + e).cast("int")

    def most(self, longest: int) -> int:
        """Edits between two names of this length, which no shorter ones exceed."""
        return floor((1 - self.threshold) * longest * (1 if self.measure == "edit" else 2) + 1e-9)

    def longest(self, n: Column) -> Column:
        t = self.threshold
        return F.floor(n / F.lit(t if self.measure == "edit" else t / (2 - t)) + F.lit(1e-9)).cast("int")

    def shortest(self, m: Column) -> Column:
        t = self.threshold
        return F.greatest(F.lit(1), F.ceil(m * F.lit(t if self.measure == "edit" else t / (2 - t)) - F.lit(1e-9)).cast("int"))


    def common(self, n: np.ndarray, m: int) -> np.ndarray:
        """Letters that names of these lengths must have in common, in order, to be similar; more than they have where they cannot be, or where few enough edits part them for pieces."""
        t, shorter, longer = self.threshold, np.minimum(n, m), np.maximum(n, m)
        if self.measure == "edit":
            edits = np.floor(longer * (1 - t) + 1e-9)
            least = longer - edits
        else:
            edits = np.floor((shorter + longer) * (1 - t) + 1e-9)
            least = np.ceil((t - 1e-9) * (shorter + longer) / 2 - 1e-9)
        return np.where((edits > MOST_EDITS) & (least <= shorter), least, shorter + 1).astype(np.int64)


class Joiner:
    """The join keys for names whose number, longest length and letter collisions are known; the same on both sides."""

    def __init__(self, spark, bound: Bound, names: int, longest: int, collision: float):
        self.bound, self.names, self.longest, self.collision = bound, names, longest, collision
        self.places = self._places(spark, min(MOST_EDITS, bound.most(longest)))

    def together(self, n: Column, d: Column) -> Column:
        """How many pieces to put in a key: the least of keys plus pairs that are expected to meet."""
        costs = []
        for k, most in MOST_TOGETHER.items():
            keys = F.get(F.array(*[F.lit(float(len(placements(i, k)))) for i in range(most + 1)]), d)
            met = F.lit(float(self.names)) * F.pow(F.lit(self.collision), n * k / (d + k))
            costs.append(F.struct((keys * (1 + PAIR_COST * met)).alias("cost"), F.lit(k).alias("k")))
        return F.array_min(F.filter(F.array(*costs), lambda c: c["cost"].isNotNull()))["k"]

    @staticmethod
    def _places(spark, edits: int) -> DataFrame:
        """(d, k, more, i1, x1, i2, x2, i3, x3): pieces and shifts of all placements, NULL beyond k; a fixed table, whatever the names are."""
        rows = []
        for k, most in MOST_TOGETHER.items():
            for d in range(min(most, edits) + 1):
                for more, pieces, shifts in placements(d, k):
                    rows.append((d, k, more, *[v for r in range(3) for v in ((pieces[r], shifts[r]) if r < k else (None, None))]))
        names = ["_d", "_k", "_more", *[f"_{c}{r}" for r in (1, 2, 3) for c in "ix"]]
        return F.broadcast(spark.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in zip(names, zip(*rows))})))

    @staticmethod
    def _key(text: str, shifted: bool) -> Column:
        """Of the pieces at their places: nearly equal pieces of ``_n`` letters, of which the later ones take the rest."""
        n, count = F.col("_n"), F.col("_d") + F.col("_k")
        size = F.floor(n / count).cast("int")
        short = count - n % count
        pieces = []
        for r in (1, 2, 3):
            i = F.col(f"_i{r}")
            start = i * size + F.greatest(F.lit(0), i - short) + (F.col(f"_x{r}") if shifted else 0)
            pieces.append(F.substring(F.col(text), start + 1, size + (i >= short).cast("int")))
        return F.xxhash64("_n", "_d", "_i1", "_i2", "_i3", F.concat_ws("", *pieces))

    def indexed(self, names: DataFrame, text: str) -> DataFrame:
        """A key per choice of pieces of each name as the shorter one, for every number of edits a longer partner may bring."""
        n = F.length(text)
        longer = F.sequence(n, F.least(self.bound.longest(n), F.lit(self.longest)))
        d = F.explode(F.array_distinct(F.transform(longer, lambda m: self.bound.edits(n, m))))
        df = names.withColumn("_n", n).withColumn("_d", d).filter(F.col("_d") <= MOST_EDITS).withColumn("_k", self.together(F.col("_n"), F.col("_d")))
        some = self.places.select("_d", "_k", "_i1", "_i2", "_i3").distinct()
        return df.join(F.broadcast(some), ["_d", "_k"]).withColumn("_key", self._key(text, False)).drop("_d", "_k", "_i1", "_i2", "_i3")

    def probing(self, names: DataFrame, text: str) -> DataFrame:
        """A key per place of each name, as the longer one, at which the pieces of a shorter one may stand."""
        df = names.withColumn("_m", F.length(text))
        df = df.withColumn("_n", F.explode(F.sequence(F.least(self.bound.shortest(F.col("_m")), F.col("_m")), F.col("_m"))))
        df = df.withColumn("_d", self.bound.edits(F.col("_n"), F.col("_m"))).filter(F.col("_d") <= MOST_EDITS)
        df = df.withColumn("_k", self.together(F.col("_n"), F.col("_d"))).withColumn("_more", F.col("_m") - F.col("_n"))
        df = df.join(self.places, ["_d", "_k", "_more"]).withColumn("_key", self._key(text, True))
        return df.drop("_n", "_d", "_k", "_more", *[f"_{c}{r}" for c in "ix" for r in (1, 2, 3)])

    def grams(self, names: DataFrame, text: str, as_longer: bool) -> DataFrame:
        """(.., _q, _g): the stretches of q letters of each name, for every q that a pair with more than ``MOST_EDITS`` edits may ask for, and ``_rare``: how many of the rarest are keys."""
        n = F.length(text)
        if as_longer:
            partners = F.transform(F.sequence(F.least(self.bound.shortest(n), n), n), lambda s: F.struct(s.alias("s"), n.alias("m")))
        else:
            partners = F.transform(F.sequence(n, F.greatest(n, F.least(self.bound.longest(n), F.lit(self.longest)))), lambda m: F.struct(n.alias("s"), m.alias("m")))
        q = lambda d, m: F.greatest(F.lit(1), F.floor(m / (d + 1)).cast("int"))  # noqa: E731  the longest stretches of which one stays
        asked = F.transform(partners, lambda p: F.struct(q(self.bound.edits(p["s"], p["m"]), p["m"]).alias("q"), self.bound.edits(p["s"], p["m"]).alias("d"), p["m"].alias("m")))
        asked = F.filter(asked, lambda a: a["d"] > MOST_EDITS)
        df = names.withColumn("_asked", asked).filter(F.size("_asked") > 0).withColumn("_q", F.explode(F.array_distinct(F.transform("_asked", lambda a: a["q"]))))
        own = F.filter("_asked", lambda a: a["q"] == F.col("_q"))
        # of a name's stretches all but those of the fewest that stay can be lost, and one more is a key
        stay = F.array_min(F.transform(own, lambda a: F.greatest(F.lit(1), a["m"] - F.col("_q") + 1 - F.col("_q") * a["d"])))
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - F.col("_q") + 1)), lambda i: F.xxhash64("_q", F.substring(F.col(text), i, F.col("_q"))))
        return df.withColumn("_rare", F.size(every) - stay + 1).withColumn("_grams", every).drop("_asked")

    @staticmethod
    def rarest(df: DataFrame, counts: DataFrame, block: Sequence[str], text: str, name: str) -> DataFrame:
        """(block, _key, ``name``): the keys of ``grams``, with a hash of the name for the name and its length."""
        each = df.select(*block, F.xxhash64(text).alias("h"), F.length(text).alias("n"), "_q", "_rare", F.explode("_grams").alias("_g")).join(counts, "_g")
        ranked = each.groupBy(*block, "h", "n", "_q", "_rare").agg(F.sort_array(F.collect_list(F.struct("_c", "_g"))).alias("_all"))  # the letters of one name
        keys = F.array_distinct(F.transform(F.slice("_all", F.lit(1), F.greatest(F.lit(1), F.col("_rare"))), lambda x: x["_g"]))
        return ranked.select(*block, F.struct("n", "h").alias(name), F.explode(keys).alias("_key"))


def _letters(names: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)


def in_common(names: list[str], others: list[str], bound: Bound, one: bool) -> Iterator[tuple[np.ndarray, int]]:
    """(names, other): which ``names`` have as many letters in common, in order, with one of ``others`` as ``bound`` asks for. Names stand in order of length, then text; ``one``: only those before the other.

    A bit for each letter of a name is 0 once the letter belongs to the longest common sequence with the other name so far; a sum carries it on, all letters and names at once.
    """
    width, alphabet = -(-len(names[-1]) // 64), np.unique(_letters(names))
    step = max(1, min(TOGETHER, ROOM // (len(alphabet) * width)))
    coded = []
    for other in others:
        own = _letters([other])
        at = np.minimum(np.searchsorted(alphabet, own), len(alphabet) - 1)
        coded.append(at[alphabet[at] == own].tolist())  # other letters are in no name
    for first in range(0, len(names), step):
        some = names[first: first + step]
        n = np.array([len(x) for x in some])
        who, place = np.repeat(np.arange(len(some)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        held = np.zeros((len(alphabet), width, len(some)), np.uint64)
        cell = (np.searchsorted(alphabet, _letters(some)) * width + place // 64) * len(some) + who
        np.bitwise_or.at(held.reshape(-1), cell, np.uint64(1) << (place % 64).astype(np.uint64))
        fit: dict[int, tuple[int, int, np.ndarray]] = {}
        for i, (other, letters) in enumerate(zip(others, coded)):
            m = len(other)
            if m not in fit:
                least = bound.common(n, m)
                good = np.flatnonzero(least <= np.minimum(n, m))
                fit[m] = (int(good[0]), int(good[-1]) + 1, least) if len(good) else (0, 0, least)
            a, b, least = fit[m]
            if one:
                b = min(b, bisect_left(some, (m, other), key=lambda x: (len(x), x)))
            if a < b:
                hits = np.flatnonzero(_longest(held, letters, a, b) >= least[a:b])
                if len(hits):
                    yield first + a + hits, i


def _longest(held: np.ndarray, letters: list[int], a: int, b: int) -> np.ndarray:
    """Length of the longest common sequence of ``letters`` and each of the names a to b."""
    width = held.shape[1]
    left, met, moved = np.full((width, b - a), ~np.uint64(0)), np.empty(b - a, np.uint64), np.empty(b - a, np.uint64)
    both, add, less, either = np.bitwise_and, np.add, np.subtract, np.bitwise_or
    if width == 1:
        rows, v = list(held[:, 0, a:b]), left[0]
        for c in letters:
            both(v, rows[c], met)
            add(v, met, moved)
            less(v, met, v)
            either(v, moved, v)
    else:
        for c in letters:
            carry = None
            for v, row in zip(left, held[c, :, a:b]):
                both(v, row, met)
                add(v, met, moved)
                over = moved < v
                if carry is not None:
                    add(moved, carry, moved)
                    over |= moved < carry
                less(v, met, v)
                either(v, moved, v)
                carry = over.astype(np.uint64)
    return 64 * width - np.bitwise_count(left).sum(0, dtype=np.int64)


def tiled(names: DataFrame, block: Sequence[str], a: str, b: str, j: Joiner, one: bool) -> DataFrame:
    """(block, a, b): pairs of ``names`` (block, _t, _side) with more than ``MOST_EDITS`` edits that may be similar; of the two sides, or with ``one`` each unordered pair once.

    Names are dealt by hash, those of up to 64, 128, ... letters apart; the shorter kind of a group waits, and a slice of a tile of the other is held against it.
    """
    bound, schema = j.bound, StructType([*(names.schema[c] for c in block), StructField(a, StringType()), StructField(b, StringType())])
    arrow = to_arrow_schema(schema)
    n = F.length("_t")
    names = names.dropna(subset=[*block, "_t"]).filter(bound.edits(n, F.greatest(n, F.least(bound.longest(n), F.lit(j.longest)))) > MOST_EDITS).withColumn("_w", F.ceil(n / 64).cast("int"))
    size = F.least(F.lit(MOST_TILE), F.greatest(F.lit(TILE), F.ceil(F.col("_n") * F.col("_w") / TILES)))
    sizes = cut_lineage(names.groupBy(*block, "_side", "_w").agg(F.count(F.lit(1)).alias("_n")).withColumn("_tiles", F.ceil(F.col("_n") * F.col("_w") / size).cast("int")))
    wait, come = (sizes.select(*block, *[F.col(c).alias(c + s) for c in ("_side", "_w", "_n", "_tiles")]) for s in "pq")
    sides = F.lit(True) if one else (F.col("_sidep") != F.col("_sideq")) & ((F.col("_wp") < F.col("_wq")) | (F.col("_sidep") == 0))
    near = (F.col("_wp") <= F.col("_wq")) & (64 * (F.col("_wq") - 1) + 1 <= bound.longest(64 * F.col("_wp")))
    pairs = (wait.join(come, list(block)) if block else wait.crossJoin(come)).filter(sides & near).withColumn("_slices", F.col("_tilesq") * SLICES)
    words = F.col("_np") * F.col("_wp") * F.col("_nq") * F.col("_wq")
    groups, work = pairs.agg(F.coalesce(F.sum(F.col("_tilesp") * F.col("_slices")), F.lit(0)), F.coalesce(F.sum(words.cast("double")), F.lit(0.0))).first()
    key = [*block, "_sidep", "_wp", "_wq", "_u", "_c"]
    # with one side, two tiles meet once, and a tile meets itself, where each name takes only those before it
    place = F.col("_c") % F.col("_tilesp") - F.col("_u")
    once, own = ((place >= 0) | (F.col("_wp") < F.col("_wq")), (place == 0) & (F.col("_wp") == F.col("_wq"))) if one else (F.lit(True), F.lit(False))
    h, up_to = F.xxhash64("_t"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def dealt(s: str, u: Column, c: Column) -> DataFrame:
        some = names.withColumnsRenamed({"_side": f"_side{s}", "_w": f"_w{s}"}).join(pairs, [*block, f"_side{s}", f"_w{s}"])
        return some.withColumn("_u", u).withColumn("_c", c).filter(once).select(*key, "_t", F.lit(s == "p").alias("_waits"), own.alias("_own"))

    every = dealt("p", F.pmod(h, F.col("_tilesp")), up_to("_slices")).unionByName(dealt("q", up_to("_tilesp"), F.pmod(h, F.col("_slices"))))

    def meet(table: pa.Table) -> pa.Table:
        texts = table.column("_t").combine_chunks()
        read = [x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]
        waits = table.column("_waits").to_pylist()
        order = sorted(range(len(read)), key=lambda i: (len(read[i]), read[i]))
        held, other = [i for i in order if waits[i]], [i for i in order if not waits[i]]
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if held and other:
            place, row = np.array(held), np.array(other)
            for found, i in in_common([read[i] for i in held], [read[i] for i in other], bound, table.column("_own")[0].as_py()):
                x.append(place[found])
                y.append(np.full(len(found), row[i]))
        x, y = np.concatenate(x), np.concatenate(y)
        if table.column("_sidep")[0].as_py():
            x, y = y, x
        return pa.Table.from_arrays([*(table.column(c).take(pa.array(np.zeros(len(x), np.int64))) for c in block), texts.take(pa.array(x)), texts.take(pa.array(y))], names=[*block, a, b]).cast(arrow)

    tasks = max(1, min(int(groups), -(-int(work) // TASK), 10_000))
    return every.repartition(tasks, *key).groupBy(*key).applyInArrow(meet, schema)


def joiner(names: DataFrame, text: str, bound: Bound, blocks: Sequence[str] = ()) -> Joiner:
    """Learns what the keys depend on: how many names a block holds on average, the longest length, the chance that two letters are equal."""
    block = F.to_json(F.struct(*blocks)) if blocks else F.lit("")
    letters = names.select(block.alias("_b"), F.posexplode(F.split(text, "")).alias("_at", "_c")).groupBy("_c").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("_at") == 0).alias("names"), F.max("_at").alias("last"), F.hll_sketch_agg("_b").alias("blocks"))
    n = F.sum("n")
    total, longest, parts, equal = letters.agg(F.sum("names"), F.max("last") + 1, F.hll_sketch_estimate(F.hll_union_agg("blocks")), F.sum(F.col("n") * F.col("n")) / (n * n)).first()
    return Joiner(names.sparkSession, bound, max(1, (total or 0) // max(1, parts or 1)), longest or 1, min(1.0, equal or 1.0))


def candidates(left: DataFrame, right: DataFrame | None, block: Sequence[str], a: str, b: str, threshold: float, measure: str = "edit") -> DataFrame:
    """(block, a, b): the pairs that meet on a key, some more than once; a superset of the similar ones.

    ``left`` (block, a) and ``right`` (block, b) are distinct non-empty names, best as written tables; ``right`` None joins ``left`` with itself, each unordered pair in either order but once.
    """
    one = right is None
    every = left.select(*block, F.col(a).alias("_t")) if one else left.select(*block, F.col(a).alias("_t")).unionByName(right.select(*block, F.col(b).alias("_t")))
    j = joiner(every, "_t", Bound(threshold, measure), block)
    other = left.withColumnRenamed(a, b) if one else right
    shorter, equal = F.length(a) < F.length(b), F.length(a) == F.length(b)

    def by_pieces(short: DataFrame, s: str, long: DataFrame, t: str, also: Column) -> DataFrame:
        # a name makes many keys, which no size check of its table knows of: neither side is to reach the driver
        return j.indexed(short, s).join(j.probing(long, t).hint("merge"), [*block, "_key"]).filter(also & (F.col("_n") <= F.col("_m"))).select(*block, a, b)

    out = by_pieces(left, a, other, b, shorter | (equal & (F.col(a) < F.col(b))) if one else shorter | equal)
    if not one:
        out = out.unionByName(by_pieces(other, b, left, a, F.length(b) < F.length(a)))
    if j.bound.most(j.longest) <= MOST_EDITS:  # no name is long enough for more
        return out
    if threshold <= DENSE[measure]:
        names = left.select(*block, F.col(a).alias("_t"), F.lit(0).alias("_side"))
        names = names if one else names.unionByName(right.select(*block, F.col(b).alias("_t"), F.lit(1).alias("_side")))
        return out.unionByName(tiled(names, block, a, b, j, one))
    long = {s: [j.grams(df, s, as_longer) for as_longer in (True, False)] for df, s in ([(left, a)] if one else [(left, a), (other, b)])}
    flat = None
    for frames in long.values():
        for df in frames:
            part = df.select(F.explode("_grams").alias("_g"))
            flat = part if flat is None else flat.unionByName(part)
    counts = flat.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))

    def by_grams(short: DataFrame, s: str, long: DataFrame, t: str, key: str, frames: tuple, also: Column) -> DataFrame:
        """Pairs share many keys and meet at each, so they meet as hashes, once each after ``distinct``, and only then get their names."""
        near = j.rarest(frames[0], counts, block, key, "_s")
        far = j.rarest(frames[1], counts, block, key, "_t")
        n, m = F.col("_s.n"), F.col("_t.n")
        met = near.join(far.hint("merge"), [*block, "_key"]).filter(also & (n >= j.bound.shortest(m)) & (j.bound.edits(n, m) > MOST_EDITS)).select(*block, F.col("_s.h").alias("_sh"), F.col("_t.h").alias("_th")).distinct()
        met = met.join(short.withColumn("_sh", F.xxhash64(s)), [*block, "_sh"]).join(long.withColumn("_th", F.xxhash64(t)), [*block, "_th"])
        return met.filter(F.col(s) != F.col(t)).select(*block, a, b) if one else met.select(*block, a, b)

    n, m, h, g = (F.col(c) for c in ("_s.n", "_t.n", "_s.h", "_t.h"))
    (x_long, x_short), *more = long.values()
    if one:
        return out.unionByName(by_grams(left, a, other, b, a, (x_short, x_long), (n < m) | ((n == m) & (h <= g))))
    (y_long, y_short), = more
    aligned = lambda df: df.withColumnRenamed(b, a)  # noqa: E731  both sides' keys come from a column of one name
    out = out.unionByName(by_grams(left, a, other, b, a, (x_short, aligned(y_long)), n <= m))
    return out.unionByName(by_grams(other, b, left, a, a, (aligned(y_short), x_long), n < m))


def similar_names(left: DataFrame, right: DataFrame | None, block: Sequence[str], a: str, b: str, threshold: float, measure: str = "edit") -> DataFrame:
    """(block, a, b, score) of distinct names with a score of at least ``threshold`` (0.5 or more, 0.6 for blocks).

    ``measure``: "edit" for 1 - edits / longer length, "blocks" for the matching-block ratio. ``right=None`` joins ``left`` (holding ``a``) with itself and gives each unordered
    pair once. NULL and empty names are like nothing and are left out. The distinct names are written once, and counted, before the join is built.
    """
    if threshold < (0.5 if measure == "edit" else 0.6):
        raise ValueError("the join needs a threshold of at least 0.5, or 0.6 for blocks")
    one = right is None
    some = lambda df, c, side: df.select(*block, F.col(c).alias("_t"), F.lit(side).alias("_side")).filter(F.length(c) > 0)
    every = cut_lineage((some(left, a, 0) if one else some(left, a, 0).unionByName(some(right, b, 1))).distinct())
    own = lambda side, c: every.filter(F.col("_side") == side).select(*block, F.col("_t").alias(c))
    met = candidates(own(0, a), None if one else own(1, b), block, a, b, threshold, measure)
    least, most = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    within = F.call_function("levenshtein", F.col(a), F.col(b), Bound(threshold, measure).edits(least, most)) >= 0  # -1 beyond the bound
    met = met.filter(within)
    if one:
        met = met.select(*block, F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    if measure == "edit":
        return met.distinct().withColumn("score", similarity(F.col(a), F.col(b))).filter(F.col("score") >= threshold - 1e-9)
    # letters in common are the most that blocks can hold: few pairs reach the search for blocks
    shared = F.size(F.array_intersect(bag(F.col(a)), bag(F.col(b)))) * 2 >= (threshold - 1e-9) * (F.length(a) + F.length(b))
    return met.distinct().filter(shared).withColumn("score", block_ratio(F.col(a), F.col(b))).filter(F.col("score") >= threshold - 1e-9)


def contained_names(names: DataFrame, a: str, b: str, min_length: int) -> DataFrame:
    """(a, b): all tokens of ``a`` occur in ``b``, ``a`` has fewer or equal tokens, each pair once.

    The rarest token of ``a`` is the only join key it needs.
    """
    d = names.select(F.col(a).alias("_n")).distinct().withColumn("_t", F.array_distinct(tokens(F.col("_n"))))
    each = d.select("_n", "_t", F.explode("_t").alias("tok"))
    freq = each.groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    rarest = each.join(freq, "tok").groupBy("_n", "_t").agg(F.min_by("tok", F.struct("f", "tok")).alias("tok"))
    small = rarest.filter(F.length("_n") >= min_length).select(F.col("_n").alias("_s"), F.col("_t").alias("_ts"), "tok")
    large = each.filter(F.length("_n") >= min_length).select(F.col("_n").alias("_l"), F.col("_t").alias("_tl"), "tok")
    met = small.join(large, "tok").filter(
        (F.col("_s") != F.col("_l")) & (F.size(F.array_except("_ts", "_tl")) == 0)
        & ((F.size("_ts") < F.size("_tl")) | (F.col("_s") < F.col("_l")))
    )
    return met.select(F.least("_s", "_l").alias(a), F.greatest("_s", "_l").alias(b)).distinct()


def duplicate_names(names: DataFrame, name: str, risk_tokens: Sequence[str], high: float = 0.88, overlap: float = 0.45,
                    low: float = 0.75, min_length: int = 6, measure: str = "edit") -> DataFrame:
    """Review pairs of distinct normalized names with at least one token in common, similar by the ``measure`` of ``similar_names``.

    Included when similar and overlapping; when one name's tokens contain the other's and both are
    long enough; or when less similar but sharing a high-risk token. Copies of a name are counted
    by ``name_copies`` and not paired with each other.
    """
    n = names.select(F.col(name).alias("name_a")).distinct()
    risky = n.filter(F.arrays_overlap(tokens(F.col("name_a")), F.array(*[F.lit(t) for t in risk_tokens])))
    pairs = (
        similar_names(n, None, [], "name_a", "name_b", high, measure).select("name_a", "name_b")
        .unionByName(contained_names(n, "name_a", "name_b", min_length))
        .unionByName(similar_names(risky, None, [], "name_a", "name_b", low, measure).select("name_a", "name_b"))
        .distinct()
    )
    ta, tb = tokens(F.col("name_a")), tokens(F.col("name_b"))
    out = pairs.withColumn("similarity", (similarity if measure == "edit" else block_ratio)(F.col("name_a"), F.col("name_b"))).withColumn("overlap", token_overlap(ta, tb))
    shorter = F.least(F.length("name_a"), F.length("name_b"))
    common_risk = F.size(F.array_intersect(F.array_intersect(ta, tb), F.array(*[F.lit(t) for t in risk_tokens]))) > 0
    reasons = F.array(
        F.when((F.col("similarity") >= high - 1e-9) & (F.col("overlap") >= overlap), "high string similarity"),
        F.when((F.col("overlap") == 1) & (shorter >= min_length), "one name is token subset of the other"),
        F.when((F.col("similarity") >= low - 1e-9) & common_risk, "shared high-risk token"),
    )
    out = out.withColumn("candidate_reason", F.array_join(reasons, "; "))
    return out.filter((F.col("overlap") > 0) & (F.col("candidate_reason") != ""))


def describe_pairs(pairs: DataFrame, rows: DataFrame, name: str, key: str, label: str, labels: int = 8) -> DataFrame:
    """``pairs`` (name_a, name_b, ...) with each name's smallest id, number of rows, and ``labels`` most frequent labels as ``label:count``, ties by label.

    Names and labels reduce to one row per (name, label) before anything is listed, so a name that many rows hold is no large group.
    """
    each = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name"), F.col(label).alias("_label")).agg(F.min(key).alias("_id"), F.count(F.lit(1)).alias("_n"))
    first = top_per_key(each.filter(F.col("_label").isNotNull()), ["_name"], [F.desc("_n"), F.asc("_label")], labels, "_r")
    item = F.concat_ws(":", F.col("_label").cast("string"), F.col("_n").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("_r", item.alias("s"))))  # at most ``labels`` of a name
    listed = first.groupBy("_name").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "; ").alias("_labels"))
    about = each.groupBy("_name").agg(F.min("_id").alias("_id"), F.sum("_n").alias("_n")).join(listed, "_name", "left")
    out = pairs
    for side in ("a", "b"):
        own = about.select(F.col("_name").alias(f"name_{side}"), F.col("_id").alias(f"id_{side}"), F.col("_n").alias(f"count_{side}"), F.coalesce("_labels", F.lit("")).alias(f"labels_{side}"))
        out = out.join(own, f"name_{side}", "left")
    return out


def name_copies(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names held by more than one row: copies and the smallest key."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")).filter("copies > 1")
