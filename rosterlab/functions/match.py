"""Similarity and membership expressions for already paired rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longer.cast("double")), F.lit(0.0))


def _letters(x: Column) -> Column:
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bag(x: Column) -> Column:
    """The letters with their number of earlier occurrences, so that the intersection of two bags has the letters in common, repeats included."""
    return _bound(F.array_sort(_letters(x)), lambda s: F.transform(s, lambda c, i: F.concat(c, (i + 1 - F.array_position(s, c)).cast("string"))))


def _longest_block(a: Column, b: Column, r: Column) -> Column:
    """(k, -i, -j) of the longest common stretch of a[r.alo:r.ahi] and b[r.blo:r.bhi]: the first in a, then in b, of the longest; k is 0 if there is none.

    Along a, ``run`` holds for each place of b how many letters up to it equal those up to here; the best of a row is taken when the next one comes.
    """
    def better(s: Column, last: Column) -> Column:
        ends = F.transform(s["run"], lambda k, j: F.struct(k.alias("k"), (k - last - 1).alias("i"), (k - j - 1 - r["blo"]).alias("j")))
        return F.greatest(s["best"], F.array_max(ends))

    def along(s: Column, i: Column) -> Column:
        run = F.transform(F.slice(b, r["blo"] + 1, r["bhi"] - r["blo"]), lambda c, j: F.when(c == F.get(a, i), F.coalesce(F.get(s["run"], j - 1), F.lit(0)) + 1).otherwise(F.lit(0)))
        return F.struct(run.alias("run"), better(s, i - 1).alias("best"))

    nothing = F.struct(F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    start = F.struct(F.array_repeat(F.lit(0), r["bhi"] - r["blo"]).alias("run"), nothing.alias("best"))
    return F.aggregate(F.sequence(r["alo"], r["ahi"] - 1), start, along, lambda s: better(s, r["ahi"] - 1))


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the letters in matching blocks over all letters; 1 when both are empty.

    The longest common stretch is a block, the first one if there are several; what stands to its left and to its right is searched alike. No letter is left
    out for being frequent.
    """
    def split(x: Column, s: Column) -> Column:
        r = F.element_at(s["todo"], -1)

        def cut(f: Column) -> Column:
            i, j, rest = -f["i"], -f["j"], F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1)
            sides = F.array(
                F.struct(r["alo"].alias("alo"), i.alias("ahi"), r["blo"].alias("blo"), j.alias("bhi")),
                F.struct((i + f["k"]).alias("alo"), r["ahi"].alias("ahi"), (j + f["k"]).alias("blo"), r["bhi"].alias("bhi")),
            )
            more = F.when(f["k"] > 0, F.concat(rest, F.filter(sides, lambda q: (q["ahi"] > q["alo"]) & (q["bhi"] > q["blo"])))).otherwise(rest)
            return F.struct(more.alias("todo"), (s["same"] + f["k"]).alias("same"))

        return F.when(F.size(s["todo"]) == 0, s).otherwise(_bound(_longest_block(x["a"], x["b"], r), cut))

    n, m = F.length(a), F.length(b)
    whole = F.struct(F.lit(0).alias("alo"), n.alias("ahi"), F.lit(0).alias("blo"), m.alias("bhi"))
    start = F.struct(F.array(whole).alias("todo"), F.lit(0).alias("same"))
    steps = F.sequence(F.lit(1), 2 * F.least(n, m) + 1)  # each block leaves two sides at most
    same = _bound(F.struct(_letters(a).alias("a"), _letters(b).alias("b")), lambda x: F.aggregate(steps, start, lambda s, _: split(x, s), lambda s: s["same"]))
    return F.when(n + m == 0, 1.0).when(F.least(n, m) == 0, 0.0).otherwise(2.0 * same / (n + m))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set; inputs are token arrays."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    return F.try_divide(F.size(F.array_intersect(sa, sb)).cast("double"), F.least(F.size(sa), F.size(sb)).cast("double"))


def alias_match(value: Column, name: Column, aliases: Column | None = None) -> Column:
    """The value is the name or one of its aliases; false when the value is missing."""
    hit = value == name
    if aliases is not None:
        hit = hit | F.coalesce(F.array_contains(aliases, value), F.lit(False))
    return F.coalesce(hit, F.lit(False))


def rule_score(rules: Sequence[tuple[Column, int, str]]) -> Column:
    """Sum of the points of every rule that holds."""
    total = F.lit(0)
    for hit, points, _ in rules:
        total = total + F.when(hit, points).otherwise(0)
    return total


def rule_reasons(rules: Sequence[tuple[Column, int, str]], sep: str = "|") -> Column:
    """Names of the rules that hold, in rule order (``array_join`` leaves NULLs out)."""
    return F.array_join(F.array(*[F.when(hit, name) for hit, _, name in rules]), sep)
