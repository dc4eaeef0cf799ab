"""Similarity joins at low thresholds: what meets, what may reach the driver, and tiles against brute force."""

import random
import re

import pytest

from rosterlab.operators import similar
from tests.test_matching import blocks, lev, sim

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def long_names(n, seed, letters=LETTERS, least=55, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)]


def changed(rng, name, edits, letters):
    out = list(name)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i: i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)]])
    return "".join(out)


def test_long_names_meet_only_with_letters_in_common(spark):
    """Before, a pair met at each rare pair of letters it shared: nearly all pairs did, several times each."""
    names = similar.cut_lineage(spark.createDataFrame([(x,) for x in long_names(1200, 5)], "a string"))
    assert similar.candidates(names, None, [], "a", "b", 0.6).count() <= 1e-3 * 1200**2 / 2


@pytest.mark.parametrize("threshold, measure", [(0.6, "edit"), (0.75, "edit"), (0.88, "edit"), (0.7, "blocks")])
def test_keys_of_names_are_never_sent_to_the_driver(spark, threshold, measure):
    """A name makes up to hundreds of keys, so a small table of names says nothing about the size of its keys."""
    mk = lambda seed, c: similar.cut_lineage(spark.createDataFrame([(i % 2, x) for i, x in enumerate(long_names(40, seed, least=10, most=80))], f"blk int, {c} string"))
    for met in (similar.candidates(mk(1, "a"), None, ["blk"], "a", "b", threshold, measure), similar.candidates(mk(1, "a"), mk(2, "b"), ["blk"], "a", "b", threshold, measure)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"Broadcast\w+Join \[[^\]]*_key", plan)


@pytest.mark.parametrize("threshold, measure", [(0.5, "edit"), (0.6, "edit"), (0.7, "blocks")])
def test_tiles_lose_no_pair(spark, monkeypatch, threshold, measure):
    """Names of one to three words of 64 letters, letters beyond 16 bits, many tiles; blocks apart, a null block like nothing."""
    monkeypatch.setattr(similar, "TILE", 8)
    monkeypatch.setattr(similar, "TASK", 200)
    rng = random.Random(int(threshold * 100))
    letters = "abcdé🙂 ñ"
    base = long_names(14, 3, letters, 15, 150)
    a = sorted({changed(rng, x, rng.randint(0, len(x) // 3), letters) for x in base for _ in range(3)})
    b = sorted({changed(rng, x, rng.randint(0, len(x) // 2), letters) for x in base for _ in range(3)} | set(a[::5]))
    score = sim if measure == "edit" else blocks
    mk = lambda xs, c: spark.createDataFrame([(i % 2 if i % 11 else None, x) for i, x in enumerate(xs)], f"blk int, {c} string")
    got = {(r.blk, r.a, r.b) for r in similar.similar_names(mk(a, "a"), mk(b, "b"), ["blk"], "a", "b", threshold, measure).collect()}
    want = {(i % 2, x, y) for i, x in enumerate(a) for j, y in enumerate(b) if i % 11 and j % 11 and i % 2 == j % 2 and score(x, y) >= threshold - 1e-9}
    assert got == want and sum(lev(x, y) > similar.MOST_EDITS for _, x, y in want) > 5
    got = {(r.a, r.b) for r in similar.similar_names(mk(a, "a"), None, [], "a", "b", threshold, measure).collect()}
    assert got == {(x, y) for x in a for y in a if x < y and score(x, y) >= threshold - 1e-9}
