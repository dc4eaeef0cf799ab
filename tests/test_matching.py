"""Similarity joins and assignments against brute force on small fixtures."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rosterlab.functions.match import bag, block_ratio
from rosterlab.operators import assign, reconcile, similar


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def sim(a, b):
    return 1 - lev(a, b) / max(len(a), len(b)) if a or b else 0.0


def typo(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        i, op = rng.randrange(len(s)) if s else 0, rng.random()
        if op < 0.4 and s:
            s[i] = rng.choice("abcde ")
        elif op < 0.7 and s:
            del s[i]
        else:
            s.insert(i, rng.choice("abcde "))
    return "".join(s)


def words(rng, n):
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 16))) for _ in range(n)]
    return sorted({typo(rng, rng.choice(base)) for _ in range(n * 4)} - {""})


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.88])
def test_similar_names_loses_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 100))
    a, b = words(rng, 40), words(rng, 40)
    mk = lambda xs, c: spark.createDataFrame([(i % 2, x) for i, x in enumerate(xs)], f"blk int, {c} string")
    got = {(r.blk, r.a, r.b) for r in similar.similar_names(mk(a, "a"), mk(b, "b"), ["blk"], "a", "b", threshold).collect()}
    want = {(i % 2, x, y) for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2 and sim(x, y) >= threshold - 1e-9}
    assert got == want
    self_got = {(r.a, r.b) for r in similar.similar_names(mk(a, "a").select("a"), None, [], "a", "b", threshold).collect()}
    assert self_got == {(x, y) for x in a for y in a if x < y and sim(x, y) >= threshold - 1e-9}


def test_null_and_empty_names_are_like_nothing(spark):
    names = spark.createDataFrame([(None,), ("",), ("abcdef",), ("abcdeg",), ("",), (None,)], "a string")
    assert [(r.a, r.b) for r in similar.similar_names(names, None, [], "a", "b", 0.8).collect()] == [("abcdef", "abcdeg")]
    assert similar.duplicate_names(names, "a", ["fc"]).count() == 0
    ours = spark.createDataFrame([(1, "N", None), (2, "N", "jon smith")], "our_id long, blk string, nm string")
    theirs = spark.createDataFrame([(11, "N", "jon smyth"), (12, "N", None), (13, None, "x")], "their_id long, blk string, nm string")
    m, cut, new = reconcile.reconcile(ours, theirs, "blk", "nm", "our_id", "their_id")
    assert [(r.our_id, r.their_id) for r in m.collect()] == [(2, 11)]
    assert {r.our_id for r in cut.collect()} == {1} and {r.their_id for r in new.collect()} == {12, 13}


def long_words(rng, n):
    """Names of 20 to 70 letters, some with many edits, some that share only their ends."""
    base = [" ".join("".join(rng.choice("abcdei") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 13))) for _ in range(n)]
    out = set(base)
    for x in base:
        y = list(x)
        for _ in range(rng.randint(1, 30)):
            i = rng.randrange(len(y))
            if rng.random() < 0.5:
                y[i] = rng.choice("abcdei xyz")
            elif rng.random() < 0.5:
                del y[i]
            else:
                y.insert(i, rng.choice("abcdei xyz"))
        out.add("".join(y))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.88])
def test_long_names_lose_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 1000))
    a, b = long_words(rng, 45), long_words(rng, 20)
    b += a[::3]
    mk = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.a, r.b) for r in similar.similar_names(mk(a, "a"), None, [], "a", "b", threshold).collect()}
    assert got == {(x, y) for x in a for y in a if x < y and sim(x, y) >= threshold - 1e-9} and len(got) > 5
    got = {(r.a, r.b) for r in similar.similar_names(mk(a, "a"), mk(b, "b"), [], "a", "b", threshold).collect()}
    assert got == {(x, y) for x in a for y in set(b) if sim(x, y) >= threshold - 1e-9} and len(got) > 15


def blocks(x, y):
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


@pytest.mark.parametrize("threshold", [0.6, 0.88])
def test_block_ratio_join_loses_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 10))
    a = words(rng, 30) + long_words(rng, 15)
    got = {(r.a, r.b): r.score for r in similar.similar_names(spark.createDataFrame([(x,) for x in a], "a string"), None, [], "a", "b", threshold, "blocks").collect()}
    want = {(x, y): blocks(x, y) for x in a for y in a if x < y and blocks(x, y) >= threshold - 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 10


def test_block_ratio_equals_the_library(spark):
    rng = random.Random(11)
    pairs = [("", ""), ("a", ""), ("", "b"), ("same", "same"), ("qabxcd", "abycdf"), ("née 🙂x", "nee 🙂x"), ("ab" * 40, "ba" * 40)]
    while len(pairs) < 5000:
        x = "".join(rng.choice("abcde é") for _ in range(rng.randint(0, 18)))
        pairs.append((x, typo(rng, x) if rng.random() < 0.6 else "".join(rng.choice("abcde é") for _ in range(rng.randint(0, 18)))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", block_ratio(F.col("a"), F.col("b")).alias("r"), F.size(F.array_intersect(bag(F.col("a")), bag(F.col("b")))).alias("n")).collect():
        assert abs(r.r - blocks(r.a, r.b)) < 1e-12
        assert r.n == sum((Counter(r.a) & Counter(r.b)).values())
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(block_ratio(F.col("a"), F.col("b")).alias("r")).first().r is None


def random_names(spark, n):
    rng = random.Random(n)
    names = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(12, 20))) for _ in range(n)}
    return similar.cut_lineage(spark.createDataFrame([(x,) for x in names], "a string"))


@pytest.mark.parametrize("threshold, share", [(0.88, 1e-6), (0.75, 3e-4)])
def test_pairs_that_meet_do_not_grow_with_the_square(spark, threshold, share):
    met = [similar.candidates(random_names(spark, n), None, [], "a", "b", threshold).count() for n in (5000, 10_000, 20_000)]
    for n, small, large in zip((5000, 10_000), met, met[1:]):
        assert large <= 2.7 * max(small, n / 100), met
    assert met[-1] <= share * 20_000**2 / 2


def test_few_pairs_meet_at_a_low_threshold(spark):
    """At 0.6 random names of 12 to 20 letters may differ in half their letters; a fiftieth of all pairs meets."""
    n = 10_000
    assert similar.candidates(random_names(spark, n), None, [], "a", "b", 0.6).count() <= 0.025 * n * n / 2


def test_pairs_with_ids_counts_and_labels(spark):
    rows = spark.createDataFrame([("ab fc", 3, "T2"), ("ab fc", 1, "T1"), ("ab fc", 2, "T1"), ("abc fc", 9, None)], "n string, id int, team string")
    got = similar.describe_pairs(similar.duplicate_names(rows, "n", ["fc"]), rows, "n", "id", "team").collect()
    assert [(r.id_a, r.count_a, r.labels_a, r.id_b, r.count_b, r.labels_b) for r in got] == [(1, 3, "T1:2; T2:1", 9, 1, "")]


def test_contained_names(spark):
    names = ["al ahli", "al ahli jeddah", "ahli al", "real madrid", "madrid", "fc", "fc porto", "porto b fc"]
    got = {(r.a, r.b) for r in similar.contained_names(spark.createDataFrame([(n,) for n in names], "a string"), "a", "b", 6).collect()}
    toks = {n: set(n.split()) for n in names}
    want = {(x, y) for x in names for y in names if x < y and min(len(x), len(y)) >= 6 and (toks[x] <= toks[y] or toks[y] <= toks[x])}
    assert got == want


def test_greedy_assign_is_best_first(spark):
    rng = random.Random(3)
    edges = {(f"a{rng.randrange(12)}", f"b{rng.randrange(12)}"): rng.random() for _ in range(70)}
    df = spark.createDataFrame([(a, b, s, 1, 1) for (a, b), s in edges.items()], "a string, b string, score double, cap_a long, cap_b long")
    got = {(r.a, r.b) for r in assign.greedy_assign(df).collect()}
    want, used = set(), set()
    for (a, b), _ in sorted(edges.items(), key=lambda e: -e[1]):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    assert got == want


def test_greedy_assign_with_capacities(spark):
    df = spark.createDataFrame([("a", "x", 0.9, 5, 3), ("a", "y", 0.8, 5, 4), ("b", "y", 0.7, 2, 4)], "a string, b string, score double, cap_a long, cap_b long")
    got = {(r.a, r.b): (r.start_a, r.start_b, r.take) for r in assign.greedy_assign(df).collect()}
    assert got == {("a", "x"): (0, 0, 3), ("a", "y"): (3, 0, 2), ("b", "y"): (0, 2, 2)}


def rosters(spark):
    ours = [(1, "N", "jon smith", "1990-01-01"), (2, "N", "jon smith", None), (3, "N", "ali khan", "1991-02-02"), (4, "N", "maria garcia lopez", "1992-03-03"),
            (5, "S", "jon smith", None), (6, "N", "zed", "1980-01-01"), (7, "N", "zed two", "1980-01-01"), (8, "N", "alone", None)]
    theirs = [(11, "N", "jon smith", None), (12, "N", "jon smyth", None), (13, "N", "khan ali", "1991-02-02"), (14, "N", "maria garcia lopes", None),
              (15, "N", "completely other", "1980-01-01"), (16, "N", "nobody", "1980-01-01"), (17, "S", "ann lee", None)]
    schema = "{} long, blk string, nm string, dob string"
    return spark.createDataFrame(ours, schema.format("our_id")), spark.createDataFrame(theirs, schema.format("their_id"))


def test_reconcile_partitions_and_rules(spark):
    ours, theirs = rosters(spark)
    m, cut, new = reconcile.reconcile(ours, theirs, "blk", "nm", "our_id", "their_id", "dob")
    pairs = {(r.our_id, r.their_id): r.method for r in m.collect()}
    assert pairs[(1, 11)] == "exact" and pairs[(2, 12)] == "fuzzy" and pairs[(3, 13)] == "date" and pairs[(4, 14)] == "fuzzy"
    assert pairs[(6, 15)] == "date" and pairs[(7, 16)] == "date"
    assert {r.our_id for r in cut.collect()} == {5, 8} and {r.their_id for r in new.collect()} == {17}
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def test_reconcile_hot_copies(spark):
    ours = spark.range(300).select(F.col("id").alias("our_id"), F.lit("N").alias("blk"), F.when(F.col("id") < 200, "anna maria").otherwise("bo li").alias("nm"))
    theirs = spark.range(250).select(F.col("id").alias("their_id"), F.lit("N").alias("blk"), F.when(F.col("id") < 150, "anna marja").otherwise("bo li").alias("nm"))
    m, cut, new = reconcile.reconcile(ours, theirs, "blk", "nm", "our_id", "their_id")
    by = {r.method: r["count"] for r in m.groupBy("method").count().collect()}
    assert by == {"exact": 100, "fuzzy": 150} and cut.count() == 50 and new.count() == 0
    assert m.select("our_id").distinct().count() == 250 == m.select("their_id").distinct().count()


def test_link_by_keys(spark):
    rows = spark.createDataFrame([("N", "KHAN Ali"), ("N", "Müller-Lüd Jo"), ("N", "Jon Smyth"), ("N", "Who Else")], "blk string, nm string")
    ros = spark.createDataFrame([("N", "Ali Khan", "p1", 1), ("N", "Ali Khan", "p0", 2), ("N", "Jo Muller Lud", "p2", 3), ("N", "John Smyth", "p3", 4)], "blk string, rn string, pid string, o int")
    got = {r.nm: (r.pid, r.link_method) for r in reconcile.link_by_keys(rows, ros, "blk", "nm", "rn", "pid", "o").collect()}
    assert got == {"KHAN Ali": ("p1", "exact"), "Müller-Lüd Jo": ("p2", "exact"), "Jon Smyth": ("p3", "fuzzy"), "Who Else": (None, "unmatched")}


def test_variants_of_names_are_worked_out_once(spark):
    from rosterlab.functions import text

    expr = text.query_variants(F.col("id").cast("string"))._jc.toString()
    assert expr.count("football club|soccer club") == 1  # the pattern that strips legal forms stood there once per use of its result
    rows = spark.createDataFrame([("  Ça  F.C. ",), ("\ufb01n \u00bd \ud55c\uae00 \u00df",), (None,)], "n string")
    got = [r.v for r in rows.select(text.query_variants(F.col("n")).alias("v")).collect()]
    assert got[0] == ["Ça F.C", "Ça F.C. football club", "Ça F.C. soccer club", "Ça", "Ça football club", "Ca F.C", "Ca F.C. football club", "Ca F.C. soccer club"]
    assert got[2] == []
    plain = [r.v for r in rows.select(text.strip_marks(F.col("n")).alias("v")).collect()]
    assert plain[1] == "fin 1\u20442 \u1112\u1161\u11ab\u1100\u1173\u11af \u00df"


def test_similar_titles_agree_with_the_sql_beyond_ascii(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    titles = ["Iech\u00e4.", "Rech.", "\u00dcber alle", "\u00dcber alles", "Uber alles", "\u00e9\u00e9\u00e9\u00e9", "\u00e8\u00e9\u00e9\u00e9", "", "plain title", "plain titles"]
    rows = [(i, f"http://h/{i}", f"<html><title>{x}</title>") for i, x in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(oracle_sql()["similar_titles"]).fetchall()
    assert len(want) > 3
    assert sorted(map(tuple, queries()["similar_titles"](spark, str(tmp_path)).collect())) == sorted(want)
