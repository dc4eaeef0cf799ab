"""Ranked search, spelling variants and the additive quality model, each against a plain version or held-out labels."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from .cases import empty_frame, odd_frame, odd_rows, prose

SF = "/root/testdata/sf0.001"


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_ranks(docs, queries, k):
    """docs [(id, text)], queries [(id, text)] to a Counter of (item, rank, doc, score)."""
    held = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in set(queries):
        terms = {t for t in TERM.findall(lowered(text)) if df[t]}
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scores = []
        for d, c in held:
            m = 100 - 90 + ((90 * sum(c.values()) * n_docs) // n_terms)
            scores.append((-sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t]), d is None, d))
        best = sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] if s[2] is not None else 0))[:k]
        out.update((item, i + 1, s[2], -s[0]) for i, s in enumerate(best))
    return out


@pytest.mark.parametrize("shard, block", [(8_000_000, 1 << 20), (600, 50)])
def test_ranks_match_brute_force(spark, shard, block):
    from rosterlab.llm.ranked_search import search_all

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    rows = [tuple(r) for r in docs.collect()]
    items = [tuple(r) for r in queries.collect()]
    for k in (10, 3):
        got = search_all(docs, queries, k=k, shard_chars=shard, block_postings=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == plain_ranks(rows, items, k)


def test_search_bears_odd_rows(spark):
    from rosterlab.llm.ranked_search import search_all

    docs = odd_frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = [(1, "one TWO née 中文字符 word"), (2, None), (3, ""), (4, " \n"), (5, "nothing0here1x"), (6, "b\na"), (None, "one"), (1, "one"), (6, "b\na")]
    queries = spark.createDataFrame([(*x, 7, "q") for x in items], "item_id int, text string, score int, doc_id string")
    want = plain_ranks(rows, [x for x in items if x[1]], 10)
    assert Counter(tuple(r) for r in search_all(docs, queries).collect()) == want and any(x[0] is None for x in want)
    assert search_all(empty_frame(spark), queries).count() == 0
    assert search_all(docs, queries.filter("item_id > 99")).count() == 0


def test_no_accumulators_for_hopeless_documents(spark):
    """Common terms only update: documents that hold nothing else get no accumulator, and the rows are right all the same."""
    from rosterlab.llm.ranked_search import Best, Block

    rng = random.Random(5)
    rows = [(i, {0: 1} | ({1: 3, 2: 2} if i % 97 == 0 else {}) | {3 + rng.randrange(40): 1}) for i in range(2000)]
    count = np.array([len(c) for _, c in rows])
    term = np.array([t for _, c in rows for t in sorted(c)], np.int32)
    tf = np.array([c[t] for _, c in rows for t in sorted(c)], np.int32)
    weight = np.array([1, 4000, 4100] + [1500] * 40, np.int64)
    block = Block([i for i, _ in rows], [50] * 2000, count, term, tf, weight, 2000, 100_000)
    made = []
    real = np.flatnonzero
    best = Best(10)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(np, "flatnonzero", lambda a: made.append(real(a)) or made[-1])
        block.search(np.array([2, 1, 0], np.int64), best)
    assert len(made[0]) == len([i for i in range(2000) if i % 97 == 0])
    assert [d for _, d in best.rows] == [97 * i for i in range(10)]


# spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows, modulus, least=5):
    counts = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = lowered(run)
            h = crc32(f"{d}:{run}".encode()) if modulus and d is not None else 1
            if modulus and d is not None and h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def plain_forms(words):
    near = defaultdict(list)
    kept = sorted(words)
    for i, a in enumerate(kept):
        for b in kept[:i]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in kept:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w in kept}


def spelled(rows):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def misspelt(rng):
    """Rows of text whose words are misspelt at falling rates, so that forms chain."""
    bank = ["".join(rng.choices("abcdeéñ", k=rng.randint(6, 9))) for _ in range(60)]
    texts = []
    for w in bank:
        level = [w] * 900
        v = w
        for n in (150, 28, 5):
            i = rng.randrange(len(v))
            v = rng.choice([v[:i] + v[i + 1:], v[:i] + "z" + v[i:], v[:i] + "ÿ" + v[i + 1:]])
            level += [v] * n
        rng.shuffle(level)
        texts += [" ".join(level[i: i + 40]) for i in range(0, len(level), 40)]
    return texts


@pytest.mark.parametrize("bits, blocks", [(16, 1 << 19), (2, 2)])
def test_forms_match_brute_force(spark, bits, blocks):
    from rosterlab.llm.spelling import spelling_groups

    rng = random.Random(bits)
    rows = list(enumerate(misspelt(rng))) + [(None, "Zwölfter " * 9), (7, "a" * 300 + " " + "a" * 301)] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_forms(plain_words(rows, 199))
    got = spelling_groups(df, modulus=199, bits_per_word=bits, pass_blocks=blocks).collect()
    assert len(got) == len(want) and spelled(got) == want
    assert sum(1 for r in got if r["form"] is not None and r["form"] != r["root"]) > 20 and any(r["word"] == "a" * 301 and r["n_near"] == 1 for r in got)


def test_spelling_bears_odd_rows(spark):
    from rosterlab.llm.spelling import spelling_groups

    rows = [(r[0], r[1]) for r in odd_rows()]
    for modulus in (None, 3):
        got = spelling_groups(odd_frame(spark), modulus=modulus).collect()
        assert spelled(got) == plain_forms(plain_words(rows, modulus)) and len(got) > 50
    assert spelling_groups(empty_frame(spark)).count() == 0


def test_pieces_lose_no_word(spark, monkeypatch):
    from rosterlab.llm import spelling

    text = prose(random.Random(2), 4000) + " naïve 中文 Straße" * 20
    want = Counter(w for w in (lowered(x) for x in RUN.findall(text)) if len(w.encode()) >= 6)
    monkeypatch.setattr(spelling, "PIECE", 37)
    assert Counter(w.decode() for runs in spelling.runs_of(text.encode()) for w in runs) == want


def test_classes_of_length_agree(spark):
    from rosterlab.llm.spelling import _class_of, length_class

    for r in spark.range(1, 5000).union(spark.createDataFrame([(2**k + d,) for k in range(6, 28) for d in (-1, 0, 1)], "id long")).select("id", length_class(F.col("id")).alias("c")).collect():
        assert r["c"] == _class_of(r["id"])


# quality

def test_held_out_quality(spark):
    from rosterlab.llm.quality_gam import op11_quality_gam

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op11_quality_gam(spark, sf).collect()
    assert len({r["doc_id"] for r in got}) == len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 40 and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(p == 1 for p, y in held if y == 1)


def test_tables_learn_single_measures_and_pairs():
    from rosterlab.llm.quality_gam import Model, PAIRS

    rng = np.random.default_rng(1)
    x = rng.random((4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) & ((x[:, 1] > 0.5) != (x[:, 2] > 0.5))).astype(float)  # an exclusive or: neither measure tells alone
    whole, single = Model(x, y), Model(x, y, pairs=0)
    fresh = rng.random((2000, 5)).astype(np.float32)
    truth = (fresh[:, 0] > 0.3) & ((fresh[:, 1] > 0.5) != (fresh[:, 2] > 0.5))
    right = lambda m: ((m(fresh) > 0.5) == truth).mean()
    assert (1, 2) in whole.pairs and len(whole.pairs) <= PAIRS
    assert right(whole) > 0.95 > 0.8 > right(single)
    # a sum of looked-up entries and nothing else
    f = whole.start + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(whole.tables, whole.edges, fresh[0]))
    f += sum(t[np.searchsorted(whole.grid[i], fresh[0, i], "right"), np.searchsorted(whole.grid[j], fresh[0, j], "right")] for (i, j), t in zip(whole.pairs, whole.pair_tables))
    assert abs(1 / (1 + np.exp(-f)) - whole(fresh[:1])[0]) < 1e-12


def test_measures_do_not_depend_on_pieces(monkeypatch):
    from rosterlab.llm import quality_gam

    for text in [prose(random.Random(4), 3000), "", "a", "née\n中文 x!! \n\n y" * 50, "z" * 5000]:
        whole = quality_gam.measures(text.encode())
        with monkeypatch.context() as patch:
            patch.setattr(quality_gam, "PIECE", 64)
            assert np.allclose(quality_gam.measures(text.encode()), whole, atol=2e-3)
        assert len(whole) == len(quality_gam.MEASURES) and np.isfinite(whole).all()


def test_quality_bears_odd_rows(spark):
    from rosterlab.llm.quality_gam import classify

    docs = odd_frame(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(14)] + [(3, 0, "y"), (None, 1, "z"), (4, None, "z")], "doc_id long, quality int, text string")
    got = classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["r"]["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    for none in (labels.filter("quality is null"), labels.filter("doc_id > 99"), labels.filter("quality = 1")):
        assert len({r["score"] for r in classify(docs, none).collect()}) == 1
    assert classify(empty_frame(spark), labels).count() == 0


def test_the_sample_is_bounded_and_copies_teach_once(spark):
    from rosterlab.llm import quality_gam

    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 2 else "Bad. " * (40 + i)) for i in range(300)] + [(1000, "Bad. " * 30)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    taught = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality_gam, "Model", lambda x, y: taught.append(len(y)))
        quality_gam.fit(docs, labels)
        quality_gam.fit(docs, labels, sample=40)
    assert taught[0] == 301 and 10 < taught[1] <= 40
