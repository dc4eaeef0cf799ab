"""Operators over the whole corpus, each against a brute-force version; and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .cases import Sets, WORD, empty_frame, odd_frame, odd_rows, prose

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# near-duplicates

def plain_simhash(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i: i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """[(doc_id, fp)] to {fp: smallest id reachable}."""
    sets = Sets()
    fps = sorted({f for _, f in rows})
    for i, a in enumerate(fps):
        sets.find(a)
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    least = {}
    for d, f in rows:
        root = sets.find(f)
        if d is not None:
            least[root] = min(d, least.get(root, d))
    return {f: least.get(sets.find(f)) for f in fps}


def test_fingerprint_groups_match_brute_force(spark):
    from rosterlab.llm.simhash import hex16, near_duplicates

    odd = odd_frame(spark).select("doc_id", "text")
    for df in (documents(spark).select("doc_id", "text"), odd):
        rows = [(r["doc_id"], plain_simhash(r["text"])) for r in df.collect()]
        want = plain_groups(rows)
        got = near_duplicates(df).select("doc_id", hex16(F.col("fp")).alias("f"), "component_id").collect()
        assert Counter((r[0], r[1], r[2]) for r in got) == Counter((d, f"{f:016x}", want[f]) for d, f in rows)
    assert near_duplicates(empty_frame(spark)).count() == 0


def clustered(rng, n):
    fps = set()
    while len(fps) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 60])):
            x = center
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    return sorted(fps)


@pytest.mark.parametrize("tile", [4096, 16])
def test_no_link_is_lost_whatever_the_tiles(spark, tile):
    from rosterlab.llm.graph import components
    from rosterlab.llm.simhash import links

    fps = clustered(random.Random(tile), 1500)
    sets = Sets()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile)).collect()
    root = {r["node"]: r["root"] for r in found}
    groups, want = {}, {}
    for f, s in zip(fps, signed):
        groups.setdefault(root.get(s, s), set()).add(f)
        want.setdefault(sets.find(f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_masks_keep_every_pair():
    from rosterlab.llm.simhash import gray_rank, masks_for

    rng = random.Random(9)
    for n in (10, 10**6, 10**8, 10**10):
        masks = masks_for(n)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flips & m for m in masks)
    x = np.arange(64, dtype=np.uint64)
    assert sorted(gray_rank(x ^ (x >> np.uint64(1)))) == list(range(64)) and list(gray_rank(x ^ (x >> np.uint64(1)))) == list(range(64))


def test_components_of_chains_stars_and_loops(spark):
    from rosterlab.llm.graph import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (-7, -9), (-9, -7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[-7] == -9 and 5000 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_of_each_group(spark):
    from rosterlab.llm.simhash import keep_one

    odd = odd_frame(spark)
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], plain_simhash(r["text"])) for r in odd.collect()]
    want = plain_groups(rows)
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted({v for v in want.values() if v is not None})


# repeated spans

def plain_repeats(rows, windows, split):
    """{(doc, text): pieces to cut} by keeping every window's first place."""
    first, cut = {}, {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        for key, s, n in windows(t or "", split(t or "")):
            if key in first and first[key] != (d, t, s):
                cut.setdefault((d, t), set()).update(range(s, s + n))
            else:
                first[key] = (d, t, s)
    return cut


def test_line_windows_match_brute_force(spark):
    from rosterlab.llm.line_dedup import dedup_lines

    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["aa", "bb", "cc", "", "dd "]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] + [(i + 500, r[1]) for i, r in enumerate(odd_rows())] + [(None, texts[5])]
    got = {(r["r"]["doc_id"], r["r"]["text"]): (r["text"], r["n_removed"]) for r in dedup_lines(spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, spans string").repartition(3)).collect()}

    def full(t):
        return [i for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]

    def windows(t, at):
        lines = t.split("\n")
        return [(tuple(lines[j] for j in at[i: i + 3]), i, 3) for i in range(len(at) - 2)]

    cut = plain_repeats(rows, windows, full)
    for d, t in rows:
        gone = cut.get((d, t), set())
        if not gone:
            assert got[d, t] == (t, 0)
            continue
        kept, p = [], -1
        for i, line in enumerate(t.split("\n")):
            p += i in full(t)
            if p not in gone:
                kept.append(line)
        assert got[d, t] == ("\n".join(kept), len(gone)), (d, t)
    assert dedup_lines(empty_frame(spark)).count() == 0


def test_sentence_runs_match_brute_force(spark):
    from rosterlab.llm.sentence_spans import dedup_sentences, sentences

    rng = random.Random(5)
    bank = [prose(rng, 6).replace(".", "").replace("\n", "") + "." for _ in range(12)]
    texts = [" ".join(rng.choices(bank, k=rng.randint(0, 8))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 500, r[1]) for i, r in enumerate(odd_rows())]
    got = {r["r"]["doc_id"]: r for r in dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def windows(t, at):
        parts = [tuple(WORD.findall(t[a:b])) for a, b in at]
        out = [(p, i, 1) for i, p in enumerate(parts) if max(len(p), unspaced(p)) >= 25]
        for i in range(len(parts)):
            for k in range(2, len(parts) - i + 1):
                run = parts[i: i + k]
                if sum(max(len(p), unspaced(p)) for p in run) >= 20:
                    out.append((sum(run, ()), i, k))
                    break
        return out

    def unspaced(words):
        return sum("\u4e00" <= c <= "\u9fff" for c in "".join(words))

    cut = plain_repeats(rows, windows, sentences)
    assert cut
    for d, t in rows:
        gone = cut.get((d, t), set())
        assert got[d]["n_removed"] == len(gone)
        kept = [t[a:b] for i, (a, b) in enumerate(sentences(t or "")) if i not in gone]
        assert got[d]["text"] == t if not gone else [got[d]["text"][a:b] for a, b in sentences(got[d]["text"])] == kept
    assert dedup_sentences(empty_frame(spark)).count() == 0


@pytest.mark.parametrize("sizes", [[51], [26, 27], [10, 20, 25], [3, 4, 50, 2]])
def test_a_planted_passage_of_over_fifty_words_goes(spark, sizes):
    from rosterlab.llm.sentence_spans import dedup_sentences

    rng = random.Random(sum(sizes))
    passage = " ".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) + "." for n in sizes)
    rows = [(i, prose(random.Random(i), 40).replace("\n", " ") + ".\n" + passage + "\n" + prose(random.Random(i + 90), 30)) for i in range(4)] + [(9, prose(random.Random(77), 200))]
    got = {r["r"]["doc_id"]: r["text"] for r in dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and got[9] == rows[-1][1]
    assert all(passage[:40] not in got[i] and passage[-20:] not in got[i] for i in (1, 2, 3))


def test_a_passage_cut_inside_sentences_goes(spark):
    """The ends of the passage lie inside sentences of their documents, and some sentences end in marks."""
    from rosterlab.llm.sentence_spans import dedup_sentences

    word = lambda rng: "".join(rng.choices("abcdefgh", k=5))
    rng = random.Random(8)
    whole = [" ".join(word(rng) for _ in range(n)) + end for n, end in ((9, ".&&&"), (4, "!"), (12, ".***"), (6, "?\"), "))]
    whole = [x.rstrip(", ") for x in whole]
    passage = " ".join(word(rng) for _ in range(11)) + ". " + " ".join(whole) + " " + " ".join(word(rng) for _ in range(10))
    own = lambda i, n: " ".join(word(random.Random(i * 100 + n)) for _ in range(n))
    rows = [(i, own(i, 15) + ". " + own(i, 7) + " " + passage + " " + own(i, 5) + ". " + own(i, 12) + ".") for i in range(3)] + [(9, own(9, 60) + ".")]
    got = {r["r"]["doc_id"]: r["text"] for r in dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[3][1]
    for i in (1, 2):
        assert all(x not in got[i] for x in whole) and got[i].startswith(own(i, 15) + ". " + own(i, 7)) and got[i].endswith(own(i, 12) + ".")


def test_repeated_rows_and_clashing_columns_keep_their_sentences(spark):
    from rosterlab.llm.sentence_spans import dedup_sentences

    odd = odd_frame(spark)
    got = dedup_sentences(odd).collect()
    assert Counter(tuple(r["r"]) for r in got) == Counter(tuple(r) for r in odd.collect())
    twice = [r for r in got if r["r"]["doc_id"] == odd_rows()[4][0]]
    assert len(twice) == 3 and all(r["text"] == odd_rows()[4][1] for r in twice)  # one document, three rows


@pytest.mark.parametrize("passage", [
    "他昨天去了城里的市場。那裡有很多新鮮的蔬菜。他買了三斤白菜和兩條魚。回家以後他做了一頓晚飯。全家人都說味道非常好。大家吃完飯就去散步了。",
    "今日は天気がとてもいいです。朝から公園へ行きました。たくさんの人が歩いていました。私は本を読みました。それから家に帰りました。",
    "เมื่อวานเขาไปตลาดในเมืองกับแม่\nที่นั่นมีผักสดมากมายให้เลือกซื้อ\nเขาซื้อปลาสองตัวกลับบ้าน",
])
def test_a_planted_passage_of_unspaced_sentences_goes(spark, passage):
    from rosterlab.llm.sentence_spans import dedup_sentences

    rows = [(i, prose(random.Random(i), 40).replace("\n", " ") + ".\n" + passage + "\n" + prose(random.Random(i + 90), 30)) for i in range(3)] + [(7, "Yes.\nNo.\nOh.\n"), (8, "Yes.\nNo.\nOh.\n")]
    got = {r["r"]["doc_id"]: r["text"] for r in dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[8] == rows[4][1]
    for i in (1, 2):
        before, after = rows[i][1].split(passage)
        assert got[i] == before + after.lstrip("\n")


# mixing

def plain_targets(sizes):
    """Round by round: shares by weight, full sources stop, the rest goes on."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("chunk", [128, 8])
def test_mix_meets_its_targets(spark, chunk, monkeypatch):
    from rosterlab.llm import mix as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    rng = random.Random(6)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5), ["é", "a", "b", None, "B"][min(4, int(rng.expovariate(1)))]) for i in range(1200)]
    rows += [(7, None, "a"), (8, "", "empty"), (None, "x y", None), (None, "x y", None), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = module.mix(df.repartition(3)).collect(), module.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((d, len((t or "").split()), s) for d, t, s in rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(10, 0.01 * t), (s, taken[s], t)
    assert module.mix(empty_frame(spark)).count() == 0


def test_documents_keep_their_probability(spark, monkeypatch):
    from rosterlab.llm import mix as module

    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string").cache()
    got = []
    for seed in range(6):
        monkeypatch.setattr(module, "SEED", seed)
        got += module.mix(df).filter("source = 'b'").collect()
    rate = got[0]["target"] / got[0]["source_size"]
    for size in range(1, 8):
        some = [r["copies"] for r in got if r["size"] == size]
        assert abs(sum(some) / len(some) - rate) < 0.15


# benchmark

def plain_leaks(rows, items):
    from rosterlab.llm.decontaminate import words_of

    def grams(w):
        return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def share(part, words, held):
        if len(part) < 5:
            return float(not part or any(words[i: i + len(part)] == part for i in range(len(words))))
        want = grams(part)
        return len(want & held) / len(want)

    out = set()
    for d, t in rows:
        words = words_of(t or "")
        held = grams(words)
        for i, x in items:
            question, _, answer = (x or "").strip().partition("\n")
            parts = words_of(question), words_of(answer)
            if any(parts) and min(share(p, words, held) for p in parts) >= 0.8:
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    from rosterlab.llm.decontaminate import leaks, without_leaks

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rng = random.Random(8)
    long_item = prose(rng, 700)
    items += [(900, long_item), (901, None), (902, ""), (903, "...")]
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    near = items[3][1].split()
    near[len(near) // 2: len(near) // 2 + 1] = []
    planted = [(9000 + i, prose(rng, 150) + " " + x[1].upper() + "\n" + prose(rng, 90)) for i, x in enumerate(items[:20])]
    planted += [(9100, prose(rng, 3000) + " " + long_item + " " + prose(rng, 50)), (9101, " ".join(near)), (9102, " ".join(items[4][1].split()[:6])), (9103, None), (9104, "")]
    df = spark.createDataFrame(rows + planted, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(rows + planted, items)
    got = {(r["doc_id"], r["item_id"]) for r in leaks(df, bench).collect()}
    assert want <= got and all((d, i) in want for d, i in got) and len(want) > 20
    sharded = {(r["doc_id"], r["item_id"]) for r in leaks(df, bench, shard_words=400).collect()}
    assert sharded == got
    kept = {r["doc_id"] for r in without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in rows + planted} - {d for d, _ in got}


def test_a_question_without_its_answer_is_no_leak(spark):
    from rosterlab.llm.decontaminate import leaks

    rng = random.Random(4)
    question, answer = prose(rng, 40).replace("\n", " "), "only these six words answer it"
    bench = spark.createDataFrame([(1, question + "\n" + answer)], "item_id long, text string")
    around = lambda x: prose(rng, 60) + " " + x + " " + prose(rng, 60)
    rows = [(1, around(question)), (2, around(question + " " + answer)), (3, around(answer)), (4, around(answer + " " + question))]
    assert {r["doc_id"] for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == {2, 4}


def test_leaks_of_odd_tables(spark):
    from rosterlab.llm.decontaminate import leaks, without_leaks

    odd, bench = odd_frame(spark), spark.createDataFrame([(1, "one two\nthree four five"), (2, None)], "item_id int, text string")
    hits = leaks(odd, bench).collect()
    assert Counter(r["doc_id"] for r in hits) == Counter([4, 4, 4, None]) and all(r["item_id"] == 1 for r in hits)
    assert without_leaks(odd, bench).columns == odd.columns and without_leaks(odd, bench).count() == odd.count() - 4
    assert leaks(empty_frame(spark), bench).count() == 0
    assert leaks(odd, bench.limit(0)).count() == 0 and without_leaks(odd, bench.limit(0)).count() == odd.count()


# language model

def test_base_scores_match_plain_counts(spark):
    import math

    from rosterlab.llm.context_mixing import op5_context_mixing, score_texts

    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]

    def check(rows, got):
        def toks(t):
            return (t or "").encode().lower().split() + [b"\n"]

        train = Counter(x for d, t in rows if zlib.crc32(str(d).encode()) % 10 for x in toks(t))
        n, v = sum(train.values()), len(train)
        assert len(got) == len(rows)
        for r in got:
            words = [toks(t) for d, t in rows if d == r["doc_id"]][0]
            assert r["n_tokens"] == len(words) and r["n_known"] == sum(w in train for w in words) and r["train_tokens"] == n
            assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
            assert r["score"] < 0 and math.isfinite(r["score"])
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)

    got = op5_context_mixing(spark, SF).collect()
    check(docs, got)
    larger = op5_context_mixing(spark, "/root/testdata/sf0.01").collect()
    for held in (True, False):
        some = [r for r in larger if r["held_out"] == held]
        assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)
        assert sum(r["score"] > r["base_score"] for r in some) > 0.8 * len(some)
    odd = odd_frame(spark)
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(1)) != 0
    scored = score_texts(odd, training).collect()
    assert len(scored) == odd.count() and all(r["score"] < 0 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] == 4}) == 1
    assert score_texts(odd, F.lit(False)).filter("n_known > 0 OR train_tokens > 0").count() == 0
    assert score_texts(empty_frame(spark), F.lit(True)).count() == 0


def counted_words(seed, n=4000):
    """Words of two kinds, with counts; some are not of training."""
    rng = random.Random(seed)
    found = Counter(bytes([k]) + w.encode() for k in (0, 1) for w in prose(rng, n).lower().split())
    found[b"\x00" + b"longer" * 20] = 2
    found[b"\x01" + "h\u00e9".encode() * 40 + b"\x07"] = 1
    return {t: c if i % 7 else 0 for i, (t, c) in enumerate(sorted(found.items()))}


def taught_model(words):
    from rosterlab.llm.context_mixing import OFFSETS, Model, count_into, halved

    counts = np.zeros(2 * OFFSETS[-1], np.uint32)
    count_into(counts, words)
    model = Model(halved(counts.astype(np.int64)))
    before = (model.bits(words) * counted(words)).sum()
    model.taught(*model.learn(words))
    assert (model.bits(words) * counted(words)).sum() < before
    return model


def counted(words):
    out = np.empty(len(words.counts))
    out[words.order] = words.counts
    return out


def test_next_byte_probabilities_add_up_to_one():
    from rosterlab.llm.context_mixing import Words

    counts = counted_words(11)
    model = taught_model(Words(list(counts), list(counts.values()), {}))
    for prefix in (b"\x00", b"\x00t", b"\x01th", b"\x00zzq", b"\x00" + b"longer" * 3):
        probes = {**counts, **{prefix + bytes([b]): counts.get(prefix + bytes([b]), 0) for b in range(256)}, prefix: counts.get(prefix, 0)}
        words = Words(list(probes), list(probes.values()), {})
        cost = dict(zip(probes, model.bits(words, depth=len(prefix))))
        start = dict(zip(probes, model.bits(words, depth=len(prefix) - 1)))
        p = sum(2 ** -(cost[prefix + bytes([b])] - start[prefix + bytes([b])]) for b in range(256))
        assert p == pytest.approx(1, abs=1e-6)
    whole = model.bits(Words(list(counts), list(counts.values()), {}))
    assert (2.0 ** -whole).sum() < 2  # of two kinds


def test_words_cost_the_same_in_ranges():
    from rosterlab.llm.context_mixing import Words

    counts = counted_words(12)
    whole = Words(list(counts), list(counts.values()), {})
    model = taught_model(whole)
    want = dict(zip(counts, model.bits(whole)))
    tokens = sorted(counts)
    parts = [tokens[:300], tokens[300:301], tokens[301:700], tokens[700:]]
    shared = {}
    for part in parts:
        for prefix, byte, n in Words(part, [counts[t] for t in part], {}).border():
            shared.setdefault(prefix, np.zeros(256, np.int64))[byte] += n
    for part in parts:
        part = random.Random(1).sample(part, len(part))
        got = model.bits(Words(part, [counts[t] for t in part], shared))
        assert got == pytest.approx([want[t] for t in part])


def test_scores_hardly_depend_on_the_ranges(spark, monkeypatch):
    from rosterlab.llm import context_mixing

    rng = random.Random(5)
    rows = [(i, prose(rng, 200)) for i in range(40)]
    df = spark.createDataFrame(rows + [(100, rows[3][1]), (101, "x" * 5000), (102, None)], "doc_id long, text string")
    training = F.col("doc_id") < 30
    once = {r["doc_id"]: r for r in context_mixing.score_texts(df, training).collect()}
    monkeypatch.setattr(context_mixing, "RANGE", 50)
    many = {r["doc_id"]: r for r in context_mixing.score_texts(df, training).collect()}
    assert once.keys() == many.keys() and once[3]["score"] == once[100]["score"]
    for d, r in once.items():
        assert r["n_known"] == many[d]["n_known"] and r["base_score"] == pytest.approx(many[d]["base_score"])
    # tiny ranges see few words each, so the weights they learn differ; what they add up to hardly does
    assert sum(r["score"] for r in once.values()) == pytest.approx(sum(r["score"] for r in many.values()), rel=0.05)


def test_scores_of_many_ranges_beat_the_base(spark, monkeypatch):
    from rosterlab.llm import context_mixing

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    monkeypatch.setattr(context_mixing, "RANGE", 5000)
    got = context_mixing.score_texts(docs, training).withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    for r in got.groupBy("train").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect():
        assert r["s"] > 0.98 * r["b"]


def test_kinds_are_settled_by_every_training_row(spark, monkeypatch):
    from rosterlab.llm import context_mixing

    settled, start = [], context_mixing.Kinds.__init__

    def recorded(self, counts):
        settled.append(counts.sum())
        start(self, counts)

    monkeypatch.setattr(context_mixing.Kinds, "__init__", recorded)
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), F.col("id") % 70, F.col("id")).alias("text"))
    assert context_mixing.score_texts(docs, F.col("doc_id") % 9 > 0).filter("score >= 0").count() == 0
    assert settled[-1] == 4 * 8000


# pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark).withColumns({"r": F.lit("own"), "th": F.lit(1), "n": F.lit(2)})
    odd = spark.createDataFrame([(5000, None, None, None, 0, "o", 1, 2), (5001, "12 34", "en", None, 5, "o", 1, 2)], docs.schema)
    docs = docs.unionByName(odd)
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= ids
        if k == 0:
            assert ids - now == {5000, 5001}
        ids = now
    assert docs.agg(F.sum("taken")).first()[0] > 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.count() == 0


def test_a_kind_does_not_hang_on_the_order_of_words():
    import numpy as np

    from rosterlab.llm.context_mixing import FEATURES, KINDS, Kinds

    rng = np.random.default_rng(1)
    kinds = Kinds(rng.integers(0, 9, (KINDS, FEATURES)).astype(float))
    assert (kinds.logs == np.round(kinds.logs)).all()  # sums are exact
    for n in (0, 1, 7, 70_000):
        at = rng.integers(0, FEATURES, n)
        each, times = np.unique(at, return_counts=True)
        assert kinds.of(at) == kinds.of(at[::-1]) == kinds.of(each, times.astype(float)) == int(kinds.logs[at].sum(0).argmax())


def test_words_are_told_apart_once_for_many_texts(monkeypatch):
    import pyarrow as pa

    from rosterlab.llm import context_mixing as cm

    rng = random.Random(9)
    texts = ["", " ", "  a  A\x0bb\x1c ", "x" * 300, "\n\n", "a", "é É z", *[prose(rng, 60) for _ in range(30)], "\x00 \x00\x00 b\x00", "a\n", "", " "]
    batch = pa.record_batch({"d": pa.array(range(len(texts))), "th": pa.array(range(len(texts))), "t": pa.array(texts), "train": pa.array([i % 4 > 0 for i in range(len(texts))])})
    tokens = [cm.tokens_of(t.encode()) for t in texts]
    for most in (1, 100, 1 << 20):
        got = []
        for first, each, which, begin in cm.spans_of(batch, most):
            words = cm.listed(each)
            assert first == len(got) and len(set(words)) == len(words)
            got += [[words[i] for i in which[a:b]] for a, b in zip(begin, begin[1:])]
        assert got == tokens

    calls, plain = [], cm.hashed
    monkeypatch.setattr(cm, "hashed", lambda words: calls.append(len(words)) or plain(words))
    kinds = cm.Kinds(np.random.default_rng(1).integers(0, 9, (cm.KINDS, cm.FEATURES)).astype(float))
    found = Counter()
    for out in cm._gather(iter([batch]), kinds):
        found.update({(k, t): c for k, t, c in zip(*(out.column(x).to_pylist() for x in ("kind", "token", "c")))})
    want = Counter()
    for i, words in enumerate(tokens):
        for w in [*words, b"\n"]:
            want[kinds.of(plain(words)), w] += int(i % 4 > 0)
    assert dict(found) == dict(want)
    assert sum(calls) <= len({w for words in tokens for w in words}) < sum(map(len, tokens))  # no word is hashed for each of its texts

    keys = sorted(found)[::2]
    base = cm.Base([bytes([k]) + w for k, w in keys], [found[x] for x in keys], [0.1 * (i + 1) for i in range(len(keys))], 1000, 300)
    rows = [{x: pa.array(v).to_pylist() for x, v in out.items()} for out in cm._scored(batch, base, kinds)]
    rows = [dict(zip(out, row)) for out in rows for row in zip(*out.values())]
    assert [r["d"] for r in rows] == list(range(len(texts)))  # one row a text
    for i, (r, words) in enumerate(zip(rows, tokens)):
        kind, held = kinds.of(plain(words)), Counter([*words, b"\n"])
        rare = {w: c for w, c in held.items() if (kind, w) not in keys}
        assert r["n_tokens"] == len(words) + 1 and r["n_known"] == sum(c for w, c in held.items() if w not in rare and found[kind, w])
        assert dict(zip(r["h"], r["m"])) == {int(cm.hash_of([w])[0] ^ cm._SALT[kind]): c for w, c in rare.items()}
        alone = next(iter(cm._scored(batch.slice(i, 1), base, kinds)))
        assert (alone["base"][0], alone["bits"][0]) == (r["base"], r["bits"])  # whatever else stands in the batch
