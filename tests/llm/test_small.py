"""Token counts, quality rules, languages, main text: each against a plain version or known answers."""

import random

import pytest
from pyspark.sql import functions as F

from .cases import WORD, empty_frame, odd_frame, odd_rows, prose

SF = "/root/testdata/sf0.001"


def test_token_counts_are_the_library_s(spark):
    import public_tokenizers
    from rosterlab.llm.tokens import count_tokens
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    parts = ["<|endoftext|>", "a", "B", "'s", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "1", "½", "Ⅰ", "🙂", "́", "中", "_", "<|", "don't", "\x00", "　", "ß", "hello"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(500)] + [r[1] for r in odd_rows()]
    library = Tokenizer.from_file(path)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_tokens string").repartition(3)
    got = {r["doc_id"]: r for r in count_tokens(df, path, limit=100).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (want[i] > 100) for i, t in enumerate(texts))
    assert count_tokens(empty_frame(spark), path).count() == 0


def test_only_strings_that_stay_whole_are_proven():
    import public_tokenizers
    from rosterlab.llm.tokens import Counter, prove_whole_tokens, read_model

    model = read_model(public_tokenizers.path("byte_bpe_50k.json"))
    proven = prove_whole_tokens(model)
    assert " the" in proven and "<|endoftext|>" not in proven and 40_000 < len(proven) < 50_257
    count = Counter(model, proven)
    assert count("the the<|endoftext|>") == 3
    with pytest.raises(ValueError):
        read_model(public_tokenizers.path("word_bpe_49k.json"))


def plain_measures(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark):
    from rosterlab.llm.quality import judge

    rng = random.Random(2)
    bank = ["a", "b", "c", "#", "|x|"]
    texts = [" ".join(rng.choices(bank, k=rng.randint(0, 80))) + "\n" * rng.randint(0, 2) + " ".join(rng.choices(bank, k=9)) for _ in range(150)]
    texts += [r[1] for r in odd_rows()] + [prose(rng, 300), "same line here\n" * 40, "1234 5678 90 12 " * 30]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], "doc_id int, text string, words string, kept int")
    got = {r["doc_id"]: r for r in judge(df).select("r.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    for i, t in enumerate(texts):
        want = plain_measures(t)
        assert tuple(got[i])[1:6] == want, (i, t)
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    n = len(texts)
    assert got[n - 3]["kept"] and not got[n - 2]["kept"] and not got[n - 1]["kept"]
    assert judge(empty_frame(spark)).count() == 0


def test_order_of_rules_does_not_change_the_verdict(spark):
    from rosterlab.llm.quality import judge, rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forward = {r[0]: r[1] for r in judge(docs).select("r.doc_id", "kept").collect()}
    backward = {r[0]: r[1] for r in judge(docs, predicates=dict(reversed(rules().items())), sample=10).select("r.doc_id", "kept").collect()}
    assert forward == backward and 0 < sum(forward.values()) < len(forward)


def test_language_on_held_out_documents(spark):
    from rosterlab.llm.language import op4_language

    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in op4_language(spark, SF).collect() if r["held_out"]]
    assert len(held) > 30 and sum(docs[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_of_odd_texts(spark):
    from rosterlab.llm.language import Model, identify, vector

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = odd_frame(spark).select("doc_id", "text").withColumn("lang", F.lit(None).cast("string"))
    got = identify(docs.union(odd)).collect()
    for r in got:
        text = r["r"]["text"]
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert {r["lang_pred"] for r in identify(odd).collect()} == {"und"}  # nothing to learn from
    assert identify(empty_frame(spark)).count() == 0
    one = Model([vector("bonjour le monde").tobytes()], ["fr"])
    assert one("salut") == ("fr", 1.0)


def test_copies_take_no_language_from_the_sample(spark, monkeypatch):
    from rosterlab.llm import language

    rng = random.Random(12)
    rows = [("one same text", "fr")] * 3000 + [(prose(rng, 12), x) for x in ("fr", "en") for _ in range(30)]
    taught = []
    monkeypatch.setattr(language, "Model", lambda vectors, langs: taught.append(langs))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    language.fit(docs)
    language.fit(docs, per_language=3)
    assert [(x.count("fr"), x.count("en")) for x in taught] == [(31, 30), (3, 3)]


def test_every_label_is_learned(spark, monkeypatch):
    from rosterlab.llm import language

    taught = []
    monkeypatch.setattr(language, "Model", lambda vectors, langs: taught.append(langs))
    language.fit(spark.createDataFrame([(f"text {i} of it", f"x{i % 230}") for i in range(690)], "text string, lang string").repartition(3))
    assert sorted(taught[0]) == sorted(f"x{i % 230}" for i in range(690))


def test_copies_take_no_page_from_the_sample(spark, monkeypatch):
    from rosterlab.llm import main_text

    pages = [f"<article><p>Page {i} of them.</p></article>" for i in range(40)]
    drawn = []
    monkeypatch.setattr(main_text, "_examples", lambda pages: drawn.append(set(pages)) or ())
    monkeypatch.setattr(main_text, "Boosted", lambda *_: None)
    df = spark.createDataFrame([(x,) for x in pages + pages[:1] * 3000], "html string").repartition(3)
    main_text.fit(df)
    main_text.fit(df, sample=5)
    assert drawn[0] == {*pages, main_text.USUAL} and len(drawn[1]) == 6


PAGES = {
    "plain": ("<html><body><nav><a href=/>Home</a></nav><article><h1>A  title</h1><p>First &amp; best, as they say, of all.<p>Second<br>line, here.</article><footer>&copy; X</footer></body></html>", "A title\nFirst & best, as they say, of all.\nSecond line, here."),
    "divs": ('<div id="header"><a href=/>Site</a></div><div class="content"><h1>Title of it</h1><p>This is a long paragraph, with commas, and text that goes on.</p><p>One more, of the same kind, with words.</p></div><div class="comments"><div class="comment"><p>Great article, thanks a lot!</p></div></div><div class="footer">(c) 2020</div>', "Title of it\nThis is a long paragraph, with commas, and text that goes on.\nOne more, of the same kind, with words."),
    "inside": ('<main><p>Some text that is long, and meaningful for the reader of it.</p><aside>Related things</aside><script>var p="</p>";</script><form><input><label>Mail</label></form><section class="comments"><p>nice post</p></section><p>The end of it, at last, is here.</p></main><div class="cookie-notice">We use cookies</div>', "Some text that is long, and meaningful for the reader of it.\nThe end of it, at last, is here."),
    "null": (None, ""), "empty": ("", ""), "blank": (" \n", ""), "only tags": ("<div><span></span></div>", ""), "broken": ("<<<>>></p></div><![CDATA[", None), "open comment": ("<article><p>Text of a story, which is here.</p></article><!-- never closed", "Text of a story, which is here."),
}


def test_main_text_of_known_pages(spark):
    from rosterlab.llm.main_text import fit, main_text

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = fit(pages)
    rows = [(k, v[0], "x", "y") for k, v in PAGES.items()] * 2 + [("deep", "<div>" * 5000 + "<p>Deep text, in here.", "x", "y"), ("long", "<article>" + "<p>A sentence, and more of it, goes here.</p>" * 20_000 + "</article>", "x", "y")]
    got = main_text(spark.createDataFrame(rows, "page_id string, html string, text string, r string").repartition(2), trees=trees).select("r.page_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] in PAGES and PAGES[r["page_id"]][1] is not None:
            assert r["text"] == PAGES[r["page_id"]][1], r["page_id"]
        if r["page_id"] == "long":
            assert r["text"].count("\n") == 19_999
    assert main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("head", ["<head><title>T</title><body>", "<head><title>T</title>", "<head><meta charset=utf-8><title>T</title><script>var x</script>", "<head></head><body>"])
def test_main_text_of_pages_with_an_open_head_or_formulas(head):
    from rosterlab.llm.main_text import USUAL, Boosted, _examples, extract

    trees = Boosted(*_examples([USUAL] * 10))
    page = "<html>" + head + "<article><p>First, the sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is said to be known, of all.</p><p>Then a second paragraph, of some length, ends it.</p></article></html>"
    assert list(extract([page], trees)) == ["First, the sum a+b is said to be known, of all.\nThen a second paragraph, of some length, ends it."]


def test_text_ends_an_open_head():
    from rosterlab.llm.main_text import parse

    nodes = parse("<head><title>T</title> \nSome text<noscript><img></noscript><p>more")
    assert [(n.tag, n.parent and n.parent.tag) for n in nodes] == [("#page", None), ("head", "#page"), ("title", "head"), ("noscript", "#page"), ("img", "noscript"), ("p", "#page")]


def test_main_text_is_the_article_of_given_pages(spark):
    import html
    import re

    from rosterlab.llm.main_text import op6_main_text

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op6_main_text(spark, SF).collect()
    right = 0
    for r in got:
        page = source[r["page_id"]] or ""
        inner = page[page.find("<article>") + 9: page.find("</article>")]
        parts = re.split(r"</?(?:p|h1)[^>]*>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)
        right += r["text"] == want and r["n_chars"] == len(want)
    assert len(got) == len(source) and right >= 0.98 * len(got)


def test_no_kept_element_below_a_dropped_one():
    import numpy as np
    from rosterlab.llm.main_text import decode, parse

    rng = np.random.default_rng(5)
    nodes = parse("<div><div><p>a<b>b</b></p><ul><li>c<li>d</ul></div><section><p>e</p></section></div>" * 4)
    for _ in range(50):
        odds = rng.normal(size=len(nodes))
        keep = decode(nodes, odds)
        place = {id(n): i for i, n in enumerate(nodes)}
        assert all(keep[place[id(n.parent)]] for i, n in enumerate(nodes) if keep[i] and n.parent is not None)
        # no single subtree is better put the other way
        for i, n in enumerate(nodes[1:], 1):
            below = [j for j, m in enumerate(nodes) if j == i or (j > i and keep[j] and _under(m, n))]
            if keep[i]:
                assert odds[below].sum() > 0


def _under(m, n):
    while m is not None:
        if m is n:
            return True
        m = m.parent
    return False


def test_rule_costs_come_from_distinct_texts(spark):
    """One row very many times over is one row of the sample."""
    from pyspark.sql import functions as F
    from rosterlab.llm.quality import distinct_sample

    same = spark.range(30_000).select(F.lit("one and the same text").alias("text"))
    other = spark.range(3000).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    n = distinct_sample(same.unionByName(other).unionByName(spark.createDataFrame([(None,), (None,)], "text string")), "text", 2000).count()
    assert 60 < n < 400
    assert distinct_sample(other, "text", 5000).count() == 3000 and distinct_sample(other.limit(0), "text", 10).count() == 0
