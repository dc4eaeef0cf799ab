"""Quality rules as a short-circuit cascade, in DataFrame operations only.

The rules are independent predicates and a document must pass all, so their order changes the cost and not the verdict. On a sample
each rule is timed and its rejections counted; the cascade asks the rule with the most rejections per second first, and a
CASE WHEN leaves the others unasked once one rejects.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import BLANKS, table

SAMPLE = 2000  # rows on which costs and selectivities are estimated
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words inside repeated three-word windows
SYMBOLS = "#*$%&|<>"
_GAP = r"[\x20\x09-\x0D]+"


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as struct ``r`` with the text ``t``, its ``words`` and ``lines``, and the measures of the rules.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text is a text without words. Each step is a projection of its own, so that
    nothing is computed twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct("*").alias("r"), t.alias("t"))
    df = df.select("r", "t", F.array_remove(F.split("t", _GAP), "").alias("words"), F.split("t", "\n").alias("lines"))
    full = F.filter("lines", lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hw"), full.alias("full_lines"))
    windows = F.transform(F.slice("hw", 1, F.greatest(F.size("hw") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("hw", i + 1), F.get("hw", i + 2)))
    df = df.select("*", windows.alias("w3")).drop("hw")
    df = df.select("*", (F.size(F.array_distinct("w3")) < F.size("w3")).alias("again"))
    # windows in hash order only where some window comes twice
    placed = F.when(F.col("again"), F.sort_array(F.transform("w3", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select("*", placed.alias("placed")).drop("w3", "again")
    twice = F.filter("placed", lambda e, i: (e["h"] == F.get("placed", i + 1)["h"]) | (e["h"] == F.get("placed", i - 1)["h"]))
    df = df.select("*", F.sort_array(F.transform(twice, lambda e: e["i"])).alias("at")).drop("placed")
    steps = F.zip_with(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    repeated = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    return df.select(
        "r", "t", "words", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.size("full_lines").cast("long").alias("n_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _share(found: Column, of: Column) -> Column:
    return found.cast("double") / F.greatest(of, F.lit(1))


def rules() -> dict[str, Column]:
    """Name to a predicate that is true where the rule rejects."""
    n = F.col("n_words")
    with_letter = F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))
    bullets = F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[•‣●○■□▪▫–*-]\s")))
    trailing = F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")))
    digits = F.length("t") - F.length(F.translate("t", "0123456789", ""))
    longest = F.array_max(F.transform("words", lambda w: F.length(w)))
    return {
        "mean_word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "words_without_letters": _share(with_letter, n) < 0.7,
        "bullet_lines": _share(bullets, F.size("lines")) > 0.9,
        "trailing_dots": _share(trailing, F.size("lines")) > 0.3,
        "digits": _share(digits, F.col("word_chars")) > 0.3,
        "endless_word": longest > 1000,
    }


def cascade_order(measured: DataFrame, predicates: dict[str, Column], sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) with the most rejections per second first, from about ``sample`` rows drawn by hash.

    Only counts and times reach the driver. A table smaller than the sample is used whole; on an empty one the order is as given.
    """
    n = measured.count()
    if not n:
        return [(name, 0.0, 0.0) for name in predicates]
    drawn = measured.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.lit(max(1, 1_000_000 * sample // n)))
    drawn = cut_lineage(drawn.drop("r"))

    def seconds(aggregate: Column) -> tuple[float, int]:
        start = time.perf_counter()
        hits = drawn.agg(F.count("*"), aggregate).first()
        return time.perf_counter() - start, (hits[1] or 0) / max(1, hits[0])

    seconds(F.sum("n_words"))
    idle = min(seconds(F.sum("n_words"))[0] for _ in range(2))
    found = []
    for name, rejects in predicates.items():
        (a, hit), (b, _) = (seconds(F.count_if(rejects)) for _ in range(2))
        found.append((name, max(1e-3, min(a, b) - idle), hit))
    return sorted(found, key=lambda x: -x[2] / x[1])


def distinct_sample(docs: DataFrame, text: str, sample: int) -> DataFrame:
    """About ``sample`` rows by a hash of the text, each text once: a text that very many rows hold is one row of the sample."""
    share = max(1, 1_000_000 * sample // max(1, docs.count()))
    return docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < share).distinct()


def judge(docs: DataFrame, text: str = "text", predicates: dict[str, Column] | None = None, sample: int = SAMPLE) -> DataFrame:
    """with_measures() and ``base_failed``, ``kept``: false where the base fails or a rule rejects.

    Null, empty and blank texts fail the base. Equal texts get equal verdicts, so repeated rows do; other columns stay inside ``r``, whatever their names. A very long text is
    measured whole by array functions in its task; an empty table gives no rows.
    """
    predicates = predicates or rules()
    measured = with_measures(docs, text)
    asked = F.when(base_failed(), False)
    for name, _, _ in cascade_order(with_measures(distinct_sample(docs, text, sample), text), predicates, sample):
        asked = asked.when(predicates[name], False)
    return measured.select("*", base_failed().alias("base_failed"), asked.otherwise(True).alias("kept"))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    done = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("r.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality_cascade": op10_quality_cascade}
ORACLES = {
    "op10_quality_cascade": r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM base),
tri AS (SELECT doc_id, p, w AS a, lead(w) OVER v AS b, lead(w, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, t, words, lines, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM base),
f AS (
  SELECT m.*, len(full_lines) AS n_lines, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR len(list_filter(words, lambda x: regexp_matches(x, '\pL')))::DOUBLE / greatest(n_words, 1) < 0.7
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[•‣●○■□▪▫–*-]\s')))::DOUBLE / len(lines) > 0.9
    OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))::DOUBLE / len(lines) > 0.3
    OR (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::DOUBLE / greatest(word_chars, 1) > 0.3
    OR coalesce(list_max(list_transform(words, lambda x: length(x))), 0) > 1000) AS kept
FROM g
""",
}
