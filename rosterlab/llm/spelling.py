"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Words and their counts come from one pass with counters in the tasks. Of the vocabulary, blocked Bloom filters are built, one per class of length, each a range of
numbered blocks of 512 bits. A task that holds the filters generates the edits of its words and asks them: deletions, and replacements by a larger letter, which
between them meet every pair once (a word with a letter more finds the shorter one). Edits are never spelled out for this: a word has a polynomial hash, and an edit changes it by one
term, so all edits of a word are one matrix. Only edits that the filter holds become text, and they alone are shuffled to an exact join
with the vocabulary, which removes the false ones. A filter has no false negatives, so no pair is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import bytes_of, map_batches, table

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
TYPO_MODULUS = 199  # the query's contract deletes a letter of one run in so many
BITS_PER_WORD = 16
PASS_BLOCKS = 1 << 19  # blocks of 64 bytes asked at once: 32 MB are broadcast, about 17 million words; more words make more passes
PIECE = 1 << 22  # bytes of a text looked at together
MOST_WORDS, MOST_BYTES = 200_000, 1 << 26  # a task's counter is given out at so many words, or after so many bytes of text
CELLS = 1 << 18  # edits hashed together
# Letters: a-z, and U+00C0 to U+00FF, whose UTF-8 is C3 and one more byte. A-Z are lower-cased.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def runs_of(text: bytes | memoryview) -> Iterator[list[bytes]]:
    """The lower-cased letter runs with at least ``LEAST_LENGTH`` bytes, piece by piece; shorter ones can be no word."""
    at = 0
    while at < len(text):
        past = min(len(text), at + PIECE)
        while past < len(text) and _LETTERS[text[past]] != 32:
            past += 1
        piece = bytes(text[at:past])
        if not piece.isascii():
            piece = _OTHER.sub(b" ", piece)
        yield [w for w in piece.translate(_LETTERS).split() if len(w) >= LEAST_LENGTH]
        at = past


def shortened(run: bytes, h: int) -> bytes:
    letters = run.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1:]).encode()


def _counted(batches: Iterator[pa.RecordBatch], modulus: int | None, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    counter: Counter = Counter()
    seen = 0

    def given() -> pa.RecordBatch:
        some = [(w, n) for w, n in counter.items() if n > 0]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()).cast(pa.string()), pa.array([n for _, n in some], pa.int64())], schema=out)

    for batch in batches:
        for doc_id, text in zip(batch.column("d").to_pylist(), bytes_of(batch, "t")):
            start = None if modulus is None or doc_id is None else crc32(f"{doc_id}:".encode())
            for runs in runs_of(text):
                counter.update(runs)
                if start is not None:
                    for run in [w for w in set(runs) if crc32(w, start) % modulus == 0]:
                        n = runs.count(run)
                        counter[run] -= n
                        counter[shortened(run, crc32(run, start))] += n
            seen += len(text)
            if len(counter) > MOST_WORDS or seen > MOST_BYTES:
                yield given()
                counter.clear()
                seen = 0
    if counter:
        yield given()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int | None = None, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``LEAST_LENGTH`` letters with at least ``least`` occurrences in all texts.

    With a ``modulus``, a run whose crc32 of ``<id>:<run>`` it divides loses the letter at that number modulo its length, first; rows without an id lose none.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"))
    words = rows.mapInArrow(lambda it: _counted(it, modulus, schema), "word string, n long").filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def length_class(n: Column) -> Column:
    """Lengths of up to 63 each have a class, longer ones one per doubling: the number of filters is bounded."""
    return F.when(n < 64, n).otherwise(58 + F.floor(F.log2(n) + F.lit(1e-9))).cast("int")


def _class_of(length: int) -> int:
    return length if length < 64 else 57 + length.bit_length()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _block_of(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bit(mixed: np.ndarray, lane: int) -> np.ndarray:
    """A single bit per hash, in the block's ``lane``-th word of 64 bits."""
    low = mixed & np.uint64(0xFFFFFFFF)
    return np.uint64(1) << (((low * _LANES[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(26))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letters): words of one length, a few at a time, as a matrix of code points."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        n = int(lengths[same[0]]) if len(same) else 0
        for i in range(0, len(same) if n else 0, max(1, CELLS // n)):
            some = same[i: i + max(1, CELLS // n)]
            letters = np.frombuffer("".join(words[j] for j in some).encode("latin-1"), np.uint8).reshape(len(some), n)
            yield some, letters.astype(np.uint64)


def _terms(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and each letter's term of the hash, whose sum it is (modulo 2^64)."""
    powers = np.ones(letters.shape[1], np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)[::-1]
    return powers, letters * powers


def hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for some, letters in by_length(words):
        out[some] = _terms(letters)[1].sum(1, dtype=np.uint64)
    return out


def edits(letters: np.ndarray, alphabet: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(letter put in or -1 for none, hashes, which of them are asked) of all edits at every place of words of one length.

    Of a stretch of equal letters the first stands for all deletions; a letter is replaced by larger ones only, since the other word of the pair has the larger one.
    """
    powers, terms = _terms(letters)
    along = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = along[:, -1:]
    first = np.ones(letters.shape, bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    yield -1, (along - terms) * _UNDO + (whole - along), first
    rest = whole - terms
    for a in alphabet:
        yield a, rest + np.uint64(a) * powers, letters < a


class Filters:
    """Blocks ``low`` up to ``low`` + len(blocks) of all filters; ``ranges``: class of length to (first block, blocks)."""

    def __init__(self, low: int, blocks: np.ndarray, ranges: dict[int, tuple[int, int]]):
        self.low, self.blocks, self.ranges = low, blocks, ranges

    def hold(self, h: np.ndarray, length: int) -> np.ndarray:
        """Which of these hashes of words of one length may be in the vocabulary, by the blocks at hand."""
        first, n = self.ranges.get(_class_of(length), (0, 0))
        if not n or first + n <= self.low or first >= self.low + len(self.blocks):
            return np.zeros(0, np.int64)
        mixed = _mixed(h)
        block = _block_of(mixed, n).astype(np.int64) + (first - self.low)
        some = np.arange(len(h))
        if first < self.low or first + n > self.low + len(self.blocks):
            some = np.flatnonzero((block >= 0) & (block < len(self.blocks)))
        for lane in range(8):
            bit = _bit(mixed[some], lane)
            some = some[(self.blocks[block[some], lane] & bit) != 0]
        return some


def bloom_blocks(words: DataFrame, ranges: dict[int, tuple[int, int]]) -> DataFrame:
    """(block, l0 .. l7): the filters' blocks that hold a word, each the union of its words' bits."""
    lanes = [f"l{i}" for i in range(8)]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        own = batch.column("word").to_pylist()
        first, n = (np.array([ranges[_class_of(len(w))][i] for w in own], np.uint64) for i in (0, 1))
        mixed = _mixed(hashes(own))
        block = _block_of(mixed, n) + first
        order = np.argsort(block)
        heads = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) > 0)))
        bits = {lane: np.bitwise_or.reduceat(_bit(mixed[order], i), heads).view(np.int64) for i, lane in enumerate(lanes)}
        yield {"block": block[order][heads].astype(np.int64), **bits}

    parts = map_batches(words.select("word"), run, "block long, " + ", ".join(f"{x} long" for x in lanes))
    return parts.groupBy("block").agg(*[F.bit_or(x).alias(x) for x in lanes])


def _asked(batch: pa.RecordBatch, filters: Filters, alphabet: list[int]) -> Iterator[dict]:
    words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
    for some, letters in by_length(words):
        out: dict[str, list] = {"word": [], "n": [], "edit": []}
        length = letters.shape[1]
        for letter, h, asked in edits(letters, alphabet):
            if letter < 0 and length <= LEAST_LENGTH:
                continue
            row, at = np.nonzero(asked)
            held = filters.hold(h[row, at], length - (letter < 0))
            put = "" if letter < 0 else chr(letter)
            for r, i in zip(some[row[held]].tolist(), at[held].tolist()):
                out["word"].append(words[r])
                out["n"].append(counts[r])
                out["edit"].append(words[r][:i] + put + words[r][i + 1:])
            if len(out["word"]) > CELLS // max(64, length):  # long words: few at a time
                yield out
                out = {"word": [], "n": [], "edit": []}
        if out["word"]:
            yield out


def near_pairs(words: DataFrame, bits_per_word: int = BITS_PER_WORD, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(a, na, b, nb): every unordered pair of the vocabulary (word, n) one insertion, deletion or replacement apart, once.

    ``words`` is read several times: pass a written table.
    """
    spark = words.sparkSession
    sizes = {r["c"]: r["n"] for r in words.groupBy(length_class(F.length("word")).alias("c")).agg(F.count("*").alias("n")).collect()}  # at most 63 + 26 classes
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).distinct().collect()  # letters: at most 90
    alphabet = sorted(ord(r["x"]) for r in letters if r["x"])
    ranges, total = {}, 0
    for c, n in sorted(sizes.items()):
        ranges[c] = (total, max(1, -(-n * bits_per_word // 512)))
        total += ranges[c][1]
    blocks = bloom_blocks(words, ranges)
    if total > pass_blocks:
        blocks = cut_lineage(blocks)
    met = None
    for low in range(0, total, pass_blocks):
        some = blocks.filter((F.col("block") >= low) & (F.col("block") < low + pass_blocks)).toArrow()  # at most pass_blocks rows of 72 bytes
        filled = np.zeros((min(pass_blocks, total - low), 8), np.uint64)
        filled[some["block"].to_numpy() - low] = np.stack([some[f"l{i}"].to_numpy().view(np.uint64) for i in range(8)], axis=1)
        shared = spark.sparkContext.broadcast(Filters(low, filled, ranges))
        part = map_batches(words, lambda batch, s=shared: _asked(batch, s.value, alphabet), "word string, n long, edit string")
        met = part if met is None else met.unionByName(part)
    if met is None:
        return spark.createDataFrame([], "a string, na long, b string, nb long")
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("nb"))
    return met.join(known, "edit").select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("edit").alias("b"), "nb")


def with_forms(words: DataFrame, ratio: int = RATIO, bits_per_word: int = BITS_PER_WORD, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root.

    form is the near word of largest n, ties to the smallest in code-point order, if that is at least ``ratio`` times the word's n. Counts rise along forms by that
    ratio, so chains are short and never circular; roots are found by joining the chain to itself, which doubles its steps each time.
    """
    words = cut_lineage(words)
    most = words.agg(F.max("n")).first()[0] or 1
    near = near_pairs(words, bits_per_word, pass_blocks)
    both = near.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w")).alias("o")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("na")).alias("m"), F.col("a").alias("w")).alias("o")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("o").alias("o"))
    clear = -F.col("o.m") >= ratio * F.col("n")
    rows = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, F.col("o.w")).alias("form"), F.when(clear, -F.col("o.m")).alias("form_n")))
    up = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))  # a chain has no more
    for _ in range(math.ceil(math.log2(steps))):
        up = cut_lineage(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int | None = None, least: int = LEAST_COUNT, ratio: int = RATIO,
                    bits_per_word: int = BITS_PER_WORD, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least six letters that occurs ``least`` times in all texts.

    Words are runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased. Rows with equal root are a spelling group. See ``vocabulary`` and ``with_forms``.
    Null and empty texts have no words; repeated rows count as often as they stand; an empty table gives no rows. Texts of any length are read in pieces, and a word of any
    length is hashed as a row of its letters. Only the named columns are read.
    """
    return with_forms(vocabulary(docs, doc_id, text, modulus, least), ratio, bits_per_word, pass_blocks)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, some with a letter deleted, with its near words, form and root."""
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), modulus=TYPO_MODULUS)


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {
    # crc32 by its table of 256 entries, built in the statement; near words share what is left of them when one place is blanked or cut out
    "op12_spelling_variants": r"""
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)), lambda x: x::BIGINT),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM own, poly),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
keys AS (SELECT word, n, i, substr(word, 1, i) || '?' || substr(word, i + 2) AS blanked, substr(word, 1, i) || substr(word, i + 2) AS cut FROM cuts),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM keys a JOIN keys b ON a.blanked = b.blanked AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM keys a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM keys a JOIN words b ON a.cut = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
up AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON up.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, n) AS root FROM up JOIN (SELECT word AS root, n FROM words) USING (root) GROUP BY word)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM forms LEFT JOIN roots USING (word)
""",
}
