"""Benchmark decontamination: training passages query an index of the test items.

The index is an inverted one with BM25 weights, each item's scaled so that the item itself would score 1. Items lie in blocks;
a term knows its largest weight anywhere and its largest in each block that holds it. Every passage is a query, and all items that score at least ``threshold`` are
retrieved, as block-max WAND does: a passage whose terms' largest weights do not add up to the threshold is passed over; then
blocks whose own largest weights do not; only items of the rest are scored. A retrieved item counts if the passage holds
its five-word shingles: of the question (its first line) and of the answer (the other lines).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import table

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE, OVERLAP = 5, 0.8
BLOCK_ITEMS = 4
CELLS = 1 << 21  # passages times blocks that are bounded together
SHARD_WORDS = 1_000_000  # words of items in one broadcast index; more items make more indexes
CHUNK = 1 << 19  # characters, and words, looked at together: arrays of this length are what a task holds beside its batch
_WORD = re.compile(r"\w+")
FOUND = "array<struct<item: int, score: double, question_overlap: double, answer_overlap: double, word: long>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(ids: np.ndarray, n: int = SHINGLE) -> set[tuple[int, ...]]:
    ids = ids.tolist()
    return {tuple(ids[i: i + n]) for i in range(max(1, len(ids) - n + 1))} if ids else set()


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then the same for the next."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(count.sum())


def _once(a: np.ndarray) -> np.ndarray:
    """Sorted, each value once; sorting is faster here than the hash table of np.unique."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


class Index:
    """Of items whose lengths fall in one class: all fit in ``stride`` words, so each lies whole in two neighbouring blocks of words."""

    def __init__(self, stride: int, numbers: list[int], items: list[np.ndarray], parts: list[tuple[set, set]], idf: np.ndarray, mean: float):
        self.stride, self.numbers, self.parts = stride, numbers, parts
        n_terms = len(idf)
        weights = []
        for ids in items:
            term, tf = np.unique(ids, return_counts=True)
            w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
            weights.append((term, w / w.sum()))
        self.item_at = np.concatenate(([0], np.cumsum([len(t) for t, _ in weights])))
        self.item_term = np.concatenate([t for t, _ in weights])
        self.item_w = np.concatenate([w for _, w in weights])
        block = np.repeat(np.arange(len(items)) // BLOCK_ITEMS, np.diff(self.item_at))
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        key, back = np.unique(self.item_term.astype(np.int64) * self.blocks + block, return_inverse=True)
        self.list_max = np.zeros(len(key))
        np.maximum.at(self.list_max, back, self.item_w)
        self.list_block = key % self.blocks
        self.list_at = np.searchsorted(key // self.blocks, np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, self.item_term, self.item_w)
        # terms of very many blocks have their largest weights as a table, the others as lists
        self.common = np.diff(self.list_at) > max(1, self.blocks // 4)
        usual = np.flatnonzero(self.common)
        self.column = np.zeros(n_terms, np.int64)
        self.column[usual] = np.arange(len(usual))
        self.common_max = np.zeros((len(usual), self.blocks), np.float32)
        n = np.diff(self.list_at)[usual]
        entry = _ranges(self.list_at[usual], n)
        self.common_max[np.repeat(np.arange(len(usual)), n), self.list_block[entry]] = self.list_max[entry]

    def search(self, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, block of words, item, score) of word ids (-1: in no item) of many documents, with ``pos`` inside each."""
        n_terms, eps = len(self.most), 1e-9
        # blocks of all documents in a row, one empty block after each document
        per_doc = np.bincount(doc, weights=None) // self.stride + 2
        first = np.cumsum(per_doc) - per_doc
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        known = np.flatnonzero((ids >= 0) & (self.most[ids] > 0))
        key = _once((first[doc[known]] + pos[known] // self.stride) * n_terms + ids[known])
        block, term = key // n_terms, key % n_terms
        bound = np.bincount(block, self.most[term], len(owner))
        pivots = np.flatnonzero(bound[:-1] + bound[1:] >= threshold - eps)
        at = np.searchsorted(block, np.arange(len(owner) + 1))
        step = max(64, CELLS // self.blocks)
        for i in range(0, len(pivots), step):
            pivot = pivots[i: i + step]
            n = at[pivot + 2] - at[pivot]
            held = _once(np.repeat(np.arange(len(pivot)), n) * n_terms + term[_ranges(at[pivot], n)])
            p, t = held // n_terms, held % n_terms
            usual = self.common[t]
            has = np.zeros((len(pivot), len(self.common_max)), np.float32)
            has[p[usual], self.column[t[usual]]] = 1
            most = has @ self.common_max
            p, t = p[~usual], t[~usual]
            n = self.list_at[t + 1] - self.list_at[t]
            entry = _ranges(self.list_at[t], n)
            most += np.bincount(np.repeat(p, n) * self.blocks + self.list_block[entry], self.list_max[entry], most.size).reshape(most.shape)
            p, b = np.nonzero(most >= threshold - 1e-4)
            n = np.minimum((b + 1) * BLOCK_ITEMS, len(self.numbers)) - b * BLOCK_ITEMS
            p, item = np.repeat(p, n), _ranges(b * BLOCK_ITEMS, n)
            n = self.item_at[item + 1] - self.item_at[item]
            entry, pair = _ranges(self.item_at[item], n), np.repeat(np.arange(len(item)), n)
            want = p[pair] * n_terms + self.item_term[entry]
            place = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
            hit = held[place] == want if len(held) else np.zeros(0, bool)
            score = np.bincount(pair[hit], self.item_w[entry[hit]], len(item))
            for k in np.flatnonzero(score >= threshold - eps).tolist():
                g = int(pivot[p[k]])
                yield int(owner[g]), g - int(first[owner[g]]), int(item[k]), float(score[k])


class Searcher:
    """The indexes of one shard of items, by class of length, with their vocabulary."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean: float, threshold: float):
        self.vocabulary: dict[str, int] = {}
        self.threshold, self.indexes = threshold, []
        split = []
        for number, text in items:
            question, _, answer = text.strip().partition("\n")
            parts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(x)], np.int64) for x in (question, answer)]
            split.append((number, parts))
        terms = list(self.vocabulary)
        idf = np.array([np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) for w in terms])
        classes: dict[int, list] = {}
        for number, parts in split:
            n = len(parts[0]) + len(parts[1])
            if n:
                classes.setdefault(max(64, 1 << (n - 1).bit_length()), []).append((n, number, parts))
        for stride, members in sorted(classes.items()):
            members.sort(key=lambda m: (m[0], m[1]))  # items of like length share a block: their weights are alike
            self.indexes.append(Index(stride, [m[1] for m in members], [np.concatenate(m[2]) for m in members], [tuple(map(shingles, m[2])) for m in members], idf, mean))

    def ids(self, text: str) -> np.ndarray:
        """Word numbers of the whole text, -1 for words of no item; read in pieces that end between words."""
        out, at = [], 0
        while at < len(text):
            past = min(len(text), at + CHUNK)
            while past < len(text) and (text[past].isalnum() or text[past] == "_"):
                past += 1
            words = words_of(text[at:past])
            out.append(np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words)))
            at = past
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> list[list[tuple]]:
        """Per text its verified items: (item, score, question overlap, answer overlap, first word of the passage)."""
        found: list[dict[int, tuple]] = [{} for _ in texts]
        batch, size = [], 0
        longest = 2 * max((x.stride for x in self.indexes), default=0)
        for i, text in enumerate(texts):
            ids = self.ids(text) if text else np.zeros(0, np.int64)
            for at in range(0, len(ids), CHUNK):  # passages over a cut lie whole in the piece before it
                piece = ids[at: at + CHUNK + longest]
                batch.append((i, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    self.look(batch, found)
                    batch, size = [], 0
        self.look(batch, found)
        return [sorted(f.values()) for f in found]

    def look(self, batch: list[tuple[int, int, np.ndarray]], found: list[dict[int, tuple]]) -> None:
        if not batch:
            return
        lengths = [len(p) for _, _, p in batch]
        ids = np.concatenate([p for _, _, p in batch])
        doc, pos = np.repeat(np.arange(len(batch)), lengths), _ranges(np.zeros(len(batch), np.int64), np.array(lengths))
        for index in self.indexes:
            for d, block, item, score in index.search(ids, doc, pos, self.threshold):
                i, at, piece = batch[d]
                start = block * index.stride
                held = shingles(piece[start: start + 2 * index.stride])
                short = piece[start: start + 2 * index.stride].tolist()
                question, answer = (self.overlap(part, held, short) for part in index.parts[item])
                if min(question, answer) >= OVERLAP:
                    number, new = index.numbers[item], (index.numbers[item], score, question, answer, at + start)
                    old = found[i].get(number)
                    if old is None or (score, -new[4]) > (old[1], -old[4]):
                        found[i][number] = new

    @staticmethod
    def overlap(part: set, held: set, passage: list[int]) -> float:
        """Share of the part's shingles in the passage; an absent part is held, one shorter than a shingle is looked for as it is."""
        if not part:
            return 1.0
        n = len(next(iter(part)))
        if n < SHINGLE:
            words = next(iter(part))
            return float(any(tuple(passage[i: i + n]) == words for i in range(len(passage) - n + 1)))
        return len(part & held) / len(part)


def searchers(benchmark: DataFrame, item_id: str, text: str, threshold: float, shard_words: int) -> list[tuple[DataFrame, Searcher]]:
    """(numbered items, their Searcher) per shard; document frequencies are those of all items.

    A shard holds about ``shard_words`` words, so what is broadcast at once does not grow with the benchmark.
    """
    n_words = F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0)))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), n_words.alias("n")).filter("n > 0")
    total, count = items.agg(F.sum("n"), F.count("*")).first()
    if not count:
        return []
    shards = -(-total // shard_words)
    items = cut_lineage(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")))

    @F.pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(words_of(t))))

    df = items.select("shard", F.explode(distinct("text")).alias("w"))
    df = cut_lineage(df.groupBy("w").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards")))
    out = []
    for k in range(shards):
        own = items.filter(F.col("shard") == k).orderBy("item_id", "text").collect()
        weights = {r["w"]: r["df"] for r in df.filter(F.array_contains("shards", k)).select("w", "df").collect()}
        names = benchmark.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {benchmark.schema[item_id].dataType.simpleString()}") if own else None
        if names is not None:
            out.append((names, Searcher([(i, r["text"]) for i, r in enumerate(own)], weights, count, total / count, threshold)))
    return out


def _finder(spark: SparkSession, searcher: Searcher, text: str) -> Column:
    shared = spark.sparkContext.broadcast(searcher)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item", "score", "question_overlap", "answer_overlap", "word"), x)) for x in found] for found in shared.value(texts.tolist())])

    return find(F.col(text))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, word): every test item that a document holds.

    An item is held if at least ``OVERLAP`` of the five-word shingles of its question, and that share of its answer's, lie in one passage of at most twice its length class; an
    item of one line has no answer to look for. Words are lower-cased runs of letters, digits and _. score is the BM25 score over the item's own, word
    the first word of the best passage. Null and empty texts hold nothing and items without words are never held; repeated
    rows give repeated results; an empty table gives an empty result. Very long texts are searched whole, in pieces that overlap by a passage; other columns are not read. Documents are searched where they lie: nothing of them is shuffled.
    """
    spark, out = docs.sparkSession, None
    for names, searcher in searchers(benchmark, item_id, item_text, threshold, shard_words):
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.inline(_finder(spark, searcher, text)))
        rows = rows.join(names, "item").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double, word long")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    rows = docs.select(F.struct("*").alias("r"))
    for _, searcher in searchers(benchmark, item_id, item_text, threshold, SHARD_WORDS):
        rows = rows.select("r", F.size(_finder(docs.sparkSession, searcher, f"r.{text}")).alias("n")).filter("n = 0").select("r")
    return rows.select("r.*")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op1_benchmark_leaks": op1_benchmark_leaks}
ORACLES: dict[str, str] = {}
