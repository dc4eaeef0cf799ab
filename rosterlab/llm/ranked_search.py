"""Ranked lexical search: the best documents for each query, exactly, with a limited number of accumulators.

Documents are read once: a task keeps of each its length and how often it holds each term of the queries. The statistics of all
documents follow from that table. Then blocks of documents are searched in the tasks that hold them, term at a time and rarest term first. A document gets an
accumulator when one of these terms first meets it; as soon as the largest weights of the terms still to come add up to less than the k-th partial score,
no document without an accumulator can be among the best, so none is made any more, and those there are get their remaining terms exactly.
A task carries the k best of its earlier blocks along, so that later ones stop sooner. What is shuffled are k rows per query and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage
from ..skew import top_per_key
from .common import bytes_of, map_batches, table

TOP = 10
SHARD_CHARS = 8_000_000  # characters of queries searched for together; more make more passes over the documents
PIECE = 1 << 22  # bytes of a text looked at together
BLOCK_POSTINGS = 1 << 20  # entries of an index block
# Bytes of terms as they are but for A-Z, all others as a blank: every byte from 128 on is part of a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def pieces_of(text: bytes | memoryview, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces that end between terms."""
    at = 0
    while at < len(text):
        past = min(len(text), at + size)
        while past < len(text) and _TERMS[text[past]] != 32:
            past += 1
        yield bytes(text[at:past])
        at = past


def terms_of(text: bytes | memoryview) -> Iterator[list[bytes]]:
    for piece in pieces_of(text):
        yield piece.translate(_TERMS).split()


def postings_of(text: bytes | memoryview, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of terms, numbers of the known ones ascending, how often each occurs)."""
    n, known = 0, []
    for words in terms_of(text):
        n += len(words)
        ids = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
        known.append(ids[ids >= 0])
    term, tf = np.unique(np.concatenate(known), return_counts=True) if known else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return n, term, tf.astype(np.int32)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of at most SHARD_CHARS characters

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [postings_of(t, shared.value) for t in bytes_of(batch, "t")]
        keep = np.flatnonzero([f[0] > 0 for f in found])
        if len(keep):
            at = np.concatenate(([0], np.cumsum([len(found[i][1]) for i in keep]))).astype(np.int32)
            listed = lambda part: pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([found[i][part] for i in keep]), pa.int32()))
            yield {"doc_id": batch.column("d").take(pa.array(keep)), "n": [found[i][0] for i in keep], "terms": listed(1), "tfs": listed(2)}

    return map_batches(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Best:
    """The k best (score, document) of one query so far: larger scores first, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A score below this one is not among the best; 0 and less never is."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, rows: list[tuple[int, object]]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1]))[: self.k]


class Block:
    """An index of some documents: per term the places of the documents that hold it, ascending, and what it adds to their scores."""

    def __init__(self, ids: list, n: list[int], count: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int):
        self.ids = ids
        m = np.array([10 + 90 * x * documents // length for x in n], np.int64)
        place = np.repeat(np.arange(len(ids)), count)
        order = np.argsort(term, kind="stable")
        term, tf, self.place = term[order], tf[order].astype(np.int64), place[order]
        self.gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.place]))
        self.terms = np.flatnonzero(np.bincount(term, minlength=len(weight)))
        self.at = np.searchsorted(term, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        if len(term):
            self.most[self.terms] = np.maximum.reduceat(self.gain, self.at[self.terms])
        self.acc = np.zeros(len(ids), np.int64)

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Adds this block's documents for a query with these terms, rarest first, to the best so far."""
        terms = terms[self.most[terms] > 0]
        left = int(self.most[terms].sum())  # the most that terms still to come can add
        if left < best.least:
            return
        acc, made, kth, k = self.acc, None, best.least, best.k
        for t in terms.tolist():
            place, gain = self.place[self.at[t]: self.at[t + 1]], self.gain[self.at[t]: self.at[t + 1]]
            if made is None and left < kth:
                made = np.flatnonzero(acc)
                score = acc[made]
            if made is None:
                acc[place] += gain
                partial = acc[acc > 0]
                if len(partial) >= k:
                    kth = max(kth, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            elif len(made):
                i = np.minimum(np.searchsorted(place, made), len(place) - 1)
                score += np.where(place[i] == made, gain[i], 0)
            left -= int(self.most[t])
        if made is None:
            made = np.flatnonzero(acc)
            score = acc[made]
        self.acc[:] = 0
        least = max(best.least, int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else 1)
        keep = np.flatnonzero(score >= least).tolist()
        if keep:
            best.add([(int(score[i]), self.ids[made[i]]) for i in keep])


def _search_blocks(batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], weight: np.ndarray, documents: int, length: int, k: int, out: pa.Schema, block_postings: int) -> Iterator[pa.RecordBatch]:
    """(query, doc_id, score): the k best of one task's documents per query."""
    best = [Best(k) for _ in queries]
    held: list[pa.RecordBatch] = []

    def look() -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        if not rows.num_rows:
            return
        flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in rows[c].chunks])
        count = np.concatenate([x.value_lengths().to_numpy() for x in rows["terms"].chunks])
        block = Block(rows["doc_id"].to_pylist(), rows["n"].to_pylist(), count, flat("terms"), flat("tfs"), weight, documents, length)
        for terms, found in zip(queries, best):
            block.search(terms, found)

    size = 0
    for batch in batches:
        at = 0
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
        while at < batch.num_rows:  # a block ends after the row that fills it
            past = min(batch.num_rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_postings - size)) + 1)
            held.append(batch.slice(at, past - at))
            size += int(ends[past - 1] - (ends[at - 1] if at else 0))
            at = past
            if size >= block_postings:
                look()
                held, size = [], 0
    if held:
        look()
    rows = [(q, d, s) for q, found in enumerate(best) for s, d in found.rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)


def search_all(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP,
               shard_chars: int = SHARD_CHARS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every query, scores above 0 only.

    Terms are runs of ASCII letters and digits and of everything beyond ASCII, only A-Z lower-cased; the whole text counts. A score sums, over the query's distinct terms,
    w * (10^9 tf div (1000 tf + 8 m)): w = floor(1000 ln((2N+2) / (2df+1))), m = 10 + 90 n N div L, with N documents that have a term, L their terms and n those of the
    document. Equal scores rank by ascending id, null last; ranks are unique.

    Null and empty texts, and those without a term, are no documents and no queries. A row that repeats another is a document of its own and ranks beside it;
    queries equal in id and text are one, those that share only an id rank each on their own. Very long texts are read in pieces and counted whole. Empty tables on
    either side give no rows. Only the named columns are read, so others may have any name. Queries are dealt into shards of about ``shard_chars`` characters, each with its
    own pass over the documents, so that what is broadcast does not grow with them; a single longer query is a shard of its own.
    """
    spark = docs.sparkSession
    items = queries.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.length("text") > 0).distinct()
    kinds = docs.schema[doc_id].dataType.simpleString(), queries.schema[item_id].dataType.simpleString()
    found = f"query int, doc_id {kinds[0]}, score long"
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards, out = -(-total // shard_chars), None
    if shards > 1:
        items = cut_lineage(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")))
    for shard in range(shards):
        own = (items if shards == 1 else items.filter(F.col("shard") == shard)).select("item_id", "text").collect()
        vocabulary: dict[bytes, int] = {}
        named = [(r["item_id"], sorted({vocabulary.setdefault(w, len(vocabulary)) for words in terms_of(r["text"].encode()) for w in words})) for r in own]
        named = [x for x in named if x[1]]
        if not named:
            continue
        index = cut_lineage(postings(docs, vocabulary, doc_id, text))
        documents, length = index.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the shard
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        rarest = [np.array(sorted((t for t in terms if df[t]), key=lambda t: (df[t], t)), np.int64) for _, terms in named]
        shared = spark.sparkContext.broadcast((rarest, weight, documents, length))
        schema = to_arrow_schema(StructType.fromDDL(found))
        rows = index.mapInArrow(lambda it, s=shared, schema=schema: _search_blocks(it, *s.value, k, schema, block_postings), found)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(named)], f"query int, item_id {kinds[1]}")
        best = top_per_key(rows, ["query"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, "rank")
        best = best.join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search_all(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {
    "op13_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (
  SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
m AS (SELECT r, 10 + (90 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM d, total WHERE len(ts) > 0),
s AS (
  SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
""",
}
