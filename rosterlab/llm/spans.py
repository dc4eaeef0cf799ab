"""Repeated windows of pieces (lines or sentences): found globally by hash, removed after their first place.

Three passes. Each document's windows are hashed in its task and written as arrays. One aggregate over (hash) gives the
first place of every hash that occurs twice; it combines before the shuffle, so a window that a third of the documents
hold arrives as one row per task. A join tells each document which of its windows are later ones, and the covered
positions are merged and cut out of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import map_batches, texts_of

#: Pieces of a text as (start, end) offsets, ascending; and windows over them as (hash, first piece, pieces).
Split = Callable[[str], list[tuple[int, int]]]
Windows = Callable[[str, list[tuple[int, int]]], list[tuple[int, int, int]]]


def hash64(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def merged(covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, count) ranges to disjoint ascending (first, past) ranges."""
    out: list[tuple[int, int]] = []
    for first, count in sorted(covered):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + count))
        else:
            out.append((first, first + count))
    return out


def cut_out(text: str, pieces: list[tuple[int, int]], covered: list[tuple[int, int]], tidy: Callable[[str], str]) -> tuple[str, int]:
    """The text without the covered pieces, each with what stands between it and the next, and the number cut.

    ``tidy`` mends the end where the last piece went.
    """
    out, at, n = [], 0, 0
    for first, past in merged(covered):
        out.append(text[at: pieces[first][0]])
        at = pieces[past][0] if past < len(pieces) else len(text)
        n += past - first
    rest = "".join([*out, text[at:]])
    return (tidy(rest) if n and at == len(text) else rest), n


def repeated_spans(docs: DataFrame, split: Split, windows: Windows, doc_id: str, text: str) -> DataFrame:
    """(d, th, spans): per document with something to remove, its id, text hash and the (s, n) windows that are not the first."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [windows(t, split(t)) for t in texts_of(batch, "t")]
        yield {"d": batch.column("d"), "th": batch.column("th"), "h": [[x[0] for x in w] for w in found], "s": [[x[1] for x in w] for w in found], "n": [[x[2] for x in w] for w in found]}

    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    hashed = cut_lineage(map_batches(rows, run, f"d {kind}, th long, h array<long>, s array<int>, n array<int>"))
    flat = hashed.select("d", "th", F.inline(F.arrays_zip("h", "s", "n")))
    place = F.struct(F.col("d").isNull().alias("z"), "d", "th", "s")
    first = flat.groupBy("h").agg(F.count("*").alias("c"), F.min(place).alias("f")).filter("c > 1").select("h", "f")
    later = flat.join(first, "h").filter(place != F.col("f"))
    return later.groupBy("d", "th").agg(F.collect_set(F.struct("s", "n")).alias("spans"))


def remove_repeated(docs: DataFrame, split: Split, windows: Windows, tidy: Callable[[str], str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(r, text, n_removed): every row of ``docs`` as a struct, its text without repeated pieces, and how many were cut."""
    spans = repeated_spans(docs, split, windows, doc_id, text)

    @F.pandas_udf("text string, n_removed int")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, covered in batches:
            done = [(None, 0) if t is None else cut_out(t, split(t), [(x["s"], x["n"]) for x in c], tidy) for t, c in zip(texts, covered)]
            yield pd.DataFrame(done, columns=["text", "n_removed"])

    rows = docs.select(F.struct("*").alias("r"), F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    spans = spans.select(F.col("d").alias("sd"), F.col("th").alias("st"), "spans")
    both = rows.join(spans, rows.d.eqNullSafe(spans.sd) & (rows.th == spans.st), "left")
    # only the texts that change go to Python
    both = both.withColumn("c", cut(F.when(F.col("spans").isNotNull(), F.col("t")), "spans"))
    return both.select("r", F.coalesce("c.text", "t").alias("text"), F.col("c.n_removed").alias("n_removed"))
