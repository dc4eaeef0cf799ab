"""Quality classifier: a generalised additive model with pairwise interactions.

A text is a vector of measures of its whole content. Each measure has a lookup table over quantile bins, and each chosen pair of measures one over
a coarser grid; shallow trees, boosted in turns over the measures, fill them. The score is the logistic of a sum of table entries, so a batch
is scored by one addition of looked-up bins per table. The tables are fitted on a bounded sample of labelled rows; every text is measured and scored in its task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bytes_of, id_mod, map_batches, table

SAMPLE = 20_000  # labelled rows the tables are fitted on, at most
BINS, GRID = 48, 12  # bins of a measure; of each of two measures in a pair
ROUNDS, PAIR_ROUNDS = 150, 60
PAIRS = 8
RATE, CALM = 0.1, 1.0  # step, and what is added to every leaf's weight
CUT = 0.3  # the contract's bound of ``predicted``
PIECE = 1 << 20  # bytes looked at together

MEASURES = [
    "words", "chars", "chars_per_word", "longest_word", "upper", "digits", "symbols", "bars", "marks", "stops", "blanks", "lines_per_word", "beyond_ascii",
    "odd_word_ends", "words_without_letter", "capital_words", "title_words", "one_char_words", "distinct_words", "most_frequent", "stutter", "repeated_windows", "repeated_lines",
    "line_ends", "packed", "entropy",
]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CLASSES = {  # fixed sets of bytes
    "digits": b"0123456789", "symbols": b"#$%&*<>@^_~=+\\/{}[]`", "bars": b"|", "marks": b"!?", "stops": b".,;:", "blanks": b" \t\n\x0b\x0c\r",
}
_PLAIN_END = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:'\")") | frozenset(range(128, 256))
_NO_LETTER = bytes(range(0, 65)) + bytes(range(91, 97)) + bytes(range(123, 128))


def measures(text: bytes | memoryview) -> np.ndarray:
    """The measures of a whole text, read in pieces that end between words."""
    histogram, packer, packed = np.zeros(256, np.int64), zlib.compressobj(1), 0
    odd = bare = capital = title = single = longest = n = 0
    hashed, lines, ended, line, at = [], [], 0, b"", 0
    while at < len(text):
        past = min(len(text), at + PIECE)
        while past < len(text) and text[past] not in b" \t\n\x0b\x0c\r":
            past += 1
        piece = bytes(text[at:past])
        at = past
        histogram += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        packed += len(packer.compress(piece))
        words = piece.split()
        n += len(words)
        odd += sum(w[-1] not in _PLAIN_END for w in words)
        bare += sum(not w.translate(None, _NO_LETTER) for w in words)
        capital += sum(map(bytes.isupper, words))
        title += sum(map(bytes.istitle, words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        single += int((sizes == 1).sum())
        longest = max(longest, int(sizes.max(initial=0)))
        hashed.append(np.fromiter(map(hash, words), np.int64, len(words)))
        *full, line = (line + piece).split(b"\n")
        for x in (x for x in map(bytes.strip, full) if x):
            lines.append(hash(x))
            ended += x[-1] in b".!?:\"'"
    if x := line.strip():
        lines.append(hash(x))
        ended += x[-1] in b".!?:\"'"
    packed += len(packer.flush())
    size = max(1, len(text))
    own = max(1, n)
    words = np.concatenate(hashed) if hashed else np.zeros(0, np.int64)
    _, counts = np.unique(words, return_counts=True)
    windows = words[:-2] * 1_000_003 + words[1:-1] * 998_244_353 + words[2:] if n > 2 else np.zeros(0, np.int64)
    share = lambda found: float(histogram[list(found)].sum()) / size
    spread = histogram[histogram > 0] / size
    letters = max(1, int(histogram[65:91].sum() + histogram[97:123].sum()))
    return np.array([
        np.log1p(n), np.log1p(size - histogram[128:192].sum()), (size - share(_CLASSES["blanks"]) * size) / own, np.log1p(longest), histogram[_UPPER].sum() / letters,
        *(share(_CLASSES[c]) for c in ("digits", "symbols", "bars", "marks", "stops", "blanks")), histogram[10] / own, histogram[192:].sum() / size,
        odd / own, bare / own, capital / own, title / own, single / own, len(counts) / own, counts.max(initial=0) / own,
        float((words[1:] == words[:-1]).sum()) / own, 1 - len(np.unique(windows)) / max(1, len(windows)), 1 - len(set(lines)) / max(1, len(lines)),
        ended / max(1, len(lines)), packed / size if len(text) else 0.0, -float((spread * np.log2(spread)).sum()),
    ], np.float32)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + CALM)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut along the last axis; sums over the bins of one node."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl * _leaf(gl, hl) + (g.sum() - gl) * _leaf(g.sum() - gl, h.sum() - hl) - g.sum() * _leaf(g.sum(), h.sum())
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree with up to three leaves over one measure's bins."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    gain, cut = _best_cut(g, h)
    if gain <= 1e-9:
        return out
    sides = [slice(0, cut), slice(cut, len(g))]
    for s in sides:
        out[s] = _leaf(g[s].sum(), h[s].sum())
    (gain, again), side = max((( _best_cut(g[s], h[s])), i) for i, s in enumerate(sides))
    if gain > 1e-9:
        s = sides[side]
        for part in (slice(s.start, s.start + again), slice(s.start + again, s.stop)):
            out[part] = _leaf(g[part].sum(), h[part].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """(leaf value per cell, gain) of a tree of depth two over a grid: one cut along one measure, then one along the other on each side."""
    best, best_gain = np.zeros(g.shape), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, cut = _best_cut(a.sum(1), b.sum(1))
        if gain <= 1e-9:
            cut = a.shape[0] // 2  # an interaction may show on neither measure alone
        out, total = np.zeros(a.shape), -a.sum() * _leaf(a.sum(), b.sum())
        for rows in (slice(0, cut), slice(cut, a.shape[0])):
            _, along = _best_cut(a[rows].sum(0), b[rows].sum(0))
            for columns in (slice(0, along), slice(along, a.shape[1])):
                s, w = a[rows, columns].sum(), b[rows, columns].sum()
                out[rows, columns] = _leaf(s, w)
                total += s * _leaf(s, w)
        if total > best_gain:
            best, best_gain = (out.T if turned else out), float(total)
    return best, best_gain


class Model:
    """Lookup tables: of single measures, over their bins, and of pairs of measures, over two grids. Its size is fixed by the parameters above."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS):
        self.edges: list[np.ndarray] = []
        self.grid: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        mean = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return  # nothing to tell apart
        self.edges = [self._cuts(c, BINS) for c in x.T]
        self.grid = [self._cuts(c, GRID) for c in x.T]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            for t, b in zip(self.tables, bins):
                p = 1 / (1 + np.exp(-f))
                step = RATE * shallow_tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
                t += step
                f += step[b]
        grids = [np.searchsorted(e, c, "right") for e, c in zip(self.grid, x.T)]
        cells = lambda i, j: grids[i] * (len(self.grid[j]) + 1) + grids[j]
        shape = lambda i, j: (len(self.grid[i]) + 1, len(self.grid[j]) + 1)
        sums = lambda c, v, s: np.bincount(c, v, s[0] * s[1]).reshape(s)
        p = 1 / (1 + np.exp(-f))
        ranked = []
        for i in range(len(bins)):
            for j in range(i + 1, len(bins)):
                s = shape(i, j)
                ranked.append((pair_tree(sums(cells(i, j), y - p, s), sums(cells(i, j), p * (1 - p), s))[1], -i, -j))
        self.pairs = [(-i, -j) for gain, i, j in sorted(ranked, reverse=True)[:pairs] if gain > 0]
        self.pair_tables = [np.zeros(shape(i, j)) for i, j in self.pairs]
        own = [cells(i, j) for i, j in self.pairs]
        for _ in range(pair_rounds):
            for t, c in zip(self.pair_tables, own):
                p = 1 / (1 + np.exp(-f))
                step = RATE * pair_tree(sums(c, y - p, t.shape), sums(c, p * (1 - p), t.shape))[0]
                t += step
                f += step.ravel()[c]

    @staticmethod
    def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
        """Edges between quantile bins; a value that many rows hold has a bin of its own."""
        return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="inverted_cdf"))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for e, t, c in zip(self.edges, self.tables, x.T):
            f += t[np.searchsorted(e, c, "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            f += t[np.searchsorted(self.grid[i], x[:, i], "right"), np.searchsorted(self.grid[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows, drawn by a hash of the id; copies of one text with one label teach once.

    A document whose labels contradict each other teaches nothing, nor does a null label or id. What reaches the driver of a row is its label and its measures, of fixed
    size; the only texts that are shuffled are the drawn ones, to meet their labels.
    """
    key = lambda c: F.pmod(F.xxhash64(F.lit("sample"), c.cast("string")), F.lit(1 << 40))
    marks = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("m")).agg(F.min(label).alias("y"), F.max(label).alias("other"))
    marks = marks.filter("y = other").select("m", F.col("y").cast("int").alias("y"))
    n = marks.count()
    if not n:
        return Model(np.zeros((0, len(MEASURES)), np.float32), np.zeros(0))
    span = (1 << 40) * sample // n + 1
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"d": batch.column("d"), "th": batch.column("th"), "v": [measures(t).tobytes() for t in bytes_of(batch, "t")]}

    few = docs.filter(F.col(doc_id).isNotNull() & (key(F.col(doc_id)) < span)).select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    marks = marks.filter(key(F.col("m")) < span)
    told = map_batches(few.join(marks.select(F.col("m").alias("d")), "d", "left_semi"), run, f"d {kind}, th long, v binary").join(marks, F.col("d") == F.col("m"))
    # the hash range holds about the sample; the limit makes it a bound whatever the ids are
    rows = told.groupBy("th", "y").agg(F.min("v").alias("v")).orderBy("th", "y").limit(sample).collect()
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in rows]) if rows else np.zeros((0, len(MEASURES)), np.float32)
    return Model(x, np.array([float(r["y"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The chance, between 0 and 1, that a whole text is of label 1; null texts are empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = [measures((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pd.Series(shared.value(np.stack(x)) if x else [], dtype=float)

    return run(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, training: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``docs`` as struct ``r`` with its score.

    Learns from the labelled documents for which ``training`` (over the columns of ``docs``) holds, all if None. Null and empty texts are scored like any other; equal texts get
    equal scores; very long ones are measured whole, in pieces. Without labels, or with one label only, every score is the share of label 1, smoothed. An empty table gives
    no rows. All columns stay inside ``r``, so their names cannot clash.
    """
    model = fit(docs if training is None else docs.filter(training), labels, doc_id, text, label, sample)
    return docs.select(F.struct("*").alias("r"), score(docs, model, text).alias("score"))


def op11_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from those whose crc32 of the id is not 0 modulo 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = lambda c: id_mod(F.col(c), 5, missing=0) == 0
    done = classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ~held("doc_id"))
    return done.select("r.doc_id", held("r.doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op11_quality_gam": op11_quality_gam}
ORACLES: dict[str, str] = {}
