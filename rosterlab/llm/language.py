"""Language identification in two steps: the family first, then linear support vector machines inside it.

A text is one vector of hashed three-byte counts, over all of it. A multinomial logistic model names the family; for every pair of
languages of a family a linear SVM votes. The models are fitted on a bounded sample of labelled rows; every text is predicted in its task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import id_mod, map_batches, table, texts_of

BITS = 12  # buckets of three-byte groups: 2 ** BITS
PER_LANGUAGE = 400  # rows the models are fitted on, per language
MOST_ROWS = 4000  # and in all: with many languages each gets its share
LEAST_ROWS = 20  # but so many at least: every label is learned, so the sample grows with the labels, not with the rows
CHUNK = 1 << 20  # characters looked at together
# Which languages are close relatives. A label that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "finnic": "et fi",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "malayic": "id jv ms tl",
    "sinitic": "wuu yue zh",
}
_BLANKED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))  # ASCII other than letters is one blank
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    root = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if root in members.split()), f"own:{lang}")


def has_letter(text: str) -> bool:
    import regex

    return bool(_LETTER.search(text)) and bool(regex.search(r"\p{L}", text))


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed counts of the three-byte groups of the lower-cased text, ASCII non-letters as one blank."""
    out = np.zeros(1 << bits, np.int64)
    for i in range(0, max(1, len(text)), CHUNK):
        raw = b" " + text[max(0, i - 2): i + CHUNK].lower().encode("utf-8", "replace").translate(_BLANKED) + b" "
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code = code[(b[1:-1] != 32) | (b[:-2] != 32)]  # runs of blanks say nothing
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def vector(text: str) -> np.ndarray:
    """Square roots of the counts, of length 1."""
    v = np.sqrt(counts(text))
    return (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_families(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 200, rate: float = 20.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (features, k) of a logistic model by gradient descent, classes weighted alike."""
    w, hot = np.zeros((x.shape[1], k), np.float32), np.eye(k, dtype=np.float32)[y]
    share = ((1 / np.maximum(hot.sum(0), 1))[y][:, None] / k).astype(np.float32)
    for _ in range(rounds):
        w -= rate * (x.T @ ((_softmax(x @ w) - hot) * share) + decay * w)
    return w


def fit_svm(x: np.ndarray, sign: np.ndarray, rounds: int = 200, rate: float = 10.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, both sides weighted alike."""
    w, sign = np.zeros(x.shape[1], np.float32), sign.astype(np.float32)
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    for _ in range(rounds):
        w += rate * (x.T @ (sign * share * np.maximum(0, 1 - sign * (x @ w))) - decay * w)
    return w


class Model:
    """What is sent to the tasks: languages, their families, and the weights of every classifier in one matrix."""

    def __init__(self, vectors: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        self.family = np.array([self.families.index(family_of(x)) for x in self.langs], int)
        self.pairs = [(a, b) for a in range(len(self.langs)) for b in range(a + 1, len(self.langs)) if self.family[a] == self.family[b]]
        if not self.langs:
            return
        x = np.stack([np.frombuffer(v, np.float32) for v in vectors])
        y = np.array([self.langs.index(t) for t in langs])
        self.weights = [fit_families(x, self.family[y], len(self.families))]
        for a, b in self.pairs:
            own = (y == a) | (y == b)
            self.weights.append(fit_svm(x[own], np.where(y[own] == a, 1.0, -1.0))[:, None])
        self.weights = np.hstack(self.weights).astype(np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        z = vector(text) @ self.weights
        p = _softmax(z[: len(self.families)].astype(float))
        best = int(p.argmax())
        members = np.flatnonzero(self.family == best)
        if len(members) == 1:
            return self.langs[members[0]], float(p[best])
        votes, won = np.zeros(len(self.langs)), np.zeros(len(self.langs))
        for (a, b), margin in zip(self.pairs, z[len(self.families):].astype(float)):
            if self.family[a] == best:
                q = 1 / (1 + np.exp(-np.clip(4 * margin, -50, 50)))
                votes[a], votes[b] = votes[a] + q, votes[b] + 1 - q
                won[a if margin >= 0 else b] += 1
        lang = max(members.tolist(), key=lambda m: (won[m], votes[m], -m))
        return self.langs[lang], float(p[best] * votes[lang] / (len(members) - 1))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits on ``per_language`` distinct texts of each label, drawn by a hash of the text.

    The sample is bounded by this parameter and ``MOST_ROWS``, or ``LEAST_ROWS`` of each label where that is more; what reaches the driver of a row is its vector, of fixed size, computed from
    the whole text. Rows without a letter are no examples. All else about the operator sees every row.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # copies share one hash and teach once, so it is distinct texts that count
    labels = rows.select("lang", "h").distinct().groupBy("lang").count().orderBy("lang").collect()
    if not labels:
        return Model([], [])
    each = min(per_language, max(LEAST_ROWS, MOST_ROWS // len(labels)))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"lang": batch.column("lang"), "h": batch.column("h"), "v": [vector(t).tobytes() for t in texts_of(batch, "t")]}

    # hashes are spread evenly, so a language's count says which range of them holds about the texts wanted: no ranking, no sort;
    # where the range held too few it is doubled, until it holds them or is all
    span = {r["lang"]: (1 << 40) * each * 5 // (4 * r["count"]) + 1 for r in labels}
    texts, short, sample = {r["lang"]: r["count"] for r in labels}, set(span), []
    while short:
        ranges = F.create_map(*[F.lit(v) for x in sorted(short) for v in (x, span[x])])
        few = rows.filter(F.pmod("h", F.lit(1 << 40)) < ranges[F.col("lang")]).select("lang", "h", F.col("text").alias("t")).dropDuplicates(["lang", "h"])
        found = map_batches(few, run, "lang string, h long, v binary").collect()
        held = Counter(r["lang"] for r in found)
        enough = {x for x in short if held[x] >= min(each, texts[x]) or span[x] >= 1 << 40}
        sample += [r for r in found if r["lang"] in enough]
        short -= enough
        span.update({x: 2 * span[x] for x in short})
    own: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"] % (1 << 40), r["h"])):
        if len(own.setdefault(r["lang"], [])) < each:
            own[r["lang"]].append(r["v"])
    return Model([v for vs in own.values() for v in vs], [x for x, vs in own.items() for _ in vs])


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang, score) of the whole text: ``und`` and 0 where it is null, has no letter, or nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times buckets, both bounded

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value(t) for t in texts], columns=["lang", "score"])

    return run(F.col(text))


def identify(docs: DataFrame, training: Column | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` as struct ``r`` with lang_pred and score.

    Learns from the rows where ``training`` holds (all, if None) and ``lang`` is not null. Repeated rows get equal predictions;
    an empty table, or one without labels, learns nothing and gives ``und``.
    """
    model = fit(docs if training is None else docs.filter(training), text, lang)
    found = docs.select(F.struct("*").alias("r"), predict(docs, model, text).alias("p"))
    return found.select("r", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 of the id is not 1 modulo 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_mod(F.col("doc_id"), 3, missing=0) == 1
    done = identify(docs, ~held)
    return done.select("r.doc_id", (id_mod(F.col("r.doc_id"), 3, missing=0) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
