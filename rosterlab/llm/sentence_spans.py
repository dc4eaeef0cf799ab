"""Substring dedup over sliding runs of consecutive sentences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .spans import hash64, remove_repeated

RUN = 2  # sentences in a run, at least
RUN_WORDS = 20  # a run goes on until it has so many words: shorter ones are common phrases
LONG_SENTENCE = 25  # a sentence of so many words is a run by itself too
# A sentence ends after . ! ? … with any closing marks, before white space; after a wide full stop; and at a line's end.
_END = re.compile(r"[.!?…]+[^\w\s]*(?!\S)|[。！？]+[”’」』）]*|\n")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Scripts without blanks between words: a letter of the first kind (Chinese, Japanese) is a word, and so are up to four of the second (Thai, Lao, Burmese, Khmer).
_UNSPACED = re.compile(r"[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]{1,4}")


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of the sentences, without the white space between them."""
    out, at = [], 0
    for past in [*(m.end() for m in _END.finditer(text)), len(text)]:
        piece = text[at:past].strip()
        if piece:
            start = text.index(piece, at)
            out.append((start, start + len(piece)))
        at = past
    return out


def n_words(part: str) -> int:
    """Words of a sentence with single blanks; by letters where the script has no blanks."""
    n = part.count(" ") + 1 if part else 0
    return n if part.isascii() else max(n, len(_UNSPACED.findall(part)))


def sentence_windows(text: str, pieces: list[tuple[int, int]], run: int = RUN, least: int = RUN_WORDS, long: int = LONG_SENTENCE) -> list[tuple[int, int, int]]:
    """(hash, first, sentences) of a run from each sentence: the shortest of ``run`` sentences or more with ``least`` words; and of each sentence with ``long`` words.

    Runs are compared word by word, so line breaks and double spaces inside them do not matter. Every sentence has a word, so no run has more than ``least`` sentences.
    """
    parts = [" ".join(_WORD.findall(text[a:b])) for a, b in pieces]
    words = [n_words(p) for p in parts]
    out, past, have = [], 0, 0
    for i in range(len(parts)):
        while past < len(parts) and (have < least or past - i < run):
            have += words[past]
            past += 1
        if have >= least and past - i >= run:
            out.append((hash64(" ".join(parts[i:past])), i, past - i))
        if words[i] >= long:
            out.append((hash64(parts[i]), i, 1))
        have -= words[i]
    return out


def dedup_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(r, text, n_removed): ``docs`` without the sentences of runs that occurred before.

    A run's first place, by (doc_id, position), keeps its sentences, nulls last; sentences of any later place go, in the
    same document too. From each sentence a run grows to ``RUN`` sentences and ``RUN_WORDS`` words, however short they are, and a sentence of ``LONG_SENTENCE`` words is a run
    too; so a repeated passage of over 50 words holds a run unless its ends cut all its sentences. What stands after a passage's last whole run stays.
    Where a script has no blanks, letters count as words: see ``n_words``.

    Null and empty texts and those without a run are unchanged; a very long text is split and hashed in its task, one at a time. Rows that repeat id and text are one document,
    each is returned. Other columns stay inside ``r``, so their names cannot clash. An empty table gives no rows. Runs meet by 64-bit hash.
    """
    return remove_repeated(docs, sentences, sentence_windows, str.rstrip, doc_id, text)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated sentence runs, with the number of sentences removed."""
    done = dedup_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("r.doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"))


QUERIES = {"op9_sentence_spans": op9_sentence_spans}
ORACLES: dict[str, str] = {}
