"""Token counts with the whole-token shortcut.

Before any text is read, every string of the vocabulary is put through the tokenizer alone: those that come out as
one token, their own, are proven. A text is cut into the pre-tokens that the tokenizer would merge inside; a proven one counts as one
token at once, and only the others go through the merges, once per distinct string and worker cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

LIMIT = 1024
CACHE = 600_000  # remembered merges of a worker; emptied when full, which changes no count
# The pre-token pattern of byte-level vocabularies; White_Space as the library has it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# The same for the standard library, which is faster; it differs on the characters that ``unlike`` lists.
PRE_TOKEN_RE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def unlike() -> re.Pattern:
    """Finds a character that ``re`` puts in another class (letter, number, white space, rest) than ``regex``, or one beyond U+FFFF."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    pairs = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\p{White_Space}", r"\s"), (r"[^\p{White_Space}\p{L}\p{N}]", r"[^\s\w]|_"))
    differ = sorted(set().union(*(set(regex.findall(a, every)) ^ set(re.findall(b, every)) for a, b in pairs)))
    return re.compile("[" + "".join(map(re.escape, differ)) + "\U00010000-\U0010FFFF]")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def prove_whole_tokens(model: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and that the tokenizer gives as one token, their own."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    special = {t["content"] for t in json.loads(model)["added_tokens"]}
    ids = range(tokenizer.get_vocab_size(with_added_tokens=False))
    strings = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    whole = regex.compile(PRE_TOKEN)
    tried = [(i, s) for i, s in zip(ids, strings) if s and "�" not in s and s not in special and whole.fullmatch(s)]
    found = tokenizer.encode_batch([s for _, s in tried], add_special_tokens=False)
    return frozenset(s for (i, s), e in zip(tried, found) if e.ids == [i])


def read_model(path: str) -> str:
    """The tokenizer file, which must be the byte-level kind whose pre-tokens ``PRE_TOKEN`` gives."""
    with open(path, encoding="utf-8") as f:
        model = f.read()
    own = json.loads(model)
    cut = own.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in own["added_tokens"])
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or own.get("normalizer") or not plain:
        raise ValueError("only byte-level vocabularies without a normalizer and prefix space are counted this way")
    return model


class Counter:
    """Counts tokens of texts; a worker keeps one, with the merges it has seen."""

    def __init__(self, model: str, proven: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        special = sorted((t["content"] for t in json.loads(model)["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.slow, self.fast, self.unlike = regex.compile(PRE_TOKEN).findall, re.compile(PRE_TOKEN_RE).findall, unlike().search
        self.letters = byte_letters()
        self.proven, self.known = proven, dict.fromkeys(proven, 1)

    def merge(self, pre_tokens: set[str]) -> None:
        if len(self.known) > len(self.proven) + CACHE:
            self.known.clear()
            self.known.update(dict.fromkeys(self.proven, 1))
        new = [t for t in pre_tokens if t not in self.known]
        tokenize = self.tokenizer.model.tokenize  # the library's merges, without its cutting
        for t in new:
            self.known[t] = len(tokenize(t.encode().decode("latin-1").translate(self.letters)))

    def plain(self, text: str) -> int:
        total, pieces = 0, self.slow(text) if self.unlike(text) else self.fast(text)
        for i in range(0, len(pieces), CACHE):
            some = pieces[i: i + CACHE]
            counts = list(map(self.known.get, some))
            if None in counts:
                self.merge({t for t, n in zip(some, counts) if n is None})
                counts = [n or self.known[t] for t, n in zip(some, counts)]
            total += sum(counts)
        return total

    def __call__(self, text: str) -> int:
        if self.special is None or not text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=1)
def counter(model: str, proven: frozenset[str]) -> Counter:
    """The worker's one counter: a task takes over what earlier ones have set up and seen."""
    return Counter(model, proven)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) appended.

    Null and empty texts have 0 of both; repeated rows are counted each; other columns pass through, but columns of
    these three names give way to the new ones. A special string in a text is the one token the library makes of it.
    """
    spark = docs.sparkSession
    model = read_model(path)
    shared = spark.sparkContext.broadcast((model, prove_whole_tokens(model)))  # bounded by the vocabulary file

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(*shared.value)
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    t = F.coalesce(F.col(text), F.lit(""))
    # Arrow batches end at a number of bytes as well as rows, so long texts do not pile up
    return docs.withColumns({"n_bytes": F.octet_length(t).cast("long"), "n_tokens": tokens(t)}).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
