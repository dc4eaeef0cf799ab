"""Rows that every operator must bear, and plain versions of what operators share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r string, t string, d long, th long, h long, n int, p double, x int, size long, spans string, item int, copies int"


def prose(rng, n, words=400):
    bank = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(words)]
    return " ".join(w + ("." if rng.random() < 0.12 else "") + ("\n" if rng.random() < 0.05 else "") for w in rng.choices(bank, k=n))


def odd_rows():
    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t ", "a", "One two three four five.", "\n\n\n", "née Ünïcode 中文字符 🙂   x", "word " * 2000, long, long, long[: len(long) // 2], "z" * 200_000, "A\nB\nC\nD", "A\nB\nC\nE", "\x00\x1c \x85"]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s0", None, "s1", "s0"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "One two three four five.", None, None, 1), (None, None, None, None, None), (None, None, None, None, None)]
    return [(*x, "r", "t", 1, 2, 3, 4, 5.0, 6, 7, "s", 8, 9) for x in rows]


def odd_frame(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
