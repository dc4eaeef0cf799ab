"""Line dedup over overlapping windows of three lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .spans import hash64, remove_repeated

WINDOW = 3
_LINE = re.compile(r"[^\n]+")


def lines(text: str) -> list[tuple[int, int]]:
    """Offsets of the lines with anything but the ASCII white space in them."""
    return [m.span() for m in _LINE.finditer(text) if m[0].strip(" \t\n\x0b\x0c\r")]


def line_windows(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    parts = [text[a:b] for a, b in pieces]
    return [(hash64("\n".join(parts[i: i + WINDOW])), i, WINDOW) for i in range(len(parts) - WINDOW + 1)]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(r, text, n_removed): ``docs`` without the lines of windows of three lines that occurred before.

    Windows run over consecutive lines with a word; lines are compared exactly. A window's first place, by (doc_id, position), keeps its lines, nulls
    last; every later one loses them, in the same document too. Blank lines after a removed line go with it. Texts of fewer than three such lines and null texts are
    unchanged; rows that repeat id and text are one document. Windows meet by 64-bit hash.
    """
    return remove_repeated(docs, lines, line_windows, lambda rest: rest.removesuffix("\n"), doc_id, text)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated three-line windows, with the number of lines removed."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("r.doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
full_lines AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM raw WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
win AS (SELECT doc_id, p, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS seen FROM win WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (VALUES (0), (1), (2)) t(k) WHERE seen > 1),
numbered AS (SELECT r.doc_id, r.line, r.pos, count(f.pos) OVER (PARTITION BY r.doc_id ORDER BY r.pos) AS p FROM raw r LEFT JOIN full_lines f USING (doc_id, pos)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM numbered ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(g.n, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
""",
}
