"""Readers for messy snapshots: typed tables with rejects, unknown encodings, optional sources."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import blank_to_null, coerce


def typed(df: DataFrame, types: dict[str, str], row_key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects). A value that does not fit its type is NULL in the rows and one row
    (key, column, raw value) in the rejects, instead of staying text."""
    rows = df.select(*[coerce(F.col(c), types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    bad = [
        F.when(blank_to_null(F.col(c)).isNotNull() & coerce(F.col(c), k).isNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")))
        for c, k in types.items() if c in df.columns and k != "text"
    ]
    if not bad:
        nothing = F.lit(None).cast("string")
        return rows, df.select(*row_key, nothing.alias("field"), nothing.alias("raw")).filter(F.lit(False))
    rejects = df.select(*row_key, F.explode(F.array_compact(F.array(*bad))).alias("b")).select(*row_key, "b.*")
    return rows, rejects


def read_table(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Header-driven text table: every column a string, byte-order mark and outer spaces off the names.

    CSV and JSON lines ("jsonl") split into many tasks. Cells with line breaks need ``multi_line``, and a JSON array ("json") needs no
    telling; both make each file one task.
    """
    if fmt == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', mode="PERMISSIVE")
    elif fmt in ("json", "jsonl"):
        df = spark.read.json(path, multiLine=fmt == "json", primitivesAsString=True)
    else:
        df = spark.read.format(fmt).load(path)
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def read_json_table(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """Objects with a declared schema: a JSON array, one task per file, or with ``lines`` one object a line."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def decode_lines(lines: DataFrame, file: str = "file", raw: str = "raw", fallback: str = "ISO-8859-1") -> DataFrame:
    """Adds ``line`` and ``source_encoding``: UTF-8, or the fallback for every line of a file that has
    one line which is not valid UTF-8. The verdict is one small aggregate per file."""
    per_file = lines.groupBy(file).agg(F.min(F.is_valid_utf8(F.col(raw).cast("string"))).alias("_utf8"))
    text = F.when(F.col("_utf8"), F.col(raw).cast("string")).otherwise(F.decode(raw, fallback))
    encoding = F.when(F.col("_utf8"), "utf-8").otherwise(fallback)
    return lines.join(per_file, file).withColumn("line", F.regexp_replace(text, "^\ufeff", "")).withColumn(
        "source_encoding", encoding
    ).drop("_utf8", raw)


#: Cells of a CSV line: the commas outside quotes part them.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_cells(line: Column) -> Column:
    """The cells of one CSV line as an array: quoted ones without their quotes, empty ones NULL unless they are quoted."""
    whole = r'(?s)^"(.*)"$'

    def cell(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, whole, 1), F.lit('""'), F.lit('"'))
        return F.when(c.rlike(whole), inner).when(c != "", c)

    return F.transform(F.split(line, _COMMA, -1), cell)


def read_text_csv_any(spark: SparkSession, path: str, columns: Sequence[str], fallback: str = "ISO-8859-1", multi_line: bool = False) -> DataFrame:
    """CSV in UTF-8 or, per file, in the fallback encoding; columns by each file's own header.

    An aggregate gives every file its header and whether all its lines are valid UTF-8, and a join gives them to its lines, so that one plan reads any
    number of files with any headers and nothing about them reaches the driver. A column that a file lacks is NULL. ``multi_line`` is for cells
    with line breaks, which lines cannot show: see ``read_text_csv_whole``.
    """
    if multi_line:
        return read_text_csv_whole(spark, path, columns, fallback)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("_at"), "value")
    files = lines.groupBy("file").agg(F.min(F.is_valid_utf8("value")).alias("_ok"), F.min("_at").alias("_head"), F.min_by(F.col("value").cast("binary"), "_at").alias("_names"))
    told = lambda raw, text: F.regexp_replace(F.when(F.col("_ok"), text).otherwise(F.decode(raw, fallback)), "^\ufeff|\r$", "")
    names = F.transform(csv_cells(told(F.col("_names"), F.col("_names").cast("string"))), lambda c: F.trim(c))
    files = files.select("file", "_ok", "_head", names.alias("_names"))
    rows = lines.join(files, "file").filter(F.col("_at") != F.col("_head")).select("file", "_ok", "_names", told(F.col("value").cast("binary"), F.col("value")).alias("_line"))
    rows = rows.filter(F.trim("_line") != "").withColumn("_cells", csv_cells(F.col("_line")))
    own = [F.get("_cells", F.nullif(F.array_position("_names", F.lit(c)), F.lit(0)) - 1).alias(c) for c in columns]
    return rows.select(*own, F.when(F.col("_ok"), "utf-8").otherwise(fallback).alias("source_encoding"), "file")


def read_text_csv_whole(spark: SparkSession, path: str, columns: Sequence[str], fallback: str = "ISO-8859-1") -> DataFrame:
    """``read_text_csv_any`` for cells with line breaks: each file is one task.

    A first pass gives every file its header and whether all its lines are valid UTF-8: one row per file, like the listing that the
    driver holds anyway. Files of like header and encoding are then read together.
    """
    lines = read_lines(spark, path).withColumn("ok", F.is_valid_utf8("value"))
    files = lines.groupBy("file").agg(F.min("ok").alias("ok"), F.min_by(F.col("value").cast("binary"), "pos").alias("head")).collect()
    groups: dict[tuple, list[str]] = {}
    for r in files:
        encoding = "utf-8" if r["ok"] else fallback
        head = bytes(r["head"]).decode(encoding).lstrip("\ufeff").rstrip("\r")
        groups.setdefault((encoding, head), []).append(unquote(r["file"]))
    out = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, "source_encoding", "file"]))
    for (encoding, head), paths in sorted(groups.items()):
        names = [c.strip() for c in next(csv.reader([head]), [])]
        schema = StructType([StructField(c, StringType()) for c in names])
        df = spark.read.schema(schema).csv(paths, header=True, enforceSchema=True, encoding=encoding, multiLine=True, escape='"')
        own = [F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in columns]
        out = out.unionByName(df.select(*own, F.lit(encoding).alias("source_encoding"), F.col("_metadata.file_path").alias("file")))
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): lines of text files with a position that rises down each file.

    A split reads its lines in order, so the position is the split's byte offset scaled up plus
    the row number inside the split.
    """
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"), "value",
    )
    # a line takes at least one byte, so offsets leave room for the rows between them; rows of
    # several small files in one task keep their order, which is all a position needs
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    firsts = df.groupBy("file", "_start").agg(F.min(inside).alias("_first"))
    return df.join(firsts, ["file", "_start"]).select("file", (F.col("_start") + inside - F.col("_first")).alias("pos"), "value")


def trim_blank_rows_cols(df: DataFrame) -> DataFrame:
    """Drop rows whose every cell is blank and columns whose header is blank or generated."""
    named = [c for c in df.columns if c.strip() and not re.fullmatch(r"_c\d+", c)]
    any_value = F.coalesce(*[blank_to_null(F.col(f"`{c}`").cast("string")) for c in named])
    return df.filter(any_value.isNotNull()).select(*[F.col(f"`{c}`").alias(c.strip()) for c in named])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, paths: Sequence[str], schema: str, fmt: str = "csv") -> DataFrame:
    """The first alternative that exists and has a row; an empty table when none does."""
    for path in paths:
        if path_exists(spark, path):
            df = read_table(spark, path, fmt)
            if df.limit(1).count():
                return df
    return spark.createDataFrame([], schema)


def choose_source(primary: DataFrame, overlay: DataFrame | None, required: Sequence[str], filled: Sequence[str]) -> tuple[DataFrame, str]:
    """The primary when it has the required columns and a row with every ``filled`` column; else the overlay."""
    ready = set(required) <= set(primary.columns)
    if ready:
        every: Column = F.lit(True)
        for c in filled:
            every = every & F.col(c).isNotNull()
        ready = primary.filter(every).limit(1).count() > 0
    return (primary, "primary") if ready or overlay is None else (overlay, "overlay")
