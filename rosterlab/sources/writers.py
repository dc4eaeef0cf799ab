"""Snapshots, projections and the export manifest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F


def union_header(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of several frames under the union of their headers, columns in order of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def write_snapshot(df: DataFrame, path: str, fmt: str = "csv", columns: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> None:
    """Write with a stable column order. Array columns become pipe lists in CSV."""
    out = df.select(*(columns or df.columns))
    if fmt == "csv":
        out = out.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])
    w = out.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        w.csv(path, header=True, escape='"', emptyValue="", nullValue="")
    else:
        w.format(fmt).save(path)


def csv_projection(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One labelled CSV line per row, quotes doubled and cells with comma, quote or newline quoted."""
    def cell(c: str):
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return df.select(F.concat_ws(",", *[cell(c) for c in labels]).alias("line"))


def csv_header(labels: dict[str, str]) -> str:
    return ",".join(f'"{v}"' if "," in v else v for v in labels.values())


def write_counted(tables: dict[str, DataFrame], folder: str, exported_at: str, source: str, fmt: str = "csv") -> DataFrame:
    """Write every table to ``folder`` and return its manifest, with the rows counted by the writes themselves.

    The manifest costs no scan, and it counts what was written, whatever the sources hold by now.
    """
    rows = []
    for name, df in tables.items():
        seen = Observation()
        write_snapshot(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{folder}/{name}", fmt)
        rows.append((name, seen.get["rows"], exported_at, source))
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "entity string, rows long, exported_at string, source string")


def export_manifest(tables: dict[str, DataFrame], exported_at: str, source: str) -> DataFrame:
    """Row count per table; the date is an argument so a rerun gives the same manifest."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("entity"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("exported_at", F.lit(exported_at)).withColumn("source", F.lit(source))
