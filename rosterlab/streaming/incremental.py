"""Streams of landing files: the resumable run, and the log of daily snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.diff import resume_pending, snapshot_diff
from ..skew import first_per_key, last_per_key


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_pending(todo: DataFrame, resolver: Callable[[DataFrame], DataFrame], key: str, order: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``resolver`` over the streamed rows whose key is not in ``out`` yet, and append its rows.

    Finished rows leave before the resolver sees them, and a batch replayed after a failure adds nothing twice.
    ``availableNow`` drains what has landed and stops, like one run of a batch job.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark, fresh = df.sparkSession, first_per_key(df, [key], order)
        if _there(spark, out):
            fresh = resume_pending(fresh, spark.read.parquet(out), key)
        resolver(fresh).write.mode("append").parquet(out)

    return todo.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_snapshots(snapshots: DataFrame, day: str, key: Sequence[str], fields: Sequence[str], state: str, log: str, checkpoint: str) -> StreamingQuery:
    """Change-log rows between consecutive days, one folder ``<day>=...`` of ``log`` for each.

    A day is all rows that have landed for it, in however many files and batches; of a repeated key the last batch's row counts. When
    rows of a day land, its folder and that of the day after are written anew, so a day in several files, a late file and a replayed batch all
    end in the same log. The state keeps each batch in its own folder, by day, so that only the days in question are read.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = df.select(*key, *fields, day)
        rows.write.mode("overwrite").partitionBy(day).parquet(f"{state}/batch={batch_id}")
        schema = StructType([*rows.schema.fields, StructField("batch", IntegerType())])
        landed = spark.read.schema(schema).parquet(state)
        new = {r[0] for r in rows.select(day).distinct().collect()}  # days, not rows
        days = sorted(r[0] for r in landed.select(day).distinct().collect() if r[0] is not None)
        whole = lambda d: last_per_key(landed.filter(F.col(day) == F.lit(d)), list(key), ["batch", *fields]).select(*key, *fields)
        for before, now in zip([None, *days], days):
            if now in new or before in new:
                prev = whole(before) if before is not None else whole(now).limit(0)
                snapshot_diff(prev, whole(now), key, fields).write.mode("overwrite").parquet(f"{log}/{day}={now}")

    return snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
