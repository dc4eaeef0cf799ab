"""What several operators of this subpackage share: reading a table, ids modulo a number, batches of Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, in every contract of this subpackage: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for ``translate``.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_mod(doc_id: Column, n: int, missing: int) -> Column:
    """crc32 of the id as text, modulo ``n``; ``missing`` where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(missing)).cast("int")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one batch into dicts of columns; empty ones are left out."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                if len(next(iter(columns.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts one by one, null as empty: only one is a Python string at a time."""
    for x in batch.column(name):
        yield x.as_py() or ""


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[memoryview]:
    """The UTF-8 of each text, null as empty, without copying the batch."""
    import numpy as np

    column = batch.column(name)
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset: column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist()
    for i in range(len(column)):
        yield view[at[i]: at[i + 1]] if valid[i] else memoryview(b"")
