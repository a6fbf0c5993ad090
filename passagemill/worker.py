"""Python workers find this package where the driver has it; what is computed once is written where all can read it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path; on a cluster it is installed there, or sent with ``--py-files``."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table written where driver and executors share a folder: what it took isn't done again, whichever executors are lost."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/passagemill"
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 64, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` rows and, but for a single longer one, ``most`` bytes of the column ``text``: what Python makes of a slice is held at once."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0), np.int64))
        start = 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
            end = max(start + 1, min(full, start + rows))
            yield batch.slice(start, end - start)
            start = end


def record_batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    """Rows as an Arrow batch, without pandas between."""
    fields = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
