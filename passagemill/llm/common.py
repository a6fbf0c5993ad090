"""Shared pieces of the training-data operators.

Word boundaries are the six ASCII blanks everywhere (``bytes.split()`` in Python,
:data:`WORD_GAP` in SQL), so that native and Arrow operators agree on every text.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the separators of words: space, tab, newline, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    env.setdefault("OPENBLAS_NUM_THREADS", "1")  # a task has one core; more threads wait in loops
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default, for rows of numbers; these are whole texts
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='passagemill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/passagemill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Holds a row's other columns while an operator works, so that their names can't clash with its own.
REST = "passagemill_other_columns"


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(None).cast("struct<>")).alias(REST))


def bring_back(changed: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, in their order: the used ones from ``changed``, the others as they were."""
    return changed.select(*(F.col(c) if c in used else F.col(REST)[c].alias(c) for c in docs.columns))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array, in order."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def slices(batches: Iterator, rows: int = 256, most: int = 1 << 22) -> Iterator:
    """Arrow batches in slices of at most ``rows`` rows and, but for a single longer text, ``most`` bytes of text: that bounds what Python holds as objects at once."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
        start = 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
            end = max(start + 1, min(full, start + rows))
            yield batch.slice(start, end - start)
            start = end


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within, jobs hand Python at most ``rows`` rows at once: for rows that hold whole tiles or blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
