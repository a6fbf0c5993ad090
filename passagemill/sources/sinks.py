"""Writers that leave a whole file or none: a temporary beside it, then a rename."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import raise_if_any


@contextmanager
def whole_file(path: str | Path) -> Iterator[TextIO]:
    """A text file that appears under its name only if the block ends well."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with open(handle, "w", encoding="utf-8", newline="\n") as file:
            yield file
            file.flush()
            os.fsync(file.fileno())
        os.replace(draft, path)
    except BaseException:
        Path(draft).unlink(missing_ok=True)
        raise


def _floats(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def write_json_lines(df: DataFrame, path: str | Path, *order: str) -> int:
    """One JSON object a line, nulls kept; not-finite numbers are refused. Rows are streamed through the driver partition by partition."""
    for name in _floats(df.schema):
        bad = df.filter(F.isnan(name) | (F.abs(name) == float("inf"))).limit(1).count()
        raise_if_any([name] * bad, ValueError, "a number that isn't finite in column")
    rows = df.orderBy(*order) if order else df
    n = 0
    with whole_file(path) as file:
        for row in rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            file.write(row["j"] + "\n")
            n += 1
    return n


def write_tsv(df: DataFrame, path: str | Path, *order: str) -> int:
    """Tab-separated with a header; a tab or line end inside a value is an error, never quoted."""
    texts = [F.col(f"`{c}`").cast("string") for c in df.columns]
    bad = df.filter(F.exists(F.array(*texts), lambda x: x.rlike("[\t\r\n]"))).limit(1).count()
    raise_if_any(["value"] * bad, ValueError, "a tab or line end in a")
    rows = df.orderBy(*(F.col(f"`{c}`") for c in order)) if order else df
    n = 0
    with whole_file(path) as file:
        file.write("\t".join(df.columns) + "\n")
        for row in rows.select(F.concat_ws("\t", *texts).alias("l")).toLocalIterator():
            file.write(row["l"] + "\n")
            n += 1
    return n


def write_split_qrels(qrels: DataFrame, folder: str | Path) -> dict[str, int]:
    """Judgments (split, query_id, chunk_id, relevance) as one sorted table a split, with the usual header; the lines of each."""
    shaped = qrels.select("split", F.col("query_id").alias("query-id"), F.col("chunk_id").alias("corpus-id"), F.col("relevance").alias("score"))
    names = sorted(r["split"] for r in shaped.select("split").distinct().collect())  # one row a split
    return {n: write_tsv(shaped.filter(F.col("split") == n).drop("split"), Path(folder) / f"{n}.tsv", "query-id", "corpus-id") for n in names}


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The distributed form: one file a task, committed by Spark."""
    writer = df.write.mode("errorifexists")
    writer.option("ignoreNullFields", "false").json(path) if fmt == "json" else writer.format(fmt).save(path)


def trec_lines(run: DataFrame, tag: str) -> DataFrame:
    """query_id, rank, line; ranked by score, then passage ascending."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return run.withColumn("rank", rank).select("query_id", "rank", F.format_string("%s Q0 %s %d %.6f %s", "query_id", "chunk_id", "rank", "score", F.lit(tag)).alias("line"))


def run_json(run: DataFrame) -> DataFrame:
    """query_id, scores: each question's passages as a map."""
    return run.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "score"))).alias("scores"))


def write_run(run: DataFrame, path: str | Path, fmt: str = "json", tag: str = "passagemill") -> None:
    if fmt not in ("json", "trec"):
        raise ValueError(f"unknown run format {fmt!r}")
    with whole_file(path) as file:
        if fmt == "trec":
            for row in trec_lines(run, tag).orderBy("query_id", "rank").toLocalIterator():
                file.write(row["line"] + "\n")
            return
        file.write("{")
        for k, row in enumerate(run_json(run).orderBy("query_id").select(F.to_json("scores").alias("s"), "query_id").toLocalIterator()):
            file.write(("," if k else "") + json.dumps(row["query_id"]) + ":" + row["s"])
        file.write("}\n")


def write_report(report: dict, path: str | Path, runs_folder: str | Path | None = None) -> None:
    """A report as JSON; not into the folder whose runs it judges."""
    if runs_folder is not None and Path(runs_folder).resolve() in Path(path).resolve().parents:
        raise ValueError("a report can't lie among the runs")
    with whole_file(path) as file:
        json.dump(report, file, ensure_ascii=False, indent=2, allow_nan=False)
        file.write("\n")
