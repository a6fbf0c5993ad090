"""Checks of a dataset as frames of (check, offender), so that all offenders are known before one error is raised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GenerationError, raise_if_any
from .dataset import COUNTED


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``df`` whose key no parent has."""
    known = parents.select(F.col(f"`{parent_key}`").alias("known")).distinct()
    return df.join(known, df[f"`{key}`"] == known["known"], "left_anti")


def bijection(left: DataFrame, right: DataFrame, key: str, same: tuple[str, ...] = ()) -> DataFrame:
    """key, problem: missing on the right, foreign to the left, or with other values in ``same``."""
    a = left.select(key, *(F.col(c).alias(f"left_{c}") for c in same), F.lit(True).alias("in_left"))
    b = right.select(key, *(F.col(c).alias(f"right_{c}") for c in same), F.lit(True).alias("in_right"))
    differs = reduce(lambda x, c: x | ~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")), same, F.lit(False))
    problem = F.when(F.col("in_right").isNull(), "missing").when(F.col("in_left").isNull(), "foreign").when(differs, "misplaced")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).filter("problem is not null")


def inconsistent(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys that come with different values."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("n")).filter("n > 1").select(key)


def leaking(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n")).filter("n > 1").select(key)


def reconcile(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """name, declared, observed of the counters (name, n) that differ."""
    joined = declared.select("name", F.col("n").alias("declared")).join(observed.select("name", F.col("n").alias("observed")), "name", "full_outer")
    return joined.filter(~F.col("declared").eqNullSafe(F.col("observed")))


def violations(artifacts: dict[str, DataFrame]) -> DataFrame:
    """check, offender for every broken rule of a dataset."""
    corpus, queries, qrels, candidates = (artifacts[f"beir/{n}"] for n in ("corpus", "queries", "qrels", "candidates"))
    place = corpus.select(F.col("_id").alias("chunk_id"), "metadata.*")
    listed = candidates.select("query_id", F.col("document_id").alias("claimed"), F.explode("candidate_ids").alias("chunk_id"))
    located = listed.join(place.select("chunk_id", "document_id"), "chunk_id", "left")
    judged = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("chunk_id"))
    offset_bad = ~((F.col("start_offset") >= 0) & (F.col("start_offset") < F.col("end_offset")))
    found = {
        "corpus ids repeat": repeated(corpus, "_id").select("key"),
        "query ids repeat": repeated(queries, "_id").select("key"),
        "passage without a document": place.filter(F.coalesce("document_id", F.lit("")) == "").select("chunk_id"),
        "offsets are no interval": place.filter(F.coalesce(offset_bad, F.lit(True))).select("chunk_id"),
        "question with several candidate records": repeated(candidates, "query_id").select("key"),
        "candidates of an unknown question": orphans(candidates, "query_id", queries, "_id").select("query_id"),
        "empty candidate list": candidates.filter(F.coalesce(F.size("candidate_ids"), F.lit(0)) <= 0).select("query_id"),
        "unpublished candidate": located.filter("document_id is null").select("chunk_id"),
        "candidate of another document": located.filter("document_id <> claimed").select("chunk_id"),
        "question without candidates": orphans(queries, "_id", candidates, "query_id").select("_id"),
        "judgment of an unknown question": orphans(judged, "query_id", queries, "_id").select("query_id"),
        "judgment of an unknown passage": orphans(judged, "chunk_id", corpus, "_id").select("chunk_id"),
        "judgment outside the candidates": judged.join(listed, ["query_id", "chunk_id"], "left_anti").select("chunk_id"),
        "question without a judgment": orphans(queries, "_id", judged, "query_id").select("_id"),
    }
    frames = [df.toDF("offender").select(F.lit(name).alias("check"), F.col("offender").cast("string")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, frames)


def counter_problems(artifacts: dict[str, DataFrame], summary: dict[str, int]) -> list[str]:
    """Counters that differ from what is there, and rows or questions that aren't accounted for."""
    n = {name: df.count() for name, df in artifacts.items()}
    pairs = [(c, summary[c], n[a]) for c, a in COUNTED.items()]
    pairs += [("source_rows", summary["source_rows"], n["documents"] + n["audits/rejected_sources"]), ("queries", summary["queries"], n["beir/queries"] + n["audits/dropped_queries"])]
    return [f"{name} is {declared}, found {observed}" for name, declared, observed in pairs if declared != observed]


def check(artifacts: dict[str, DataFrame], summary: dict[str, int]) -> None:
    """Raise GenerationError naming the first offenders, if any rule is broken."""
    bad = violations(artifacts).orderBy("check", "offender").limit(6).collect()
    raise_if_any([f"{r['check']} ({r['offender']})" for r in bad], GenerationError, "the dataset breaks its contract")
    raise_if_any(counter_problems(artifacts, summary), GenerationError, "counters don't match")
