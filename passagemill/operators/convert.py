"""Question and passage pair tables to a retrieval dataset; column roles are found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import raise_if_any
from ..functions.text import stable_id, text_value
from .validate import inconsistent, leaking

#: Names that a role's column may have, the first that is there counts.
ROLES = {
    "question": ("question", "query", "pergunta"), "positive": ("positive", "positives", "chunk", "chunks", "context", "passage"), "negative": ("negative", "negatives", "hard_negatives"),
    "query_id": ("query_id", "question_id", "qid"), "chunk_id": ("chunk_id", "passage_id", "corpus_id"), "document_id": ("document_id", "doc_id", "doc"), "title": ("title", "section"),
    "relevance": ("relevance", "score", "label"),
}


def detect_column(columns: list[str], role: str, explicit: str | None = None, required: bool = False) -> str | None:
    """The column of a role: the named one, which must exist, or the first usual name."""
    if explicit:
        if explicit not in columns:
            raise ValueError(f"no column {explicit!r} for {role}")
        return explicit
    found = next((c for c in ROLES[role] if c in columns), None)
    if required and not found:
        raise ValueError(f"no column for {role}; tried {', '.join(ROLES[role])}")
    return found


def convert_pairs(pairs: DataFrame, **explicit: str) -> dict[str, DataFrame]:
    """corpus (_id, title, text), queries (_id, text), qrels and candidates (with split) of rows with a ``split`` column."""
    columns = pairs.columns
    role = {r: detect_column(columns, r, explicit.get(r), r in ("question", "positive")) for r in ROLES}
    value = lambda r: text_value(F.col(role[r])) if role[r] else F.lit("")

    def values(r: str):
        if not role[r]:
            return F.array().cast("array<string>")
        column = F.col(role[r])
        several = isinstance(pairs.schema[role[r]].dataType, T.ArrayType)
        return F.filter(F.transform(column if several else F.array(column), text_value), lambda x: x != "")

    relevance = F.coalesce(F.col(role["relevance"]).cast("int"), F.lit(1)) if role["relevance"] else F.lit(1)
    rows = pairs.select("split", value("question").alias("question"), F.coalesce(values("positive"), F.array()).alias("positive"), F.coalesce(values("negative"), F.array()).alias("negative"),
                        value("query_id").alias("qid"), value("chunk_id").alias("cid"), value("document_id").alias("document_id"), value("title").alias("title"), relevance.alias("relevance"))
    rows = rows.filter((F.col("question") != "") & (F.size("positive") > 0) & (F.col("relevance") > 0))
    rows = rows.withColumn("query_id", F.when(F.col("qid") != "", F.col("qid")).otherwise(stable_id("q", F.col("document_id"), F.col("question"))))
    each = rows.select("*", F.explode(F.concat(F.transform("positive", lambda x: F.struct(x.alias("text"), F.lit(True).alias("good"))), F.transform("negative", lambda x: F.struct(x.alias("text"), F.lit(False).alias("good"))))).alias("p"))
    alone = (F.col("cid") != "") & F.col("p.good") & (F.size("positive") == 1)
    each = each.withColumn("chunk_id", F.when(alone, F.col("cid")).otherwise(stable_id("c", F.col("document_id"), F.col("p.text"))))
    if role["document_id"]:
        for key in ("document_id", "query_id"):
            raise_if_any([r[key] for r in leaking(rows, key).limit(6).collect()], ValueError, f"{key} in more than one split")
    chunks = each.select("chunk_id", "title", F.col("p.text").alias("text"), "document_id", "split")
    for key, df, kept in (("chunk_id", chunks, ("text",)), ("query_id", rows, ("question",))):
        raise_if_any([r[key] for r in inconsistent(df, key, *kept).limit(6).collect()], ValueError, f"{key} with different contents")
    ids = F.array_sort(F.collect_set("chunk_id"))
    return {
        "corpus": chunks.groupBy(F.col("chunk_id").alias("_id")).agg(F.min("title").alias("title"), F.min("text").alias("text")).orderBy("_id"),
        "queries": rows.groupBy(F.col("query_id").alias("_id")).agg(F.min("question").alias("text")).orderBy("_id"),
        "qrels": each.filter("p.good").groupBy("split", "query_id", "chunk_id").agg(F.max("relevance").alias("relevance")).orderBy("split", "query_id", "chunk_id"),
        "candidates": rows.select("split", "query_id", "document_id").distinct().join(chunks.groupBy("split", "document_id").agg(ids.alias("candidate_ids")), ["split", "document_id"]).orderBy("split", "query_id"),
    }


def candidate_set_problems(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Questions whose results aren't exactly their candidates."""
    got = results.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("got"))
    want = candidates.select("query_id", F.array_sort(F.array_distinct("candidate_ids")).alias("want"))
    return want.join(got, "query_id", "full_outer").filter(~F.col("got").eqNullSafe(F.col("want"))).select("query_id")
