"""Ranking metrics of any number of runs at any cutoffs in one plan.

NDCG, MAP, Recall and P follow the trec_eval definitions, MRR and Pass count the first relevant hit. Runs are ranked by score and then id, both
descending. Judged questions that a run doesn't answer count as zero; unjudged ones are ignored; relevance of zero or less isn't relevant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10, 20, 100)
FAMILIES = ("NDCG", "MAP", "Recall", "P", "MRR", "Pass")


def latest_judgments(rows: DataFrame) -> DataFrame:
    """Of repeated (query_id, chunk_id) judgments the one on the last line."""
    return rows.groupBy("query_id", "chunk_id").agg(F.max_by("relevance", "line_no").alias("relevance"))


def ranked(runs: DataFrame, judged: DataFrame, most: int | None = None) -> DataFrame:
    """run, query_id, chunk_id, rank for the judged questions; up to rank ``most``, which Spark applies before the shuffle too."""
    order = Window.partitionBy("run", "query_id").orderBy(F.desc("score"), F.desc("chunk_id"))
    found = runs.join(judged.select("query_id"), "query_id", "left_semi").select("run", "query_id", "chunk_id", F.row_number().over(order).alias("rank"))
    return found if most is None else found.filter(F.col("rank") <= most)


def per_query(runs: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """run, query_id, k and the six metrics, unrounded, for every judged question of every run.

    No metric at k reads a rank beyond k, so ranks beyond the largest cutoff are left out before anything is joined.
    """
    ks = sorted(set(cutoffs))
    relevant = qrels.filter("relevance > 0")
    gain = lambda rel, rank: rel.cast("double") / (F.log(rank + 1) / F.log(F.lit(2.0)))
    # the ideal order needs no more than how many judgments of each relevance a question has
    counts = qrels.groupBy("query_id", "relevance").agg(F.count("*").alias("n"))
    places = counts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(max(ks, default=1))))))
    places = places.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "copy")))
    good = F.col("relevance") > 0
    judged = places.groupBy("query_id").agg(
        F.sum(F.when(good & (F.col("copy") == 1), F.col("n"))).alias("r"),
        *(F.sum(F.when(good & (F.col("place") <= k), gain(F.col("relevance"), F.col("place")))).alias(f"ideal_{k}") for k in ks),
    )
    hit_order = Window.partitionBy("run", "query_id").orderBy("rank")
    hits = ranked(runs, judged, max(ks, default=0)).join(relevant, ["query_id", "chunk_id"]).withColumn("hit_no", F.row_number().over(hit_order))
    sums = [
        x
        for k in ks
        for x in (
            F.sum(F.when(F.col("rank") <= k, gain(F.col("relevance"), F.col("rank")))).alias(f"dcg_{k}"),
            F.sum(F.when(F.col("rank") <= k, F.col("hit_no").cast("double") / F.col("rank"))).alias(f"ap_{k}"),
            F.count(F.when(F.col("rank") <= k, 1)).alias(f"hits_{k}"),
        )
    ]
    found = hits.groupBy("run", "query_id").agg(F.min("rank").alias("first"), *sums)
    grid = judged.crossJoin(F.broadcast(runs.select("run").distinct())) if ks else judged  # questions x runs: the result's own size
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cells = [
        F.struct(
            F.lit(k).alias("k"),
            zero(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias("NDCG"),
            zero(F.col(f"ap_{k}") / F.col("r")).alias("MAP"),
            zero(F.col(f"hits_{k}").cast("double") / F.col("r")).alias("Recall"),
            zero(F.col(f"hits_{k}").cast("double") / F.lit(float(k))).alias("P"),
            zero(F.when(F.col("first") <= k, F.lit(1.0) / F.col("first"))).alias("MRR"),
            F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("Pass"),
        )
        for k in ks
    ]
    return grid.join(found, ["run", "query_id"], "left").select("run", "query_id", F.inline(F.array(*cells)))


def evaluate(runs: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, digits: int = 5) -> DataFrame:
    """run, k and the six means over all judged questions, rounded."""
    return per_query(runs, qrels, cutoffs).groupBy("run", "k").agg(*(F.round(F.avg(m), digits).alias(m) for m in FAMILIES))


def coverage(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """run, queries_scored, queries_missing."""
    judged = qrels.select("query_id").distinct()
    answered = runs.select("run", "query_id").distinct().withColumn("answered", F.lit(1))
    grid = judged.crossJoin(F.broadcast(runs.select("run").distinct()))
    return grid.join(answered, ["run", "query_id"], "left").groupBy("run").agg(
        F.count("*").alias("queries_scored"), F.count_if(F.col("answered").isNull()).alias("queries_missing")
    )


def unjudged_runs(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Runs that answer no judged question at all; scoring them would say nothing."""
    return runs.select("run").distinct().join(runs.join(qrels.select("query_id"), "query_id", "left_semi").select("run").distinct(), "run", "left_anti")


def long_form(means: DataFrame) -> DataFrame:
    """run, metric (family@k), value."""
    tall = means.unpivot(["run", "k"], list(FAMILIES), "family", "value")
    return tall.select("run", F.concat("family", F.lit("@"), F.col("k").cast("string")).alias("metric"), "value")


def wide_form(means: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row a run, a column for each family@k."""
    return long_form(means).groupBy("run").pivot("metric", [f"{m}@{k}" for m in FAMILIES for k in sorted(set(cutoffs))]).agg(F.first("value"))
