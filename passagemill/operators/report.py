"""Leaderboards and comparison reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEADERBOARD = ("NDCG@10", "Recall@10", "MRR@10", "MAP@10")
MOST_PLOTTED = 8


def leaderboard(tall: DataFrame, metrics: tuple[str, ...] = LEADERBOARD) -> DataFrame:
    """position, run and the chosen metrics, best first by the first of them; a missing metric sorts as zero and shows as NaN."""
    wide = tall.groupBy("run").pivot("metric", list(metrics)).agg(F.first("value"))
    order = Window.orderBy(F.desc(F.coalesce(F.col(f"`{metrics[0]}`"), F.lit(0.0))), "run")  # one row a run
    return wide.select(F.row_number().over(order).alias("position"), "run", *(F.coalesce(F.col(f"`{m}`"), F.lit(float("nan"))).alias(m) for m in metrics))


def leaderboard_text(tall: DataFrame, metrics: tuple[str, ...] = LEADERBOARD) -> str:
    rows = leaderboard(tall, metrics).orderBy("position").collect()  # one row a run
    width = max([3, *(len(r["run"]) for r in rows)])
    head = "run".ljust(width) + "".join(m.rjust(12) for m in metrics)
    return "\n".join([head, *(r["run"].ljust(width) + "".join(f"{r[m]:12.5f}" for m in metrics) for r in rows)])


def run_labels(models: DataFrame) -> DataFrame:
    """run, label: the model's id, with the run's name where runs share a model, the run's name where it has none."""
    shared = F.count("*").over(Window.partitionBy("model_id")) > 1
    label = F.when(F.col("model_id").isNull(), F.col("run")).when(shared, F.concat("model_id", F.lit(" ("), "run", F.lit(")"))).otherwise(F.col("model_id"))
    return models.select("run", label.alias("label"))


def metric_means(tall: DataFrame, labels: DataFrame) -> DataFrame:
    """family, k, label, value: what charts need."""
    parts = F.split("metric", "@")
    return tall.join(labels, "run").select(F.element_at(parts, 1).alias("family"), F.element_at(parts, 2).cast("int").alias("k"), "label", "value")


def means_text(means: DataFrame) -> str:
    """The means of every family and cutoff as text, a line for each label; it has one row a run."""
    names = [f"{r['family']}@{r['k']}" for r in means.select("family", "k").distinct().orderBy("family", "k").collect()]
    wide = means.withColumn("metric", F.concat_ws("@", "family", "k")).groupBy("label").pivot("metric", names).agg(F.first("value")).orderBy("label").collect()
    cells = [["", *names], *([r["label"], *("-" if r[n] is None else f"{r[n]:.4f}" for n in names)] for r in wide)]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "\n".join("  ".join(x.ljust(w) if k == 0 else x.rjust(w) for k, (x, w) in enumerate(zip(row, widths, strict=True))).rstrip() for row in cells)


def with_models(means: DataFrame, provenance: DataFrame) -> DataFrame:
    """Attach model_id by run; null where a run has no provenance."""
    return means.join(provenance.select("run", "model_id").dropDuplicates(["run"]), "run", "left")


def comparison_report(means: DataFrame, coverage: DataFrame, qrels: DataFrame, provenance: DataFrame, *, qrels_sha256: str, generation: str | None) -> dict:
    """The report of all runs as a plain structure; it has one entry a run."""
    from .metrics import long_form

    judged = qrels.agg(F.count_distinct("query_id").alias("q"), F.count("*").alias("n")).first()
    tall = with_models(long_form(means), provenance).join(coverage, "run")
    rows = tall.groupBy("run", "model_id", "queries_scored", "queries_missing").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")).orderBy("run").collect()
    return {
        "k_values": sorted(r["k"] for r in means.select("k").distinct().collect()),
        "generation": generation,
        "judgments": {"qrels_sha256": qrels_sha256, "queries": judged["q"], "judgments": judged["n"]},
        "models": [
            {"model": r["run"], **({"model_id": r["model_id"]} if r["model_id"] else {}), "queries_scored": r["queries_scored"], "queries_missing": r["queries_missing"], "metrics": dict(r["metrics"])}
            for r in rows
        ],
    }


def latency_summary(samples: DataFrame, *by: str) -> DataFrame:
    """Mean, nearest-rank p50 and p95, and maximum of ``seconds``, in milliseconds."""
    ms = F.col("seconds") * 1000
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY seconds)") * 1000
    return samples.groupBy(*by).agg(
        F.count("*").alias("queries"), F.round(F.avg(ms), 3).alias("mean"), F.round(rank(0.5), 3).alias("p50"), F.round(rank(0.95), 3).alias("p95"), F.round(F.max(ms), 3).alias("max")
    )


def usage_totals(requests: DataFrame, *by: str) -> DataFrame:
    """Requests, texts and tokens; one unknown token count makes the total unknown."""
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum("texts").alias("texts"), F.when(F.count("*") == F.count("prompt_tokens"), F.sum("prompt_tokens")).alias("prompt_tokens")
    )
