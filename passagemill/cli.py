"""Command line: ``spark-submit passagemill/cli.py COMMAND ...`` or ``python -m passagemill.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import lengths
from .functions.chunking import Sizes
from .operators import convert, dataset, index, metrics, report, retrieve
from .sources import embed, readers, sinks
from .sources.snapshot import Publisher
from .worker import written


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="passagemill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    build = commands.add_parser("build", help="source rows to a published snapshot")
    build.add_argument("source"), build.add_argument("root")
    build.add_argument("--sha256", required=True, help="the source file's digest"), build.add_argument("--rows", type=int, required=True)
    build.add_argument("--rank-file", help="byte-pair rank file for token lengths; words are counted without one"), build.add_argument("--pattern", default=r"\S+|\s+")
    for name, default in (("most", 512), ("target", 320), ("overlap", 64), ("least", 64), ("max-gold-chunks", 10), ("max-query-tokens", 512), ("max-citation-words", None)):
        build.add_argument(f"--{name}", type=int, default=default)
    build.add_argument("--keep-documents-without-queries", action="store_true"), build.add_argument("--allow-empty-answers", action="store_true")

    activate = commands.add_parser("activate", help="point to an older snapshot")
    activate.add_argument("root"), activate.add_argument("generation")

    for name, text in (("index", "embed and store the passages of a snapshot"), ("rank", "rank the questions of a snapshot")):
        command = commands.add_parser(name, help=text)
        command.add_argument("root"), command.add_argument("store"), command.add_argument("--model", required=True), command.add_argument("--revision", required=True)
        command.add_argument("--endpoint", required=True), command.add_argument("--batch", type=int, default=32 if name == "index" else 64), command.add_argument("--generation")
        if name == "rank":
            command.add_argument("--output", required=True), command.add_argument("--format", choices=("json", "trec"), default="json"), command.add_argument("--top-k", type=int, default=100)

    evaluate = commands.add_parser("evaluate", help="score the runs of a folder")
    evaluate.add_argument("qrels"), evaluate.add_argument("runs"), evaluate.add_argument("--output", required=True)
    evaluate.add_argument("--k", type=int, nargs="+", default=list(metrics.CUTOFFS)), evaluate.add_argument("--metrics", nargs="+", default=list(report.LEADERBOARD))

    pairs = commands.add_parser("convert", help="a question and passage table to a dataset")
    pairs.add_argument("input", help="Parquet with a split column, or a folder of one table a split"), pairs.add_argument("output")
    for role in convert.ROLES:
        pairs.add_argument(f"--{role.replace('_', '-')}-column")
    return top


def _build(spark: SparkSession, a) -> None:
    fingerprint = readers.verify_source_file(spark, a.source, expected_sha256=a.sha256, expected_rows=a.rows)
    counter = (lambda: lengths.rank_file_counter(a.rank_file, a.pattern)) if a.rank_file else (lambda: lengths.count_words)
    policy = dataset.Policy(
        Sizes(a.most, a.target, a.overlap, a.least, version="tokens-1" if a.rank_file else "words-1"), a.max_citation_words, most_gold_chunks=a.max_gold_chunks, most_query_tokens=a.max_query_tokens,
        need_answer_text=not a.allow_empty_answers, keep_unquestioned=a.keep_documents_without_queries,
    )
    made = dataset.build(readers.read_source_rows_strict(spark, a.source), policy, counter, settle=written)
    facts = {"source_sha256": fingerprint.sha256, "source_row_count": fingerprint.rows, "chunking": vars(policy.sizes), "length_unit": "tokens" if a.rank_file else "words", "max_citation_words": policy.citation_words}
    snapshot = Publisher(spark, a.root).publish(made.artifacts, made.summary.first().asDict(), facts=facts)
    print(json.dumps({"generation_id": snapshot.manifest["generation_id"], **snapshot.manifest["summary"]}))


def _activate(spark: SparkSession, a) -> None:
    print(Publisher(spark, a.root).activate(a.generation).manifest["generation_id"])


def _service(a):
    profile = embed.model(a.model)
    embed.check_endpoint(a.endpoint)  # before any job
    return profile, lambda: embed.Client(a.endpoint, profile, batch=a.batch)


def _index(spark: SparkSession, a) -> None:
    snapshot, (profile, client) = Publisher(spark, a.root).load(a.generation), _service(a)
    corpus = snapshot.frame("beir/corpus").select(F.col("_id").alias("chunk_id"), "metadata.document_id", "metadata.chunk_index", "text")
    facts = index.Provenance(
        profile.model_id, a.revision, profile.dimension, snapshot.manifest["generation_id"], snapshot.manifest_sha256, snapshot.manifest["source_sha256"], profile.query_prefix, profile.passage_profile,
        snapshot.manifest["summary"]["chunks"],
    )
    print(index.IndexStore(spark, a.store).build(corpus, facts, profile, lambda df: embed.embed(df, client)))


def _rank(spark: SparkSession, a) -> None:
    snapshot, (profile, client) = Publisher(spark, a.root).load(a.generation), _service(a)
    output = Path(a.output)
    beside = output.parent.with_name(output.parent.name + ".provenance") / f"{output.stem}.json"

    # questions are sent once: their vectors are written before they are used
    run, facts = retrieve.rank(snapshot, index.IndexStore(spark, a.store), profile, model_revision=a.revision, embed_queries=lambda df: embed.embed(df, client, "queries"), settle=written, k=a.top_k)
    sinks.write_run(run, output, a.format)
    sinks.write_report({"run_file": output.name, **facts}, beside, output.parent)


def _evaluate(spark: SparkSession, a) -> None:
    qrels, runs = readers.read_qrels(spark, a.qrels), written(readers.read_runs(spark, a.runs))
    empty = [r["run"] for r in metrics.unjudged_runs(runs, qrels).collect()]
    if empty:
        raise ValueError(f"runs without a judged question: {', '.join(empty)}")
    named = [(p.stem, readers.run_model_id(str(p))) for p in sorted(Path(a.runs).iterdir())]
    provenance = spark.createDataFrame(named, "run string, model_id string")
    means = written(metrics.evaluate(runs, qrels, tuple(a.k)))
    found = report.comparison_report(means, metrics.coverage(runs, qrels), qrels, provenance, qrels_sha256=readers.file_sha256(a.qrels), generation=None)
    sinks.write_report(found, a.output, a.runs)
    print(report.leaderboard_text(metrics.long_form(means), tuple(a.metrics)))
    labels = report.run_labels(report.with_models(means.select("run").distinct(), provenance))
    print("\n" + report.means_text(report.metric_means(metrics.long_form(means), labels)))


def _convert(spark: SparkSession, a) -> None:
    explicit = {r: v for r in convert.ROLES if (v := getattr(a, f"{r}_column"))}
    made = convert.convert_pairs(readers.read_splits(spark, a.input), **explicit)
    for name in ("corpus", "queries", "candidates"):
        sinks.write_json_lines(made[name], Path(a.output) / f"{name}.jsonl", *[c for c in ("split", "_id", "query_id") if c in made[name].columns])
    sinks.write_split_qrels(made["qrels"], Path(a.output) / "qrels")


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("passagemill").getOrCreate()
    {"build": _build, "activate": _activate, "index": _index, "rank": _rank, "evaluate": _evaluate, "convert": _convert}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
