"""Readers of source rows, judgments, runs, questions, candidates and corpora."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..errors import RetrievalInputError, SourceContractError, raise_if_any
from ..functions.questions import json_array
from ..functions.text import strip

#: What the last part of a file's name says about its split.
SPLITS = {"train": "train", "training": "train", "val": "validation", "valid": "validation", "validation": "validation", "dev": "validation", "test": "test"}
RUN_SUFFIXES = (".json", ".jsonl", ".run", ".txt", ".tsv", ".trec")


# -- source rows ------------------------------------------------------------------------------


def read_source_rows(spark: SparkSession, path: str) -> DataFrame:
    """SOURCE_ROWS with source_row, the row's number in its file. Quoted fields may hold line ends, doubled quotes and any length."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', maxCharsPerColumn=-1, inferSchema=False)
    missing = [c for c in schemas.SOURCE_ROWS.names if c not in rows.columns]
    raise_if_any(missing, SourceContractError, "columns missing from the header")
    # a multi-line file is one task, so ids rise by one in file order; several files would be read one by one
    return rows.select(*schemas.SOURCE_ROWS.names, F.monotonically_increasing_id().alias("source_row"))


def source_violations(rows: DataFrame) -> DataFrame:
    """source_row, document_id, problem of rows that break the strict contract."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("source_row"))
    questions, answers = json_array(F.col("question_texts")), json_array(F.col("output"))
    problem = (
        F.when(F.coalesce(strip(F.col("id")), F.lit("")) == "", "blank_id").when(F.col("nth") > 1, "repeated_id").when(questions.isNull(), "question_texts_no_array")
        .when(answers.isNull(), "output_no_array").when(F.size(questions) != F.size(answers), "lengths_differ")
    )
    return rows.withColumn("nth", first).select("source_row", F.col("id").alias("document_id"), problem.alias("problem")).filter("problem is not null")


def read_source_rows_strict(spark: SparkSession, path: str) -> DataFrame:
    rows = read_source_rows(spark, path)
    bad = source_violations(rows).orderBy("source_row").limit(6).collect()
    raise_if_any([f"row {r['source_row']} ({r['document_id']}): {r['problem']}" for r in bad], SourceContractError, "source rows break the contract")
    return rows


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files, on the executors (up to 2 GB each)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def advisory_split(path: str) -> str | None:
    """The split that a file's name suggests; only advice."""
    return SPLITS.get(Path(path).stem.rsplit("-", 1)[-1].lower())


@dataclass(frozen=True)
class SourceFingerprint:
    path: str
    sha256: str
    rows: int
    split: str | None


def verify_source_file(spark: SparkSession, path: str, *, expected_sha256: str, expected_rows: int) -> SourceFingerprint:
    """Pass a test source only: there, not named as another split, with the expected bytes and rows."""
    if not Path(path).is_file():
        raise SourceContractError(f"no such file: {path}")
    split = advisory_split(path)
    if split not in (None, "test"):
        raise SourceContractError(f"{path} is named as the {split} split")
    if (found := file_sha256(path)) != expected_sha256:
        raise SourceContractError(f"{path} has sha256 {found}, not {expected_sha256}")
    if (rows := read_source_rows(spark, path).count()) != expected_rows:
        raise SourceContractError(f"{path} has {rows} rows, not {expected_rows}")
    return SourceFingerprint(path, found, rows, split)


# -- snapshots and question sets --------------------------------------------------------------


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Objects of one schema; blank lines are skipped, anything else that isn't an object fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise RetrievalInputError(f"no {what}")
    return df


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return _not_empty(read_json_lines(spark, path, schemas.QUERIES).select(F.col("_id").alias("query_id"), "text"), "questions")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    found = _not_empty(read_json_lines(spark, path, schemas.CANDIDATES), "candidates")
    repeated = found.groupBy("query_id").count().filter("count > 1").limit(6).collect()
    raise_if_any([r["query_id"] for r in repeated], RetrievalInputError, "questions with two candidate lists")
    return found


def read_corpus_order(spark: SparkSession, path: str) -> DataFrame:
    """Ids and texts in embedding order; a caller that selects ids alone has the texts pruned."""
    found = read_json_lines(spark, path, schemas.CORPUS)
    return found.select(F.col("_id").alias("chunk_id"), "metadata.document_id", "metadata.chunk_index", "text").orderBy("document_id", "chunk_index", "chunk_id")


def read_qrels_strict(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema(schemas.QRELS).csv(path, sep="\t", header=True, enforceSchema=False, mode="FAILFAST")
    return found.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("chunk_id"), F.col("score").alias("relevance"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line_no (from 1) of one text file, whose parts are read apart.

    A split's rows are consecutive, so a line's number is its place in the split and the lines of splits before it; there is one row a split to sum those.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(splits.select("split", "first", before.alias("before")), "split")
    return placed.select("value", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no")).filter(F.trim("value") != "")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, chunk_id, relevance: the header may be missing, of repeated pairs the last counts."""
    rows = numbered_lines(spark, path).filter(~((F.col("line_no") == 1) & F.lower("value").startswith("query-id")))
    parts = F.split("value", "\t")
    rows = rows.select("line_no", parts.alias("p"), F.try_element_at(parts, F.lit(3)).alias("third"))
    rows = rows.withColumn("relevance", F.expr("try_cast(trim(third) as int)"))
    bad = rows.filter((F.size("p") != 3) | F.col("relevance").isNull()).orderBy("line_no").limit(6).collect()
    raise_if_any([f"line {r['line_no']}" for r in bad], ValueError, "malformed judgments")
    from ..operators.metrics import latest_judgments

    return _judged(latest_judgments(rows.select(F.col("p")[0].alias("query_id"), F.col("p")[1].alias("chunk_id"), "relevance", "line_no")))


def _judged(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no judgments")
    return df


# -- folders of datasets ----------------------------------------------------------------------


#: Readers of a split's table by its file's ending.
SPLIT_FORMATS = {".parquet": "parquet", ".jsonl": "json", ".json": "json", ".csv": "csv"}


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``split``: a table that has the column, or a folder of tables, each named after its split."""
    tables = sorted(p for p in Path(path).iterdir() if p.suffix in SPLIT_FORMATS and not p.name.startswith("part-")) if Path(path).is_dir() else []
    if not tables:
        found = spark.read.parquet(path)
        if "split" not in found.columns:
            raise ValueError(f"{path}: no split column")
        return found
    out = None
    for p in tables:
        options = {"header": True, "multiLine": True, "escape": '"'} if p.suffix == ".csv" else {}
        one = spark.read.format(SPLIT_FORMATS[p.suffix]).options(**options).load(str(p)).withColumn("split", F.lit(p.stem.split("-")[0]))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> dict[str, DataFrame]:
    """corpus (chunk_id, title, text), queries (query_id, text) of those judged, and qrels (query_id, chunk_id, relevance) of a split."""
    qrels = read_qrels(spark, f"{folder}/qrels/{split}.tsv")
    shape = "_id string, title string, text string"
    corpus = _not_empty(read_json_lines(spark, f"{folder}/corpus.jsonl", schemas.schema(shape)).withColumnRenamed("_id", "chunk_id"), "passages")
    queries = read_queries(spark, f"{folder}/queries.jsonl").join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return {"corpus": corpus, "queries": queries, "qrels": qrels}


# -- runs -------------------------------------------------------------------------------------


def may_be_report(path: Path) -> bool:
    """Whether a JSON file begins like a report, so that long runs needn't be read to tell."""
    with path.open(encoding="utf-8") as file:
        return re.match(r'\s*\{\s*"(?:k_values|generation|judgments|models)"', file.read(4096)) is not None


def is_metrics_report(text: str) -> bool:
    """Whether a JSON file in a runs folder is a report of this engine and no run."""
    try:
        value = json.loads(text)
    except ValueError:
        return False
    return isinstance(value, dict) and {"k_values", "models"} <= value.keys()


def read_run_json(spark: SparkSession, path: str, run: str) -> DataFrame:
    """{question: {passage: score}}; scores must be finite numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = whole.select(F.schema_of_variant("v")).first()
    if not kind or not (kind[0] or "").startswith("OBJECT"):
        raise ValueError(f"{path}: a run must be an object")
    outer = whole.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).select(F.col("key").alias("query_id"), F.col("value").alias("scores"))
    bad = outer.filter(F.col("query_id").isNotNull() & ~F.coalesce(F.schema_of_variant("scores").startswith("OBJECT"), F.lit(False))).limit(6).collect()
    raise_if_any([r["query_id"] for r in bad], ValueError, f"{path}: questions without an object of scores")
    inner = outer.filter("query_id is not null").lateralJoin(spark.tvf.variant_explode(F.col("scores").outer())).select("query_id", F.col("key").alias("chunk_id"), F.col("value").alias("s"))
    kind = F.schema_of_variant("s")
    scored = inner.select("query_id", "chunk_id", F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.try_variant_get("s", "$", "double")).alias("score"))
    return _checked_run(scored, path, run)


def read_run_trec(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Lines of question, Q0, passage, rank, score and more."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, path).select("line_no", parts.alias("p")).select("line_no", F.size("p").alias("n"), F.try_element_at("p", F.lit(1)).alias("query_id"), F.try_element_at("p", F.lit(3)).alias("chunk_id"), F.expr("try_cast(try_element_at(p, 5) as double)").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("line_no"))
    bad = rows.withColumn("nth", nth).filter("n < 5 or score is null or nth > 1").orderBy("line_no").limit(6).collect()
    raise_if_any([f"line {r['line_no']}" for r in bad], ValueError, f"{path}: malformed or repeated results")
    return _checked_run(rows.select("query_id", "chunk_id", "score"), path, run)


def _checked_run(scored: DataFrame, path: str, run: str) -> DataFrame:
    bad = scored.filter(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).limit(6).collect()
    raise_if_any([f"{r['query_id']}/{r['chunk_id']}" for r in bad], ValueError, f"{path}: scores that are no finite numbers")
    if scored.isEmpty():
        raise ValueError(f"{path}: an empty run")
    return scored.select(F.lit(run).alias("run"), "query_id", "chunk_id", "score")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """JSON or TREC, told apart by the first character."""
    head = spark.read.text(path).select(F.substring(F.ltrim("value"), 1, 1)).filter(F.ltrim("value") != "").first()
    reader = read_run_json if head and head[0] in ("{", "[") else read_run_trec
    return reader(spark, path, Path(path).stem)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of a folder; reports are passed over, anything malformed fails."""
    paths = [p for p in sorted(Path(folder).iterdir()) if p.suffix in RUN_SUFFIXES and not (p.suffix == ".json" and may_be_report(p) and is_metrics_report(p.read_text()))]
    if not paths:
        raise ValueError(f"no runs in {folder}")
    out = read_run(spark, str(paths[0]))
    for p in paths[1:]:
        out = out.unionByName(read_run(spark, str(p)))
    return out


def run_model_id(run_file: str) -> str | None:
    """The model named by a run's provenance, which lies in ``<folder>.provenance``; None on any trouble."""
    try:
        real = Path(run_file).resolve()
        return json.loads((real.parent.with_name(real.parent.name + ".provenance") / f"{real.stem}.json").read_text()).get("model_id")
    except (OSError, ValueError, AttributeError):
        return None
