"""Source rows to a retrieval dataset: documents, passages, questions, judgments, candidates, evidence and audits.

One Python crossing a document normalises, cleans and splits it; everything after that is joins, windows and aggregates on ids. The prepared documents
are written once, since all outputs read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import headings
from ..functions.chunking import CHUNK_SCHEMA, Sizes, Splitter, chunk_rows
from ..functions.cleaning import ENTITY, Cleaned, decodable_entities, violation_counts
from ..functions.html_text import html_to_text
from ..functions.lengths import Counter, count_words
from ..functions.questions import VALID, explode_questions, has_answer_text, read_sources
from ..worker import record_batch, ship, slices
from . import evidence

_SPAN = schemas.schema("citation_id string, start int, end int, source_start int, source_end int")
_EVENT = schemas.schema("rule string, count int, removed_characters int")
PREPARED = T.StructType([
    T.StructField("source_row", T.LongType()), T.StructField("document_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("events", T.ArrayType(_EVENT)), T.StructField("entities", T.IntegerType()), T.StructField("chunks", T.ArrayType(T.StructType(CHUNK_SCHEMA.fields[1:]))),
])


@dataclass(frozen=True)
class Policy:
    """What is kept. Limits of 0 mean none; ``most_citation_words`` defaults to the passage maximum, though it counts words."""

    sizes: Sizes = Sizes()
    most_citation_words: int | None = None
    whole_document: float = evidence.WHOLE_DOCUMENT
    most_gold_chunks: int = 10
    most_query_tokens: int = 512
    need_answer_text: bool = True
    keep_unquestioned: bool = False

    @property
    def citation_words(self) -> int:
        return self.sizes.most if self.most_citation_words is None else self.most_citation_words


@dataclass(frozen=True)
class Dataset:
    """The artifacts, by their names in a snapshot, and the counters as a one-row frame."""

    artifacts: dict[str, DataFrame]
    summary: DataFrame


def prepare(sources: DataFrame, sizes: Sizes, counter: Callable[[], Counter] = lambda: count_words, is_heading=headings.is_heading) -> DataFrame:
    """PREPARED rows of (source_row, document_id, data)."""
    ship(sources.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(sizes, counter(), is_heading)
        for batch in slices(batches, "data"):
            rows = []
            for row, document, html in zip(*(batch.column(c).to_pylist() for c in ("source_row", "document_id", "data")), strict=True):
                raw, found = html_to_text(html or "")
                cleaned = Cleaned(raw)
                starts, ends = cleaned.map_spans([s for s, _ in found.values()], [e for _, e in found.values()])
                spans = [
                    {"citation_id": c, "start": int(a), "end": int(b), "source_start": s, "source_end": e} for (c, (s, e)), a, b in zip(found.items(), starts, ends, strict=True)
                ]
                events = [dict(zip(_EVENT.names, e, strict=True)) for e in cleaned.events]
                chunks = [dict(zip(CHUNK_SCHEMA.names[1:], c[1:], strict=True)) for c in chunk_rows(document, cleaned.text, splitter)]
                rows.append((row, document, cleaned.text, spans, events, decodable_entities(cleaned.text), chunks))
            yield record_batch(rows, PREPARED)

    return sources.select("source_row", "document_id", "data").mapInArrow(run, PREPARED)


def first_wins(rows: DataFrame, key: str = "document_id", order: str = "source_row") -> DataFrame:
    """``rows`` with is_repeated: all but the first row of a key; blank keys are never repeated."""
    alone = F.when(F.coalesce(F.col(key), F.lit("")) == "", F.col(order))  # blank keys needn't meet in one task
    nth = F.row_number().over(Window.partitionBy(F.col(key), alone).orderBy(order))
    return rows.withColumn("is_repeated", (F.col(key) != "") & (nth > 1))


def drop_reason(policy: Policy) -> Column:
    """Why a question goes, the first reason that holds, from query_tokens, reference_answer, citations, evidence_spans, mapped and gold_chunks."""
    n = policy.most_gold_chunks
    return (
        F.when(F.lit(policy.most_query_tokens > 0) & (F.col("query_tokens") > policy.most_query_tokens), "question_exceeds_max_tokens")
        .when(F.lit(policy.need_answer_text) & ~has_answer_text(F.col("reference_answer")), "answer_has_no_text")
        .when(F.size("citations") == 0, "answer_has_no_citations")
        .when(F.col("evidence_spans") == 0, "all_citations_unmapped")
        .when(F.col("mapped") == 0, "no_chunk_holds_the_evidence")
        .when(F.lit(n > 0) & (F.col("gold_chunks") > n), "too_many_gold_chunks")
    )


def build(rows: DataFrame, policy: Policy = Policy(), counter: Callable[[], Counter] = lambda: count_words, settle: Callable[[DataFrame], DataFrame] = lambda df: df.persist(), is_heading=headings.is_heading) -> Dataset:
    """Everything from source rows (SOURCE_ROWS with source_row). ``settle`` keeps a frame that many outputs read."""
    sources = settle(first_wins(read_sources(rows)).select("source_row", "document_id", "data", "questions", "answers", "rejected_reason", "is_repeated"))
    own = sources.filter("not is_repeated")
    valid = own.filter(VALID)
    prepared = settle(prepare(valid, policy.sizes, counter, is_heading))
    bare = prepared.select("source_row", "document_id", (F.regexp_replace("text", r"(?U)\s+", "") == "").alias("is_blank"), F.size("chunks").alias("n_chunks"))
    usable = prepared.filter(F.size("chunks") > 0)
    documents = usable.select("document_id", "text")
    chunks = usable.select("document_id", F.inline("chunks"))

    asked = explode_questions(own.filter(F.col("questions").isNotNull() & F.col("answers").isNotNull()))
    blanks = asked.filter("is_blank")
    count = F.pandas_udf(lambda texts: texts.map(counter()), "int")
    questions = asked.filter("not is_blank").join(documents.select("document_id"), "document_id", "left_semi").withColumn("query_tokens", count("text"))
    cited = questions.select("document_id", "query_id", F.posexplode("citations").alias("ordinal", "citation_id"))
    spans = evidence.measured_spans(usable)
    resolved = settle(evidence.resolve_citations(cited, spans, policy.citation_words, policy.whole_document))
    fine = resolved.filter("reason is null")
    images = settle(evidence.map_to_chunks(fine, chunks))
    per_question = fine.groupBy("query_id").agg(F.count("*").alias("evidence_spans")).join(
        images.groupBy("query_id").agg(F.count("*").alias("mapped"), F.count_distinct("chunk_id").alias("all_gold")), "query_id", "left"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    judged = questions.join(per_question, "query_id", "left").withColumns({c: zero(c) for c in ("evidence_spans", "mapped", "all_gold")}).withColumn("gold_chunks", F.col("all_gold"))
    judged = settle(judged.withColumn("reason", drop_reason(policy)))
    kept = judged.filter("reason is null")
    published = documents.select("document_id") if policy.keep_unquestioned else documents.select("document_id").join(kept.select("document_id").distinct(), "document_id", "left_semi")
    published = settle(published)
    in_published = lambda df: df.join(published, "document_id", "left_semi")
    kept, final_chunks = in_published(kept), in_published(chunks)

    # a drop before mapping has no gold passages to report
    late = F.col("reason").isin("no_chunk_holds_the_evidence", "too_many_gold_chunks")
    dropped = judged.filter("reason is not null").select(
        "query_id", "document_id", "question_index", "reason", "reference_answer", "citations", F.when(late, F.col("gold_chunks")).otherwise(0).cast("long").alias("gold_chunks"),
        F.when(F.col("reason") == "question_exceeds_max_tokens", F.col("query_tokens")).alias("query_tokens"),
    )
    blank_rows = blanks.select("query_id", "document_id", "question_index", F.lit("blank_question").alias("reason"))
    rejected = (
        sources.filter("is_repeated").select("source_row", "document_id", F.lit("duplicate_document_id").alias("reason"))
        .unionByName(own.filter(f"not ({VALID})").select("source_row", "document_id", F.col("rejected_reason").alias("reason")))
        .unionByName(bare.filter("is_blank").select("source_row", "document_id", F.lit("empty_document_after_cleaning").alias("reason")))
        .unionByName(bare.filter("not is_blank and n_chunks = 0").select("source_row", "document_id", F.lit("no_chunks_produced").alias("reason")))
        .withColumn("discarded_chunks", F.lit(None).cast("long"))
        .unionByName(
            bare.filter("n_chunks > 0").join(published, "document_id", "left_anti").select("source_row", "document_id", F.lit("no_retained_queries").alias("reason"), F.col("n_chunks").cast("long").alias("discarded_chunks"))
        )
    )
    # of a citation that a question repeats, the last image counts
    last = images.groupBy("query_id", "citation_id").agg(F.max_by("chunk_id", "ordinal").alias("chunk_id"))
    span_rows = fine.join(last, ["query_id", "citation_id"], "left").join(kept.select("query_id"), "query_id", "left_semi")
    fields = ["citation_id", "start", "end", "source_start", "source_end", "word_count", "chunk_id"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("span")))), lambda x: x["span"])
    counters = violation_counts(F.col("text")) | {"html_entity": F.col("entities")}
    violations = F.map_filter(F.create_map(*(x for name, n in counters.items() for x in (F.lit(name), n.cast("int")))), lambda _, n: n > 0)
    artifacts = {
        "beir/corpus": final_chunks.select(F.col("chunk_id").alias("_id"), F.col("section").alias("title"), "text", F.struct("document_id", "chunk_index", "start_offset", "end_offset", "chunk_type").alias("metadata")),
        "beir/queries": kept.select(F.col("query_id").alias("_id"), "text", "reference_answer", "citations"),
        "beir/qrels": evidence.qrels(images.join(kept.select("query_id"), "query_id", "left_semi")).select(F.col("query_id").alias("query-id"), F.col("chunk_id").alias("corpus-id"), "score"),
        "beir/candidates": evidence.candidate_lists(kept, final_chunks),
        "documents": in_published(documents),
        "evidence": span_rows.groupBy("query_id", "document_id").agg(ordered.alias("spans")),
        "audits/rejected_sources": rejected,
        "audits/dropped_queries": dropped.unionByName(blank_rows, allowMissingColumns=True),
        "audits/unmapped_citations": in_published(resolved.filter("reason is not null")).select("document_id", "query_id", "citation_id", "reason"),
        "audits/cleaning_events": in_published(usable).select("document_id", F.inline("events")),
        "audits/plain_text_violations": in_published(usable).select("document_id", violations.alias("violations")).filter(F.size("violations") > 0),
    }
    artifacts = {name: df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schemas.SNAPSHOT[name])) for name, df in artifacts.items()}
    return Dataset(artifacts, summarize(sources, artifacts, asked.filter("is_blank"), questions))


#: Counters of a summary and the artifact whose rows each counts.
COUNTED = {
    "rejected_sources": "audits/rejected_sources", "documents": "documents", "chunks": "beir/corpus", "queries_retained": "beir/queries", "dropped_queries": "audits/dropped_queries",
    "qrels": "beir/qrels", "unmapped_citations": "audits/unmapped_citations", "plain_text_violations": "audits/plain_text_violations",
}


def summarize(sources: DataFrame, artifacts: dict[str, DataFrame], blanks: DataFrame, questions: DataFrame) -> DataFrame:
    """One row with the counters of a build."""
    counts = {"source_rows": sources, **{name: artifacts[a] for name, a in COUNTED.items()}}
    rows = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    asked = blanks.agg(F.count("*").alias("n")).unionByName(questions.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n")).select(F.lit("queries").alias("name"), "n")
    return rows.unionByName(asked).groupBy().pivot("name", ["source_rows", *COUNTED, "queries"]).agg(F.first("n"))


__all__ = ["ENTITY", "PREPARED", "Dataset", "Policy", "build", "drop_reason", "first_wins", "prepare", "summarize"]
