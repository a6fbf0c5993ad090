"""Citations to evidence spans, and spans to the passage that holds most of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count

WHOLE_DOCUMENT = 0.9
MOST_WORDS = 300


def citation_reason(span: Column, words: Column, cleaned_length: Column, most_words: int, whole: float = WHOLE_DOCUMENT) -> Column:
    """Why a citation can't be used, the first reason that holds; null if it can.

    span: struct with ``found`` (the element exists), ``start`` and ``end`` in the cleaned text (-1 if removed). ``words`` counts those of the span's text.
    """
    return (
        F.when(~F.coalesce(span["found"], F.lit(False)), "element_not_found")
        .when(span["start"] < 0, "removed_by_cleaning")
        .when(words > most_words, "exceeds_max_words")
        .when((span["end"] - span["start"]).cast("double") / cleaned_length > whole, "covers_whole_document")
    )


def measured_spans(documents: DataFrame) -> DataFrame:
    """Rows of ``spans`` of documents (document_id, text, spans) with word_count and document_length; taken where the text is, which goes no further."""
    words = lambda s: word_count(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    own = F.transform("spans", lambda s: s.withField("word_count", words(s)).withField("document_length", F.length("text")))
    return documents.select("document_id", F.inline(own))


def resolve_citations(citations: DataFrame, spans: DataFrame, most_words: int = MOST_WORDS, whole: float = WHOLE_DOCUMENT) -> DataFrame:
    """citations (document_id, query_id, ordinal, citation_id) with start, end, source_start, source_end, word_count and reason.

    spans, of :func:`measured_spans`: document_id, citation_id, start, end, source_start, source_end, word_count, document_length.
    """
    found = citations.join(spans.withColumn("found", F.lit(True)), ["document_id", "citation_id"], "left")
    reason = citation_reason(F.struct("found", "start", "end"), F.col("word_count"), F.col("document_length"), most_words, whole)
    return found.select(*citations.columns, "start", "end", "source_start", "source_end", "word_count", reason.alias("reason"))


def map_to_chunks(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """spans (document_id, query_id, ordinal, start, end) with chunk_id, chunk_index and overlap.

    An equi-join on the document with the interval test as residual; of the passages that overlap, the one with most characters, then the first.
    Spans that no passage overlaps don't appear.
    """
    overlap = F.least("end", "end_offset") - F.greatest("start", "start_offset")
    met = spans.join(chunks.select("document_id", "chunk_id", "chunk_index", "start_offset", "end_offset"), "document_id").withColumn("overlap", overlap).filter("overlap > 0")
    best = Window.partitionBy("query_id", "ordinal").orderBy(F.desc("overlap"), "chunk_index")
    return met.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "start_offset", "end_offset")


def qrels(images: DataFrame) -> DataFrame:
    """query_id, chunk_id, score 1: the distinct passages of a question's citations."""
    return images.select("query_id", "chunk_id").distinct().withColumn("score", F.lit(1))


def candidate_lists(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, document_id, candidate_ids: all passages of the question's document in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"])
    return queries.select("query_id", "document_id").join(chunks.groupBy("document_id").agg(ordered.alias("candidate_ids")), "document_id").select("query_id", "document_id", "candidate_ids")
