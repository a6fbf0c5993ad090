"""Questions and answers out of JSON columns, strictly typed, with the reason why a source row is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_question, query_id, strip

VALID = "rejected_reason is null"


def json_array(column: Column) -> Column:
    """array<variant> if the text is a JSON array, else null."""
    parsed = F.try_parse_json(column)
    return F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))


def question_list(column: Column) -> Column:
    """array<string> if the text is a JSON array of strings only, else null."""
    items = json_array(column)
    return F.when(F.forall(items, lambda x: F.schema_of_variant(x) == "STRING"), F.transform(items, lambda x: F.variant_get(x, "$", "string")))


def reference_answer(answer: Column) -> Column:
    """The answer's text; null for a null or missing one, or for what is no object."""
    value = F.when(F.schema_of_variant(answer).startswith("OBJECT"), F.try_variant_get(answer, "$.answer", "variant"))
    kind = F.schema_of_variant(value)
    return F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string"))).when(kind != "VOID", F.try_variant_get(value, "$", "string"))


def citations(answer: Column) -> Column:
    """Non-empty strings of the answer's citations, duplicates kept."""
    found = F.when(F.schema_of_variant(answer).startswith("OBJECT"), F.try_variant_get(answer, "$.citations", "variant"))
    items = F.when(F.schema_of_variant(found).startswith("ARRAY"), F.try_variant_get(found, "$", "array<variant>"))
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def has_answer_text(answer: Column) -> Column:
    return F.coalesce(strip(answer) != "", F.lit(False))


def read_sources(rows: DataFrame) -> DataFrame:
    """``rows`` (id, question_texts, output, ...) with questions, answers and rejected_reason, the first that applies."""
    parsed = rows.withColumns({
        "document_id": F.coalesce(strip(F.col("id")), F.lit("")),
        "questions": question_list(F.col("question_texts")),
        "answers": json_array(F.col("output")),
    })
    a, b = F.size("questions"), F.size("answers")
    reason = (
        F.when(F.col("document_id") == "", "missing_document_id")
        .when(F.col("questions").isNull(), "question_texts_unreadable")
        .when(F.col("answers").isNull(), "output_unreadable")
        .when(a != b, F.concat(F.lit("question_answer_count_mismatch:"), a.cast("string"), F.lit("!="), b.cast("string")))
        .when(~F.exists("questions", lambda q: strip(q) != ""), "no_usable_questions")
    )
    return parsed.withColumn("rejected_reason", reason)


def explode_questions(sources: DataFrame, keys: tuple[str, ...] = ("source_row", "document_id")) -> DataFrame:
    """One row a question: keys, question_index, query_id, text, reference_answer, citations, is_blank."""
    each = sources.select(*keys, F.posexplode(F.arrays_zip(F.col("questions").alias("q"), F.col("answers").alias("a"))).alias("question_index", "x"))
    return each.select(
        *keys, "question_index", query_id(F.col("document_id"), F.col("question_index")).alias("query_id"), normalize_question(F.col("x.q")).alias("text"),
        reference_answer(F.col("x.a")).alias("reference_answer"), citations(F.col("x.a")).alias("citations"), (strip(F.col("x.q")) == "").alias("is_blank"),
    )
