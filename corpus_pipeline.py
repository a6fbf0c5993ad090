"""The corpus pipeline: documents in, packed training sequences out, one operator a stage.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, written and read again. All but the last return
the columns of ``docs``. Where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import language_id, near_dup, packing, quality, secret_scan
from passagemill.llm.common import settle, table
from passagemill.llm.queries import byte_level_pattern, vocabulary

#: A text whose main language has less than this share of its letters is mixed beyond use.
LEAST_SHARE = 0.5


def _as_before(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``; n_chars of changed texts counted anew."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, boilerplate lines of the others too.

    A null text has no word and goes. A null source is a host of its own. Equal rows are judged alike and stay equal; they count as one document. An
    empty table stays one.
    """
    return _as_before(docs, quality.without_boilerplate(docs))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language, or without a main one, go; each is judged by its own text.

    A null or empty text has no language and goes. Rows that share an id, or have none, and equal rows are judged alike but apart. Without a
    labelled text nothing is known, and all go; an empty table stays one.
    """
    return language_id.with_main_language(docs, language_id.fit(docs.filter(language_id.learnable(docs))), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles of a similarity of 0.8 or more.

    That of the least id, a null id last; of equal ids, the text of the least hash; of equal rows one. Null and empty texts are copies of each
    other. Texts of fewer than five words have one shingle. An empty table stays one.
    """
    return near_dup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark.

    No row goes. Null and empty texts stay as they are; equal rows and rows that share an id are each rid of their own text's secrets.
    """
    return _as_before(docs, secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences.

    A null or empty text is one piece of its end id. Equal rows are packed once each; a null id is kept. An empty table gives no piece.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), byte_level_pattern())


STAGES = [("quality rules", quality_rules), ("language ID", languages), ("near-duplicates", near_duplicates), ("secret scans", secrets), ("packing", packed)]
#: SQL can't express language identification, fingerprints or tokenisation; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it kept, written and reread."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = settle(docs, f"stage-{number + 1}")
    return docs
