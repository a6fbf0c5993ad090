"""Schemas of every artifact. Readers use them as they are; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_ATOMS = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType}


def _split(text: str) -> list[str]:
    """Parts between the commas that aren't inside angle brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]


def _type(text: str) -> T.DataType:
    name, _, inner = text.partition("<")
    inner = inner[:-1]
    if name == "array":
        return T.ArrayType(_type(inner))
    if name == "map":
        return T.MapType(*map(_type, _split(inner)))
    if name == "struct":
        return T.StructType([T.StructField(n.strip(), _type(t.strip())) for n, _, t in (f.partition(":") for f in _split(inner))])
    return _ATOMS[name]()


def schema(ddl: str) -> T.StructType:
    """A schema from its text; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n.strip("`"), _type(t.strip())) for n, _, t in (f.partition(" ") for f in _split(ddl))])


_s = schema


SOURCE_ROWS = _s("id string, question_texts string, output string, data string")
CORPUS = _s("_id string, title string, text string, metadata struct<document_id:string,chunk_index:int,start_offset:int,end_offset:int,chunk_type:string>")
QUERIES = _s("_id string, text string, reference_answer string, citations array<string>")
QRELS = _s("`query-id` string, `corpus-id` string, score int")
CANDIDATES = _s("query_id string, document_id string, candidate_ids array<string>")
DOCUMENTS = _s("document_id string, text string")
EVIDENCE = _s("query_id string, document_id string, spans array<struct<citation_id:string,start:int,end:int,source_start:int,source_end:int,word_count:int,chunk_id:string>>")
REJECTED_SOURCES = _s("source_row bigint, document_id string, reason string, discarded_chunks bigint")
DROPPED_QUERIES = _s("query_id string, document_id string, question_index int, reason string, reference_answer string, citations array<string>, gold_chunks bigint, query_tokens int")
UNMAPPED_CITATIONS = _s("document_id string, query_id string, citation_id string, reason string")
CLEANING_EVENTS = _s("document_id string, rule string, count int, removed_characters int")
PLAIN_TEXT_VIOLATIONS = _s("document_id string, violations map<string,int>")
RUNS = _s("run string, query_id string, chunk_id string, score double")
INDEX_BUILDS = _s(
    "index_build_id string, model_id string, model_revision string, dimension int, generation_id string, generation_manifest_sha256 string, source_sha256 string,"
    " split string, query_instruction string, chunk_text_profile string, metric string, normalized boolean, chunk_count bigint, status string, created_at string, updated_at string"
)
INDEXED_CHUNKS = _s("index_build_id string, chunk_id string, document_id string, chunk_index int, embedding array<float>")
ACTIVE_MODEL_INDEXES = _s("generation_id string, model_id string, index_build_id string, activated_at string")

#: Artifacts of a snapshot and their schemas.
SNAPSHOT = {
    "beir/corpus": CORPUS, "beir/queries": QUERIES, "beir/qrels": QRELS, "beir/candidates": CANDIDATES, "documents": DOCUMENTS, "evidence": EVIDENCE,
    "audits/rejected_sources": REJECTED_SOURCES, "audits/dropped_queries": DROPPED_QUERIES, "audits/unmapped_citations": UNMAPPED_CITATIONS,
    "audits/cleaning_events": CLEANING_EVENTS, "audits/plain_text_violations": PLAIN_TEXT_VIOLATIONS,
}
