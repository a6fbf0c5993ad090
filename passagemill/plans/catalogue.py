"""Queries of the engine's own operators over the bundled tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, cleaning, questions, text, vectors
from ..operators import dataset, evidence, index, metrics, report, search, validate
from ..sources import sinks
from ..streaming import ingest
from ..worker import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- vectors and metrics ----------------------------------------------------------------------

_COSINE = "list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e)))"
_VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_PAIRS = f"""{_VECTORS},
    scored AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_COSINE} AS score, list_inner_product(q.e[1:16], c.e[1:16]) AS front
               FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)"""
_RUNS = f"""{_PAIRS},
    runs AS (SELECT 'whole' AS run, query_id, chunk_id, score FROM scored
             UNION ALL SELECT 'front' AS run, query_id, chunk_id, front AS score FROM scored WHERE query_id % 300 <> 0),
    qrels AS (SELECT query_id, chunk_id, CASE WHEN chunk_id % 5 = query_id % 5 THEN 2 ELSE 1 END AS relevance FROM scored WHERE chunk_id % 7 = query_id % 7)"""
_METRICS = f"""{_RUNS},
    judged AS (SELECT query_id, count(*) AS r FROM qrels GROUP BY query_id),
    ranked AS (SELECT run, query_id, chunk_id, row_number() OVER (PARTITION BY run, query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM runs),
    hits AS (SELECT run, query_id, rank, relevance, row_number() OVER (PARTITION BY run, query_id ORDER BY rank) AS hit_no FROM ranked JOIN qrels USING (query_id, chunk_id)),
    ideal AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS place FROM qrels),
    ks AS (SELECT unnest([1, 3, 5, 10, 20, 100])::INTEGER AS k),
    best AS (SELECT query_id, k, sum(relevance / (ln(place + 1) / ln(2.0))) AS ideal FROM ideal JOIN ks ON place <= k GROUP BY query_id, k),
    found AS (SELECT run, query_id, k, sum(relevance / (ln(rank + 1) / ln(2.0))) AS dcg, sum(hit_no::DOUBLE / rank) AS ap, count(*) AS n, min(rank) AS first
              FROM hits JOIN ks ON rank <= k GROUP BY run, query_id, k),
    cells AS (SELECT g.run, g.query_id, ks.k, coalesce(dcg / ideal, 0) AS ndcg, coalesce(ap / g.r, 0) AS map_, coalesce(n::DOUBLE / g.r, 0) AS recall, coalesce(n::DOUBLE / ks.k, 0) AS p,
                     coalesce(1.0 / first, 0) AS mrr, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END AS pass
              FROM (SELECT run, query_id, r FROM (SELECT DISTINCT run FROM runs) CROSS JOIN judged) g CROSS JOIN ks
              LEFT JOIN best ON best.query_id = g.query_id AND best.k = ks.k LEFT JOIN found ON found.run = g.run AND found.query_id = g.query_id AND found.k = ks.k),
    means AS (SELECT run, k, round(avg(ndcg), 5) AS "NDCG", round(avg(map_), 5) AS "MAP", round(avg(recall), 5) AS "Recall", round(avg(p), 5) AS "P", round(avg(mrr)::DOUBLE, 5) AS "MRR",
                     round(avg(pass)::DOUBLE, 5) AS "Pass" FROM cells GROUP BY run, k)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_pairs(_asked(spark, sf_dir), _vectors(spark, sf_dir)).filter("query_id <> chunk_id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other vector of the question's label as its candidates."""
    chunks = _vectors(spark, sf_dir).withColumn("chunk_index", F.col("chunk_id"))
    lists = evidence.candidate_lists(_asked(spark, sf_dir), chunks)
    return lists.withColumn("candidate_ids", F.filter("candidate_ids", lambda c: c != F.col("query_id")))


def _runs_and_judgments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs down to the largest cutoff, which is as far as metrics read, in their order of equal scores, and all judgments."""
    asked, every, depth = _asked(spark, sf_dir), _vectors(spark, sf_dir), max(metrics.CUTOFFS)
    best = lambda queries, measure, run: search.document_best(queries, every, depth, measure, last_first=True).select(F.lit(run).alias("run"), "query_id", "chunk_id", "score")
    runs = best(asked, search.InOrder(cosine=True), "whole").unionByName(best(asked.filter("query_id % 300 <> 0"), search.InOrder(16), "front"))
    judged = _pairs(spark, sf_dir).filter("chunk_id % 7 = query_id % 7").select("query_id", "chunk_id", F.expr("if(chunk_id % 5 = query_id % 5, 2, 1)").alias("relevance"))
    return written(runs), judged


@query(f"WITH {_PAIRS} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def scoped_cosine_topk(spark, sf_dir):
    scored = _pairs(spark, sf_dir).select("query_id", "chunk_id", search.score_column(F.col("query_vector"), F.col("chunk_vector"), 64).alias("score"))
    return search.top_k(scored, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VECTORS}, scored AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_COSINE} AS score FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id <> c.vec_id) SELECT query_id, count(*) AS results, round(sum(score), 5) AS total, round(max(score), 6) AS best FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 100) GROUP BY query_id")
def scoped_search_every_vector(spark, sf_dir):
    """Every vector as a question: the load of a whole question set in one job."""
    every = _vectors(spark, sf_dir)
    found = search.document_search(every.withColumnRenamed("chunk_id", "query_id"), every, 100)
    return found.groupBy("query_id").agg(F.count("*").alias("results"), F.round(F.sum("score"), 5).alias("total"), F.round(F.max("score"), 6).alias("best"))


@query(f"WITH {_PAIRS} SELECT query_id, chunk_id, round(list_inner_product(q.e, c.e), 6) AS score FROM scored JOIN v q ON q.vec_id = query_id JOIN v c ON c.vec_id = chunk_id")
def scoped_score_all(spark, sf_dir):
    return search.score_all(_asked(spark, sf_dir), _candidates(spark, sf_dir), _vectors(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_PAIRS} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM scored WHERE chunk_id % 3 <> query_id % 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def candidate_list_search(spark, sf_dir):
    """Search within a list of candidates for each question, which leaves out some of its document's passages."""
    lists = _candidates(spark, sf_dir).withColumn("candidate_ids", F.filter("candidate_ids", lambda c: c % 3 != F.col("query_id") % 3))
    found = search.scoped_search(_asked(spark, sf_dir), lists, _vectors(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id, label, (len(embedding) = 64 AND abs(sqrt(list_inner_product(e, e)) - 1) <= 0.001) AS is_unit FROM (SELECT *, list_transform(embedding, lambda x: x::DOUBLE * (CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END)) AS e FROM embeddings)")
def vector_validation(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x.cast("double") * F.expr("if(vec_id % 3 = 0, 2, 1)")).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.is_unit(scaled, 64).alias("is_unit"))


@query("SELECT vec_id, 1.0::DOUBLE AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 3) + 0 AS first, round(e[64] / sqrt(list_inner_product(e, e)), 3) + 0 AS last FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS e FROM embeddings)")
def l2_normalize_norms(spark, sf_dir):
    stretched = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))
    found = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalize(stretched).alias("unit"))
    return found.select("vec_id", F.round(vectors.norm(F.col("unit")), 5).alias("norm"), F.round(F.get("unit", F.lit(0)).cast("double"), 3).alias("first"), F.round(F.get("unit", F.lit(63)).cast("double"), 3).alias("last"))


@query(f'WITH {_METRICS} SELECT run, k, "NDCG", "MAP", "Recall", "P", "MRR", "Pass" FROM means')
def ir_metrics_at_k(spark, sf_dir):
    return metrics.evaluate(*_runs_and_judgments(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT r.run, count(*) AS queries_scored, count(*) FILTER (WHERE a.query_id IS NULL) AS queries_missing FROM (SELECT DISTINCT run FROM runs) r CROSS JOIN (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN (SELECT DISTINCT run, query_id FROM runs) a ON a.run = r.run AND a.query_id = q.query_id GROUP BY r.run")
def metrics_zero_fill(spark, sf_dir):
    return metrics.coverage(*_runs_and_judgments(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT run, family || '@' || k AS metric, value FROM (UNPIVOT means ON \"NDCG\", \"MAP\", \"Recall\", \"P\", \"MRR\", \"Pass\" INTO NAME family VALUE value)")
def metric_means_long(spark, sf_dir):
    return metrics.long_form(metrics.evaluate(*_runs_and_judgments(spark, sf_dir)))


@query(f'WITH {_METRICS} SELECT (row_number() OVER (ORDER BY "NDCG" DESC, run))::INTEGER AS position, run, "NDCG" AS ndcg_10, "Recall" AS recall_10, "MRR" AS mrr_10, "MAP" AS map_10 FROM means WHERE k = 10')
def leaderboard(spark, sf_dir):
    board = report.leaderboard(metrics.long_form(metrics.evaluate(*_runs_and_judgments(spark, sf_dir), (10,))))
    return board.toDF("position", "run", "ndcg_10", "recall_10", "mrr_10", "map_10")


@query(f"WITH {_RUNS}, m AS (SELECT DISTINCT run, 'model' AS model_id FROM runs) SELECT run, model_id || ' (' || run || ')' AS label FROM m")
def run_labels(spark, sf_dir):
    runs, _ = _runs_and_judgments(spark, sf_dir)
    return report.run_labels(runs.select("run").distinct().withColumn("model_id", F.lit("model")))


@query(f"WITH {_PAIRS}, r AS (SELECT query_id, chunk_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank, printf('%d Q0 %d %d %.6f %s', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id), score, 'tag') AS line FROM r")
def trec_lines(spark, sf_dir):
    return sinks.trec_lines(scoped_cosine_topk(spark, sf_dir), "tag")


@query("SELECT event_type, count(*) AS queries, round(avg(value * 1000), 3) AS mean, round(quantile_disc(value, 0.5) * 1000, 3) AS p50, round(quantile_disc(value, 0.95) * 1000, 3) AS p95, round(max(value * 1000), 3) AS max FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return report.latency_summary(table(spark, sf_dir, "events").withColumn("seconds", F.col("value")), "event_type")


@query("SELECT user_id, count(*) AS requests, sum(1)::BIGINT AS texts, CASE WHEN count(*) = count(t) THEN sum(t)::BIGINT END AS prompt_tokens FROM (SELECT user_id, CASE WHEN event_id % 50 <> 0 THEN event_id % 97 END AS t FROM events) GROUP BY user_id")
def usage_null_poison(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.lit(1).alias("texts"), F.expr("if(event_id % 50 <> 0, event_id % 97, null)").alias("prompt_tokens"))
    return report.usage_totals(events, "user_id")


# -- texts ------------------------------------------------------------------------------------


@query("SELECT doc_id, (row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AND text <> '') AS is_repeated FROM documents")
def first_wins_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # texts are compared by digest, which keeps the shuffle small
    keyed = docs.select("doc_id", F.when(F.col("text") == "", "").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    return dataset.first_wins(keyed, "digest", "doc_id").select("doc_id", "is_repeated")


_FLAT = r"trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))"
_TAIL = text.QUESTION_TAIL.replace("(?is)", "").replace("'", "''")


@query(rf"WITH f AS (SELECT conv_id, turn, {_FLAT} AS flat FROM conversations), b AS (SELECT *, trim(regexp_replace(flat, '{_TAIL}\z', '', 'is'), ' .;:' || chr(9)) AS bare FROM f) SELECT conv_id, turn, CASE WHEN length(bare) >= 20 THEN bare ELSE flat END AS question FROM b")
def question_normalize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_question(F.col("text")).alias("question"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::INTEGER AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


def _re2(pattern: str) -> str:
    import re

    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace("'", "''")


_COUNT = lambda p, flags="": f"len(regexp_extract_all(html, '{_re2(p)}', 0{flags}))::INTEGER"


@query(f"SELECT page_id, {_COUNT(cleaning.CONTROL)} AS control_character, {_COUNT(cleaning.UNUSUAL_SPACE)} AS unusual_space, {_COUNT(cleaning.TAG, chr(44) + chr(39) + 'i' + chr(39))} AS html_tag, {_COUNT(cleaning.ENTITY)} AS html_entity FROM pages")
def plain_text_violations(spark, sf_dir):
    found = cleaning.violation_counts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", *(found[n].alias(n) for n in ("control_character", "unusual_space", "html_tag", "html_entity")))


@query(f"SELECT page_id, regexp_replace(html, '{_re2(cleaning.TAG)}', '', 'gi') AS stripped FROM pages")
def strip_tags_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.strip_tags(F.col("html")).alias("stripped"))


@query("SELECT doc_id, md5('• x y' || text || '—') AS digest FROM documents")
def private_use_and_controls(spark, sf_dir):
    dirty = F.concat(F.lit("\uf0b7\u00a0x\u200b\u0007\u3000y\ufffd\ue001"), F.col("text"), F.lit("—\ufeff"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaning.clean_characters(dirty).cast("binary")).alias("digest"))


@query("SELECT page_id, 'see https://www.' || regexp_replace(url, '^https?://', '') || ' and ' || regexp_extract(url, '^https?', 0) || '://' || regexp_replace(url, '^https?://', '') AS canonical FROM pages")
def url_canonicalize(spark, sf_dir):
    bare = F.regexp_replace("url", "^https?://", "")
    spoken = F.concat(F.lit("see www . "), bare, F.lit(" and "), F.regexp_extract("url", "^https?", 0), F.lit(" : / / "), bare)
    return table(spark, sf_dir, "pages").select("page_id", cleaning.canonical_urls(spoken).alias("canonical"))


_LINES = r"""raw AS (SELECT doc_id, string_split(regexp_replace(text, '\r', chr(10), 'g'), chr(10)) AS parts FROM documents),
    numbered AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM raw)),
    placed AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM numbered),
    bare AS (SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, pos + length(line) - length(regexp_replace(line, '^[\x20\x09-\x0D]+', '')) AS start FROM placed),
    lines AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS line_no, line, start::INTEGER AS start, (start + length(line))::INTEGER AS end_ FROM bare WHERE line <> '')"""


def _lines(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Lines of all documents, or of those that ``of`` (doc_id) has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs if of is None else docs.join(of.select("doc_id"), "doc_id", "left_semi")
    return docs.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "x")).select("doc_id", "line_no", "x.*")


@query(f"WITH {_LINES} SELECT doc_id, line_no, start, end_, CASE WHEN starts_with(line, '|') THEN 'table' ELSE 'prose' END AS kind FROM lines")
def line_spans(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", "start", F.col("end").alias("end_"), "kind")


def _heading_sql(line: str) -> str:
    word = r"\p{L}{3}"
    prose = lambda x: rf"(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) >= 4 AND length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace({x}, '[\x20\x09-\x0D]', '', 'g'))) >= 0.5 AND regexp_matches({x}, '{word}'))"
    counted = r"^(?:\d{1,3}(?:\.\d{1,3}){0,3}|[IVXLCDM]{1,7})\s*[–—.:)-]\s*(\p{L}.*)$"
    titled = rf"(regexp_matches({line}, '{text.ARTICLE}') OR regexp_matches({line}, '{text.UPPERCASE}'))"
    return rf"(length({line}) <= 180 AND NOT regexp_matches({line}, '{text.IDENTIFIER}') AND CASE WHEN regexp_matches({line}, '{counted}') THEN {prose(f'regexp_extract({line}, {chr(39)}{counted}{chr(39)}, 1)')} ELSE {titled} AND {prose(line)} END)"


_UP = "translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {_heading_sql('line')}) AS headings, count(*) FILTER (WHERE {_heading_sql(_UP)}) AS upper_headings FROM lines GROUP BY doc_id")
def heading_lines(spark, sf_dir):
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return _lines(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(text.is_heading(F.col("text"))).alias("headings"), F.count_if(text.is_heading(upper)).alias("upper_headings")
    )


@query("SELECT doc_id, 'd-' || substr(sha256(source || chr(31) || lang || chr(31) || text), 1, 20) AS stable_id, doc_id || ':vv1:' || printf('%04d', doc_id % 100) || ':' || 0 || '-' || n_chars AS chunk_id FROM documents")
def stable_ids(spark, sf_dir):
    chunk = text.chunk_id(F.col("doc_id").cast("string"), "v1", F.col("doc_id") % 100, F.lit(0), F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", text.stable_id("d", F.col("source"), F.col("lang"), F.col("text")).alias("stable_id"), chunk.alias("chunk_id"))


# -- evidence ---------------------------------------------------------------------------------

_EVIDENCE = """spans AS (SELECT doc_id, item_id, (strpos(d.text, b.text) - 1)::INTEGER AS start, (strpos(d.text, b.text) - 1 + length(b.text))::INTEGER AS end_, b.text AS cited, length(d.text) AS doc_length
                         FROM documents d JOIN benchmark b ON strpos(d.text, b.text) > 0)"""
_BLOCKS = f"""{_LINES}, blocks AS (SELECT doc_id, (line_no // 4)::INTEGER AS chunk_index, min(start) AS start_offset, max(end_) AS end_offset FROM lines GROUP BY doc_id, line_no // 4)"""
_IMAGES = f"""{_BLOCKS}, {_EVIDENCE}, met AS (SELECT s.doc_id, item_id, chunk_index, (least(end_, end_offset) - greatest(start, start_offset)) AS overlap FROM spans s JOIN blocks b ON s.doc_id = b.doc_id),
    images AS (SELECT * FROM met WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, chunk_index) = 1)"""


#: Anchors up to which they may be joined beside the texts; a join with more carries ids alone.
FEW_ANCHORS = 100_000


def _cited_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents: an equi-join on the hash of a passage's inner words proposes, a search confirms.

    A passage's first and last word may be parts of longer ones in a document, so its anchor is its second word and up to seven more, but not the last.
    Passages without an inner word are searched for as they are.
    """
    split = lambda: F.split("text", r"[\x20\x09-\x0D]+", -1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("cited"), split().alias("w")).withColumn("n", F.least(F.lit(8), F.size("w") - 2))
    anchors = items.filter("n > 0").select("item_id", "cited", F.xxhash64("n", F.slice("w", F.lit(2), F.col("n"))).alias("anchor"))
    lengths = [r["n"] for r in items.filter("n > 0").select("n").distinct().collect()]  # eight at most
    windows = lambda own, n: F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda k: F.xxhash64(F.lit(n), F.slice(own, k, n)))).otherwise(F.array())
    every = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *(windows(F.col("w"), n) for n in lengths)))
    few = anchors.count() <= FEW_ANCHORS
    proposed = docs.select("doc_id", *(["text"] if few else []), split().alias("w")).select("doc_id", *(["text"] if few else []), F.explode(every).alias("anchor"))
    hits = proposed.join(F.broadcast(anchors) if few else anchors, "anchor")
    hits = (hits if few else hits.join(docs, "doc_id")).select("doc_id", "item_id", "cited", "text")
    bare = items.filter("n <= 0").select("item_id", "cited")
    if not bare.isEmpty():
        hits = hits.unionByName(docs.join(bare, F.expr("instr(text, cited) > 0")).select("doc_id", "item_id", "cited", "text"))
    found = hits.withColumn("at", F.expr("instr(text, cited)")).filter("at > 0")
    return found.select("doc_id", "item_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("cited")).alias("end"), "cited", F.length("text").alias("doc_length"))


def _blocks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Passages of four lines each."""
    blocks = _lines(spark, sf_dir, of).groupBy(F.col("doc_id").alias("document_id"), F.expr("line_no div 4").cast("int").alias("chunk_index")).agg(F.min("start").alias("start_offset"), F.max("end").alias("end_offset"))
    return blocks.withColumn("chunk_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))


def _images(spark: SparkSession, sf_dir: str, cited: DataFrame | None = None) -> DataFrame:
    """Passages that hold most of each span; only documents with one are split. ``cited``: spans that were found already."""
    cited = written(_cited_spans(spark, sf_dir)) if cited is None else cited
    spans = cited.select(F.col("doc_id").alias("document_id"), F.concat_ws(":", "doc_id", "item_id").alias("query_id"), F.col("item_id").alias("ordinal"), "start", "end")
    return evidence.map_to_chunks(spans, _blocks(spark, sf_dir, cited))


@query(f"WITH {_EVIDENCE} SELECT doc_id, item_id, start, end_ FROM spans")
def evidence_spans(spark, sf_dir):
    return _cited_spans(spark, sf_dir).select("doc_id", "item_id", "start", F.col("end").alias("end_"))


@query(rf"""WITH {_EVIDENCE} SELECT doc_id, b.item_id, CASE WHEN s.item_id IS NULL THEN 'element_not_found' WHEN b.item_id % 7 = 3 THEN 'removed_by_cleaning'
        WHEN len(list_filter(regexp_split_to_array(cited, '[\x20\x09-\x0D]+'), lambda w: w <> '')) > 45 THEN 'exceeds_max_words'
        WHEN (end_ - start)::DOUBLE / doc_length > 0.5 THEN 'covers_whole_document' END AS reason FROM benchmark b LEFT JOIN spans s ON s.item_id = b.item_id""")
def citation_filter_reasons(spark, sf_dir):
    found = table(spark, sf_dir, "benchmark").select("item_id").join(_cited_spans(spark, sf_dir).withColumn("found", F.lit(True)), "item_id", "left")
    moved = found.withColumn("start", F.expr("if(item_id % 7 = 3, -1, start)"))
    return moved.select("doc_id", "item_id", evidence.citation_reason(F.struct("found", "start", "end"), text.word_count(F.col("cited")), F.col("doc_length"), 45, 0.5).alias("reason"))


@query(f"WITH {_IMAGES} SELECT doc_id, item_id, chunk_index, overlap FROM images")
def max_overlap_chunk(spark, sf_dir):
    return _images(spark, sf_dir).select(F.col("document_id").alias("doc_id"), F.col("ordinal").alias("item_id"), "chunk_index", "overlap")


@query(f"WITH {_IMAGES} SELECT DISTINCT item_id::VARCHAR AS query_id, doc_id || ':' || chunk_index AS chunk_id, 1 AS score FROM images")
def qrels_from_citations(spark, sf_dir):
    return evidence.qrels(_images(spark, sf_dir).withColumn("query_id", F.col("ordinal").cast("string")))


@query(f"WITH {_BLOCKS}, {_EVIDENCE} SELECT item_id AS query_id, doc_id AS document_id, (SELECT string_agg(b.doc_id || ':' || b.chunk_index, ' ' ORDER BY b.chunk_index) FROM blocks b WHERE b.doc_id = s.doc_id) AS candidate_ids FROM spans s")
def candidates_by_document(spark, sf_dir):
    asked = _cited_spans(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("document_id"))
    return evidence.candidate_lists(asked, _blocks(spark, sf_dir)).withColumn("candidate_ids", F.array_join("candidate_ids", " "))


# -- retention and contracts ------------------------------------------------------------------


@query(r"""SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) > 60 THEN 'question_exceeds_max_tokens' WHEN turn % 3 = 2 THEN 'answer_has_no_text'
        WHEN conv_id % 5 = 0 THEN 'answer_has_no_citations' WHEN conv_id % 7 = 0 THEN 'all_citations_unmapped' WHEN conv_id % 11 = 0 THEN 'no_chunk_holds_the_evidence' WHEN conv_id % 13 > 10 THEN 'too_many_gold_chunks' END AS reason FROM conversations""")
def query_drop_reasons(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.word_count(F.col("text")).alias("query_tokens"), F.expr("if(turn % 3 = 2, '  ', role)").alias("reference_answer"),
        F.expr("if(conv_id % 5 = 0, array(), array('p'))").alias("citations"), F.expr("conv_id % 7").alias("evidence_spans"), F.expr("conv_id % 11").alias("mapped"), F.expr("conv_id % 13").alias("gold_chunks"),
    )
    return asked.select("conv_id", "turn", dataset.drop_reason(dataset.Policy(most_query_tokens=60)).alias("reason"))


@query("""SELECT turn_id, CASE WHEN turn_id % 9 = 1 THEN 'missing_document_id' WHEN turn_id % 9 = 2 THEN 'question_texts_unreadable' WHEN turn_id % 9 = 3 THEN 'question_texts_unreadable' WHEN turn_id % 9 = 4 THEN 'output_unreadable'
        WHEN turn_id % 9 = 5 THEN 'question_answer_count_mismatch:1!=2' WHEN turn_id % 9 = 6 THEN 'no_usable_questions' END AS rejected_reason FROM (SELECT conv_id * 100 + turn AS turn_id FROM conversations)""")
def source_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 100 + turn").alias("turn_id"), "text").withColumn("m", F.expr("turn_id % 9"))
    plain = F.to_json(F.array("text"))
    rows = rows.select(
        "turn_id", F.expr("if(m = 1, ' ', cast(turn_id as string))").alias("id"),
        F.when(F.col("m") == 2, "[1]").when(F.col("m") == 3, "no json").when(F.col("m") == 6, '[" "]').otherwise(plain).alias("question_texts"),
        F.when(F.col("m") == 4, '{"a": 1}').when(F.col("m") == 5, '[{}, {"answer": null}]').otherwise('[{"answer": "x", "citations": ["p-1", "", 3]}]').alias("output"),
    )
    return questions.read_sources(rows).select("turn_id", "rejected_reason")


@query("SELECT doc_id, quality FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id) UNION ALL SELECT doc_id, NULL AS quality FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def documents_without_queries(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    lone = labels.join(docs, "doc_id", "left_anti").select("doc_id", "quality")
    return lone.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("quality", F.lit(None).cast("int")))


@query("""SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, CASE WHEN b.vec_id IS NULL THEN 'missing' WHEN a.vec_id IS NULL THEN 'foreign' ELSE 'misplaced' END AS problem
        FROM embeddings a FULL JOIN (SELECT vec_id + 5 AS vec_id, label FROM embeddings) b ON a.vec_id = b.vec_id WHERE a.label IS DISTINCT FROM b.label""")
def index_bijection(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return validate.bijection(own, own.withColumn("vec_id", F.col("vec_id") + 5), "vec_id", ("label",))


@query("""SELECT 'lineitem' AS child, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)
        UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)""")
def contract_orphans(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = validate.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", orders.filter("o_orderkey % 7 <> 0"), "o_orderkey")
    b = validate.orphans(orders, "o_custkey", customer.filter("c_custkey % 7 <> 0"), "c_custkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
    return count(a, "lineitem").unionByName(count(b, "orders"))


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return validate.repeated(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT d.lang AS name, d.n AS declared, o.n AS observed FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d LEFT JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang) o USING (lang) WHERE d.n IS DISTINCT FROM o.n")
def counter_reconcile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    count = lambda df: df.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    return validate.reconcile(count(docs), count(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")))


@query("SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def split_leakage(spark, sf_dir):
    return validate.leaking(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT text_digest FROM (SELECT md5(text) AS text_digest, source, lang FROM documents) GROUP BY text_digest HAVING count(DISTINCT (source, lang)) > 1")
def consistent_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_digest"), "source", "lang")
    return validate.inconsistent(docs, "text_digest", "source", "lang")


@query("SELECT user_id AS key, event_id AS build, ts AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def active_build(spark, sf_dir):
    return index.active_builds(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("build"), F.col("ts").alias("at"))).select("key", "build", "at")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INTEGER AS n_keys FROM events")
def json_props(spark, sf_dir):
    parsed = F.try_parse_json("props")
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.get(F.map_values(F.try_variant_get(parsed, "$", "map<string,string>")), F.lit(0)).alias("first_value"), F.size(keys).alias("n_keys"))


_BOW = r"list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda w: (('0x' || substr(sha256(w), 1, 8))::BIGINT % 32)::INTEGER)"


def _buckets(content: Column) -> Column:
    lowered = F.translate(content, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: vectors.word_bucket(w, 32))


@query(f"""WITH d AS (SELECT doc_id, lang, unnest({_BOW}) AS b FROM documents), n AS (SELECT doc_id, lang, b, count(*) AS n FROM d GROUP BY ALL),
        norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY doc_id), q AS (SELECT item_id, unnest({_BOW}) AS b FROM benchmark), qn AS (SELECT item_id, b, count(*) AS n FROM q GROUP BY ALL),
        qnorms AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM qn GROUP BY item_id), dots AS (SELECT item_id, doc_id, sum(qn.n * n.n) AS dot FROM qn JOIN n USING (b) GROUP BY item_id, doc_id)
        SELECT item_id AS query_id, doc_id AS chunk_id, round(dot / (qnorms.norm * norms.norm), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(dot / (qnorms.norm * norms.norm), 9) DESC, doc_id)::INTEGER AS rank
        FROM dots JOIN norms USING (doc_id) JOIN qnorms USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(dot / (qnorms.norm * norms.norm), 9) DESC, doc_id) <= 5""")
def bow_embedding_topk(spark, sf_dir):
    def weights(df: DataFrame, key: str, name: str) -> DataFrame:
        counts = df.select(F.col(key).alias(name), F.explode(_buckets(F.col("text"))).alias("b")).groupBy(name, "b").agg(F.count("*").alias("n"))
        held = counts.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
        return held.select(name, F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("double")).alias("embedding"))

    docs, items = weights(table(spark, sf_dir, "documents"), "doc_id", "chunk_id"), weights(table(spark, sf_dir, "benchmark"), "item_id", "query_id")
    # ids of two tables: equal ones are different things, so they differ in type
    found = search.corpus_search(items.withColumn("query_id", F.col("query_id").cast("string")), docs, 5, digits=9, least=0.0)
    return found.select(F.col("query_id").cast(table(spark, sf_dir, "benchmark").schema["item_id"].dataType).alias("query_id"), "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rates(spark, sf_dir):
    return ingest.event_rates(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# -- document operators, held against fixtures in tests ------------------------------------------


@query()
def normalize_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_row"), F.col("page_id").cast("string").alias("document_id"), F.col("html").alias("data"))
    return dataset.prepare(pages, chunking.Sizes(version="words")).select("document_id", "text", F.size("events").alias("rules_applied"), F.size("chunks").alias("n_chunks"))


@query()
def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return chunking.chunk_documents(docs, chunking.Sizes(version="words"))


def synthetic_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotated sources: each line an element with an id, a question about the second one."""
    own = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    html = F.concat_ws("", F.transform(own, lambda x, k: F.concat(F.lit('<p id="p-'), k.cast("string"), F.lit('">'), x, F.lit("</p>"))))
    asked = F.to_json(F.array(F.concat(F.lit("What is said after this: "), F.substring(F.col("text"), 1, 60))))
    answer = F.to_json(F.array(F.struct(F.substring(F.col("text"), 1, 30).alias("answer"), F.array(F.lit("p-1"), F.lit("p-99999")).alias("citations"))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), asked.alias("question_texts"), answer.alias("output"), html.alias("data"), F.col("doc_id").alias("source_row"))


@query()
def dataset_build_summary(spark, sf_dir):
    return dataset.build(synthetic_sources(spark, sf_dir), dataset.Policy(sizes=chunking.Sizes(version="words"))).summary


@query()
def passage_benchmark(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: passages of documents, citations to benchmark texts, bag-of-words search inside the document, and metrics."""
    # what several steps read is found once; only documents that are asked about are split and embedded
    spans = written(_cited_spans(spark, sf_dir))
    blocks = written(_blocks(spark, sf_dir, spans))
    judged = written(evidence.qrels(_images(spark, sf_dir, spans)).withColumn("relevance", F.col("score")))
    docs = table(spark, sf_dir, "documents")
    passages = blocks.join(docs.select(F.col("doc_id").alias("document_id"), "text"), "document_id").select(
        "document_id", "chunk_id", _unit_bag(F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))).alias("embedding")
    )
    asked = spans.select(F.concat_ws(":", "doc_id", "item_id").alias("query_id"), F.col("doc_id").alias("document_id"), _unit_bag(F.col("cited")).alias("embedding"))
    scored = search.document_pairs(asked, passages).select("query_id", "chunk_id", vectors.cosine(F.col("query_vector"), F.col("chunk_vector")).alias("score"))
    run = search.top_k(scored.filter("score is not null"), 100).select(F.lit("bag-of-words").alias("run"), "query_id", "chunk_id", "score")
    return metrics.evaluate(written(run), judged)


def _unit_bag(content: Column) -> Column:
    counts = F.aggregate(_buckets(content), F.array_repeat(F.lit(0), 32), lambda acc, k: F.transform(acc, lambda n, i: n + (i == k).cast("int")))
    return vectors.normalize(counts)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
