"""DataFrame operators on small frames, and the dataset build, snapshots and index from end to end."""

import json
import math
import random

import pytest

from passagemill.errors import GenerationError, IndexBuildError, IndexCompatibilityError, IndexNotReadyError, PublicationError, RetrievalInputError, SourceContractError
from passagemill.functions import text as text_columns
from passagemill.functions.chunking import Sizes
from passagemill.functions.questions import read_sources
from passagemill.operators import convert, dataset, index, metrics, report, retrieve, search, validate
from passagemill.sources import readers, sinks
from passagemill.sources.embed import Model
from passagemill.sources.snapshot import Publisher
from pyspark.sql import functions as F

SIZES = Sizes(most=60, target=40, overlap=8, least=8, version="words")


def source(document, questions, answers, html):
    return (document, json.dumps(questions), json.dumps(answers), html)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, question_texts string, output string, data string, source_row long")


GOOD = [{"answer": "yes", "citations": ["p-0"]}]
HTML = '<p id="p-0">The contract ends in May and the parties agree on it.</p><p id="p-1">Another paragraph about costs.</p>'
MIXED = [
    source("doc-a", ["", "What about p-99?", "No citations here?", "Null answer here?"], [{}, {"answer": "a", "citations": ["p-99"]}, {"answer": "a", "citations": []}, {"answer": None, "citations": ["p-0"]}], HTML),
    source("doc-b", ["When does the contract end?"], GOOD, HTML),
    source("doc-b", ["Repeated?"], GOOD, HTML),
    source("doc-empty", ["Anything there?"], GOOD, " "),
    source("doc-mismatch", ["One?", "Two?"], GOOD, HTML),
    ("doc-bad-json", "[1]", json.dumps(GOOD), HTML),
    ("doc-bad-output", json.dumps(["q?"]), "{}", HTML),
    source("doc-blank", [" "], GOOD, HTML),
    source(" ", ["No id?"], GOOD, HTML),
    source("doc-none", ["Blank answer?"], [{"answer": " ", "citations": ["p-0"]}], HTML),
]


@pytest.fixture(scope="module")
def built(spark):
    out = dataset.build(rows_of(spark, MIXED), dataset.Policy(sizes=SIZES))
    return {n: df.persist() for n, df in out.artifacts.items()}, out.summary.first().asDict()


def test_every_reason_once(built):
    artifacts, _ = built
    rejected = {(r["source_row"], r["reason"]) for r in artifacts["audits/rejected_sources"].collect()}
    assert rejected == {
        (0, "no_retained_queries"), (2, "duplicate_document_id"), (3, "empty_document_after_cleaning"), (4, "question_answer_count_mismatch:2!=1"), (5, "question_texts_unreadable"),
        (6, "output_unreadable"), (7, "no_usable_questions"), (8, "missing_document_id"), (9, "no_retained_queries"),
    }
    dropped = {(r["query_id"], r["reason"]) for r in artifacts["audits/dropped_queries"].collect()}
    assert dropped == {
        ("doc-a:q0", "blank_question"), ("doc-a:q1", "all_citations_unmapped"), ("doc-a:q2", "answer_has_no_citations"), ("doc-a:q3", "answer_has_no_text"), ("doc-none:q0", "answer_has_no_text"),
        ("doc-blank:q0", "blank_question"),
    }


def test_published_rows_and_counters(built):
    artifacts, summary = built
    assert [r["_id"] for r in artifacts["beir/queries"].collect()] == ["doc-b:q0"]
    [span] = artifacts["evidence"].first()["spans"]
    assert span["citation_id"] == "p-0" and span["start"] == 0 and span["chunk_id"] == artifacts["beir/qrels"].first()["corpus-id"]
    assert summary["source_rows"] == 10 and summary["documents"] == 1 and summary["queries_retained"] == 1
    validate.check(artifacts, summary)


def test_too_many_gold_passages(spark):
    html = "".join(f'<p id="p-{k}">' + " ".join(f"w{k}x{j}" for j in range(30)) + "</p>" for k in range(14))
    rows = rows_of(spark, [source("d", ["Which of all of them?"], [{"answer": "all", "citations": [f"p-{k}" for k in range(14)]}], html)])
    out = dataset.build(rows, dataset.Policy(sizes=SIZES, most_gold_chunks=10))
    [row] = out.artifacts["audits/dropped_queries"].collect()
    assert row["reason"] == "too_many_gold_chunks" and row["gold_chunks"] > 10
    assert dataset.build(rows, dataset.Policy(sizes=SIZES, most_gold_chunks=0)).artifacts["beir/queries"].count() == 1


@pytest.mark.parametrize("artifact, change, what", [
    ("beir/corpus", lambda df: df.unionByName(df), "corpus ids repeat"), ("beir/candidates", lambda df: df.limit(0), "question without candidates"), ("beir/qrels", lambda df: df.limit(0), "question without a judgment"),
    ("beir/candidates", lambda df: df.withColumn("document_id", F.lit("other")), "another document"), ("beir/corpus", lambda df: df.withColumn("metadata", F.col("metadata").withField("start_offset", F.lit(-1))), "no interval"),
])
def test_broken_datasets_are_refused(built, artifact, change, what):
    artifacts, summary = built
    with pytest.raises(GenerationError, match=what):
        validate.check(artifacts | {artifact: change(artifacts[artifact])}, summary)


def test_wrong_counters_are_refused(built):
    artifacts, summary = built
    with pytest.raises(GenerationError, match="queries is 99"):
        validate.check(artifacts, summary | {"queries": 99})


# -- snapshots and index -------------------------------------------------------------------------


def test_publication_and_retrieval(spark, built, tmp_path):
    artifacts, summary = built
    publisher = Publisher(spark, tmp_path)
    first = publisher.publish(artifacts, summary, generation_id="g1")
    with pytest.raises(GenerationError):
        publisher.publish(artifacts, summary | {"queries": 5}, generation_id="bad")
    assert publisher.current_id() == "g1" and not (tmp_path / "generations" / "bad").exists()
    publisher.publish(artifacts, summary, generation_id="g2")
    assert publisher.load().manifest["generation_id"] == "g2" and publisher.activate("g1").manifest["generation_id"] == "g1"
    with pytest.raises(PublicationError):
        publisher.publish(artifacts, summary, generation_id="g1")

    profile = Model("test", dimension=4)
    corpus = first.frame("beir/corpus").select(F.col("_id").alias("chunk_id"), "metadata.document_id", "metadata.chunk_index", "text")
    unit = lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).cast("array<float>"))
    store = index.IndexStore(spark, tmp_path / "index")
    with pytest.raises(IndexNotReadyError):
        store.active("g1", "test")
    facts = index.Provenance("test", "r1", 4, "g1", first.manifest_sha256, "", "", profile.passage_profile, corpus.count())
    one = store.build(corpus, facts, profile, unit)
    two = store.build(corpus, facts, profile, unit)
    status = {r["index_build_id"]: r["status"] for r in store.builds().collect()}
    assert status == {one: "superseded", two: "active"}
    with pytest.raises(IndexBuildError):
        store.insert(two, unit(corpus))
    with pytest.raises(IndexBuildError, match="wrong size"):
        store.build(corpus, facts, profile, lambda df: unit(df).withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>")))
    with pytest.raises(IndexBuildError, match="missing"):
        store.build(corpus, facts, profile, lambda df: unit(df).limit(0))
    run, provenance = retrieve.rank(first, store, profile, model_revision="r1", embed_queries=unit, settle=lambda df: df.persist())
    assert run.count() == corpus.count() and provenance["index_build_id"] == two
    with pytest.raises(IndexCompatibilityError, match="model_revision"):
        retrieve.rank(first, store, profile, model_revision="r2", embed_queries=unit, settle=lambda df: df.persist())


# -- search and metrics ----------------------------------------------------------------------------


def test_scoped_search_order_and_ties(spark):
    chunks = spark.createDataFrame([("c0", "a", [1.0, 0.0]), ("c1", "a", [0.6, 0.8]), ("c2", "a", [0.8, 0.6]), ("c9", "b", [0.0, 1.0]), ("c3", "a", [0.6, 0.8])], "chunk_id string, document_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<double>")
    candidates = spark.createDataFrame([("q", "a", ["c0", "c1", "c2", "c3"])], "query_id string, document_id string, candidate_ids array<string>")
    found = search.scoped_search(queries, candidates, chunks, 3, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in found] == [("c1", 0.8), ("c3", 0.8), ("c2", 0.6)]
    arrow = search.scoped_search(queries, candidates, chunks, 3, 999).orderBy("rank").collect()
    assert [r["chunk_id"] for r in arrow] == ["c1", "c3", "c2"]
    search.check_inputs(queries, candidates, chunks)
    with pytest.raises(RetrievalInputError, match="not_indexed"):
        search.check_inputs(queries, candidates.withColumn("candidate_ids", F.array(F.lit("none"))), chunks)
    with pytest.raises(ValueError):
        search.top_k(chunks, 0)


def brute_metrics(run, qrels, k):
    out = {m: 0.0 for m in metrics.FAMILIES}
    for q, judged in qrels.items():
        order = sorted(run.get(q, {}).items(), key=lambda x: (x[1], x[0]), reverse=True)
        rel = [judged.get(c, 0) for c, _ in order][:k]
        good = [r for r in judged.values() if r > 0]
        dcg = sum(r / math.log2(i + 2) for i, r in enumerate(rel) if r > 0)
        ideal = sum(r / math.log2(i + 2) for i, r in enumerate(sorted(good, reverse=True)[:k]))
        hits = [i for i, r in enumerate(rel) if r > 0]
        out["NDCG"] += dcg / ideal if ideal else 0
        out["MAP"] += sum((n + 1) / (i + 1) for n, i in enumerate(hits)) / len(good) if good else 0
        out["Recall"] += len(hits) / len(good) if good else 0
        out["P"] += len(hits) / k
        out["MRR"] += 1 / (hits[0] + 1) if hits else 0
        out["Pass"] += bool(hits)
    return {m: v / len(qrels) for m, v in out.items()}


def test_metrics_are_their_definitions(spark):
    rng = random.Random(4)
    qrels = {f"q{k}": {f"c{rng.randrange(30)}": rng.choice([0, 1, 1, 2]) for _ in range(6)} for k in range(25)}
    runs = {r: {f"q{k}": {f"c{c}": rng.choice([0.1, 0.2, 0.3, 0.5]) for c in rng.sample(range(30), 12)} for k in range(30) if rng.random() > 0.2} for r in ("a", "b")}
    judged = spark.createDataFrame([(q, c, r) for q, own in qrels.items() for c, r in own.items()], "query_id string, chunk_id string, relevance int")
    ranked = spark.createDataFrame([(n, q, c, s) for n, run in runs.items() for q, own in run.items() for c, s in own.items()], "run string, query_id string, chunk_id string, score double")
    for row in metrics.evaluate(ranked, judged, (10, 1, 3, 3), digits=9).collect():
        want = brute_metrics(runs[row["run"]], qrels, row["k"])
        assert {m: pytest.approx(row[m], abs=1e-8) for m in metrics.FAMILIES} == want
    wide = metrics.wide_form(metrics.evaluate(ranked, judged, (1,)), (1,)).first()
    assert wide["MAP@1"] <= wide["P@1"] == wide["MRR@1"] == wide["Pass@1"]
    assert metrics.coverage(ranked, judged).count() == 2
    assert "run" in report.leaderboard_text(metrics.long_form(metrics.evaluate(ranked, judged, (10,))))


# -- readers and writers -----------------------------------------------------------------------------


def test_csv_rows(spark, tmp_path):
    path = tmp_path / "cases-test.csv"
    path.write_text('id,question_texts,output,data\r\nd1,"[""Q1?""]","[{""answer"": ""x"", ""citations"": [""p-0""]}]","<p id=""p-0"">A\nB</p>"\r\nd2,[],[],\r\n')
    rows = readers.read_source_rows(spark, str(path)).orderBy("source_row").collect()
    assert [r["id"] for r in rows] == ["d1", "d2"] and rows[0]["data"] == '<p id="p-0">A\nB</p>'
    sha = readers.file_sha256(str(path))
    assert readers.verify_source_file(spark, str(path), expected_sha256=sha, expected_rows=2).split == "test"
    for more in ({"expected_sha256": "0", "expected_rows": 2}, {"expected_sha256": sha, "expected_rows": 3}):
        with pytest.raises(SourceContractError):
            readers.verify_source_file(spark, str(path), **more)
    assert readers.read_source_rows_strict(spark, str(path)).count() == 2
    path.write_text("id,question_texts,output,data\nd1,[],[],x\nd1,[],[],x\n")
    with pytest.raises(SourceContractError, match="repeated_id"):
        readers.read_source_rows_strict(spark, str(path))


def test_judgments(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text("query-id\tcorpus-id\tscore\nq1\tc1\t1\nq1\tc1\t0\n\nq2\tc5\t2\n")
    assert sorted(map(tuple, readers.read_qrels(spark, str(path)).collect())) == [("q1", "c1", 0), ("q2", "c5", 2)]
    assert readers.read_qrels_strict(spark, str(path)).count() == 3
    path.write_text("q1\tc1\tx\n")
    with pytest.raises(ValueError, match="line 1"):
        readers.read_qrels(spark, str(path))


def test_runs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"q1": {"c1": 0.5, "c2": 1}, "q2": {}}')
    (tmp_path / "b.run").write_text("q1 Q0 c1 1 0.25 t\nq1 Q0 c2 2 0.125 t\n")
    (tmp_path / "report.json").write_text('{"k_values": [], "models": []}')
    found = sorted(map(tuple, readers.read_runs(spark, str(tmp_path)).collect()))
    assert found == [("a", "q1", "c1", 0.5), ("a", "q1", "c2", 1.0), ("b", "q1", "c1", 0.25), ("b", "q1", "c2", 0.125)]
    for bad in ('{"q": {"c": "1"}}', '{"q": {"c": true}}', '{"q": 1}', "{}", "[]", "q Q0 c 1", "q Q0 c 1 x t", "q Q0 c 1 NaN t", "q Q0 c 1 1 t\nq Q0 c 2 1 t"):
        (tmp_path / "bad.run").write_text(bad)
        with pytest.raises(ValueError):
            readers.read_run(spark, str(tmp_path / "bad.run"))


def test_writers(spark, tmp_path):
    run = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("p", "c", 1.0)], "query_id string, chunk_id string, score double")
    sinks.write_run(run, tmp_path / "r.trec", "trec", "tag")
    assert (tmp_path / "r.trec").read_text() == "p Q0 c 1 1.000000 tag\nq Q0 a 1 0.500000 tag\nq Q0 b 2 0.500000 tag\n"
    sinks.write_run(run, tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"q": {"a": 0.5, "b": 0.5}, "p": {"c": 1.0}}
    nulls = spark.createDataFrame([("x", None)], "a string, b string")
    assert sinks.write_json_lines(nulls, tmp_path / "n.jsonl") == 1 and json.loads((tmp_path / "n.jsonl").read_text()) == {"a": "x", "b": None}
    with pytest.raises(ValueError):
        sinks.write_json_lines(run.withColumn("score", F.lit(float("nan"))), tmp_path / "nan.jsonl")
    with pytest.raises(ValueError):
        sinks.write_tsv(spark.createDataFrame([("a\tb",)], "x string"), tmp_path / "t.tsv")
    assert not (tmp_path / "nan.jsonl").exists() and not (tmp_path / "t.tsv").exists()


# -- expressions and conversion ------------------------------------------------------------------------


def test_python_and_column_headings_agree(spark):
    from passagemill.functions.headings import is_heading, is_legacy_heading

    lines = ["CARTÃO DE CRÉDITO", "I - DOS FATOS", "2.1. Da cobranca", "2.1. 04/04/1976", "04/04/1976", "", "  ", "F KO 4MQ33E", "DAS ALEGAÇÕES DA PARTE", "texto comum", "XY ZW 12AB3", "DOS FATOS " + "E " * 100, "1) é uma"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", text_columns.is_heading(F.col("x")), text_columns.is_legacy_heading(F.col("x"))).collect()
    assert [(r[1], r[2]) for r in df] == [(is_heading(x), is_legacy_heading(x)) for x in lines]


def test_question_boilerplate(spark):
    asked = ["Qual é o valor total da causa?  Caso não encontre, responda não consta.", "Qual?  Não adicione nada.", "  Quem assinou \n o contrato principal ;"]
    df = spark.createDataFrame([(x,) for x in asked], "x string")
    assert [r[0] for r in df.select(text_columns.normalize_question(F.col("x"))).collect()] == ["Qual é o valor total da causa?", "Qual? Não adicione nada.", "Quem assinou o contrato principal"]


def test_sources_keep_types_apart(spark):
    rows = spark.createDataFrame([("d", '["q?"]', '[{"answer": true, "citations": ["p", 1, ""]}]', "")], "id string, question_texts string, output string, data string").withColumn("source_row", F.lit(0))
    from passagemill.functions.questions import explode_questions

    [row] = explode_questions(read_sources(rows)).collect()
    assert row["reference_answer"] == "True" and row["citations"] == ["p"]


def test_pairs_convert(spark):
    pairs = spark.createDataFrame([("test", "d1", "Q1?", ["a", "b"], "c"), ("test", "d1", "Q2?", ["a"], ""), ("test", "d2", "", ["z"], "")], "split string, document_id string, question string, positive array<string>, negative string")
    out = convert.convert_pairs(pairs)
    assert (out["corpus"].count(), out["queries"].count(), out["qrels"].count()) == (3, 2, 3)
    assert all(len(r["candidate_ids"]) == 3 for r in out["candidates"].collect())
    with pytest.raises(ValueError, match="split"):
        convert.convert_pairs(pairs.unionByName(pairs.withColumn("split", F.lit("train"))))
    with pytest.raises(ValueError):
        convert.detect_column(["a"], "question", required=True)


def test_stream_ingest(spark, tmp_path):
    from passagemill.streaming.ingest import ingest, source_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("id", "question_texts", "output", "data"), r, strict=True))) for r in MIXED[1:2]))
    seen = []
    query = ingest(source_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda artifacts, n: seen.append((n, artifacts["beir/queries"].count())), dataset.Policy(sizes=SIZES))
    query.awaitTermination()
    assert seen == [(0, 1)]


@pytest.mark.parametrize("name", ["ir_metrics_at_k", "max_overlap_chunk", "line_spans", "query_drop_reasons"])
def test_catalogue_against_sql(spark, sf_dir, name):
    import glob
    import os

    import duckdb

    from passagemill.plans.catalogue import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lines_of_files_in_many_splits_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "run.trec"
    lines = [f"q{k} Q0 c{k} {k} {k / 7:.3f} tag" if k % 13 else "" for k in range(3000)]
    path.write_bytes("\r\n".join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = readers.numbered_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line_no"], r["value"]) for r in found) == [(k + 1, x) for k, x in enumerate(lines) if x]


def test_folders_of_splits_and_judgments_a_split(spark, tmp_path):
    spark.createDataFrame([("q one", "p one", "d1")], "question string, positive string, document_id string").toPandas().to_json(tmp_path / "train.jsonl", orient="records", lines=True)
    (tmp_path / "test.csv").write_text('question,positive,document_id\n"q, two","p two",d2\n')
    rows = readers.read_splits(spark, str(tmp_path))
    assert sorted((r["split"], r["question"]) for r in rows.collect()) == [("test", "q, two"), ("train", "q one")]
    made = convert.convert_pairs(rows)
    out = tmp_path / "beir"
    assert sinks.write_split_qrels(made["qrels"], out / "qrels") == {"test": 1, "train": 1}
    for name in ("corpus", "queries"):
        sinks.write_json_lines(made[name], out / f"{name}.jsonl", "_id")
    loaded = readers.read_beir(spark, str(out), "test")
    assert [r["text"] for r in loaded["queries"].collect()] == ["q, two"] and loaded["corpus"].count() == 2
    assert [(r["query_id"], r["relevance"]) for r in loaded["qrels"].collect()] == [(loaded["queries"].first()["query_id"], 1)]


def test_search_of_a_whole_corpus_in_blocks(spark):
    import numpy as np

    random = np.random.default_rng(0)
    own = random.integers(0, 3, (300, 6)).astype(float)
    own[7] = 0
    asked = random.integers(0, 3, (40, 6)).astype(float)
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)], "chunk_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(asked)], "query_id string, embedding array<double>")
    want = []
    for k, q in enumerate(asked):
        scores = [(-round(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), 9), c) for c, v in enumerate(own) if v.any() and q.any() and q @ v > 0]
        want += [(f"q{k}", c, n + 1) for n, (_, c) in enumerate(sorted(scores)[:4])]
    found = search.corpus_search(queries, chunks, 4, block=16, digits=9, least=0.0).select("query_id", "chunk_id", "rank").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    with pytest.raises(ValueError):
        search.corpus_search(queries, chunks, 0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_in_documents_keeps_one_result_a_question(spark, monkeypatch, kind):
    """Ties, zero vectors and documents of many blocks; a question's results don't add up over blocks."""
    import numpy as np

    drawn = np.random.default_rng(1).integers(-1, 2, (400, 4)).astype(float)
    name = (lambda k: k) if kind == "long" else (lambda k: f"c{k:04d}")
    every = spark.createDataFrame([(name(k), k % 3 % 2, v.tolist()) for k, v in enumerate(drawn)], f"chunk_id {kind}, document_id int, embedding array<float>").repartition(4)
    want = []
    for k, q in enumerate(drawn):
        scores = [(-round(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), 12), c) for c, v in enumerate(drawn) if c != k and c % 3 % 2 == k % 3 % 2 and v.any() and q.any()]
        want += [(name(k), name(c), n + 1) for n, (_, c) in enumerate(sorted(scores)[:5])]
    asked = every.withColumnRenamed("chunk_id", "query_id")
    assert sorted(map(tuple, search.document_search(asked, every, 5, block=32).select("query_id", "chunk_id", "rank").collect())) == sorted(want)
    monkeypatch.setattr(search, "top_k", lambda scored, k: scored)
    assert search.document_search(asked, every, 5, block=32).count() == len(want)


def test_passages_leave_a_worker_in_slices(spark):
    import pyarrow as pa

    from passagemill.functions import chunking

    class Caught:
        """Gives the function that a worker would run."""

        sparkSession = spark  # noqa: N815
        select = selectExpr = lambda self, *columns: self  # noqa: N815
        mapInArrow = lambda self, run, schema: run  # noqa: N815

    texts = [*(f"word {k} of a text" for k in range(1000)), None, "", "x " * 600_000, "last one"]
    rows, names = range(len(texts)), [f"d{k}" for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names), pa.array(texts), pa.array(texts)], names=["source_row", "document_id", "text", "data"])
    chunks = list(chunking.chunk_documents(Caught(), SIZES)(iter([batch])))
    prepared = list(dataset.prepare(Caught(), SIZES)(iter([batch])))
    assert max(len(set(b.column("document_id").to_pylist())) for b in chunks) <= 64 and max(b.num_rows for b in prepared) <= 64
    assert {d for b in chunks for d in b.column("document_id").to_pylist()} == {d for d, t in zip(names, texts, strict=True) if t}
    assert [d for b in prepared for d in b.column("document_id").to_pylist()] == names


def test_runs_end_at_the_largest_cutoff(spark):
    """Scores summed in order are to the bit those of the expressions, equal ones go to the larger id, and deeper runs and rarer judgments change no metric."""
    import numpy as np

    from passagemill.functions.vectors import cosine, dot

    drawn = np.random.default_rng(2).standard_normal((150, 7)).astype(np.float32)
    drawn[75:] = drawn[:75]
    every = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(drawn)], "chunk_id long, document_id int, embedding array<float>")
    asked = every.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    pairs = search.document_pairs(asked, every).filter("query_id <> chunk_id")
    first = lambda c: F.slice(c, 1, 3)
    judged = pairs.filter("chunk_id % 7 = query_id % 7").select("query_id", "chunk_id", F.expr("chunk_id % 4 - 1").alias("relevance"))
    for measure, score in ((search.InOrder(cosine=True), cosine(F.col("query_vector"), F.col("chunk_vector"))), (search.InOrder(3), dot(first("query_vector"), first("chunk_vector")))):
        whole = pairs.select(F.lit("a").alias("run"), "query_id", "chunk_id", score.alias("score"))
        short = search.document_best(asked, every, 5, measure, block=16, last_first=True).withColumn("run", F.lit("a"))
        want = metrics.ranked(whole, judged, 5).join(whole, ["run", "query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", "score")
        got = metrics.ranked(short, judged).join(short, ["run", "query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", "score")
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
        assert sorted(map(tuple, metrics.evaluate(whole, judged, (1, 5)).collect())) == sorted(map(tuple, metrics.evaluate(short, judged, (1, 5)).collect()))


def test_the_flagship_looks_for_spans_once(spark, sf_dir, monkeypatch):
    from passagemill.plans import catalogue

    plans, texts, inner, lines = [], [], catalogue._cited_spans, catalogue._lines
    monkeypatch.setattr(catalogue, "_cited_spans", lambda *a: plans.append(inner(*a)) or plans[-1])
    monkeypatch.setattr(catalogue, "_lines", lambda *a: texts.append(lines(*a)) or texts[-1])
    made = catalogue.flagship(spark, sf_dir)
    assert len(plans) == 1 and "documents.parquet" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 6
    cited = {r["doc_id"] for r in plans[0].collect()}
    assert all({r["doc_id"] for r in x.select("doc_id").distinct().collect()} == cited for x in texts)


def test_blank_keys_are_never_repeated(spark):
    rows = spark.createDataFrame([(k, key) for k, key in enumerate(["", "a", "", "a", "b", ""])], "source_row long, document_id string")
    assert [r["is_repeated"] for r in dataset.first_wins(rows).orderBy("source_row").collect()] == [False, False, False, True, False, False]
