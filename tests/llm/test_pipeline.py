"""The pipeline's stages, each held against plain Python on what the stage before it kept."""

from collections import Counter, defaultdict

import numpy as np
import xxhash

from tests.llm.conftest import ODD
from tests.llm.test_corpus_operators import EL, classes, shingle_set, similar
from tests.llm.test_text_operators import brute_kept, merged, own_words, tokenizer


def fixture_rows():
    """Rows (doc_id, text, lang, source): two languages, a notice of a host, copies, near copies, short and odd texts, secrets, shared and null ids."""
    random = np.random.default_rng(12)
    greek = EL.split()
    notice = "all rights are reserved by the publisher of this page"
    rows = []
    for k in range(60):
        body = [own_words(20_000 + 10 * k + j, 30) for j in range(3)]
        rows.append((len(rows), "\n".join([*body, notice]), "xx", "a"))
    for k in range(40):
        rows.append((len(rows), "\n".join(" ".join(f"{w}{chr(945 + int(c))}" for w, c in zip(random.choice(greek, 12), random.integers(0, 20, 12), strict=True)) for _ in range(4)), "el", None))
    page = own_words(77, 200).split()
    for k in range(12):
        own = list(page)
        own[5 * k] = f"q{chr(97 + k)}"
        rows.append((len(rows), " ".join(own), "xx", ""))
    rows += [(len(rows) + k, rows[70][1], "el", "b") for k in range(3)]
    rows += [(None, own_words(501, 90), "xx", "b"), (None, own_words(502, 90), None, "b"), (None, own_words(501, 90), "xx", "b")]
    rows += [(9000, own_words(600 + k, 90), "xx", "c") for k in range(3)] + [(9000, own_words(600, 90), "xx", "c")] * 2
    rows += [(9100 + k, own_words(700 + k, 80) + f" token=abcdefghij{k}klmnop user: bob " + own_words(800 + k, 30), "xx", "c") for k in range(4)]
    rows += [(9200, " ".join(map(str, range(50))), "xx", "c"), (9201, own_words(900, 8), "xx", "c")]
    return rows + [(9300 + k, t, None, "odd") for k, t in enumerate(ODD)]


def test_stages_are_those_of_plain_rules(spark, docs_of, tmp_path):
    import corpus_pipeline

    rows = fixture_rows()
    ids, texts, langs, hosts = map(list, zip(*rows, strict=True))
    docs = docs_of(texts, doc_id=ids, lang=langs, source=hosts, score=["s"] * len(rows))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: Counter((r["doc_id"], r["text"], r["n_chars"], r["score"]) for r in df.collect())
    whole = lambda own: Counter({(i, t, len(t), "s"): n for (i, t), n in own.items()})

    # quality rules, with the limits that the stage has
    own = [(t or "").lower() for t in texts]
    normal = lambda line: "".join(c for c in np.array(list(line), object) if c.isalpha() or c == "0")
    plain = [k for k, t in enumerate(own) if t.isascii()]
    judged = dict(zip(plain, brute_kept([texts[k] for k in plain], [hosts[k] for k in plain], 30, 0.002), strict=True))
    kept = stages["quality rules"](spark, docs, str(tmp_path))
    found, want = seen(kept), Counter()
    for k, (stays, gone) in judged.items():
        if stays:
            want[(ids[k], "\n".join(x for x in texts[k].split("\n") if normal(x.lower()) not in gone))] += 1
    greek = Counter((ids[k], texts[k]) for k in range(len(texts)) if langs[k] == "el")
    assert found == whole(want + greek) and sum(found.values()) > 120 and kept.columns == docs.columns
    assert not any("rights" in (r[1] or "") for r in found)

    # languages: all of these have one but the text of numbers
    two = stages["language ID"](spark, kept, str(tmp_path))
    found = Counter({r: n for r, n in found.items() if r[0] != 9200})
    assert seen(two) == found

    # near-duplicates: of each class the least (no id, id, hash of the text), once
    three = stages["near-duplicates"](spark, two, str(tmp_path))
    distinct = sorted({(i is None, i or 0, int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)), t) for i, t, _, _ in found})
    sets = [shingle_set(t) for *_, t in distinct]
    label = classes(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])])
    want = Counter({(None if distinct[k][0] else distinct[k][1], distinct[k][3]): 1 for k in set(label)})
    assert seen(three) == whole(want) and len(want) < sum(found.values()) - 15

    # secrets
    from passagemill.llm import secret_scan

    spans = {(r["doc_id"], r["key"]): r["spans"] for r in secret_scan.scan(three).withColumn("key", secret_scan.F.split("key", ":")[1]).collect()}
    hexed = lambda t: f"{xxhash.xxh64_intdigest(t.encode(), 42):X}"
    four = stages["secret scans"](spark, three, str(tmp_path))
    want = Counter({(i, merged(t, spans[(i, hexed(t))])): 1 for i, t in want})
    assert seen(four) == whole(want) and sum("[secret] [secret]" in t for _, t in want) == 4 and not any("token=" in t for _, t in want)

    # packing, and the whole run
    def placed(df):
        pieces, sequences = defaultdict(list), Counter()
        for r in df.collect():
            pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
            sequences[r["sequence_id"]] += r["length"]
        assert max(sequences.values()) <= 2048
        return {k: sorted(v) for k, v in pieces.items()}

    once = placed(stages["packing"](spark, four, str(tmp_path)))
    tokens, library = Counter(), tokenizer()
    for i, t in want:
        tokens[i] += len(library.encode(t, add_special_tokens=False).ids) + 1
    assert {k: sum(p[1] for p in v) for k, v in once.items()} == tokens
    assert placed(corpus_pipeline.run(spark, str(tmp_path))) == once


def test_stages_take_empty_tables(spark, docs_of):
    import corpus_pipeline

    docs = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
