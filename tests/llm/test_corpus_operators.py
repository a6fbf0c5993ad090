"""Operators over whole corpora, held against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from passagemill.llm import attention, components, language_id, lm_scoring, near_dup, queries, sharding, topk, url_filter
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- near duplicates ----------------------------------------------------------------------------


def simhash(text, shingle):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    label = list(range(n))
    for _ in range(n):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near_texts():
    random = np.random.default_rng(3)
    texts = list(ODD)
    for k in range(12):
        words = [f"w{x}" for x in random.integers(0, 900, 250)]
        texts.append(" ".join(words))
        for _ in range(6):
            words[random.integers(0, 250)] = "changed"
            texts.append(" ".join(words))
    return texts


def test_components_are_those_of_all_pairs(docs_of):
    texts = near_texts()
    prints = [simhash(t, 3) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = classes(len(texts), linked)
    found = {r["doc_id"]: r for r in near_dup.near_duplicates(docs_of(texts), **near_dup.NARROW).collect()}
    assert [found[k]["component_id"] for k in range(len(texts))] == want
    assert [found[k]["fp"].hex() for k in range(len(texts))] == [f"{p:016x}" for p in prints]


def test_small_tiles_change_nothing(docs_of):
    texts = near_texts()
    a = near_dup.near_duplicates(docs_of(texts), **near_dup.NARROW | {"tile": 2}).select("doc_id", "component_id")
    b = near_dup.near_duplicates(docs_of(texts), **near_dup.NARROW | {"parts": 1}).select("doc_id", "component_id")
    assert a.exceptAll(b).count() == 0


def test_offsets_cover_all_close_counts():
    offsets = near_dup.near_offsets(3, 4)
    random = np.random.default_rng(0)
    a = random.integers(0, 2**63, 300, dtype=np.uint64)
    b = a ^ sum((np.uint64(1) << random.integers(0, 64, 300).astype(np.uint64)) for _ in range(1)) ^ (np.uint64(1) << np.uint64(5))
    away = np.abs(near_dup.signatures(a, 4) - near_dup.signatures(b, 4))
    assert set(away.tolist()) <= set(offsets)


def test_wide_fingerprints_find_similar_texts_and_no_others(docs_of):
    random = np.random.default_rng(5)
    texts = []
    for _ in range(15):
        words = [f"w{x}" for x in random.integers(0, 3000, 300)]
        texts.append(" ".join(words))
        for at in (3, 150):
            words[at] = "changed"
        texts.append(" ".join(words))
    kept = sorted(r["doc_id"] for r in near_dup.keep_one(docs_of(texts, more=["x"] * 30)).collect())
    assert kept == list(range(0, 30, 2))


def shingle_set(text, n=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def changed_texts(bases=14, copies=12, seed=8):
    """Texts and copies that change more and more, so that similarities lie from 0.6 to 1."""
    random = np.random.default_rng(seed)
    texts = []
    for k in range(bases):
        n = int(random.choice([7, 20, 60, 150, 400, 2000]))
        words = [f"w{x}" for x in random.integers(0, 5000, n)]
        texts.append(" ".join(words))
        for c in range(copies):
            own = list(words)
            for at in random.integers(0, n, max(1, int(n * random.uniform(0, 0.05)))):
                own[at] = f"c{k}x{random.integers(0, 9)}"
            texts.append(" ".join(own if c % 3 else own + own[: n // 8]))
    return texts


@pytest.mark.parametrize("block", [4 << 20, 1500])
def test_one_text_stays_of_each_group_that_exact_similarity_links(docs_of, block):
    texts = [*ODD, *changed_texts(8 if block < 9999 else 14)]
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])]
    between = sum(0.6 < len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.8 for a in range(len(texts)) for b in range(a) if sets[a] & sets[b])
    assert between > 50
    want = sorted(set(classes(len(texts), linked)))
    assert sorted(r["doc_id"] for r in near_dup.keep_one(docs_of(texts), block=block).collect()) == want


def test_candidates_hold_nearly_all_similar_texts():
    texts = changed_texts(110, 14, seed=1)
    prints = [near_dup.fingerprint(np.unique(near_dup.hashes_of(t, 5)), 4) for t in texts]
    sets = [shingle_set(t) for t in texts]
    found = total = 0
    for a in range(len(texts)):
        for b in range(a - a % 15, a):
            if similar(sets[a], sets[b]) and len(sets[a]) > 20:
                apart = np.bitwise_count(prints[a] ^ prints[b])
                total += 1
                found += apart[0] <= near_dup.WIDE["lead"] and apart.sum() <= near_dup.WIDE["radius"]
    assert total > 1000 and found / total > 0.998


def test_different_texts_without_an_id_or_with_the_same_one_stay(docs_of):
    random = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 3000, 100)) for _ in range(9)]
    ids = [None] * 4 + [7, 7, 8, 9, 9]
    # repeats: one without an id, one with another id, and one row twice
    docs = docs_of([*texts, texts[0], texts[6], texts[8]], doc_id=[*ids, None, 10, 9])
    kept = near_dup.keep_one(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(i), t) for i, t in zip(ids, texts, strict=True))


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- search -------------------------------------------------------------------------------------


def test_exact_top_k(spark):
    random = np.random.default_rng(1)
    centers = random.standard_normal((6, 8))
    rows = [(k, (centers[k % 6] + random.standard_normal(8) * 0.2).tolist()) for k in range(900)]
    rows += [(k, rows[5][1]) for k in range(900, 1300)]  # a hot vector: ties
    rows += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [0.5] * 8), (2004, []), (2005, [0.25, 0.5])]
    table = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, label string")
    usable = {a: np.floor(1024 * np.array((b + [0.0] * 8)[:8])).astype(np.int64) for a, b in rows if a is not None and b is not None and all(x is not None and math.isfinite(x) for x in b)}
    want = []
    for q, v in usable.items():
        if q % 100 == 0:
            best = sorted(((-int(v @ w), c) for c, w in usable.items() if c != q))[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    found = topk.exact_top_k(table, pivots=8, rings=4, sample=200, block=64)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


@pytest.mark.parametrize("scale", [1e5, 1e7, 3e12, 1e300])
def test_large_components_take_part(spark, scale):
    random = np.random.default_rng(6)
    rows = [(k, (random.standard_normal(4) * (scale if k % 3 else 1)).tolist()) for k in range(250)] + [(300, [1.7e308] * 4)]
    usable = {a: [math.floor(1024 * x) for x in b] for a, b in rows if all(math.isfinite(1024 * x) for x in b)}
    assert len(usable) == 250
    want = []
    for q in (0, 100, 200):
        score = {c: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(usable[q], v, strict=True)))) for c, v in usable.items() if c != q}
        best = sorted((-s, c) for c, s in score.items())[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.exact_top_k(table, pivots=4, rings=3, block=32)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_top_k_of_little(spark):
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    two = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.1, 0.1])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(two).select("query_id", "rank", "vec_id").collect()] == [(0, 1, 1)]


# -- languages ------------------------------------------------------------------------------------

EN, DE, EL = "the quick brown fox and the lazy dog were there with them ", "der schnelle braune fuchs und der faule hund waren dort mit ihnen ", "ο γρήγορος καφέ σκύλος και η αλεπού ήταν εκεί μαζί "


def language_texts():
    random = np.random.default_rng(2)
    return [(" ".join(random.permutation(base.split())), name) for name, base in (("en", EN), ("de", DE), ("el", EL)) for _ in range(30)]


def test_languages_of_texts_and_spans(docs_of):
    texts, langs = zip(*language_texts(), strict=True)
    docs = docs_of([*texts, *ODD], lang=[*langs, *[None] * len(ODD)])
    model = language_id.fit(docs)
    assert model.languages == ["de", "el", "en"]
    mixed = EN + DE + EN
    asked = docs_of([EN.upper(), DE, EL, mixed, "123 !", None, *ODD], lang=[None] * (6 + len(ODD)))
    found = {r["doc_id"]: r for r in language_id.identify(asked, model).collect()}
    assert [found[k]["lang_pred"] for k in range(6)] == ["en", "de", "el", "en", "und", "und"]
    assert [s["lang"] for s in found[3]["spans"]] == ["en", "de", "en"] and abs(found[3]["spans"][1]["start"] - len(EN)) < 15
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[4]["score"] == 0 and len(found) == 6 + len(ODD)


def test_viterbi_is_the_best_path():
    random = np.random.default_rng(0)
    model = language_id.LanguageModel.of_texts(["a", "b", "c"], [["aaa"], ["bbb"], ["ccc"]])
    counts = np.array([7, 0, 1, 5])
    scores = random.standard_normal((13, 3)).astype(np.float32) * 3
    found = model.label(scores, counts, switch=1.5)
    at = 0
    for n in counts:
        own = scores[at : at + n]
        value = lambda path: sum(own[k][s] for k, s in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        if n:
            assert value(tuple(found[at : at + n])) == pytest.approx(max(value(p) for p in np.ndindex(*(3,) * n)), abs=1e-4)
        at += n


def test_blocks_of_words_give_the_path_of_one_pass():
    random = np.random.default_rng(4)
    model = language_id.LanguageModel.of_texts(["a", "b", "c"], [["aaa"], ["bbb"], ["ccc"]])
    counts = np.array([0, 900, 3, 0, 257, 1, 64])
    for spread in (0.3, 3, 30):
        scores = random.standard_normal((counts.sum(), 3)).astype(np.float32) * np.float32(spread)
        whole = model.label(scores, counts, switch=4.0, block=10_000)
        assert (model.label(scores, counts, switch=4.0, block=16) == whole).all()
        own, best, back = scores[:900].astype(np.float64), np.zeros(3), []
        for row in own:
            lead = best.argmax()
            back.append(np.where(best >= best[lead] - 4.0, np.arange(3), lead))
            best = np.maximum(best, best[lead] - 4.0) + row
        path = [int(best.argmax())]
        for step in back[:0:-1]:
            path.append(int(step[path[-1]]))
        assert whole[:900].tolist() == path[::-1]


def test_scripts_part_words_and_long_texts_come_in_pieces():
    words = language_id.Words(["abcже fgh", "", "漢字abc"])
    assert list(zip(words.text.tolist(), words.start.tolist(), words.end.tolist(), strict=True)) == [(0, 0, 3), (0, 3, 5), (0, 6, 9), (2, 0, 2), (2, 2, 5)]
    text = "der hund und the dog " * 3000
    parts = list(language_id.pieces(text, 1000))
    assert "".join(p for _, p in parts) == text and all(text[o : o + len(p)] == p for o, p in parts) and len(parts) > 50
    model = language_id.LanguageModel.of_texts(["de", "en"], [[DE], [EN]])
    one, many = language_id.identified(model, [text, None, "x"]), language_id.identified(model, [text, None, "x"], step=1000)
    assert one[0] == many[0] and all((a == b).all() for a, b in zip([one[1], *one[2]], [many[1], *many[2]], strict=True))


def test_rows_with_a_main_language_are_judged_by_their_own_text(docs_of):
    texts, langs = zip(*language_texts(), strict=True)
    model = language_id.fit(docs_of(texts, lang=langs))
    asked = docs_of([EN, None, "123", DE, EN, EN + DE, ""], doc_id=[7, 7, 7, None, None, 8, None], lang_pred=["x"] * 7, score=["y"] * 7)
    kept = language_id.with_main_language(asked, model, least_share=0.9)
    assert kept.columns == asked.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("7", EN), ("None", DE), ("None", EN)])
    assert language_id.with_main_language(asked, None).count() == 0 and language_id.with_main_language(docs_of([]), model).count() == 0


def test_nothing_to_learn_from(docs_of):
    docs = docs_of(["text", None], lang=[None, "en"])
    assert language_id.fit(docs) is None
    assert [r["lang_pred"] for r in language_id.identify(docs, None).collect()] == ["und", "und"]
    assert language_id.identify(docs_of([]), None).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = queries.op4_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() / found.count() > 0.9


# -- language model -------------------------------------------------------------------------------


VOCABULARY, PATTERN = queries.vocabulary("byte_bpe_50k.json"), queries.byte_level_pattern()


def small_ranks(n=700, seed=0):
    return attention.Ranks(np.random.default_rng(seed).zipf(1.3, n).clip(0, 10**6))


def small_model(seed=3, n=700):
    model = attention.Model(small_ranks(n), seed)
    model.p["low"] += np.random.default_rng(seed).standard_normal(model.p["low"].shape).astype(np.float32) * 0.3
    return model


def test_gradients_are_slopes():
    random = np.random.default_rng(0)
    model = small_model()
    inputs, targets, _ = attention.blocks_of([random.integers(0, 700, n) for n in (5, 60)], model.ranks)
    for n in model.p:
        model.p[n] = model.p[n].astype(np.float64)
    goal = targets.reshape(-1)

    def loss():
        logits = model._state(inputs)[-1] @ model.p["out"]
        all_ = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return -all_[np.arange(len(goal)), model.ranks.first[goal]][goal >= 0].mean()

    dense, tables, hidden = model.gradients(inputs, targets)
    scale = None
    for n in ("out", "mix", "near", "here", "window", "before"):
        rows, g = tables[n] if n in tables else (np.arange(len(dense[n])), dense[n])
        flat = g.reshape(len(rows), -1)
        for k in np.argsort(-np.abs(flat), axis=None)[:3]:
            r, c = np.unravel_index(k, flat.shape)
            own = model.p[n].reshape(len(model.p[n]), -1)
            old = own[rows[r], c]
            own[rows[r], c] = old + 1e-4
            up = loss()
            own[rows[r], c] = old - 1e-4
            slope = (up - loss()) / 2e-4
            own[rows[r], c] = old
            scale = scale or flat[r, c] / slope  # gradients may be scaled down together
            assert flat[r, c] == pytest.approx(scale * slope, rel=2e-2, abs=1e-5), n
    group, places = 2, np.array([0, 3, 3, 5])

    def low_loss():
        logits = hidden[:4] @ model.p["low"][:, model.ranks.columns[group] : model.ranks.columns[group + 1]]
        return -(logits[np.arange(4), places] - np.log(np.exp(logits).sum(axis=1))).mean()

    g = model.low_gradient(hidden[:4], group, places)
    at, column = 4, model.ranks.columns[group] + 3
    model.p["low"][at, column] += 1e-4
    up = low_loss()
    model.p["low"][at, column] -= 2e-4
    assert g[at, 3] == pytest.approx((up - low_loss()) / 2e-4, rel=1e-3)


def plain_scores(model, text):
    """Log probabilities of a text's ids, one token after the other, without blocks in parallel."""
    p, ranks, out = model.p, model.ranks, []
    rows = [attention.START, *ranks.row[np.asarray(text[:-1], np.int64)].tolist()]
    for t, goal in enumerate(text):
        first = max(0, t - t % attention.BLOCK - attention.CONTEXT)
        logs = [float(p["here"][rows[t], : attention.QUERY] @ p["window"][rows[j], : attention.QUERY] + p["near"][t - j]) for j in range(first, t + 1)]
        weights = np.exp(np.minimum(logs, 40))
        read = sum(w * p["window"][rows[j], attention.QUERY : -1] for w, j in zip(weights / weights.sum(), range(first, t + 1), strict=True))
        before = rows[t - 1] if t else attention.START
        hidden = np.append(np.tanh(read @ p["mix"] + p["here"][rows[t], attention.QUERY :] + p["before"][before]), 1)
        logits = hidden @ p["out"]
        value = logits[ranks.first[goal]] - np.log(np.exp(logits).sum()) + ranks.inside[goal]
        if attention.SINGLES <= ranks.first[goal] < attention.FIRST - 1:
            g = ranks.first[goal] - attention.SINGLES
            low = hidden @ p["low"][:, ranks.columns[g] : ranks.columns[g + 1]]
            value += low[ranks.place[goal]] - np.log(np.exp(low).sum())
        out.append(float(value))
    return out


def test_scores_are_those_of_one_token_after_the_other():
    random = np.random.default_rng(1)
    model = small_model()
    texts = [random.integers(0, 700, n) for n in (100, 1, 24, 25, 300)]
    inputs, targets, owner = attention.blocks_of(texts, model.ranks)
    scores = model.scores(inputs, targets, step=4)
    for k, text in enumerate(texts):
        own = scores[owner == k][targets[owner == k] >= 0]
        assert len(own) == len(text)  # each token once
        assert np.allclose(own, plain_scores(model, text), atol=2e-4)


def test_probabilities_sum_to_one():
    model = small_model(n=50_258)
    ids = np.arange(50_258)
    for start in ([], [5, 900, 30_000]):
        texts = [np.array([*start, i]) for i in ids]
        inputs, targets, _ = attention.blocks_of(texts, model.ranks)
        last = model.scores(inputs, targets)[:, len(start)]
        assert np.exp(last.astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_training_lowers_the_loss_of_both_steps():
    random = np.random.default_rng(0)
    step = random.integers(0, 700, 700)
    texts = []
    for _ in range(400):
        own = [int(random.integers(0, 700))]
        while len(own) < 60:
            own.append(int(step[own[-1]]))
        texts.append(np.array(own))
    model = attention.Model(attention.Ranks(np.bincount(np.concatenate(texts), minlength=700)))
    inputs, targets, _ = attention.blocks_of(texts, model.ranks)
    before, state = model.scores(inputs, targets).sum() / (targets >= 0).sum(), None
    for k in range(8):
        state = model.train(inputs, targets, seed=k, batch=32, state=state)
    assert model.scores(inputs, targets).sum() / (targets >= 0).sum() > before + 1


def by_brute_force(texts, held, lm):
    """base_score, n_known, n_tokens, score of each text from the definitions."""
    words = [[*(t or "").encode().split(), b""] for t in texts]
    counts = Counter(w for own, h in zip(words, held, strict=True) if not h for w in own)
    lines = [lm.subwords.lines(t or "") for t in texts]
    seen = Counter(x for own, h in zip(lines, held, strict=True) if not h for x in own)
    n, v = sum(counts.values()), len(counts)
    out = []
    for own, parts, h in zip(words, lines, held, strict=True):
        ids, ends = lm.subwords.ids(parts)
        spelt = lm.line_scores([ids], [ends])[0]
        mine = Counter() if h else Counter(parts)
        of = sum(seen.values()) - sum(mine.values())
        mixed = [math.log10(0.9 * 10.0**s + 0.1 * (seen[x] - mine[x]) / of) if of else s for s, x in zip(spelt, parts, strict=True)]
        out.append((sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), sum(counts[w] > 0 for w in own), len(own), sum(mixed)))
    return out, n


def test_scores_of_documents_are_those_of_the_definitions(docs_of, monkeypatch):
    texts = [*(t if t is None else t[:60] for t in ODD), *(f"the cat sat on mat {k} the end\nshared line\nof two {k // 2}\nshared line" for k in range(40))]
    docs = docs_of(texts, extra=["x"] * len(texts), row=["y"] * len(texts))
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    from pyspark.sql import functions as F

    models, inner = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a, **b: models.append(inner(*a, **b)) or models[-1])
    training = F.col("doc_id").isin([k for k in range(len(texts)) if not held[k]])
    for common, common_lines in ((300_000, 100_000), (3, 1), (0, 0)):
        rows = {r["doc_id"]: r for r in lm_scoring.score_all(docs, training, VOCABULARY, PATTERN, common, common_lines).collect()}
        want, n = by_brute_force(texts, held, models[-1])
        assert len(rows) == len(texts)
        for k, (base, known, many, score) in enumerate(want):
            r = rows[k]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["training"]) == (many, known, n, not held[k])
            assert r["base_score"] == pytest.approx(base, abs=1e-8)
            assert r["score"] == pytest.approx(score, abs=2e-3, rel=1e-4) and r["score"] < 0
    # every training text is learned from
    assert models[-1].learned_tokens == sum(len(models[-1].subwords.ids(models[-1].subwords.lines(t or ""))[0]) for t, h in zip(texts, held, strict=True) if not h)


def test_base_columns_of_the_query_are_those_of_its_contract(spark, docs_of, tmp_path):
    texts = [*ODD, "The cat THE Cat", "the CAT É é", "word WORD wOrd\x0bthe", *(f"Line {k % 5} of THE text" for k in range(30))]
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    words = [[*filter(None, re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower))), ""] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    counts = Counter(w for own, h in zip(words, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in queries.op1_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for k, own in enumerate(words):
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), abs=1e-8)


def test_scores_do_not_depend_on_partitioning(docs_of):
    from pyspark.sql import functions as F

    random = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 300, 120)) for k in range(300)]
    docs = docs_of(texts)
    a, b = ({r["doc_id"]: r["score"] for r in lm_scoring.score_all(d, F.lit(True), VOCABULARY, PATTERN).collect()} for d in (docs.repartition(2), docs.orderBy(F.desc("doc_id")).repartition(7, "text")))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_results_merge_in_a_tree_as_at_once(docs_of, monkeypatch):
    from pyspark.sql import functions as F

    def trained():
        docs = docs_of([f"word {k} of many and {k * k} more " * 40 for k in range(60)]).withColumn("training", F.lit(True))
        subwords = lm_scoring.Subwords(VOCABULARY, PATTERN)
        words = lm_scoring.Counted(lm_scoring.word_counts(docs), "word", 10)
        return lm_scoring.train(lm_scoring.settle(lm_scoring.encode(docs, subwords, words), "encoded"), subwords)

    monkeypatch.setattr(lm_scoring.math, "ceil", lambda x, ceil=math.ceil: 7 if 0 < x < 0.3 else ceil(x))  # seven shards of few tokens
    monkeypatch.setattr(lm_scoring, "FAN_IN", 16)
    one = trained()
    monkeypatch.setattr(lm_scoring, "FAN_IN", 2)
    tree = trained()
    assert one.learned_tokens == tree.learned_tokens > 0
    assert all(np.allclose(one.model.p[n], tree.model.p[n], atol=1e-5) for n in one.model.p)


def test_rows_are_summed_wherever_they_stand():
    random = np.random.default_rng(0)
    rows = np.concatenate([random.integers(0, 9, 500), [attention.START, attention.ROWS - 1, 700, 700]]).astype(np.int16)
    values = random.standard_normal((len(rows), 5)).astype(np.float32)
    found, sums = attention._by_row(rows.reshape(12, -1), values.reshape(12, -1, 5))
    assert found.tolist() == sorted(set(rows.tolist()))
    assert np.allclose(sums, [values[rows == r].sum(axis=0) for r in found], atol=1e-4)


def test_workers_give_back_the_tables_of_earlier_stages(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([f"word {k} of many" for k in range(40)])
    lm_scoring.score_all(docs, F.lit(True), VOCABULARY, PATTERN).count()

    def held(batches):
        from passagemill.llm.lm_scoring import ids_of_vocabulary

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ids_of_vocabulary.cache_info().currsize] * batch.num_rows, pa.int64())], names=["n"])

    last = docs.sparkSession.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()
    assert {r["n"] for r in last} == {0}


def test_what_occurs_twice_stands_apart(docs_of):
    from pyspark.sql import functions as F

    random = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 3000, 60)) for k in range(200)]
    docs = docs_of([*texts, *texts[:10]])
    scores = {r["doc_id"]: r["score"] for r in lm_scoring.score_all(docs, F.col("doc_id") % 7 != 2, VOCABULARY, PATTERN).collect()}
    twice = [scores[k] for k in (*range(10), *range(200, 210)) if (k % 200 + (k < 200) * 200) % 7 != 2]
    assert min(twice) > 0.5 * max(scores[k] for k in range(10, 200)) and len(twice) > 10


def test_scoring_learns(docs_of):
    from pyspark.sql import functions as F

    texts = [f"the cat number {k} sat on the mat and the dog {k} ran to the door" for k in range(80)]
    asked = ["the cat number 5 sat on the mat", "mat the on sat 5 number cat the"]
    scores = {r["doc_id"]: r["score"] for r in lm_scoring.score_all(docs_of(texts + asked), F.col("doc_id") < 80, VOCABULARY, PATTERN).collect()}
    assert scores[80] > scores[81] + 2
    assert lm_scoring.score_all(docs_of([]), F.lit(True), VOCABULARY, PATTERN).count() == 0
    none = lm_scoring.score_all(docs_of(["a b", None]), F.lit(False), VOCABULARY, PATTERN).collect()
    assert [r["n_known"] for r in none] == [0, 0] and all(r["train_tokens"] == 0 and r["score"] < 0 and r["base_score"] == 0 for r in none)


# -- rules and shards -------------------------------------------------------------------------------


def verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_verdicts(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.b.example.com/en/", "https://example.com", "https://example.com/EN/", "x://example.com/en/://y", "http://notexample.com/en/1",
        "http://x.net/es/1", "http://x.net/fr", "http://user@x.net:80/fr/", "http://com/", "http://..com/a", "a\nb://example.com/en/\nq", "http://x.org/" + "p/" * 500, "http://x.net/es/1",
    ]
    pages = spark.createDataFrame([(k if k != 3 else None, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    found = url_filter.url_verdicts(pages, url_filter.rule_table(spark, queries.URL_RULES)).collect()
    want = Counter((k if k != 3 else None, *verdict(u, queries.URL_RULES)) for k, u in enumerate(urls))
    assert Counter(tuple(r) for r in found) == want
    assert {r["verdict"] for r in url_filter.url_verdicts(pages, url_filter.rule_table(spark, []), "block").collect()} == {"block"}


def test_shards_compact_and_keep_every_row(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    rows = spark.range(400).selectExpr("id", "repeat(uuid(), 20) as text", "cast(null as string) as nothing")
    rows = rows.persist()
    for k in range(8):
        store.append(rows.filter(f"id % 8 = {k}").repartition(3))
    store.append(rows.limit(0))
    before = store.manifest()
    after = store.compact(target=200_000)
    assert len(after["shards"]) < len(before["shards"]) and after["version"] > before["version"]
    assert store.read().exceptAll(rows).count() == 0 and store.read().count() == 400
    assert not store.plan(after["shards"], target=200_000) and store.compact(target=200_000) == after
    with pytest.raises(sharding.CommitConflict):
        store.commit(before, [], after["schema"])


def test_old_versions_and_uncommitted_files_outlive_a_compaction(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10))
    before = store.version()
    spark.range(100, 110).write.parquet(f"{store.root}/shards/uncommitted")
    store.compact(target=1_000_000)
    store.vacuum()
    assert sorted(r["id"] for r in store.read(before).collect()) == list(range(40))
    new = store._shards_in("shards/uncommitted", 0)
    latest = store.manifest()
    store.commit(latest, latest["shards"] + new, latest["schema"])
    assert store.read().count() == 50
    store.vacuum(age=0)
    assert store.versions() == [store.version()] and store.read().count() == 50
    assert {p.parent.name for p in (tmp_path / "store" / "shards").glob("*/*.parquet")} == {s["path"].split("/")[1] for s in store.manifest()["shards"]}


def test_writers_that_lose_a_race_try_again(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/store"
    sharding.ShardStore(spark, root).append(spark.range(5).selectExpr("id", "cast(null as string) as text"))
    with ThreadPoolExecutor(6) as pool:
        jobs = [pool.submit(lambda k=k: sharding.ShardStore(spark, root).append(spark.range(k * 100, k * 100 + 5).selectExpr("id", "'x' as text"))) for k in range(1, 6)]
        jobs.append(pool.submit(lambda: sharding.ShardStore(spark, root).compact(target=1_000_000)))
        for job in jobs:
            job.result()
    store = sharding.ShardStore(spark, root)
    store.compact(target=1_000_000)
    assert sorted(r["id"] for r in store.read().collect()) == sorted(k * 100 + j for k in range(6) for j in range(5))
    assert store.versions() == list(range(1, store.version() + 1))


def test_a_merge_of_shards_that_are_gone_is_dropped(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10))
    other, first = sharding.ShardStore(spark, store.root), store._commit_on_latest

    def late(change, schema):
        store._commit_on_latest = first
        other.compact(target=1_000_000)
        return first(change, schema)

    store._commit_on_latest = late
    store.compact(target=1_000_000)
    assert sorted(r["id"] for r in store.read().collect()) == list(range(40))


def test_query_names_and_pipeline(spark, docs_of):
    import __spark_entry__
    import corpus_pipeline

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        assert 0.5 * docs.count() < kept.count() <= docs.count(), name
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.count() == 0
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() > 0
