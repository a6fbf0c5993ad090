"""Language identification of words, spans and texts.

Method. A word is a run of letters of one script, which is read off Unicode ranges. The script narrows the candidates to the
languages that were learned with it. Each candidate scores the word by its letters' bigrams and trigrams, word
ends included. Viterbi over the words of a text, staying or paying ``switch`` to change, labels each word; words of one label
in a row are a span. The text's language is the one with the most letters, its score that share of them.

Everything runs on arrays: code points of many texts at once, one table look-up per n-gram, sums per word. Viterbi runs on blocks of words side
by side; a block that began without its past is repeated from its true start until both agree, which a word that all paths share brings about
(:meth:`LanguageModel.label`). Slices are bounded by bytes, and long texts are scored piece by piece.

Learning counts n-grams in labelled texts on the executors. It takes all of them up to about ``per_language`` texts of each language,
and of more a sample of that size in expectation, by a hash of id and text: the bound is a parameter, and the sample doesn't depend on
partitioning. Texts of any length are learned whole. The driver gets one sum an n-gram slot and language; the model has ``2**BITS`` rows of one float a language.

Defined results. Null texts and texts without a letter are ``und`` with score 0. Null languages are not learned from; with
nothing to learn from all is ``und``. Repeated rows get repeated results. Extra columns are ignored by :func:`identify` and kept, whatever
their names, by :func:`with_main_language`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, slices

BITS = 17
PER_LANGUAGE = 1500
SWITCH = 6.0
UNDETERMINED = "und"
#: First code points of ranges and the script that holds from there (Unicode blocks).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "latin"), (0xAC00, "hangul"),
    (0xD800, "latin"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its number if it is a letter, else 0; and its script."""
    letter = np.zeros(0x110000, np.uint32)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p).isalpha()]
    letter[points] = points
    script = np.zeros(0x110000, np.uint8)
    for start, name in SCRIPTS:
        script[start:] = NAMES.index(name)
    return letter, script


#: Characters before the capital A are no letters.
_NO_LETTER = re.compile(r"[\x00-\x40]")


def pieces(text: str, step: int = 1 << 18) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, cut near every ``step`` characters where no word is."""
    start = 0
    while len(text) - start > step:
        found = _NO_LETTER.search(text, start + step)
        end = found.end() if found else len(text)
        yield start, text[start:end]
        start = end
    yield start, text[start:]


class Words:
    """The words of some texts, as arrays: start and end (code points of the text), script, text number."""

    def __init__(self, texts: list[str]):
        letter, script = tables()
        lowered = [t.lower() for t in texts]
        # lower case may lengthen a text ('İ'); offsets then belong to the original, which is used as it is
        kept = [low if len(low) == len(t) else t for low, t in zip(lowered, texts, strict=True)]
        points = np.frombuffer(("\n" + "\n".join(kept) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([1] + [len(t) + 1 for t in kept])[:-1] if kept else np.zeros(0, np.int64)
        self.letters = letter[points]
        runs = np.where(self.letters > 0, script[points] + np.int16(1), 0)  # 0 outside words
        edge = np.nonzero(np.diff(runs))[0] + 1
        self.begin, self.stop = edge[runs[edge] > 0], edge[runs[edge - 1] > 0]
        self.text = np.searchsorted(first, self.begin, side="right") - 1
        self.start, self.end = self.begin - first[self.text], self.stop - first[self.text]
        self.script = script[points[self.begin]]
        self.place = np.nonzero(self.letters)[0]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of the trigram around and the bigram before each letter, and where words begin among them."""
        x = self.letters
        before, here, after = x[self.place - 1], x[self.place], x[self.place + 1]
        pair = before * np.uint32(0x9E3779B1) + here * np.uint32(0x85EBCA6B)
        three = (pair + after * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        two = (pair ^ np.uint32(0x5BD1E995)) * np.uint32(0x2C1B3C6D)
        return three >> np.uint32(32 - BITS), two >> np.uint32(32 - BITS), np.searchsorted(self.place, self.begin)


#: Slots of a language's counts: n-grams, then scripts.
SLOTS = (1 << BITS) + len(NAMES)


def counts_of(text: str) -> np.ndarray:
    """How often each slot occurs in a text."""
    out = np.zeros(SLOTS, np.int64)
    for _, piece in pieces(text):
        words = Words([piece])
        three, two, _ = words.grams()
        out[: 1 << BITS] += np.bincount(three, minlength=1 << BITS) + np.bincount(two, minlength=1 << BITS)
        out[1 << BITS :] += np.bincount(words.script, minlength=len(NAMES))
    return out


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: for each language those of its slots."""
        self.languages = languages
        smoothed = counts[:, : 1 << BITS] + 0.5
        self.table = np.ascontiguousarray(np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T.astype(np.float32))
        scripts = counts[:, 1 << BITS :]
        usual = scripts >= 0.005 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
        usual[:, ~usual.any(axis=0)] = True  # of no language: the script says nothing
        self.out = np.where(usual, 0, -1e4).astype(np.float32).T.copy()

    @classmethod
    def of_texts(cls, languages: list[str], texts: list[list[str]]) -> LanguageModel:
        return cls(languages, np.stack([sum(map(counts_of, own), np.zeros(SLOTS, np.int64)) for own in texts]))

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.begin):
            return np.zeros((0, len(self.languages)), np.float32)
        three, two, at = words.grams()
        letters = self.table[three]
        letters += self.table[two]
        return 0.5 * np.add.reduceat(letters, at, axis=0) + self.out[words.script]

    def label(self, scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH, block: int = 256) -> np.ndarray:
        """The language number of each word on the best path; counts: the words of each text, in order.

        Forward, each text's words are cut into blocks that all run at once from an even start. The values of a text's later blocks are then made
        true one block after the other: from the true end of the one before, until a word where they equal the values found, as they do once the leader is ahead by
        ``switch``; from there on they stay equal. Backward, a word whose states all come from one is where paths
        meet, so the parts between such words are walked at once.
        """
        n, many = scores.shape
        labels = np.zeros(n, np.int16)
        if not n:
            return labels
        stays, leaders, after = np.zeros((n, many), bool), np.zeros(n, np.int16), np.zeros((n, many), np.float32)

        def step(now: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """Values after the words in ``rows``, from those before; only differences matter, so the best is 0."""
            lead = now.argmax(axis=1)
            bar = now[np.arange(len(now)), lead, None] - np.float32(switch)
            stays[rows] = now >= bar
            leaders[rows] = lead
            new = np.maximum(now, bar) + scores[rows]
            return new - new.max(axis=1, keepdims=True)

        ends = np.cumsum(counts)
        first = ends - counts
        blocks = -(-counts // block)
        owner = np.repeat(np.arange(len(counts)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[owner] + number * block
        length = np.minimum(ends[owner] - begin, block)
        order = np.argsort(-length, kind="stable")
        begin, length, number, owner = begin[order], length[order], number[order], owner[order]
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # blocks that have a word at each step
        now = np.zeros((len(begin), many), np.float32)
        for t in range(int(length[0])):
            rows = begin[: active[t]] + t
            now[: active[t]] = after[rows] = step(now[: active[t]], rows)
        for k in range(1, int(number.max()) + 1):
            own = np.nonzero(number == k)[0]
            rows, stop = begin[own], begin[own] + length[own]
            now = after[rows - 1]
            while len(rows):
                now = step(now, rows)
                go_on = (now != after[rows]).any(axis=1) & (rows + 1 < stop)
                after[rows] = now
                rows, stop, now = rows[go_on] + 1, stop[go_on], now[go_on]

        # backward
        known = np.zeros(n, bool)
        last = ends[counts > 0] - 1
        labels[last] = after[last].argmax(axis=1)
        starts = np.zeros(n + 1, bool)
        starts[first[counts > 0]] = True
        meet = np.nonzero(~starts[:n] & (stays.sum(axis=1) == 1))[0]  # only the leader stays: all states come from it
        labels[meet - 1] = leaders[meet]
        known[last] = known[meet - 1] = True
        rows = np.nonzero(known)[0]
        while len(rows):
            state = labels[rows]
            before = np.where(stays[rows, state], state, leaders[rows])
            go_on = ~starts[rows]
            go_on[go_on] = ~known[rows[go_on] - 1]
            rows = rows[go_on] - 1
            labels[rows] = before[go_on]
        return labels


def identified(model: LanguageModel, texts: list[str | None], switch: float = SWITCH, step: int = 1 << 18):
    """Language and score of each text, and its spans as (text, start, end, language) arrays."""
    parts = [(k, offset, piece) for k, t in enumerate(texts) for offset, piece in pieces(t or "", step)]
    scores, owner, start, end = ([np.zeros((0, len(model.languages)), np.float32)], *([np.zeros(0, np.int32)] for _ in range(3)))
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop][2]) <= step):
            size += len(parts[stop][2])
            stop += 1
        words = Words([p for _, _, p in parts[at:stop]])
        scores.append(model.word_scores(words))
        numbers, offsets = (np.array([p[c] for p in parts[at:stop]], np.int32)[words.text] for c in (0, 1))
        for array, new in ((owner, numbers), (start, words.start + offsets), (end, words.end + offsets)):
            array.append(new.astype(np.int32))
        at = stop
    scores, owner, start, end = map(np.concatenate, (scores, owner, start, end))
    labels = model.label(scores, np.bincount(owner, minlength=len(texts)), switch)
    many = len(model.languages)
    letters = np.bincount(owner.astype(np.int64) * many + labels, end - start, len(texts) * many).reshape(-1, many)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
    names = [model.languages[k] if n else UNDETERMINED for k, n in zip(best, total, strict=True)]
    share = letters.max(axis=1, initial=0) / np.maximum(total, 1)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
    begins = np.nonzero(new)[0]
    lasts = np.append(begins[1:], len(owner)) - 1
    return names, share, (owner[begins], start[begins], end[lasts] if len(begins) else end[:0], labels[begins])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """A model of the languages in ``lang``, from ``text``; None if there is nothing to learn from."""
    ship(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    seen = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not seen:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))) for name, n in seen.items()))
    drawn = usable.filter((F.col("draw").cast("double") / 2.0**64 + 0.5) <= share).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + counts_of(text)
        for name, own in sums.items():
            slots = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(own[slots])], names=["lang", "slot", "n"])

    summed = drawn.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # slots x languages at most
    names = np.array(summed.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    if not languages:
        return None
    counts = np.zeros((len(languages), SLOTS), np.int64)
    number = {name: k for k, name in enumerate(languages)}
    counts[[number[x] for x in names], summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    return LanguageModel(languages, counts)


#: Rows and bytes of text that are labelled together: enough for long arrays, and a bound of memory.
TOGETHER, TOGETHER_BYTES = 4096, 1 << 23


def identify(docs: DataFrame, model: LanguageModel | None, with_spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans (start, end, lang) of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if with_spans:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
        fields.append(T.StructField("spans", T.ArrayType(span)))
    schema = T.StructType(fields)
    if model is None:
        out = docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
        return out.withColumn("spans", F.array().cast(schema["spans"].dataType)) if with_spans else out
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for part in slices(batches, TOGETHER, TOGETHER_BYTES):
            names, share, (owner, start, end, label) = identified(own, part.column("text").to_pylist(), switch)
            columns = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(share, pa.float64())]
            if with_spans:
                offsets = np.searchsorted(owner, np.arange(part.num_rows + 1))
                items = pa.StructArray.from_arrays(
                    [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([own.languages[k] for k in label], pa.string())], ["start", "end", "lang"]
                )
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_main_language(docs: DataFrame, model: LanguageModel | None, least_share: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least_share`` of its letters; each row is judged by its own text, without a shuffle."""
    if model is None:
        return docs.filter(F.lit(False))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches, TOGETHER, TOGETHER_BYTES):
            names, share, _ = identified(shared.value, part.column("text").to_pylist(), switch)
            yield part.filter(pa.array([n != UNDETERMINED and s >= least_share for n, s in zip(names, share, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame, folds: int = 4, held: int = 2) -> Column:
    """Whether a row belongs to the folds that are learned from."""
    from .common import id_bucket

    return F.coalesce(id_bucket(F.col("doc_id"), folds) != held, F.lit(True))
