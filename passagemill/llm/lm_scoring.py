"""Language-model scoring of whole texts.

Method. A causal self-attention model (:mod:`attention`) is trained in numpy on subword ids and gives each text its log10
probability; overlapping windows score each token once. A word-frequency score stands beside it.

Learning. Counts of words, ids and lines come from every training text. The attention's weights start on the driver from about ``START_BLOCKS`` blocks, drawn by a hash
from all training texts. Then every training text trains it, in shards: each goes on from the same weights, and their results are averaged, weighted by tokens, in a tree. Which shard a
text is in, and its place there, follow from a hash of id and ids, and the number of shards from the number of tokens (its power of two thirds, in millions), so results
don't depend on how the table is partitioned.

Memory. A small model can't hold a corpus, so a line is either spelt by the attention or, with probability ``MEMORY``, one of the training texts' lines by its
frequency; a text's score is the sum over its lines of the mixture's logarithm. A training text's own lines are left out of the frequencies that score it, so that its score says
what the rest of the corpus says: what occurs twice stands apart, in training texts as in others.

Word score. The sum over a text's words and one end of log10((c + 1) / (N + V + 1)). With ``lower``, words that differ in the case of A-Z alone are one; the model reads texts as they are.

Counts meet texts in two ways. The at most ``COMMON`` words, and ``COMMON_LINES`` lines, whose count reaches a threshold, which a histogram of counts gives,
go to workers as tables of bounded size; all others of a text go back to the counts by an equi-join on the word itself, or a line's 128-bit digest. None of these is frequent, so no key is hot.

Each text is tokenised once, line by line, and the ids are written to the shared folder for training and scoring.

Defined results. A null text is empty: it has the end alone. Rows without an id are trained on. Repeated rows are scored one by one; in training they go to one shard.
Without training texts all counts are zero, and the model is its untrained self. Extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import zlib
from collections import Counter
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .attention import BLOCK, SPAN, Model, Ranks, blocks_of
from .common import arrow_rows, settle, ship, slices, text_or_empty
from .packing import ids_of_vocabulary

COMMON, COMMON_LINES = 300_000, 100_000
START_BLOCKS = 24_000
MEMORY = 0.1
FAN_IN = 16


class Subwords:
    """Ids of texts, line by line; the last line of a text has the end."""

    def __init__(self, tokenizer_path: str, pattern: str, vocabulary: int = 50_257):
        self.tokenizer, self.end, self.size = (tokenizer_path, pattern), vocabulary, vocabulary + 1
        if self.size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")

    def lines(self, text: str) -> list[str]:
        first, *rest = text.split("\n")
        return [first, *("\n" + line for line in rest)]

    def ids(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text's lines as 16-bit numbers, and where each line ends among them."""
        ids_of = ids_of_vocabulary(*self.tokenizer)
        parts = [ids_of(line) for line in lines]
        parts.append(self.end.to_bytes(4, "little"))
        ends = np.cumsum([len(p) // 4 for p in parts[:-1]])
        ends[-1] += 1
        return np.frombuffer(b"".join(parts), "<u4").astype("<u2"), ends


# -- counts -----------------------------------------------------------------------------------


def words_of(text: bytes, lower: bool) -> list[bytes]:
    return (text.lower() if lower else text).split()  # of bytes, both know ASCII alone


def word_counts(docs: DataFrame, flush: int = 400_000, lower: bool = False) -> DataFrame:
    """word (bytes; A-Z lower-cased on demand), n over all texts of ``docs``."""
    ship(docs.sparkSession)

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        let_go(ids_of_vocabulary, _numbers)  # of an earlier run
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update(words_of(text, lower))
                if len(counts) > flush:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    return docs.filter("text is not null").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_threshold(counts: DataFrame, common: int) -> int:
    """The least count that at most ``common`` rows of ``counts`` (n) reach, to within a twentieth."""
    bucket = F.floor(F.log(F.col("n").cast("double")) / math.log(1.05)).cast("int")
    seen = dict(counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("keys")).toPandas().itertuples(index=False, name=None))  # some hundred rows
    total, least = 0, max(seen, default=0) + 1
    for b in sorted(seen, reverse=True):
        total += seen[b]
        if total > common:
            break
        least = b
    return max(1, math.ceil(1.05**least - 1e-9))


class Counted:
    """Keys and their counts: the common ones of a table, the rest of which is joined."""

    def __init__(self, table: DataFrame, key: str, common: int):
        self.least = common_threshold(table, common)
        found = table.filter(F.col("n") >= self.least).select(key, "n").toArrow()  # ``common`` rows at most
        self.keys, self.n = [bytes(x) for x in found.column(key).to_pylist()], found.column("n").to_numpy()

    def numbers(self) -> dict[bytes, int]:
        """Number of each key from 1 on; built once in each worker."""
        return _numbers(self)


@lru_cache(maxsize=1)  # a stage uses one table; workers outlive stages
def _numbers(common: Counted) -> dict[bytes, int]:
    return {w: k + 1 for k, w in enumerate(common.keys)}


def let_go(*tables) -> None:
    """Empty ``tables`` (cached functions) that an earlier stage left in a worker: workers outlive stages, and two of them share an executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if any(t.cache_info().currsize for t in tables):
        for t in tables:
            t.cache_clear()
        with contextlib.suppress(OSError, AttributeError):  # a call of the GNU C library
            ctypes.CDLL(None).malloc_trim(0)


# -- texts to ids and words -------------------------------------------------------------------

ENCODED = "row long, training boolean, n_tokens long, common long, logs double, rare array<binary>, ids binary, ends binary, lines array<binary>"


def encode(docs: DataFrame, subwords: Subwords, words: Counted, lower: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, training): its words' counts as far as they are common, its ids, and its lines' ends and digests."""
    import xxhash

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(words)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(ENCODED).fields])

    def run(batches):
        number, row = shared.value.numbers(), TaskContext.get().partitionId() << 33
        logs = np.log10(np.append(0, shared.value.n.astype(np.float64)) + 1)
        for batch in slices(batches, 128):
            out = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                own = words_of(text.encode(), lower)
                found = np.fromiter(map(number.get, own, repeat(0)), np.int64, len(own))
                other = np.nonzero(found == 0)[0].tolist()
                lines = subwords.lines(text)
                ids, ends = subwords.ids(lines)
                values = (len(own) + 1, len(own) - len(other), float(logs[found].sum()), [own[k] for k in other], ids.tobytes(), ends.astype("<u4").tobytes(),
                          [xxhash.xxh3_128_digest(x.encode()) for x in lines])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column("training"), *columns], names=schema.names)
            row += batch.num_rows

    return docs.select("doc_id", "text", "training").mapInArrow(run, schema)


def id_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the training texts."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                counts += np.bincount(np.frombuffer(ids, "<u2"), minlength=size)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["id", "n"])

    found = encoded.filter("training").select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row an id
    out = np.zeros(size, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


# -- the model --------------------------------------------------------------------------------


class LanguageModel:
    def __init__(self, subwords: Subwords, counts: np.ndarray):
        self.subwords, self.ranks = subwords, Ranks(counts)
        self.model = Model(self.ranks)
        self.learned_tokens = 0  # of all texts that :func:`train` learned from

    def start(self, inputs: np.ndarray, targets: np.ndarray, passes: int = 2) -> LanguageModel:
        state = None
        for k in range(passes if len(inputs) else 0):
            state = self.model.train(inputs, targets, rate=0.01 / (k + 1), seed=k, state=state)
        return self

    def token_scores(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each id of all sequences, one after the other."""
        inputs, targets, _ = blocks_of(sequences, self.ranks)
        return self.model.scores(inputs, targets)[targets >= 0].astype(np.float64) / math.log(10)

    def line_scores(self, sequences: list[np.ndarray], ends: list[np.ndarray]) -> list[np.ndarray]:
        """log10 probability of each line of each text."""
        if not sequences:
            return []
        sums = np.append(0.0, np.cumsum(self.token_scores(sequences)))
        first = np.cumsum([0] + [len(s) for s in sequences])
        return [np.diff(sums[np.append(0, e) + f]) for e, f in zip(ends, first, strict=False)]


def _windows(lm: LanguageModel, share: float):
    """Blocks of texts, each drawn with probability ``share`` by a hash of its text's ids and its number."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                texts = batch.column("ids").slice(begin, 64).to_pylist()
                sequences = [np.frombuffer(x, "<u2") for x in texts]
                inputs, targets, owner = blocks_of(sequences, lm.ranks)
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                key = np.array([zlib.crc32(x) for x in texts], np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                drawn = np.nonzero((key >> np.uint64(11)).astype(np.float64) / 2.0**53 < share)[0]
                yield pa.RecordBatch.from_arrays([pa.array(key[drawn].astype(np.int64)), pa.array([inputs[k].tobytes() + targets[k].tobytes() for k in drawn], pa.binary())], names=["key", "block"])

    return run


def train(encoded: DataFrame, subwords: Subwords, start_blocks: int = START_BLOCKS, rate: float = 0.004) -> LanguageModel:
    """A model trained on all training texts of ``encoded``."""
    spark = encoded.sparkSession
    ship(spark)
    own = encoded.filter("training")
    lm = LanguageModel(subwords, id_counts(encoded, subwords.size))
    tokens, blocks = own.agg(F.sum(F.length("ids") / 2), F.sum(F.ceil(F.length("ids") / (2 * BLOCK)))).first()
    if not tokens:
        return lm
    drawn = own.select("ids").mapInArrow(_windows(lm, min(1.0, start_blocks / blocks)), "key long, block binary").toArrow().sort_by("key")  # ``start_blocks`` in expectation
    sample = drawn.column("block").to_pylist()
    lm.start(np.array([np.frombuffer(b, "<i2", SPAN) for b in sample]).reshape(-1, SPAN), np.array([np.frombuffer(b, "<i4", BLOCK, 2 * SPAN) for b in sample]).reshape(-1, BLOCK))
    shared = spark.sparkContext.broadcast(lm)

    def go_on(batches):
        let_go(ids_of_vocabulary, _numbers)
        own: LanguageModel = shared.value
        model = Model(own.ranks).unpack(own.model.packed())
        state, learned = None, 0
        for batch in batches:
            for k, begin in enumerate(range(0, batch.num_rows, 64)):
                sequences = [np.frombuffer(x, "<u2") for x in batch.column("ids").slice(begin, 64).to_pylist()]
                state = model.train(*blocks_of(sequences, own.ranks)[:2], rate=rate, seed=k, state=state)
                learned += sum(map(len, sequences))
        if learned:
            yield _learned(TaskContext.get().partitionId(), learned, model.packed())

    shards = math.ceil((tokens / 1e6) ** (2 / 3))
    key = F.xxhash64("doc_id", "ids")
    # written, so that a lost executor doesn't make shards be learned again
    results = settle(own.select("ids", key.alias("key")).repartition(shards, "key").sortWithinPartitions("key").select("ids").mapInArrow(go_on, LEARNED), "learned")
    left = results.agg(F.max("part")).first()[0] + 1
    while left > FAN_IN:  # a tree, so that neither a task nor the driver gets more results than FAN_IN
        results = results.groupBy((F.col("part") / FAN_IN).cast("int").alias("above")).applyInArrow(lambda t: pa.Table.from_batches([_merged(t)]), LEARNED)
        results = results.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        left = math.ceil(left / FAN_IN)
    final = _merged(results.toArrow())
    lm.learned_tokens = final.column("tokens")[0].as_py()
    lm.model.unpack(np.frombuffer(final.column("weights")[0].as_py(), np.float32))
    return lm


LEARNED = "part int, tokens long, weights binary"


def _learned(part: int, tokens: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "weights"])


def _merged(rows: pa.Table) -> pa.RecordBatch:
    """Weights averaged by tokens, in the order of parts."""
    rows = rows.sort_by("part")
    total, weights = 0, 0.0
    for tokens, own in zip(rows.column("tokens").to_pylist(), rows.column("weights"), strict=True):
        total += tokens
        weights = weights + tokens * np.frombuffer(own.as_py(), np.float32).astype(np.float64)
    return _learned(rows.column("part")[0].as_py(), total, weights / total)


# -- scores -----------------------------------------------------------------------------------


def memory_gain(line: Column, seen: Column, of: Column, memory: float = MEMORY) -> Column:
    """What it adds to a line's log10 probability that it was seen ``seen`` times among ``of`` lines, beside its spelling (log10 ``line``)."""
    more = F.log10(F.lit(memory / (1 - memory)) * seen / of) - line
    return F.when((seen > 0) & (of > 0), F.greatest(more, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(more)))).otherwise(F.lit(0.0))


def score_lines(encoded: DataFrame, lm: LanguageModel, lines: Counted, total: int) -> DataFrame:
    """``encoded`` with attention (sum over lines), gain (of common lines), other (lines that aren't) and ``of`` (lines that the text is held against)."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((lm, lines))
    kept = ["doc_id", "row", "training", "n_tokens", "common", "logs", "rare"]
    schema = T.StructType([encoded.schema[c] for c in kept] + T.StructType.fromDDL("attention double, n_lines long, of long, gain double, other array<struct<digest: binary, own: int, line: double>>").fields)

    def run(batches):
        let_go(ids_of_vocabulary)
        own, known = shared.value
        number, n = known.numbers(), np.append(0, known.n)
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                ids, ends, digests, training = (part.column(c).to_pylist() for c in ("ids", "ends", "lines", "training"))
                scores = own.line_scores([np.frombuffer(x, "<u2") for x in ids], [np.frombuffer(x, "<u4") for x in ends])
                out = [[] for _ in range(5)]
                for score, names, trained in zip(scores, digests, training, strict=True):
                    times = Counter(names) if len(set(names)) < len(names) else None
                    mine = np.array([times[x] for x in names] if times else [1] * len(names), np.int64) * trained
                    of = total - len(names) * trained
                    which = np.fromiter(map(number.get, names, repeat(0)), np.int64, len(names))
                    seen = np.where(which > 0, n[which] - mine, 0)
                    gain = 0.0
                    if (at := np.nonzero(seen > 0)[0]).size and of > 0:
                        more = np.log10(MEMORY / (1 - MEMORY) * seen[at] / of) - score[at]
                        gain = float((np.maximum(more, 0) + np.log10(1 + 10.0 ** -np.abs(more))).sum())
                    other = [{"digest": names[k], "own": int(mine[k]), "line": float(score[k])} for k in np.nonzero(which == 0)[0]]
                    for column, value in zip(out, (float(score.sum()), len(names), of, gain, other), strict=True):
                        column.append(value)
                kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("digest", pa.binary()), ("own", pa.int32()), ("line", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=schema.names)

    return encoded.select(*kept, "ids", "ends", "lines").mapInArrow(run, schema)


def score_all(docs: DataFrame, training: Column, tokenizer_path: str, pattern: str, common: int = COMMON, common_lines: int = COMMON_LINES, lower: bool = False) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of all rows, learned from those where ``training`` holds."""
    with arrow_rows(docs.sparkSession, 500):  # rows are whole texts and their ids
        return _score_all(docs, training, tokenizer_path, pattern, common, common_lines, lower)


def _score_all(docs: DataFrame, training: Column, tokenizer_path: str, pattern: str, common: int, common_lines: int, lower: bool) -> DataFrame:
    docs = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    subwords = Subwords(tokenizer_path, pattern)
    counts = settle(word_counts(docs.filter("training"), lower=lower), "word-counts")
    words = Counted(counts, "word", common)
    encoded = settle(encode(docs, subwords, words, lower), "encoded")
    lm = train(encoded, subwords)
    memory = settle(encoded.filter("training").select(F.explode("lines").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")), "lines")
    lines = Counted(memory, "digest", common_lines)
    scored = settle(score_lines(encoded, lm, lines, memory.agg(F.sum("n")).first()[0] or 0), "scored")

    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.filter(F.col("n") < words.least), "word").select("row", F.log10(F.col("n") + 1).alias("log"), F.lit(1).alias("known"), F.lit(0.0).alias("gain"))
    seldom = scored.select("row", "of", F.explode("other").alias("x")).select("row", "of", "x.*").join(memory.filter(F.col("n") < lines.least), "digest")
    gains = seldom.select("row", F.lit(0.0).alias("log"), F.lit(0).alias("known"), memory_gain(F.col("line"), F.col("n") - F.col("own"), F.col("of")).alias("gain"))
    more = rare.unionByName(gains).groupBy("row").agg(F.sum("log").alias("more_logs"), F.sum("known").alias("more_known"), F.sum("gain").alias("more_gain"))

    sums, ends = counts.agg(F.sum("n"), F.count("*")).first(), encoded.filter("training").count()
    total, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "doc_id", "training", "n_tokens",
        (F.col("common") + F.coalesce("more_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more_logs") + math.log10(ends + 1) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("attention") + F.when(F.col("of") > 0, F.col("n_lines") * math.log10(1 - MEMORY)).otherwise(0.0) + F.col("gain") + zero("more_gain")).alias("score"),
    )
