"""Quality rules: repetition inside a text, and frequent lines across documents.

Method. Lines are normalised (lower case, digits to ``0``, other characters than letters and
digits out) and hashed. For each host, the distinct documents of a line are counted. A line in
at least ``min_documents`` and more than ``max_share`` of the host's documents is boilerplate:
it is removed, and a document that keeps less than ``keep_share`` of its words is depleted and
rejected. A line counts once for each distinct text that holds it, however often the text repeats it; texts of
the same lines are one. All lines with a letter or digit count; very short ones need a larger share. Copies must not make each other's lines frequent, or a group of near copies would be
rejected whole instead of losing all but one. So lines that are frequent among distinct texts are counted again, over those texts
that stand apart: at least ``own_share`` of their bytes lie neither in such lines nor in variants of them, lines that begin or
end with the same words. Near copies don't stand apart; pages with a menu, header and footer do, and so do depleted ones that have words of their own.

Everything stays in DataFrame expressions. Repetition is found inside the row: 64-bit hashes of
8-word windows, and only where two are equal a sort tells which words they cover. Lines are counted with
partial aggregation, keyed by host and line, from line hashes written once, and frequent lines come back by an equi-join that
adaptive execution may split; no group of a host or line is ever gathered.

Defined results. A null text has no word and no line; fewer than 20 words fail the base rules. A
null host is a host of its own. Repeated rows are judged alike and each kept; they count as one document. Null ids are
kept. Extra columns, whatever their names, pass through :func:`without_boilerplate` untouched. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from .common import bring_back, set_aside, settle, text_or_empty, words_of

WINDOW = 8
#: Normal lines of fewer bytes may be chance (prose has one-word sentences): they need ``SHORT_SHARE`` of a host's documents. Bytes, so that scripts without blanks count too.
SHORT_BYTES, SHORT_SHARE = 20, 0.05
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """What two lines must share to count as the same one."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}+", "0"), r"[^\p{L}0]+", "")


def host_key(host: str) -> Column:
    """A null host is told apart from every string, the empty one too."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("-"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the array."""

    def covered(starts: Column) -> Column:
        # sorted starts: each covers up to the next one, the last its whole window
        return F.aggregate(
            F.transform(starts, lambda s, k: F.when(k + 1 < F.size(starts), F.least(F.lit(window), F.get(starts, k + 1) - s)).otherwise(window)),
            F.lit(0).cast("long"), lambda a, n: a + n,
        )

    def starts_of(pairs: Column) -> Column:
        # pairs of (hash, start), sorted: a start is repeated if a neighbour has its hash
        def twice(pair: Column, k: Column) -> Column:
            return (pair["h"] == F.get(pairs, k - 1)["h"]) & (k > 0) | F.coalesce(pair["h"] == F.get(pairs, k + 1)["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["s"]))

    def of_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("s"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bind(pairs, lambda p: bind(starts_of(p), covered)))

    def of_words(own: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(own) - window + 1), lambda k: F.xxhash64(F.slice(own, k, window)))
        return F.when(F.size(own) <= window, F.lit(0).cast("long")).otherwise(bind(hashes, of_hashes))

    return bind(words, of_words)


def text_measures(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("own_words", words_of(text))
        .withColumns({
            "n_words": F.size("own_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("own_words")),
        })
        .drop("own_words")
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    )


def line_lists(docs: DataFrame, host: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, host, text_id, lines (all with a letter or digit), size (their bytes).

    ``text_id`` is the same for texts of the same lines. A line has its hash ``h``, words ``n``, bytes ``size`` and hashes of its first and last words, ``a`` and ``b``.
    """

    def described(line: Column) -> Column:
        def of_words(words: Column) -> Column:
            ends = F.when(F.size(words) >= 6, 3).otherwise(2)
            long_enough = F.size(words) >= 4
            return bind(normal_line(line), lambda own: F.struct(
                F.xxhash64(own).alias("h"), F.size(words).alias("n"), F.octet_length(own).alias("size"),
                F.when(long_enough, F.xxhash64(F.lit(1), F.slice(words, F.lit(1), ends))).alias("a"), F.when(long_enough, F.xxhash64(F.lit(2), F.slice(words, -ends, ends))).alias("b")))

        return bind(words_of(line), of_words)

    lines = F.filter(F.transform(F.split(text_or_empty(), "\n", -1), described), lambda x: x["size"] > 0)
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), host_key(host).alias("host"), lines.alias("lines"))
        .withColumn("text_id", F.xxhash64(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["h"])))))
        .withColumn("size", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["size"]))
    )


def line_frequencies(lists: DataFrame, docs: DataFrame, host: str = "source", min_documents: int = 30, max_share: float = 0.002, own_share: float = 0.05, short_share: float = SHORT_SHARE) -> DataFrame:
    """Boilerplate lines: host, line_hash, n_documents. ``host`` names the column that groups ``docs``."""
    seen = lists.select("host", "text_id", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h"].alias("line_hash"), (x["size"] < SHORT_BYTES).alias("short"))))).alias("line"))
    seen = seen.select("host", "text_id", "line.*").distinct()
    hosts = docs.groupBy(host_key(host).alias("host")).agg(F.count_distinct(F.xxhash64("text")).alias("host_documents"))

    def frequent(counts: DataFrame) -> DataFrame:
        share = F.when(F.col("short"), max(max_share, short_share)).otherwise(max_share)
        return counts.filter(F.col("n_documents") >= min_documents).join(hosts, "host").filter(F.col("n_documents") > share * F.col("host_documents")).drop("host_documents")

    often = settle(frequent(seen.groupBy("host", "line_hash", "short").agg(F.count("*").alias("n_documents"))), "often")
    lines = lists.select("host", "text_id", "text_hash", F.col("size").alias("text_size"), F.posexplode("lines").alias("line_no", "line"))
    lines = lines.select("host", "text_id", "text_hash", "text_size", "line_no", F.col("line.h").alias("line_hash"), F.col("line.size").alias("size"), F.col("line.a").alias("a"), F.col("line.b").alias("b"))
    found = lines.join(often.select("host", "line_hash", "short"), ["host", "line_hash"])
    # lines that begin or end like a frequent one are variants of it, as near copies have them
    ends = found.select("host", F.explode(F.array("a", "b")).alias("end")).filter("end is not null").distinct()
    like = lines.select("host", "text_hash", "text_size", "line_no", "size", F.explode(F.array("a", "b")).alias("end")).join(ends, ["host", "end"]).drop("end")
    covered = (
        found.select("host", "text_hash", "text_size", "line_no", "size").unionByName(like).distinct()
        .groupBy("host", "text_hash", "text_size").agg(F.sum("size").alias("covered"))
    )
    apart = covered.filter(F.col("text_size") - F.col("covered") >= own_share * F.col("text_size")).select("host", "text_hash")
    shared = found.join(apart, ["host", "text_hash"], "left_semi").select("host", "line_hash", "short", "text_id").distinct()
    return frequent(shared.groupBy("host", "line_hash", "short").agg(F.count("*").alias("n_documents")))


def removed_words(lists: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, text_hash, hashes of boilerplate lines and removed (the words in them), for documents that have one."""
    lines = lists.select("doc_id", "text_hash", "host", F.posexplode("lines").alias("line_no", "line"))
    hit = lines.select("doc_id", "text_hash", "host", "line_no", F.col("line.h").alias("line_hash"), F.col("line.n").alias("line_words")).join(frequent.select("host", "line_hash"), ["host", "line_hash"])
    # repeated rows meet in one group; as a set their lines count once, and a group is never more than one text's lines
    once = hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line_no", "line_hash", "line_words")).alias("lines"))
    return once.select("doc_id", "text_hash", F.array_distinct(F.transform("lines", lambda x: x["line_hash"])).alias("hashes"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["line_words"]).alias("removed"))


def judge(docs: DataFrame, host: str = "source", keep_share: float = 0.2, min_documents: int = 30, max_share: float = 0.002) -> DataFrame:
    """``docs`` with its measures, ``hashes`` and ``removed`` (boilerplate lines) and ``kept``."""
    lists = settle(line_lists(docs, host), "lines")
    removed = removed_words(lists, line_frequencies(lists, docs, host, min_documents, max_share))
    measured = text_measures(docs).withColumn("text_hash", F.xxhash64("text"))
    joined = measured.alias("m").join(
        removed.alias("r"),
        F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("m.text_hash") == F.col("r.text_hash")),
        "left",
    )
    return joined.select(
        *(F.col(f"m.{c}") for c in measured.columns if c != "text_hash"),
        F.col("r.hashes").alias("boilerplate"),
        F.coalesce("r.removed", F.lit(0).cast("long")).alias("boilerplate_words"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("boilerplate_words") >= keep_share * F.col("n_words")))


def without_boilerplate(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs`` with their columns, texts rid of boilerplate lines."""
    judged = judge(set_aside(docs, "doc_id", "text", host), host, **limits)
    kept_lines = F.filter(F.split("text", "\n", -1), lambda line: ~F.array_contains(F.col("boilerplate"), F.xxhash64(normal_line(line))))
    changed = judged.filter("kept").withColumn("text", F.when(F.col("boilerplate").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
    return bring_back(changed, docs, "doc_id", "text", host)
