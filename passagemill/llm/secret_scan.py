"""Secret scans: multipart credential linking.

Method. Six kinds of parts are found with their spans. ``assign``, ``access`` and ``hex`` are strong and always
reported. ``user`` (an identifier given a value), ``key`` (a long mixed-case token) and ``endpoint`` (a service address)
are weak: each alone is ordinary text, and it is reported only if the parts that complete a credential lie within
``scope`` characters of it. A user needs a secret, a key needs an identifier, an endpoint needs both.

Linking is an interval equi-join on cells of ``scope`` characters: for each text, role and cell the complementary
parts are pre-aggregated to their first start and last end, a weak part meets the three or four cells that its
surroundings touch, and the bounds decide exactly. A cell has one row a role however many parts it holds, so no pairs
of parts arise and a text full of keys costs no more than its length.

Weak parts are looked for in the text that strong parts leave, so none overlaps a strong one.

Spans come from the engine's regular expressions alone: a text split at the matches gives the lengths between them, and
running sums of those the places, at a cost near the text's length however many parts it holds. Offsets are code points. The parts of all texts are written once and read by both sides of the join.

Defined results. A null or empty text has no part. Repeated rows are found alike; rows are told apart by id and text
hash, and a null id is an id of its own. Columns besides ``doc_id`` and ``text`` are ignored by the scan and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, running_max, running_sum
from .common import bring_back, set_aside, settle, text_or_empty

#: Patterns of the kinds in their order. Group 2, if given a least length, is the value.
KINDS = ("assign", "access", "hex", "user", "key", "endpoint")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "user": r"""((?i:user(?:name)?|login|client_?id|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""",
    "key": r"[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s?ftp|ssh|s3)://[^\x20\x09-\x0D"'<>]+""",
}
STRONG = 3
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "hex", "key")
SCOPE = 300
PART = "array<struct<kind: int, start: int, end: int>>"
#: Stands for a character of a strong part; no weak pattern takes it.
MASK = "\n"


def _accepts(kind: str, match: Column, value: Column) -> Column:
    if kind == "assign":
        return F.length(value) >= 12
    if kind == "access":
        return F.length(match) >= 18
    if kind == "key":
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def _gaps_and_matches(text: Column, kind: str) -> Column:
    """array<struct<gap, match, value>>: each match of a kind with what lies between the match before and it."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind in ("assign", "user") else matches
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))


def parts_of_kind(text: Column, kind: str) -> Column:
    """Accepted matches as structs of kind number, start and end, in order."""

    def placed(found: Column) -> Column:
        ends = running_sum(F.transform(found, lambda x: F.length(x["gap"]) + F.length(x["match"])))
        part = lambda x, end: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(x["match"])).cast("int").alias("start"), end.cast("int").alias("end"))
        parts = bind(ends, lambda e: F.transform(found, lambda x, k: F.when(_accepts(kind, x["match"], x["value"]), part(x, F.get(e, k)))))
        return F.filter(parts, lambda p: p.isNotNull())

    return F.when(text.rlike(PATTERNS[kind]), bind(_gaps_and_matches(text, kind), placed)).otherwise(F.array().cast(PART))


def masked(text: Column, kind: str) -> Column:
    """The text with the accepted matches of a kind written as so many ``MASK`` characters; offsets stay."""

    def written(found: Column) -> Column:
        pieces = F.transform(found, lambda x: F.concat(x["gap"], F.when(_accepts(kind, x["match"], x["value"]), F.repeat(F.lit(MASK), F.length(x["match"]))).otherwise(x["match"])))
        return F.concat(F.array_join(pieces, ""), F.element_at(F.split(text, PATTERNS[kind], -1), -1))

    return F.when(text.rlike(PATTERNS[kind]), bind(_gaps_and_matches(text, kind), written)).otherwise(text)


def row_key(text: Column) -> Column:
    """Tells texts of different rows apart; equal rows share it."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64(text)))


def document_parts(docs: DataFrame) -> DataFrame:
    """doc_id, key, and the parts of strong and of weak kinds; weak ones are looked for in what strong ones leave."""
    text = text_or_empty()
    found = docs.select("doc_id", row_key(text).alias("key"), F.concat(*(parts_of_kind(text, k) for k in KINDS[:STRONG])).alias("strong"), text.alias("text"))

    def left(own: Column, kinds: tuple) -> Column:
        return bind(masked(own, kinds[0]), lambda t: left(t, kinds[1:])) if kinds else F.concat(*(parts_of_kind(own, k) for k in KINDS[STRONG:]))

    weak = F.when(F.size("strong") > 0, left(F.col("text"), KINDS[:STRONG])).otherwise(left(F.col("text"), ()))
    return found.select("doc_id", "key", "strong", weak.alias("weak"))


def linked_weak_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key and the weak parts that complementary parts are near to."""
    role = F.when(F.col("p.kind").isin([KINDS.index(k) for k in IDENTIFIERS]), 0).when(F.col("p.kind").isin([KINDS.index(k) for k in SECRETS]), 1)
    some = parts.filter((F.size("weak") > 0) & (F.size("strong") + F.size("weak") > 1)).select("key", "strong", "weak")
    cells = (
        some.select("key", F.explode(F.concat("strong", "weak")).alias("p")).withColumn("role", role).filter("role is not null")
        .select("key", "role", "p", F.explode(F.sequence((F.col("p.start") / scope).cast("int"), ((F.col("p.end") - 1) / scope).cast("int"))).alias("cell"))
        .groupBy("key", "role", "cell").agg(F.min("p.start").alias("first"), F.max("p.end").alias("last"))
    )
    reach = F.sequence((F.greatest(F.col("w.start") - scope, F.lit(0)) / scope).cast("int"), ((F.col("w.end") + scope) / scope).cast("int"))
    weak = some.select("key", F.explode("weak").alias("w")).distinct().select("key", "w", F.explode(reach).alias("cell"))
    near = weak.join(cells, ["key", "cell"]).filter((F.col("first") <= F.col("w.end") + scope) & (F.col("last") >= F.col("w.start") - scope))
    has = near.groupBy("key", "w").agg(F.max(F.col("role") == 0).alias("identifier"), F.max(F.col("role") == 1).alias("secret"))
    kind = {k: KINDS.index(k) for k in KINDS}
    # a part is in its own role's cells, so a kind is only ever asked for the other role
    complete = (
        (F.col("w.kind") == kind["user"]) & F.col("secret")
        | (F.col("w.kind") == kind["key"]) & F.col("identifier")
        | (F.col("w.kind") == kind["endpoint"]) & F.col("secret") & F.col("identifier")
    )
    return has.filter(complete).groupBy("key").agg(F.collect_list("w").alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, key, strong (spans of the strong kinds) and spans (all that are reported), sorted by start and kind."""
    parts = settle(document_parts(docs), "secret-parts")
    by_start = lambda a: F.transform(F.array_sort(F.transform(a, lambda p: F.struct(p["start"], p["kind"], p["end"]))), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    joined = parts.select("doc_id", "key", "strong").join(linked_weak_parts(parts, scope), "key", "left")
    every = F.when(F.col("linked").isNull(), F.col("strong")).otherwise(F.concat("strong", "linked"))
    return joined.select("doc_id", "key", by_start(F.col("strong")).alias("strong"), by_start(every).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda p: F.element_at(F.array(*(F.lit(k) for k in KINDS)), p["kind"] + 1)
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", name(p), p["start"].cast("string"), p["end"].cast("string"))), ",")


def cut_out(text: Column, spans: Column, mark: str, step: int = 4096) -> Column:
    """The text with each span, overlapping ones together, replaced by ``mark``; spans are sorted by start.

    Pieces are taken from chunks of ``step`` characters, since a substring counts characters from the text's begin.
    """

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / step).cast("int")
        own = F.slice(chunks, first + 1, F.floor((end - 1) / step).cast("int") - first + 1)
        part = lambda c, k: F.substring(c, F.greatest(start - (first + k) * step, F.lit(0)).cast("int") + 1, (end - F.greatest(start, (first + k) * step)).cast("int"))
        return F.when(start >= end, "").otherwise(F.array_join(F.transform(own, part), ""))

    def of_chunks(chunks: Column) -> Column:
        def of_ends(ends: Column) -> Column:
            before = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(ends, k - 1))
            kept = F.transform(spans, lambda p, k: F.when((k > 0) & (p["start"] < before(k)), "").otherwise(F.concat(piece(chunks, before(k), p["start"].cast("long")), F.lit(mark))))
            return F.concat(F.array_join(kept, ""), piece(chunks, F.element_at(ends, -1), F.length(text).cast("long")))

        return bind(running_max(F.transform(spans, lambda p: p["end"])), of_ends)

    return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), of_chunks)


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each reported span, overlapping ones together, replaced by ``mark``."""
    spans = scan(docs, scope).filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    keyed = set_aside(docs, "doc_id", "text").withColumn("key", row_key(text_or_empty()))
    changed = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut_out(F.col("text"), F.col("spans"), mark))
    return bring_back(keyed.join(spans, "key", "left").withColumn("text", changed), docs, "doc_id", "text")
