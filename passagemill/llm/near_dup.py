"""SimHash near-duplicates by tiled exact comparison.

Method. A fingerprint has 64 bits or a multiple, each the majority among the hashes of a text's word shingles. Distinct
fingerprints are sorted into tiles by population counts, of ``parts`` equal parts of their leading 64 bits. Fingerprints
whose leading bits differ in at most ``lead`` have counts that differ by at most ``lead`` in sum, so a tile is compared only
with tiles whose counts are that close; other tile pairs are skipped. What is compared is exact: numpy exclusive-or and
bit counts over whole tiles. Two fingerprints are linked if their leading 64 bits differ in at most ``lead`` bits and
all of them in at most ``radius``.

A tile holds about ``tile`` fingerprints at most (fuller ones are dealt out by a hash), and yields at most
one link per fingerprint, a forest of what is linked in it; a tile pair links components of tiles, so large groups of near copies don't square. Components come
from joins. Nothing is collected: tiles, links and labels stay distributed.

:func:`keep_one` finds texts whose shingle sets have a similarity (Jaccard) of at least ``similarity``. There fingerprints, of the distinct shingles, only name
candidates: their radius is so wide that hardly a similar pair lies outside. The sets of the texts of each component of
candidates are then compared exactly, in blocks of bounded bytes (:func:`confirmed_links`), and only confirmed links make groups.

Defined results. A text without a word, or a null one, has fingerprint zero; zero is linked like any other. Fewer
words than a shingle make one shingle of them all. Repeated rows and equal texts share a fingerprint. A component's
id is its least non-null doc_id (null if it has none). Columns besides ``doc_id`` and ``text`` pass through :func:`keep_one`.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import REST, arrow_rows, bring_back, set_aside, settle, ship, slices
from .components import connected_components

#: Five-word shingles. At a similarity of 0.8 two sets' fingerprints differ in 39 of 256 bits with a deviation of 5.7, and in 10 of the leading 64 with 2.9: all but one pair in about 5,000 lie inside.
WIDE = {"shingle": 5, "words": 4, "radius": 60, "lead": 22, "parts": 1, "tile": 4096}
NARROW = {"shingle": 3, "words": 1, "radius": 3, "lead": 3, "parts": 4, "tile": 1024}


def hashes_of(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], "<u8")
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))), "<u8", len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` numbers of 64 bits; the first comes from the hashes themselves, more from mixing them."""
    out = np.zeros(words, np.uint64)
    if not len(hashes):
        return out
    for word in range(words):
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 1 << 16):  # bounds memory for very long texts
            mixed = _mix(hashes[start : start + (1 << 16)], word)
            ones += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[word] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _mix(hashes: np.ndarray, word: int) -> np.ndarray:
    if not word:
        return hashes
    x = hashes * np.uint64(2 * word + 1) + np.uint64(0x9E3779B97F4A7C15 * word % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signatures(leading: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of the leading word's parts, as digits to base 128."""
    bits, out = 64 // parts, np.zeros(len(leading), np.int64)
    for k in range(parts):
        piece = leading >> np.uint64(bits * k) & np.uint64(2**bits - 1)
        out = out * 128 + np.bitwise_count(piece)
    return out


def near_offsets(lead: int, parts: int) -> list[int]:
    """Differences of signatures whose counts differ by at most ``lead`` in sum; one of each opposite two."""
    steps = (d for d in itertools.product(range(-lead, lead + 1), repeat=parts) if sum(map(abs, d)) <= lead)
    return sorted(k for k in (sum(x * 128 ** (parts - 1 - n) for n, x in enumerate(d)) for d in steps) if k >= 0)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, parts: int = 4, distinct: bool = False) -> DataFrame:
    """doc_id, fp (binary, big-endian words), sig; of ``distinct`` shingles also node, the digest of their set."""
    import xxhash

    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.BinaryType()), T.StructField("sig", T.LongType())])
    if distinct:
        schema = schema.add("node", T.BinaryType())

    def run(batches):
        for batch in slices(batches):
            hashes = [hashes_of(t, shingle) for t in batch.column("text").to_pylist()]
            if distinct:
                hashes = list(map(np.unique, hashes))
            own = np.stack([fingerprint(h, words) for h in hashes])
            columns = [batch.column("doc_id"), pa.array([r.tobytes() for r in own.astype(">u8")], pa.binary()), pa.array(signatures(own[:, 0], parts))]
            if distinct:
                columns.append(pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def joined(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the number of the first one that the pairs (u, v), and those behind ``label``, join it to."""
    label = np.arange(n) if label is None else label
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        np.minimum.at(new, label[u], new[u])
        np.minimum.at(new, label[v], new[v])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_pairs(a: np.ndarray, b: np.ndarray, lead: int, radius: int, strip: int = 256):
    """Rows of a and of b whose fingerprints are linked, for a strip of a's rows at a time."""
    for start in range(0, len(a), strip):
        r, c = np.nonzero(np.bitwise_count(a[start : start + strip, None, 0] ^ b[None, :, 0]) <= lead)
        r += start
        if a.shape[1] > 1 and len(r):
            near = np.zeros(len(r), np.int32)
            for w in range(a.shape[1]):
                near += np.bitwise_count(a[r, w] ^ b[c, w])
            r, c = r[near <= radius], c[near <= radius]
        yield r, c


def inside(n: int, strips) -> np.ndarray:
    """The components of n rows that linked rows, in strips, make: for each row its component's first."""
    label = np.arange(n)
    for r, c in strips:
        label = joined(n, r, c, label)
    while (label != (above := label[label])).any():
        label = above
    return label


def across(inner: np.ndarray, other: np.ndarray, strips) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what linked rows of two sides join, at most one for each inner component: rows of both sides, one after the other.

    ``inner`` and ``other`` are the components within each side, by their first rows; links inside them are known.
    """
    label = np.concatenate([inner, other + len(inner)])
    n = len(label)
    found = [np.unique(label[r] * n + label[c + len(inner)]) for r, c in strips]
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    end = inside(n, [(pairs // n, pairs % n)])
    moved = np.nonzero(end != np.arange(n))[0]
    return end[moved], moved


def fingerprint_links(fps: DataFrame, radius: int, lead: int, parts: int, tile: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp, sig), enough to join all that are linked.

    Tiles are first compared with themselves, which gives their inner components; two tiles then give links between those only, so that a
    large group of near copies has about one link a fingerprint and one a tile pair.
    """
    spark = fps.sparkSession
    ship(spark)
    fps = fps.select("fp", "sig").distinct()
    width = len(fps.select("fp").first()["fp"]) if not fps.isEmpty() else 8
    numbers = lambda x: np.frombuffer(x, ">u8").reshape(-1, width // 8).astype(np.uint64)
    # a row a signature, of which there are (64 / parts + 1) ** parts at most, so it may be broadcast; a tile's group spreads the tiles of one signature
    sizes = fps.groupBy("sig").agg(F.ceil(F.count("*") / tile).cast("int").alias("shares")).withColumn("groups", F.ceil(F.sqrt("shares")).cast("int"))
    sizes = settle(sizes, "tile-sizes")
    dealt = (
        fps.join(F.broadcast(sizes), "sig").withColumn("share", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int"))
        .groupBy("sig", "share", "groups").agg(F.collect_list("fp").alias("fps"))
        .select("sig", "share", (F.col("share") % F.col("groups")).alias("group"), F.array_join(F.transform("fps", lambda x: F.hex(x)), "").alias("digits"))
        .select("sig", "share", "group", F.unhex("digits").alias("fps"))
    )

    def within(batches):
        for batch in batches:
            own = map(numbers, batch.column("fps").to_pylist())
            inner = [inside(len(x), close_pairs(x, x, lead, radius)).astype("<i4").tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner, pa.binary())], names=[*batch.schema.names, "inner"])

    with arrow_rows(spark, 64):
        tiles = settle(dealt.mapInArrow(within, "sig long, share int, group int, fps binary, inner binary"), "tiles")
    offsets = F.array(*(F.lit(k).cast("long") for k in near_offsets(lead, parts)))
    asked = (
        tiles.select(F.col("sig").alias("sig_a"), F.col("share").alias("share_a"), F.col("fps").alias("fps_a"), F.col("inner").alias("inner_a"), F.explode(F.transform(offsets, lambda k: k + F.col("sig"))).alias("sig"))
        .join(F.broadcast(sizes), "sig").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    )
    pairs = asked.join(tiles, ["sig", "group"]).filter((F.col("sig_a") < F.col("sig")) | (F.col("share_a") < F.col("share"))).select("fps_a", "inner_a", "fps", "inner")
    alone = tiles.select(F.col("fps").alias("fps_a"), F.col("inner").alias("inner_a"), F.lit(None).cast("binary").alias("fps"), F.lit(None).cast("binary").alias("inner"))

    def run(batches):
        for batch in batches:
            ends, more = [], []
            for x, own, y, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(own, "<i4").astype(np.int64)
                if y is None:
                    rows = np.nonzero(own != np.arange(len(own)))[0]
                    first = own[rows]
                else:
                    first, rows = across(own, np.frombuffer(other, "<i4").astype(np.int64), close_pairs(numbers(x), numbers(y), lead, radius))
                both = x + (y or b"")
                ends += [both[k * width : (k + 1) * width] for k in first.tolist()]
                more += [both[k * width : (k + 1) * width] for k in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(more, pa.binary())], names=["a", "b"])

    with arrow_rows(spark, 64):
        return settle(alone.unionByName(pairs).mapInArrow(run, "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 3, lead: int = 3, parts: int = 4, tile: int = 1024) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    prints = settle(fingerprints(docs, shingle, words, parts), "fingerprints")
    least = prints.groupBy("fp", "sig").agg(F.min("doc_id").alias("least"))
    labels = connected_components(fingerprint_links(least, radius, lead, parts, tile))
    named = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(settle(named.join(ids, "label").select("fp", "component_id"), "components"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_digits(fp: Column) -> Column:
    return F.lower(F.hex(fp))


def set_links(own: list[np.ndarray], other: list[np.ndarray] | None, similarity: Fraction, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of ``own`` and ``other`` (of ``own`` among themselves if None) are similar enough, exactly.

    Overlaps are products of incidence matrices, over the elements that two sets or more share, ``step`` at once.
    """
    sets = own + (other or [])
    flat = np.concatenate(sets) if sets else np.zeros(0, "<u8")
    sizes = np.array([len(x) for x in sets], np.int64)
    _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[element]
    row, column = np.repeat(np.arange(len(sets)), sizes)[shared[element]], column[shared[element]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = len(own)
    overlap = np.zeros((n, len(other) if other is not None else n))
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for k, (begin, end) in enumerate(zip(edges, edges[1:], strict=False)):
        matrix = np.zeros((len(sets), step), np.float32)
        matrix[row[begin:end], column[begin:end] - k * step] = 1
        overlap += matrix[:n] @ (matrix[n:] if other is not None else matrix).T
    union = sizes[:n, None] + (sizes[n:] if other is not None else sizes)[None, :] - overlap
    similar = similarity.denominator * overlap >= similarity.numerator * union
    if other is None:
        similar = np.triu(similar, 1)
    return np.nonzero(similar)


def confirmed_links(sets: DataFrame, similarity: float, block: int = 4 << 20) -> DataFrame:
    """Links (a, b) between nodes of one ``label`` whose sets (label, node, hashes) are similar enough, enough to join all that are.

    The sets of a label are dealt into blocks of about ``block`` bytes. Like tiles, blocks are compared with themselves, then each two in one task.
    """
    spark = sets.sparkSession
    ship(spark)
    exact = Fraction(similarity).limit_denominator(10_000)
    shares = sets.groupBy("label").agg(F.ceil(F.sum(F.length("hashes")) / block).cast("int").alias("shares")).withColumn("shares", F.greatest("shares", F.lit(1)))
    dealt = (
        sets.join(shares, "label").groupBy("label", "shares", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"))
        .agg(F.collect_list("node").alias("nodes"), F.collect_list("hashes").alias("hashes"))
    )
    unpacked = lambda many: [np.frombuffer(x, "<u8") for x in many]

    def within(batches):
        for batch in batches:
            inner = []
            for own in batch.column("hashes").to_pylist():
                inner.append(inside(len(own), [set_links(unpacked(own), None, exact)] if len(own) > 1 else []).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner, pa.list_(pa.int32()))], names=[*batch.schema.names, "inner"])

    with arrow_rows(spark, 16):
        blocks = settle(dealt.mapInArrow(within, "label binary, shares int, share int, nodes array<binary>, hashes array<binary>, inner array<int>"), "set-blocks")
    linked = F.filter(F.arrays_zip("nodes", F.transform("inner", lambda k: F.get(F.col("nodes"), k)).alias("first")), lambda x: x["nodes"] != x["first"])
    alone = blocks.select(F.explode(linked).alias("x")).select(F.col("x.first").alias("a"), F.col("x.nodes").alias("b"))
    many = blocks.filter("shares > 1").select("label", "shares", "share", "nodes", "hashes", "inner")
    asked = many.filter("share < shares - 1").select(
        "label", F.explode(F.sequence(F.col("share") + 1, F.col("shares") - 1)).alias("share"), F.col("nodes").alias("nodes_a"), F.col("hashes").alias("hashes_a"), F.col("inner").alias("inner_a")
    )
    pairs = asked.join(many, ["label", "share"]).select("nodes_a", "hashes_a", "inner_a", "nodes", "hashes", "inner")

    def run(batches):
        for batch in batches:
            ends, more = [], []
            for nodes, own, inner, others, other, outer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, rows = across(np.array(inner, np.int64), np.array(outer, np.int64), [set_links(unpacked(own), unpacked(other), exact)])
                both = nodes + others
                ends += [both[k] for k in first.tolist()]
                more += [both[k] for k in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(more, pa.binary())], names=["a", "b"])

    with arrow_rows(spark, 16):
        return settle(alone.unionByName(pairs.mapInArrow(run, "a binary, b binary")), "set-links")


def _row_key(doc_id: Column, text_hash: Column) -> Column:
    """Tells rows apart by id and text, without a null, so that a join and an aggregation deal rows out alike."""
    return F.struct(doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), text_hash.alias("text_hash"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 4, radius: int = 60, lead: int = 22, parts: int = 1, tile: int = 4096, block: int = 4 << 20) -> DataFrame:
    """One row of ``docs`` for each group of texts that similar shingle sets link: that of the least doc_id (null last) and, of its texts in the group, the least hash; of equal rows one.

    Rows are told apart by id and text, so different texts without an id, or with the same one, are each judged on their own.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    prints = settle(fingerprints(docs.select(own.alias("doc_id"), "text"), shingle, words, parts, distinct=True), "fingerprints")
    nodes = settle(prints.groupBy("node", "fp", "sig").agg(F.min("doc_id").alias("least")), "nodes")
    near = connected_components(fingerprint_links(nodes, radius, lead, parts, tile))
    named = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("node", "least", F.coalesce("label", "fp").alias("label"))
    groups = named.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    candidates = named.join(groups, "label").select("label", "node", _row_key(F.col("least.id"), F.col("least.text_hash")).alias("row_key"))
    texts = docs.select(_row_key(F.col("doc_id"), F.xxhash64("text")).alias("row_key"), "text").join(candidates, "row_key").dropDuplicates(["node"])

    def sets_of(batches):
        for batch in slices(batches):
            hashes = [np.unique(hashes_of(t, shingle)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("node"), pa.array(hashes, pa.binary())], names=["label", "node", "hashes"])

    sets = settle(texts.select("label", "node", "text").mapInArrow(sets_of, "label binary, node binary, hashes binary"), "shingle-sets")
    linked = connected_components(confirmed_links(sets, similarity, block)).withColumnRenamed("label", "first")
    kept = nodes.join(linked, "node", "left").groupBy(F.coalesce("first", "node")).agg(F.min("least").alias("least")).select(_row_key(F.col("least.id"), F.col("least.text_hash")).alias("row_key"))
    mine = set_aside(docs, "doc_id", "text").withColumn("row_key", _row_key(F.col("doc_id"), F.xxhash64("text"))).join(kept, "row_key", "left_semi")
    # partial aggregation, so that a row repeated very often is no task's burden
    one = mine.groupBy("row_key").agg(F.first(F.struct("doc_id", "text", REST)).alias("row")).select("row.*")
    return bring_back(one, docs, "doc_id", "text")
