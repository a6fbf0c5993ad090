"""Harmonic packing of tokenised documents into fixed-length training sequences.

Method. Lengths fall into reciprocal-capacity classes: a class of size ``capacity // k`` puts
exactly ``k`` pieces into a bin. A document is cut only where a class boundary is: full
sequences first, then, as long as the rest would leave more than ``slack`` tokens unused in its
class, one piece of exactly the next smaller class size. What stays over wastes at most
``slack`` tokens. Cuts depend on nothing but the document's length.

Bins of a class are filled by many workers independently: pieces are dealt into buckets of
about ``bucket_rows`` by a hash, each bucket closes its own full bins, and the fewer than ``k``
pieces that it has over go up to a bucket that joins ``fan_in`` of them. After the last level
fewer than ``k`` pieces a class are left, a number fixed by the classes and not by the data;
first-fit-decreasing puts them into a handful of sequences.

Defined results. A null or empty text is one piece that holds only the end id. Repeated rows
are packed once each. Rows with a null ``doc_id`` are packed like any other. Columns besides
``doc_id`` and ``text`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import settle, ship, slices

#: Documents of a bin in each class, from one full sequence to tiny rests.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 40, 48, 64, 85, 128, 256)
CAPACITY = 2048
END_ID = 1


class ByteLevelIds:
    """Little-endian unsigned 32-bit ids of a text under a byte-level BPE vocabulary, those of the tokenizers library with its defaults.

    The merge ranks and added tokens come from the tokenizers file itself; the tiktoken library applies the ranks. A text is cut before single blanks
    and single line ends, which no pre-token crosses, and the ids of such units are kept in a
    table of at most ``keep`` entries; texts with other white space are encoded whole.
    """

    def __init__(self, path: str, pattern: str, keep: int = 200_000):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ranks = {bytes(map(_byte_of_letter().__getitem__, piece)): i for piece, i in model["vocab"].items() if set(piece) <= _byte_of_letter().keys()}
        # added tokens are taken out of a text before anything else, as the library does by default
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in content["added_tokens"]):
            raise ValueError("added tokens that depend on what is beside them aren't handled")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        for token in self.added:
            ranks.pop(token.encode(), None)
        first = len(ranks) - len(model["merges"])
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if model["vocab"][left + right] != first + k:
                raise ValueError("merge order and ids differ; ranks can't stand for merges")
        self.encoder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.units = _Units(self.encoder, keep)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join(self.added[part].to_bytes(4, "little") if k % 2 else self(part) for k, part in enumerate(self.cut.split(text)))
        head, *rest = text.replace("\n", " \n").split(" ")
        if rest and head[-1:].isspace():
            return self.whole(text)
        try:
            tail = b"".join(map(self.units.__getitem__, rest))
        except TypeError:
            return self.whole(text)
        finally:
            self.units.trim()
        return (self.whole(head) if head else b"") + tail

    def whole(self, text: str) -> bytes:
        return self.encoder.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def ids_of_vocabulary(path: str, pattern: str) -> ByteLevelIds:
    """One table of units for each Python worker, kept from task to task."""
    return ByteLevelIds(path, pattern)


class _Units(dict):
    """Ids of units. A unit is kept from its second time on, since most units that are new never come again."""

    def __init__(self, encoder, keep: int):
        self.encoder, self.keep, self.once = encoder, keep, set()

    def __missing__(self, unit: str):
        if not unit or unit[-1].isspace():
            return ""  # joining it with bytes fails, and the text is encoded whole
        ids = array("I", self.encoder.encode_ordinary(unit if unit[0] == "\n" else " " + unit)).tobytes()
        if len(unit) <= 48:
            if unit in self.once:
                self[unit] = ids
            else:
                self.once.add(unit)
        return ids

    def trim(self) -> None:
        if len(self.once) > self.keep:
            self.once.clear()
        if len(self) > self.keep:
            # the oldest entries hold the frequent units; those that came last go
            for unit in list(self)[self.keep * 3 // 4 :]:
                del self[unit]


@lru_cache
def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def class_sizes(capacity: int = CAPACITY) -> list[int]:
    return sorted({capacity // k for k in COUNTS if capacity // k}, reverse=True)


@lru_cache(maxsize=4096)
def cut_rest(length: int, capacity: int = CAPACITY, slack: int = 8) -> tuple[tuple[int, int], ...]:
    """(length, class size) of the pieces of what a document has beyond full sequences."""
    out, sizes = [], class_sizes(capacity)
    while length:
        fits = min(s for s in sizes if s >= length)
        below = max((s for s in sizes if s <= length), default=0)
        if fits - length <= slack or not below:
            out.append((length, fits))
            break
        out.append((below, below))
        length -= below
    return tuple(out)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, slack: int = 8, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, size (of the class)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "size")])

    def run(batches):
        ids_of = ids_of_vocabulary(tokenizer_path, pattern)
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches):
            rows, out = [], [[], [], [], [], []]
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(ids_of(text or "") + end)
                total = len(ids) // 4
                start = 0
                for length, size in [(capacity, capacity)] * (total // capacity) + list(cut_rest(total % capacity, capacity, slack)):
                    rows.append(k)
                    for column, value in zip(out, (start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, size), strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 4096, fan_in: int = 64) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, whose ``length`` is at most their class ``size``."""
    sizes = class_sizes(capacity)
    pieces = settle(pieces, "pieces")
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row a class
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("size")
    buckets = {s: math.ceil(n / bucket_rows) for s, n in counts.items()}

    def of_size(values: dict) -> F.Column:
        return F.element_at(F.create_map(*(F.lit(x).cast("long") for s in values for x in (s, values[s]))), F.col("size"))

    names = [c for c in pieces.columns if c != "size"]
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "length", "doc_tokens")]
    rest = pieces.withColumns({
        "k": of_size({s: capacity // s for s in counts}),
        "class": of_size({s: sizes.index(s) for s in counts}),
        "bucket": F.pmod(F.xxhash64(*order[:3]), of_size(buckets)),
    })
    done, level, most = [], 0, max(buckets.values())
    while True:
        # a bucket is one worker's share: it closes its full bins and passes on fewer than k pieces
        share = Window.partitionBy("class", "bucket")
        placed = rest.withColumn("rn", F.row_number().over(share.orderBy(*order))).withColumn("n", F.count("*").over(share))
        placed = placed.withColumn("bin", F.floor((F.col("rn") - 1) / F.col("k")).cast("long"))
        full = F.col("rn") <= F.col("n") - F.col("n") % F.col("k")
        bins = Window.partitionBy("class", "bucket", "bin").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
        done.append(
            placed.filter(full).select(
                *names,
                (((F.lit(level * 32) + F.col("class")) * F.lit(2**34) + F.col("bucket")) * F.lit(2**20) + F.col("bin")).cast("long").alias("sequence_id"),
                F.coalesce(F.sum("length").over(bins), F.lit(0)).cast("long").alias("offset"),
            )
        )
        rest = settle(placed.filter(~full).select(*pieces.columns, "k", "class", F.floor(F.col("bucket") / fan_in).cast("long").alias("bucket")), "open-bins")
        if most == 1:
            break
        level, most = level + 1, math.ceil(most / fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.unionByName(_last_bins(rest, names, capacity, level + 1))


def _last_bins(rest: DataFrame, names: list[str], capacity: int, level: int) -> DataFrame:
    """First fit of the fewer than sum(COUNTS) pieces that fill no bin of their class."""
    schema = T.StructType([rest.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    first = level * 32 * 2**54

    def fit(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        free, ids, offsets = [], [0] * len(lengths), [0] * len(lengths)
        for row in sorted(range(len(lengths)), key=lambda r: -lengths[r]):
            at = next((b for b, room in enumerate(free) if room >= lengths[row]), len(free))
            if at == len(free):
                free.append(capacity)
            ids[row], offsets[row] = first + at, capacity - free[at]
            free[at] -= lengths[row]
        return table.select(names).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).cast(to_arrow_schema(schema))

    return rest.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(fit, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, slack: int = 8, end_id: int = END_ID) -> DataFrame:
    """Tokenise and pack: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return harmonic_pack(tokenize_pieces(docs, tokenizer_path, pattern, capacity, slack, end_id), capacity)
