"""Exact top-k inner products by a pivot-distance index.

Method. Vectors of integers get one more component that brings them all to the same length, and queries a zero; the
largest inner products are then the nearest neighbours. A vector is keyed by its nearest pivot and its distance from
it; keys fall into rings of the distance, annuli around the pivot. A query first searches its nearest annuli until
they hold enough rows, which bounds the distance of its k-th neighbour, and then only those annuli whose
triangle-inequality bound (distance of the query from the pivot against the ring's limits) doesn't exceed it. Others
can't hold a better row, so results are exact, ties included.

Pivots and ring limits are fitted on a bounded sample (``sample`` rows, or 16 a pivot, with the smallest id hashes, drawn by a bounded top-n); every row is
indexed. There are at least ``pivots`` of them, one for each 16 of the root of the number of rows, and ``most_pivots`` at most, so the directory has
at most most_pivots x rings entries. Annuli are stored as blocks of about ``block`` rows, full
ones dealt out by a hash, and meet queries in groups, block by block, so a block is compared with many queries by one matrix product,
blocks of one annulus are compared in many tasks, and no pair of rows is ever a row of a join.

Components are kept as 32-bit integers if all rows' fit, else as doubles, which hold every scaled component. Products are taken in doubles where those are exact, else in
64-bit integers, else in Python's.

Defined results. Rows with a null id, a null vector, or a null or non-finite component (after scaling, too) take no part. A score beyond
the limits of a long is that limit. Shorter vectors count as filled with zeros. Rows that share a query's id are its own and no candidates;
equal repeated rows of a query ask once. Fewer than k candidates give them all. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, settle, ship

LONG = np.iinfo(np.int64)


def scaled(batch: pa.RecordBatch, scale: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each usable vector, as doubles, and which rows those are."""
    ids, column = batch.column("vec_id"), batch.column("embedding")
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    owner = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        values = np.floor(flat * scale)
    good = np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
    good[owner[~np.isfinite(values)]] = False
    out = np.zeros((len(column), width))
    fine = good[owner]
    out[owner[fine], place[fine]] = values[fine]
    return out[good], np.nonzero(good)[0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers in doubles, as int64; its limits for those beyond."""
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(_whole(a, b), LONG.min, LONG.max).astype(np.int64)


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in Python integers."""
    exact = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return exact(a) @ exact(b).T


class PivotIndex:
    """Pivots, the common length, and ring limits; small and the same size for any table."""

    def __init__(self, sample: np.ndarray, length: float, pivots: int, rings: int):
        self.length = length
        points = self.lift(sample)
        centers = points[:1]
        nearest = ((points - centers[0]) ** 2).sum(axis=1)
        while len(centers) < min(pivots, len(points)) and nearest.max() > 0:  # farthest first
            centers = np.vstack([centers, points[nearest.argmax()]])
            nearest = np.minimum(nearest, ((points - centers[-1]) ** 2).sum(axis=1))
        for _ in range(4):
            home = self._distances(points, centers).argmin(axis=1)
            centers = np.vstack([points[home == p].mean(axis=0) if (home == p).any() else centers[p] for p in range(len(centers))])
        self.centers = centers
        apart = self._distances(points, centers)
        home, mine = apart.argmin(axis=1), apart.min(axis=1)
        cuts = np.linspace(0, 1, rings + 1)[1:-1]
        self.edges = [np.quantile(mine[home == p], cuts) if (home == p).any() else np.zeros(rings - 1) for p in range(len(centers))]
        self.rings = rings

    @staticmethod
    def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T
        return np.sqrt(np.maximum(square, 0))

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        return np.hstack([v, np.sqrt(np.maximum(self.length**2 - (v**2).sum(axis=1), 0))[:, None]])

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """cell (pivot and ring) and distance of each vector."""
        apart = self._distances(self.lift(vectors), self.centers)
        home, mine = apart.argmin(axis=1), apart.min(axis=1)
        ring = np.array([np.searchsorted(self.edges[p], d) for p, d in zip(home, mine, strict=True)], np.int64)
        return home * self.rings + ring, mine

    def bounds(self, queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer to the query than this; a little less, for rounding, which grows with the common length."""
        zero = np.hstack([queries, np.zeros((len(queries), 1))])
        apart = self._distances(zero, self.centers)[:, cells // self.rings]
        return np.maximum(0, np.maximum(apart - high, low - apart)) * (1 - 1e-9) - 1e-3 - 1e-6 * self.length


def _unpack(column, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)


def exact_top_k(table: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, pivots: int = 48, most_pivots: int = 1024, rings: int = 16, sample: int = 4096, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by ``every``, against all rows."""
    spark = table.sparkSession
    ship(spark)
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)

    def read(batches):
        for batch in batches:
            own, rows = scaled(batch, scale, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array([r.tobytes() for r in own.astype("<f8")], pa.binary()), pa.array((own**2).sum(axis=1)), pa.array(np.abs(own).max(axis=1, initial=0))],
                names=["vec_id", "v", "norm", "most"],
            )

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                packed = _unpack(batch.column("v"), width, "<f8").astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "v"])

    found = vectors.mapInArrow(read, "vec_id long, v binary, norm double, most double")
    n, longest, most = found.agg(F.count("*"), F.max("norm"), F.max("most")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = "<i4" if most < 2**31 else "<f8"
    rows = settle(found.mapInArrow(pack, "vec_id long, v binary"), "vectors")
    pivots = max(pivots, min(most_pivots, round(n**0.5 / 16)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 16 * pivots)).toPandas()  # the bounded sample
    index = spark.sparkContext.broadcast(PivotIndex(np.frombuffer(b"".join(drawn["v"]), kind).reshape(-1, width), float(np.sqrt(longest)) * (1 + 1e-12), pivots, rings))

    def key(batches):
        for batch in batches:
            if batch.num_rows:
                cell, apart = index.value.keys(_unpack(batch.column("v"), width, kind))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell), pa.array(apart)], names=["vec_id", "v", "cell", "apart"])

    keyed = settle(rows.select("vec_id", "v").mapInArrow(key, "vec_id long, v binary, cell long, apart double"), "keyed-vectors")
    directory = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high"))
    listed = directory.toPandas().sort_values("cell")  # pivots x rings rows at most
    cells, held = listed["cell"].to_numpy(), listed["n"].to_numpy()
    limits = (listed["low"].to_numpy(), listed["high"].to_numpy())
    parts = settle(directory.select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts")), "directory")
    blocks = settle(
        keyed.join(F.broadcast(parts), "cell")  # most_pivots x rings rows at most
        .groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")),
        "blocks",
    )
    asked = settle(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct(), "queries")
    search = _Search(index, width, kind, k, cells, held, limits, parts)
    first = search.score(asked.withColumn("least", F.lit(None).cast("long")), blocks, nearest=True)
    ranked = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    bound = first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("query_id", "v", F.col("score").alias("least"))
    second = search.score(asked.join(bound, ["query_id", "v"], "left"), blocks, nearest=False)
    best = first.unionByName(second).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


class _Search:
    def __init__(self, index, width: int, kind: str, k: int, cells: np.ndarray, held: np.ndarray, limits: tuple, parts: DataFrame):
        self.index, self.width, self.kind, self.k, self.cells, self.held, self.limits, self.parts = index, width, kind, k, cells, held, limits, parts

    def score(self, queries: DataFrame, blocks: DataFrame, nearest: bool, group: int = 256) -> DataFrame:
        """The k best rows (fewer, if a bound is known) of each query in each block that it is sent to."""
        index, width, kind, k, cells, held, (low, high) = self.index, self.width, self.kind, self.k, self.cells, self.held, self.limits

        def route(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    own = _unpack(part.column("v"), width, kind)
                    bounds = index.value.bounds(own, cells, low, high)
                    order = bounds.argsort(axis=1, kind="stable")
                    before = held[order].cumsum(axis=1) - held[order]
                    early = np.zeros(bounds.shape, bool)  # annuli of the first round: until they hold 2k rows and itself
                    np.put_along_axis(early, order, before <= 2 * k, axis=1)
                    if nearest:
                        send = early
                    else:
                        least = np.array([np.nan if x is None or x == LONG.min else x for x in part.column("least").to_pylist()], np.float64)
                        reach = np.sqrt(np.maximum((own**2).sum(axis=1) + index.value.length**2 - 2 * least, 0))
                        send = ~early & ~(bounds > reach[:, None])  # no bound known: everywhere
                    q, c = np.nonzero(send)
                    yield pa.RecordBatch.from_arrays([*(part.column(n).take(pa.array(q)) for n in ("query_id", "v", "least")), pa.array(cells[c])], names=["query_id", "v", "least", "cell"])

        sent = queries.select("query_id", "v", "least").mapInArrow(route, "query_id long, v binary, least long, cell long")
        counted = sent.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
        grouped = (
            sent.join(F.broadcast(counted), "cell")  # bounded like the directory
            .groupBy("cell", F.pmod(F.xxhash64("query_id", "v"), F.col("groups")).alias("queries_part"))
            .agg(F.collect_list(F.struct("query_id", "v", "least")).alias("queries"))
            .join(F.broadcast(self.parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        )

        def compare(batches):
            for batch in batches:
                out = [[], [], [], []]
                for row in range(batch.num_rows):
                    asked, rows = batch.column("queries")[row].values, batch.column("rows")[row].values
                    own, theirs = _unpack(asked.field("v"), width, kind), _unpack(rows.field("v"), width, kind)
                    ids, query_ids = rows.field("vec_id").to_numpy(), asked.field("query_id").to_numpy()
                    scores = products(own, theirs)
                    least = asked.field("least").fill_null(LONG.min).to_numpy()
                    take = (scores >= least[:, None]) & (ids[None, :] != query_ids[:, None])
                    vs = asked.field("v").to_pylist()
                    for q in np.nonzero(take.any(axis=1))[0]:
                        at = np.nonzero(take[q])[0]
                        at = at[np.lexsort((ids[at], ~scores[q, at]))[:k]]
                        out[0] += [query_ids[q]] * len(at)
                        out[1] += [vs[q]] * len(at)
                        out[2] += ids[at].tolist()
                        out[3] += scores[q, at].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["query_id", "v", "vec_id", "score"])

        with arrow_rows(blocks.sparkSession, 16):
            return settle(grouped.join(blocks, ["cell", "part"]).select("queries", "rows").mapInArrow(compare, "query_id long, v binary, vec_id long, score long"), "found")
