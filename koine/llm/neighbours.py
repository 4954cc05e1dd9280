"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions, several times at random; each axis is
stretched by the distribution of its values, so that dense regions get as many
cells as they have rows, and each projection, shifted, is ordered along a
Hilbert curve.  Spark range-partitions and sorts the keys of all curves (ties by
row), which gives every row its rank on every curve.  A query meets the rows
whose rank on some curve is within a window of its own; ranks are dealt in
ranges of a fixed number of rows, so equal keys, however many, are spread like
any others, and a query visits the few ranges that its window touches.  The
nearest of each range are merged and ranked by the exact distance.

How wide the window is is fitted, not guessed: a bounded sample of query
vectors is searched exhaustively once, and the narrowest window that would have
found ``target`` of their true neighbours is used for all.  Vectors without
structure need wide windows, clustered ones narrow ones.

Equal vectors collapse to the ``k + 1`` rows of smallest id, which is all a
result can hold of them, and equal query vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from koine.llm.tables import table
from koine.llm.text import releasing, releasing_cogroup
from koine.sources.scratch import written

CURVES = 12
DIMS, BITS = 6, 10
SAMPLE_QUERIES = 96
TARGET = 0.96
SALTS = 64
#: Bins of an axis's distribution, and how many standard deviations they cover to either side.
BINS, SPAN = 4096, 8.0
#: Bytes of vectors, as doubles, in a range of ranks, and of keys in a partition.
RANGE_BYTES = 16 << 20
KEY_ROWS = 2_000_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells ``(n, dims)`` below
    ``2 ** bits`` (bit-plane transform of Skilling, 2004)."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    levels = [np.uint64(1 << b) for b in range(bits - 1, 0, -1)]
    for level in levels:
        low = level - one
        for i in range(len(x)):
            high = (x[i] & level) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in levels:
        flip ^= np.where((x[-1] & level) != 0, level - one, np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | ((axis >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """The projections, the distributions of their axes and the shifts."""

    def __init__(self, dim: int, curves: int, dims: int, bits: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dims, self.bits = min(dims, dim), bits
        self.maps = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.dims] for _ in range(curves)]
        self.shift = rng.uniform(0, 1, (curves, self.dims))
        self.axes = np.concatenate(self.maps, axis=1)
        self.mean = np.zeros(self.axes.shape[1])
        self.scale = np.ones(self.axes.shape[1])
        #: Share of rows below each bin of each axis.
        self.below = np.tile(np.linspace(0, 1, BINS + 1), (self.axes.shape[1], 1))

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Place of each row on each axis, in bins."""
        return np.clip(((x @ self.axes - self.mean) / self.scale + SPAN) * (BINS / (2 * SPAN)), 0, BINS * (1 - 1e-12))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One key per row and curve."""
        at = self.bins(x)
        low = at.astype(np.int64)
        share = np.take_along_axis(self.below.T, low, axis=0)
        share += (at - low) * (np.take_along_axis(self.below.T, low + 1, axis=0) - share)
        out = []
        for c, shift in enumerate(self.shift):
            u = (share[:, c * self.dims : (c + 1) * self.dims] + shift) / 2
            out.append(hilbert(np.minimum((u * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits))
        return np.stack(out, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), dim)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``q`` the positions in ``x`` of its ``k`` nearest by
    (distance, id), and the distances."""
    for i, one in enumerate(q):
        d = np.sqrt(((x - one) ** 2).sum(axis=1))
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        near = near[np.lexsort((ids[near], d[near]))][:k]
        yield i, near, d[near]


def usable(vec: Column, dim: int) -> Column:
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(vec) == dim) & fine & F.exists(vec, lambda v: v != 0)


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each usable row where ``is_query``
    holds its ``k`` nearest other rows found, by Euclidean distance in double
    precision, ties to the smaller id.

    Vectors that are null, all zero, hold null or non-finite components, or do
    not have the most common length take no part; rows with a null id neither.
    Rows that repeat id and vector are one candidate; rows that repeat an id with
    other vectors are one candidate each, and each as a query gets the
    same answers; none of them answers itself.  Fewer rows than ``k`` are all
    returned; an empty table gives an empty result; other columns are not read.
    ``report`` is told the number of rows and the window.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    lengths = base.groupBy(F.size(vec_col).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["d"]
    rows = base.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"),
        F.xxhash64(F.lit(1), vec_col).alias("k1"), F.xxhash64(F.lit(2), vec_col).alias("k2"),
    ).where(usable(F.col("vec"), dim))
    asked = rows.where("q").select("k1", "k2", "vec_id").distinct()
    salt = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(SALTS))
    first = rows.select("vec_id", "vec", "k1", "k2", salt.alias("s"))
    once = lambda by: F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))
    first = first.withColumn("r", once(["k1", "k2", "s", "vec_id"])).where("r = 1")
    first = first.withColumn("r", once(["k1", "k2", "s"])).where(F.col("r") <= k + 1)
    first = first.withColumn("r", once(["k1", "k2"])).where(F.col("r") <= k + 1)
    marked = first.join(asked.select("k1", "k2", F.lit(True).alias("q")).distinct(), ["k1", "k2"], "left")
    marked = marked.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "vec", (F.col("q").isNotNull() & (F.col("r") == 1)).alias("q"), "k1", "k2")
    points = written(marked, "vectors")
    n = points.count()
    if not n or not points.where("q").limit(1).count():
        return spark.createDataFrame([], schema)

    curve = Curves(dim, curves, DIMS, BITS)
    _fit_axes(points, curve, dim)
    ranks = _ranked(points, curve, dim, n)
    window = _fit_window(points, ranks, dim, k, target)
    if report is not None:
        report |= {"rows": n, "window": window}
    size = int(max(256, min(2 * window + 1, RANGE_BYTES // (8 * dim))))

    def compare(key, left, right):
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by("rank")
            x, ids, rank = _matrix(left["vec"].combine_chunks(), dim), np.asarray(left["vec_id"]), np.asarray(left["rank"])
            q, at = _matrix(right["target"].combine_chunks(), dim), np.asarray(right["at"])
            k1, k2 = np.asarray(right["k1"]), np.asarray(right["k2"])
            lows, highs = np.searchsorted(rank, at - window), np.searchsorted(rank, at + window, side="right")
            for i, (a, z) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
                for _, near, d in nearest(q[i : i + 1], x[a:z], ids[a:z], k + 1):
                    for o, v in zip(out, (np.full(len(near), k1[i]), np.full(len(near), k2[i]), ids[a:z][near], d), strict=True):
                        o.append(v)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.int64()), cat(out[3], pa.float64())], names=["k1", "k2", "vec_id", "score"])

    # a vector joins its few ranks, then goes once to each curve
    places = ranks.groupBy("uid").agg(F.collect_list(F.struct("curve", "rank")).alias("p"))
    dealt = points.join(places, "uid").select("vec_id", "vec", "q", "k1", "k2", F.explode("p").alias("p")).select("*", "p.curve", "p.rank").drop("p")
    candidates = dealt.select("curve", F.floor(F.col("rank") / size).alias("range"), "rank", "vec_id", "vec")
    near = F.sequence(F.floor((F.col("rank") - window) / size), F.floor((F.col("rank") + window) / size))
    windows = dealt.where("q").select(F.col("curve").alias("line"), F.explode(near).alias("reach"), F.col("rank").alias("at"), "k1", "k2", F.col("vec").alias("target"))
    found = candidates.groupBy("curve", "range").cogroup(windows.groupBy("line", "reach")).applyInArrow(releasing_cogroup(compare), "k1 long, k2 long, vec_id long, score double")
    merged = found.groupBy("k1", "k2", "vec_id").agg(F.min("score").alias("score"))
    best = merged.withColumn("r", F.row_number().over(W.partitionBy("k1", "k2").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    answers = asked.withColumnRenamed("vec_id", "query_id").join(best, ["k1", "k2"]).where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "k1", "k2").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fit_axes(points: DataFrame, curve: Curves, dim: int) -> None:
    """Mean and deviation of every axis over all rows, then its distribution."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b.column(0), dim) @ curve.axes
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(y.shape[1]), pa.int32()), pa.array(np.full(y.shape[1], len(y)), pa.int64()), pa.array(y.sum(axis=0)), pa.array((y**2).sum(axis=0))], ["p", "n", "s", "ss"]
            )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((curve.axes.shape[1], BINS), dtype=np.int64)
        for b in batches:
            at = curve.bins(_matrix(b.column(0), dim)).astype(np.int64)
            for p in range(len(total)):
                total[p] += np.bincount(at[:, p], minlength=BINS)
        p, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(at, pa.int32()), pa.array(total[p, at])], ["p", "bin", "n"])

    vec = points.select("vec")
    got = vec.mapInArrow(releasing(sums), "p int, n long, s double, ss double").groupBy("p").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("p").collect()
    curve.mean = np.array([r["s"] / r["n"] for r in got])
    curve.scale = np.sqrt(np.maximum(np.array([r["ss"] / r["n"] for r in got]) - curve.mean**2, 1e-12))
    table = np.zeros((len(got), BINS))
    for r in vec.mapInArrow(releasing(counts), "p int, bin int, n long").groupBy("p", "bin").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        table[r["p"], r["bin"]] = r["n"]
    curve.below = np.concatenate([np.zeros((len(table), 1)), np.cumsum(table, axis=1) / table.sum(axis=1, keepdims=True)], axis=1)


def _ranked(points: DataFrame, curve: Curves, dim: int, n: int) -> DataFrame:
    """``curve, rank, uid``: every row's place on every curve, from 0.

    Keys are range-partitioned and sorted; a row's rank is its place in its
    partition, after the rows of the partitions before (a count per partition,
    which has ``KEY_ROWS`` rows, is what the driver sees)."""
    curves = len(curve.maps)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = curve.keys(_matrix(b.column(1), dim))
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c), pa.int32()), pa.array(key[:, c]), b.column(0)], ["curve", "key", "uid"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), np.zeros(curves, dtype=np.int64)
        for b in batches:
            own = np.asarray(b.column(0))
            place = np.zeros(len(own), dtype=np.int64)
            for c in np.unique(own):
                mine = own == c
                place[mine] = at[c] + np.arange(mine.sum())
                at[c] += mine.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part), pa.int32()), b.column(0), pa.array(place), b.column(2)], ["part", "curve", "place", "uid"])

    parallel = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(parallel, curves * n // 4096 + 1), -(-curves * n // KEY_ROWS))
    keyed = written(points.select("uid", "vec").mapInArrow(releasing(keys), "curve int, key long, uid long"), "keys")
    ordered = keyed.repartitionByRange(parts, "curve", "key", "uid").sortWithinPartitions("curve", "key", "uid")
    placed = written(ordered.mapInArrow(releasing(number), "part int, curve int, place long, uid long"), "places")
    counts = sorted((r["curve"], r["part"], r["count"]) for r in placed.groupBy("part", "curve").count().collect())
    starts, before = [], {}
    for c, part, count in counts:
        starts.append((part, c, before.get(c, 0)))
        before[c] = before.get(c, 0) + count
    offsets = points.sparkSession.createDataFrame(starts, "part int, curve int, start long")
    return placed.join(F.broadcast(offsets), ["part", "curve"]).select("curve", (F.col("start") + F.col("place")).alias("rank"), "uid")


def _fit_window(points: DataFrame, ranks: DataFrame, dim: int, k: int, target: float) -> int:
    """Ranks to either side that find ``target`` of the true neighbours of a
    sample of queries, each searched over all rows."""
    sample = points.where("q").orderBy(F.xxhash64(F.lit(9), "k1", "k2"), "k1", "k2").limit(SAMPLE_QUERIES).select("uid", "vec").toArrow()
    q, uids = _matrix(sample["vec"].combine_chunks(), dim), np.asarray(sample["uid"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            x, ids, uid = _matrix(b.column(2), dim), np.asarray(b.column(1)), np.asarray(b.column(0))
            for i, near, _ in nearest(q, x, ids, k + 1):
                if i == len(held):
                    held.append((x[near], ids[near], uid[near]))
                else:
                    both = [np.concatenate([o, v[near]]) for o, v in zip(held[i], (x, ids, uid), strict=True)]
                    _, keep, _ = next(nearest(q[i : i + 1], both[0], both[1], k + 1))
                    held[i] = tuple(o[keep] for o in both)
        for i, (x, ids, uid) in enumerate(held):
            d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i), pa.int32()), pa.array(ids, pa.int64()), pa.array(uid, pa.int64()), pa.array(d)], ["i", "vec_id", "uid", "d"])

    best = points.select("uid", "vec_id", "vec").mapInArrow(releasing(exact), "i int, vec_id long, uid long, d double").withColumn("r", F.row_number().over(W.partitionBy("i").orderBy("d", "vec_id")))
    true = [(r["i"], r["uid"]) for r in best.where(F.col("r") <= k + 1).select("i", "uid").collect()]
    wanted = points.sparkSession.createDataFrame([(int(u),) for u in {*uids.tolist(), *(u for _, u in true)}], "uid long")
    at: dict[int, dict[int, int]] = {}
    for r in ranks.join(F.broadcast(wanted), "uid", "left_semi").collect():
        at.setdefault(r["uid"], {})[r["curve"]] = r["rank"]
    far = np.sort([min(abs(at[u][c] - rank) for c, rank in at[int(uids[i])].items()) for i, u in true if u != uids[i]])
    # rows of an equal vector, k + 1 at most, have neighbouring ranks
    return max(k + 1, int(far[min(len(far) - 1, int(np.ceil(target * len(far))))]) if len(far) else 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
