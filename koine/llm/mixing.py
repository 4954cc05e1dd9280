"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks.  With target weight ``w`` (a
fraction of all output slots) block ``j`` (from 1) of a source is released at
slot ``floor((j - 1) / w)`` and due at ``ceil(j / w)``; earliest deadline first
then places every block before its deadline, so up to any slot a source is
less than one block away from its share.

Weights are taken exactly, as fractions of whole numbers, so the bound holds
however long the mixture is.  Slots repeat after the weights' common
denominator; tasks lay out segments of whole periods, none waiting for another
(a period longer than the mixture is one segment).  Ranks come from counts per
(source, hash bucket) plus ranks inside a bucket, so a source that holds a third
of all rows is spread over many tasks.

No document is left out.  A source that ends leaves its later slots idle; once
sources of half the weight have ended, the rest start a new phase with weights
in the same proportions.  The deviation bound holds up to the first end, and
for the sources that are left within each phase.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, inf, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from koine.llm.tables import table
from koine.llm.text import releasing
from koine.sources.scratch import written

#: Slots of a period of rounded weights.
RESOLUTION = 1000
BLOCK_ROWS = 16
#: Rows of a source that are ranked together, about, and bits of the buckets that are summed together.
BUCKET_ROWS = 1_000
SUM_BITS = 12
#: Parts of the whole that tempered weights are made of.
GRAIN = 1 << 20
#: Slots of a segment, about.
SEGMENT = 1 << 18
#: Blocks whose slots are handed over together.
STEP_ROWS = 1 << 16


def apportion(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole slots per period for each source, at least one, by largest remainder:
    rounded weights, for a short period only; mixtures use ``exact``."""
    if not weights:
        return {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    d = max(resolution, 2 * len(weights))
    total = float(sum(weights.values()))
    exact = {k: w / total * (d - len(weights)) for k, w in weights.items()}
    slots = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[: d - sum(slots.values())]:
        slots[k] += 1
    return slots


def exact(weights: list[float | Fraction]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights, floats as written in decimals."""
    parts = [w if isinstance(w, Fraction) else Fraction(repr(float(w))) for w in weights]
    d = lcm(*{p.denominator for p in parts})
    return [p.numerator * (d // p.denominator) for p in parts]


def earliest_deadline_first(parts: list[int], start: int = 0) -> Iterator[tuple[int, int, int]]:
    """Source, block (from 0) and slot of every block from slot ``start`` on, in
    slot order, without end.  Source ``i`` has the weight ``parts[i] / sum(parts)``;
    ``start`` is a multiple of the period, so that no source is ahead or behind."""
    d = sum(parts)
    done = [start * p // d for p in parts]
    waiting = [(start, i) for i in range(len(parts))]  # next blocks by release
    ready: list[tuple[int, int]] = []  # by deadline
    t = start
    while True:
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * d // parts[i]), i))
        due, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        yield i, done[i], t
        t += 1
        done[i] += 1
        heapq.heappush(waiting, (done[i] * d // parts[i], i))


def period(parts: list[int]) -> int:
    """Slots after which every source has exactly its share."""
    return sum(parts) // gcd(*parts)


def segments(parts: list[int], length: int) -> Iterator[tuple[int, int]]:
    """First slots and ends of whole periods, about ``SEGMENT`` slots each."""
    one = period(parts)
    size = one * max(1, SEGMENT // one)
    for start in range(0, length, size):
        yield start, min(length, start + size)


def placed_by(parts: list[int], t: int) -> list[int]:
    """How many blocks of each source lie before slot ``t``."""
    d, one = sum(parts), period(parts)
    whole = t - t % one
    out = [whole * p // d for p in parts]
    for i, _, _ in islice(earliest_deadline_first(parts), t - whole):
        out[i] += 1
    return out


def phases(parts: list[int], blocks: list[int]) -> Iterator[tuple[list[int], list[int], int, int]]:
    """Phase by phase: the sources that have blocks left, how many each has
    placed, the slots before the phase and its length.  A phase goes on until
    sources of half of the weight have ended."""
    done, before = [0] * len(parts), 0
    alive = [i for i, n in enumerate(blocks) if n > 0]
    while alive:
        d = rest = sum(parts[i] for i in alive)
        length = 0
        for i in sorted(alive, key=lambda i: Fraction(blocks[i] - done[i], parts[i])):
            rest -= parts[i]
            length = -(-(blocks[i] - done[i]) * d // parts[i])
            if 2 * rest <= d:
                break
        yield alive, [done[i] for i in alive], before, length
        if not rest:
            return
        for i, n in zip(alive, placed_by([parts[i] for i in alive], length), strict=True):
            done[i] = min(blocks[i], done[i] + n)
        alive = [i for i in alive if done[i] < blocks[i]]
        before += length


def placements(parts: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """Source, block (from 0) and slot of every block, in slot order.  Source
    ``i`` has the weight ``parts[i] / sum(parts)`` and ends after ``blocks[i]`` blocks."""
    for alive, placed, before, length in phases(parts, blocks):
        for k, j, t in islice(earliest_deadline_first([parts[i] for i in alive]), length):
            if placed[k] + j < blocks[alive[k]]:
                yield alive[k], placed[k] + j, before + t


def schedule(slots: dict[str, int]) -> dict[str, list[int]]:
    """Earliest deadline first over one period: the slot of each of a source's blocks."""
    names = sorted(slots)
    out: dict[str, list[int]] = {k: [] for k in slots}
    for i, _, t in placements([slots[k] for k in names], [slots[k] for k in names]):
        out[names[i]].append(t)
    return out


def tempered(counts: dict[str, int], temperature: float = 2.0) -> dict[str, Fraction]:
    """Target weights in proportion to ``count ** (1 / temperature)``, to the
    nearest of ``GRAIN`` parts of the whole but at least one."""
    found = {k: n ** (1.0 / temperature) for k, n in counts.items() if n}
    total = sum(found.values())
    return {k: Fraction(max(1, round(w / total * GRAIN)), GRAIN) for k, w in found.items()}


def _slots(counts: DataFrame, given: dict[str, float], block_rows: int) -> DataFrame:
    """``src, block, slot`` for all blocks of the sources in ``counts``: one task
    lists the segments, many lay them out."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["src"], r["count"]) for b in batches for r in b.to_pylist())
        names, blocks = [k for k, _ in found], [-(-n // block_rows) for _, n in found]
        target = tempered(dict(found))
        target = {k: given.get(k, w) for k, w in target.items()}
        parts = exact([target[k] for k in names]) if names else []
        for alive, placed, before, length in phases(parts, blocks):
            own = [parts[i] for i in alive]
            blob = zlib.compress(json.dumps([[names[i] for i in alive], own, placed, [blocks[i] for i in alive]]).encode())
            for start, end in segments(own, length):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (before, start, end)] + [pa.array([blob], pa.binary())], ["before", "start", "end", "sources"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            names, parts, placed, blocks = json.loads(zlib.decompress(row["sources"]))
            laid = islice(earliest_deadline_first(parts, row["start"]), row["end"] - row["start"])
            steps = ((names[k], placed[k] + j, row["before"] + t) for k, j, t in laid if placed[k] + j < blocks[k])
            while rows := list(islice(steps, STEP_ROWS)):
                src, block, slot = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(block, pa.int64()), pa.array(slot, pa.int64())], ["src", "block", "slot"])

    plan = written(counts.select("src", "count").repartition(1).mapInArrow(releasing(listed), "before long, start long, end long, sources binary"), "segments")
    many = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.repartition(many, "before", "start").mapInArrow(releasing(lay), "src string, block long, slot long")


def _placed(docs: DataFrame, weights: dict[str | None, float] | None, block_rows: int, id_col: str, source_col: str) -> DataFrame:
    """``row, block, slot, offset`` with each row of ``docs`` as one column."""
    source = F.col(source_col)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.lit(17), id_col).alias("h"),
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string"))).alias("src"),
    )
    counts = written(rows.groupBy("src").count(), "sources")
    given = {("-" if k is None else f"+{k}"): w for k, w in (weights or {}).items()}
    bad = [k for k, w in given.items() if not 0 < w < inf]
    if bad and counts.where(F.col("src").isin(bad)).limit(1).count():
        raise ValueError("weights must be positive")
    slots = written(_slots(counts, given, block_rows), "slots")
    # bucket bits: the length in bits of count div BUCKET_ROWS, at least one
    bits = F.greatest(F.lit(1), F.length(F.bin(F.floor(F.col("count") / BUCKET_ROWS)))).cast("int")
    rows = rows.join(counts.select("src", bits.alias("bits")), "src").withColumn("bucket", F.expr("shiftrightunsigned(h, 64 - bits)"))
    # a row per bucket; sums over buckets in two levels, so that no task has all of a source's
    sizes = rows.groupBy("src", "bucket").count().withColumn("part", F.expr(f"shiftrightunsigned(bucket, {SUM_BITS})"))
    sizes = written(sizes, "buckets")
    ahead = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("src", "part").agg(F.sum("count").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead("src", "part")), F.lit(0))).drop("n")
    starts = sizes.withColumn("own", F.coalesce(F.sum("count").over(ahead("src", "part", "bucket")), F.lit(0))).join(parts, ["src", "part"])
    starts = starts.select("src", "bucket", (F.col("base") + F.col("own")).alias("start"))
    inside = W.partitionBy("src", "bucket").orderBy("h", "id")
    ranked = rows.withColumn("in", F.row_number().over(inside) - 1).join(starts, ["src", "bucket"])
    rank = F.col("start") + F.col("in")
    ranked = ranked.withColumn("block", F.floor(rank / block_rows)).withColumn("offset", F.pmod(rank, F.lit(block_rows)).cast("int"))
    return ranked.join(slots, ["src", "block"]).select("row", "block", "slot", "offset")


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """``docs`` with ``block, slot, offset``: the block of its source, the
    block's slot in the mixture and the place in the block (as ``mix_block`` and
    so on where ``docs`` has a column of that name).

    ``weights`` gives each source's target; those missing in it, and all when it
    is None, get tempered weights of their row counts over the whole table.
    Within a source the order is by hash of the id, ties by id; rows that repeat
    an id follow one another.  A null source is a source of its own.  An empty
    table gives an empty result; no text is read.
    """
    out = _placed(docs, weights, block_rows, id_col, source_col)
    added = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("block", "slot", "offset")]
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *added)


def in_order(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """``docs`` with the same columns, whatever their names, its rows in the order
    of the mixture (files in slot order, rows of a file too).  Nulls, ties,
    repeated rows and empty tables are as in ``mixed``; long texts move whole."""
    placed = written(_placed(docs, weights, block_rows, id_col, source_col), "mixed")
    n = max(1, placed.rdd.getNumPartitions())
    return placed.repartitionByRange(n, "slot", "offset").sortWithinPartitions("slot", "offset").select("row.*")


def with_position(ordered: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The written and reread rows of ``in_order``, or some of their ``columns``,
    with ``position``, from 0 (``mix_position`` beside a column of that name):
    their place in the mixture by file number and row of the file, however Spark
    packs the files into tasks.  ``ordered`` must be a Parquet table as read."""
    columns = ordered.columns if columns is None else columns
    name = F.col("_metadata.file_name")
    part, chunk = (F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    # the row as one column, so that no name of its columns can clash
    rows = ordered.select(F.struct(*columns).alias("row"), part.alias("part"), chunk.alias("chunk"), F.col("_metadata.row_index").alias("at"))
    # a row per file
    ahead = W.orderBy("part", "chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("part", "chunk").count().withColumn("start", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    position = (F.col("start") + F.col("at")).alias("mix_position" if "position" in columns else "position")
    return rows.join(F.broadcast(starts), ["part", "chunk"]).select(*[F.col("row").getField(c).alias(c) for c in columns], position)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
