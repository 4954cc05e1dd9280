"""Corpora packed into chunks of compressed rows, for operators that pass over
whole texts several times and exchange fingerprints in between.

A pack is a row ``(chunk int, pack binary)``: some rows of the input as one
compressed Arrow stream.  Packing happens where the rows are read, so a shuffle
by ``chunk`` moves compressed text only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from koine.llm.text import pack_rows, releasing, strings, unpack_rows

#: Raw text in a chunk, fingerprints in a group, and what a task holds before it packs.
CHUNK_BYTES = 4 << 20
GROUP_ROWS = 1 << 20
PENDING_BYTES = 16 << 20
#: Bytes of text per fingerprint, about, and the fewest fingerprints that a chunk should send to a group.
WORD_BYTES = 6
LEAST_SENT = 32
#: Quantiles found at once.
MAX_BOUNDS = 1024


class Ranges:
    """Chunks as ranges of an integer id: a smaller range has smaller ids only.

    ``bounds`` are quantiles of the ids by bytes of text.  An id that fills
    several quantiles by itself gets a range of its own, whose rows are spread
    over as many chunks (``spread``).
    """

    def __init__(self, low: int, high: int, bounds: list[int]):
        own = Counter(b for b in bounds if low <= b <= high)
        edges = {low: 1} | {b: 1 for b in own if b > low}
        for b, n in own.items():
            if n > 1:
                edges[b] = n
                if b < high:
                    edges.setdefault(b + 1, 1)
        self.edges = np.array(sorted(edges), dtype=np.int64)
        copies = np.array([edges[e] for e in sorted(edges)], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(copies)])

    @property
    def chunks(self) -> int:
        return int(self.first[-1])

    def of(self, ids: np.ndarray, spread: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """The chunk of each row; ``spread`` gives numbers for some rows by which
        those of one id are dealt to its chunks."""
        r = np.clip(np.searchsorted(self.edges, ids, side="right") - 1, 0, len(self.edges) - 1)
        chunk = self.first[r].copy()
        many = np.flatnonzero(self.first[r + 1] - chunk > 1)
        if len(many) and spread:
            chunk[many] += spread(many) % (self.first[r + 1] - self.first[r])[many]
        return chunk

    def range_of(self, chunk: np.ndarray) -> np.ndarray:
        """The range that a chunk belongs to."""
        return np.searchsorted(self.first, chunk, side="right") - 1


def text_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows, and bytes of text."""
    got = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return got["n"], got["b"]


def layout(size: int, parallel: int) -> tuple[int, int]:
    """Numbers of chunks and groups for ``size`` bytes of text.

    Both have a fixed size up to about 130 GB.  Beyond, both sizes grow as the
    square root of the text, so that a chunk still sends each group ``LEAST_SENT``
    fingerprints and the exchange consists of data, not of row headers: at 100 TB
    a chunk has some 110 MB of text and a group 30 million fingerprints, 2 to
    3 GB of memory for a task.  Small inputs are spread over ``parallel`` tasks.
    """
    factor = max(1.0, (LEAST_SENT * size / (CHUNK_BYTES * GROUP_ROWS)) ** 0.5)
    least = min(parallel, size >> 16)
    chunks = max(1, int(-(-size // (CHUNK_BYTES * factor))), least)
    groups = max(1, int(-(-size // (WORD_BYTES * GROUP_ROWS * factor))), 2 * least)
    return chunks, groups


def id_ranges(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> Ranges | None:
    """About ``chunks`` ranges of about as many bytes of text; None without ids.

    Bounds are quantiles over all rows, a row counting once and once more for
    each average text that its own has the bytes of.  More than ``MAX_BOUNDS``
    are found in two levels: quantiles of each coarse range, by as many tasks.
    The list has 8 bytes per chunk (``layout``: some 7 MB at 100 TB).
    """
    rows, size = text_size(docs, text_col)
    weight = F.lit(1) + F.floor(F.coalesce(F.octet_length(text_col), F.lit(0)) / F.lit(max(size, 1) / max(rows, 1))).cast("int")
    ids = docs.select(F.explode(F.array_repeat(F.col(id_col), weight)).alias("id"))
    cuts = lambda n: F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), F.lit(10_000))
    k = min(chunks, MAX_BOUNDS)
    got = ids.agg(F.min("id").alias("low"), F.max("id").alias("high"), cuts(k).alias("q")).first()
    if got["low"] is None:
        return None
    bounds = list(got["q"]) if k > 1 else []
    if chunks > k:
        coarse = Ranges(got["low"], got["high"], bounds)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.asarray(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(coarse.of(own), pa.int64()), b.column(0)], ["part", "id"])

        each = ids.mapInArrow(releasing(number), "part long, id long").groupBy("part").agg(cuts(-(-chunks // k)).alias("q"))
        bounds += [x for r in each.collect() for x in r["q"]]
    return Ranges(got["low"], got["high"], sorted(bounds))


class Packer:
    """Collects numbered rows of a task and packs them by chunk."""

    def __init__(self):
        self.pending: list[tuple[np.ndarray, pa.RecordBatch]] = []
        self.held = 0

    def add(self, number: np.ndarray, rows: pa.RecordBatch) -> list[tuple[int, bytes]]:
        """Packs that are full with these rows."""
        if len(number):
            self.pending.append((number, rows))
            self.held += rows.nbytes
        return self.flush() if self.held > PENDING_BYTES else []

    def flush(self) -> list[tuple[int, bytes]]:
        if not self.pending:
            return []
        rows = pa.Table.from_batches([b for _, b in self.pending]).combine_chunks()
        number = np.concatenate([n for n, _ in self.pending])
        self.pending, self.held = [], 0
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order], prepend=-1, append=-1))
        return [(int(number[order[a]]), pack_rows(rows.take(pa.array(order[a:z])).combine_chunks().to_batches()[0])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def packed(docs: DataFrame, chunk_of: Callable[[pa.RecordBatch], tuple[np.ndarray, pa.RecordBatch]]) -> DataFrame:
    """``(chunk, pack)`` rows of ``docs``; ``chunk_of`` gives each batch's chunk
    numbers and the rows to pack (which may be fewer than it was given)."""

    def out(packs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for number, blob in packs:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch in batches:
            yield from out(packer.add(*chunk_of(batch)))
        yield from out(packer.flush())

    return docs.mapInArrow(releasing(run), "chunk int, pack binary")


def unpacked(packs: pa.ChunkedArray | pa.Array) -> pa.Table:
    return pa.concat_tables([unpack_rows(b.as_buffer()) for b in packs]).combine_chunks()


def text_of(rows: pa.Table, name: str = "text") -> pa.Array:
    return strings(rows[name])
