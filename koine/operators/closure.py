"""What composing a relation with itself adds in the end, at once.

``p('x, 'y), p('y, 'z) -> p('x, 'z)`` saturates with the closure of ``p``.  Where
the relation is small (``CLOSE_ROWS``), its graph goes to all tasks, though the
closure may be about the square of it: a task is given some of the nodes that
can be reached and finds with a bit for each of them which nodes they are reached
from.  What it makes leaves it in batches and is neither joined nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a map up to which it is closed at once.
CLOSE_ROWS = 200_000
#: Bytes of the bits that a task holds, and bits that it spreads to bytes at once.
BLOCK_BYTES = 1 << 25
SPREAD_BITS = 1 << 19
#: Tasks that there are of a large graph, and words of a node's bits that a task has at least.
BLOCKS = 96
LEAST_WORDS = 4


@dataclass
class Graph:
    """Nodes by position: what reaches itself both ways is one component, and a
    component stands after all that it reaches."""

    ids: np.ndarray
    #: The component of each position, and whether it has a cycle.
    component: np.ndarray
    cyclic: np.ndarray
    #: Edges between nodes by source: their targets, and where those of a source begin.
    targets: np.ndarray
    starts: np.ndarray
    #: Edges between different components, likewise.
    next: np.ndarray
    next_starts: np.ndarray
    #: Where the components of equal depth begin, and the end of the last.
    levels: np.ndarray
    #: Nodes that a task is given.
    width: int


def _components(n: int, targets: list[int], starts: list[int]) -> tuple[list[int], int]:
    """The strong component of each node, numbered so that edges go to equal or smaller numbers (Tarjan)."""
    seen, low, component = [0] * n, [0] * n, [-1] * n
    at, stack, count, time = starts[:-1], [], 0, 0
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not seen[v]:
                time += 1
                seen[v] = low[v] = time
                stack.append(v)
            end, least, inner = starts[v + 1], low[v], -1
            for k in range(at[v], end):
                w = targets[k]
                if not seen[w]:
                    inner, at[v] = w, k  # looked at again when it is done
                    break
                if component[w] < 0 and low[w] < least:
                    least = low[w]
            low[v] = least
            if inner >= 0:
                path.append(inner)
                continue
            path.pop()
            if least == seen[v]:
                while True:
                    w = stack.pop()
                    component[w] = count
                    if w == v:
                        break
                count += 1
    return component, count


def _rows(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values by key, and where those of each key begin."""
    pairs = np.unique(keys * n + values)
    return pairs % n, np.searchsorted(pairs, np.arange(n + 1) * n)


def graph(a: np.ndarray, b: np.ndarray) -> Graph:
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(ids)
    source, target = ends[: len(a)], ends[len(a) :]
    targets, starts = _rows(source, target, n)
    found, count = _components(n, targets.tolist(), starts.tolist())
    component = np.asarray(found)
    cyclic = np.bincount(component, minlength=count) > 1
    cyclic[component[source[source == target]]] = True
    # by the longest way to an end
    inside = component[source] == component[target]
    near, near_starts = (x.tolist() for x in _rows(component[source[~inside]], component[target[~inside]], count))
    depth = [0] * count
    for c in range(count):
        if near_starts[c] < near_starts[c + 1]:
            depth[c] = 1 + max(depth[d] for d in near[near_starts[c] : near_starts[c + 1]])
    order = np.argsort(np.asarray(depth), kind="stable")
    renamed = np.empty(count, np.int64)
    renamed[order] = np.arange(count)
    component = renamed[component]
    position = np.empty(n, np.int64)
    by_component = np.argsort(component, kind="stable")
    position[by_component] = np.arange(n)
    words = max(-(-n // (64 * BLOCKS)), LEAST_WORDS)
    return Graph(
        ids[by_component], component[by_component], cyclic[order], *_rows(position[source], position[target], n),
        *_rows(component[source[~inside]], component[target[~inside]], count),
        np.searchsorted(np.asarray(depth)[order], np.arange(max(depth) + 2)),
        64 * max(1, min(words, BLOCK_BYTES // (8 * (count + 1)))),
    )


def block(g: Graph, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of the closure that end at positions from ``lo`` to before ``hi``
    and are not edges themselves, in batches."""
    n, first = len(g.ids), int(g.component[lo])
    here = np.arange(hi - lo)
    # components before the first have no bits; they read the last row, which is empty
    bits = np.zeros((len(g.cyclic) - first + 1, -(-(hi - lo) // 64)), "<u8")
    np.bitwise_or.at(bits, (g.component[lo:hi] - first, here >> 6), np.left_shift(np.uint64(1), (here & 63).astype("<u8")))
    after, at, levels = np.maximum(g.next - first, -1), g.next_starts, g.levels.tolist()
    for s, e in zip(levels[1:], levels[2:], strict=False):
        if e <= first:
            continue
        s = max(s, first)
        k = at[s]
        bits[s - first : e - first] |= np.bitwise_or.reduceat(bits[after[k : at[e]]], at[s:e] - k, axis=0)
    own = ~g.cyclic[g.component]
    step = max(1, SPREAD_BITS // (hi - lo))
    for p in range(int(np.searchsorted(g.component, first)), n, step):
        q = min(n, p + step)
        some = bits[g.component[p:q] - first]
        rows = np.flatnonzero(some.any(axis=1))
        if not len(rows):
            continue
        spread = np.unpackbits(some[rows].view(np.uint8), axis=1, count=hi - lo, bitorder="little").view(bool)
        row = np.zeros(q - p, np.int64)
        row[rows] = np.arange(len(rows))
        mine = np.arange(max(p, lo), min(q, hi))
        mine = mine[own[mine]]
        spread[row[mine - p], mine - lo] = False
        ends = g.targets[g.starts[p] : g.starts[q]]
        begins = np.repeat(np.arange(q - p), np.diff(g.starts[p : q + 1]))
        within = (ends >= lo) & (ends < hi)
        spread[row[begins[within]], ends[within] - lo] = False
        yield np.repeat(g.ids[p:q][rows], np.count_nonzero(spread, axis=1)), np.broadcast_to(g.ids[lo:hi], spread.shape)[spread]


def _blocks(g: Graph) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo = k * g.width
                for a, b in block(g, lo, min(lo + g.width, len(g.ids))):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a0", "a1"])

    return run


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The pairs ``a0, a1`` that composing adds to ``edges``, which the driver holds; each once."""
    rows = edges.select("a0", "a1").toArrow()
    g = graph(rows.column("a0").to_numpy(), rows.column("a1").to_numpy())
    blocks = -(-len(g.ids) // g.width)
    return spark.range(0, blocks, 1, blocks).mapInArrow(_blocks(g), "a0 long, a1 long")
