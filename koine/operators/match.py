"""Conjunctive queries as natural joins.

An atom is a scan with equality filters and a projection to variables; a query
is a chain of inner equi-joins on shared variables.  Evaluation is semi-naive
with disjoint variants: in the i-th, atom i reads new rows only, atoms before it
old rows and atoms after it all rows.

A rule that composes a map with itself goes by distances where it can, see
``farther``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from koine.functions.ids import TermId
from koine.operators.rebuild import BROADCAST_ROWS
from koine.plans.compile import Atom, CompiledRule, join_order
from koine.sources.scratch import shuffled
from koine.sources.store import MapStore


#: Rows of an atom from which on those are dropped that the end of a cycle cannot meet.
REDUCE_ROWS = 200_000


def scan(atom: Atom, rows: DataFrame, roots: Mapping[int, int]) -> DataFrame:
    """The atom's columns of the rows that fit its constants and repeated variables."""
    first: dict[str, str] = {}
    for i, a in enumerate(atom.args):
        if isinstance(a, TermId):
            rows = rows.where(F.col(f"a{i}") == F.lit(roots.get(a.value, a.value)))
        elif a in first:
            rows = rows.where(F.col(f"a{i}") == F.col(first[a]))
        else:
            first[a] = f"a{i}"
    if atom.out in first:
        rows = rows.where(F.col("out") == F.col(first[atom.out]))
    return rows.select(*[F.col(c).alias(v) for v, c in first.items()], *([] if atom.out in first else [F.col("out").alias(atom.out)]))


def closes(atoms: list[Atom], order: list[int]) -> list[int]:
    """The atoms that end a cycle: they share columns with several before, and not all with one of them."""
    out = []
    for n, k in enumerate(order):
        before = [set(atoms[j].columns) & set(atoms[k].columns) for j in order[:n]]
        shared = set().union(*before)
        if len(shared) > 1 and shared not in before:
            out.append(k)
    return out


def variant(rule: CompiledRule, i: int, stores: Mapping[int, MapStore], roots: Mapping[int, int]) -> DataFrame | None:
    """Matches whose first new atom is the i-th; None if some atom has no rows."""
    found: DataFrame | None = None
    order = join_order(rule.atoms, i)
    scans, large = {}, set()
    for k in order:
        atom = rule.atoms[k]
        s = stores[atom.map.index]
        regions = [s.delta] if k == i else [s.base] if k < i else [s.base, s.delta]
        if not s.rows(*regions):
            return None
        if s.rows(*regions) > REDUCE_ROWS:
            large.add(k)
        scans[k] = scan(atom, s.read(*regions), roots)
    closing = closes(rule.atoms, order)
    for k in order:
        one = scans[k]
        # rows that the end of a cycle cannot meet would be joined with all their neighbours first
        for end in closing if k in large and k not in closing else ():
            for c in set(one.columns) & set(scans[end].columns):
                one = one.join(scans[end].select(c).distinct(), c, "left_semi")
        if found is None:
            found = one
            continue
        shared = [c for c in found.columns if c in one.columns]
        found = found.join(one, shared) if shared else found.crossJoin(one)
    return found


def farther(store: MapStore, farthest: tuple[str, int]) -> DataFrame | None:
    """What ``p('x, 'y), p('y, 'z) -> p('x, 'z)`` adds to a map that holds all pairs
    up to a distance n, as pairs ``a0, a1`` with ``far``, whether all ways there
    are of length 2n.

    ``farthest`` is the part whose rows with ``far`` have a distance of exactly
    n.  Each pair of a distance from n + 1 to 2n is met at the node n steps
    before its end, so the others need not be joined with each other: a pair is
    made once for each such node, not once for each node on its ways.
    """
    path, n = farthest
    if not n:
        return None
    last = store.folder.spark.read.schema("a0 long, a1 long, far boolean").parquet(path)
    rest = [p for p in store.base + store.delta if p[0] != path]
    left = store.read(rest).select("a0", F.col("a1").alias("_y"), F.lit(False).alias("far")).unionByName(last.select("a0", F.col("a1").alias("_y"), "far"))
    right = last.where("far").select(F.col("a0").alias("_y"), "a1")
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else shuffled(right), "_y").groupBy("a0", "a1").agg(F.min("far").alias("far"))


def matches(rule: CompiledRule, stores: Mapping[int, MapStore], roots: Mapping[int, int]) -> DataFrame | None:
    """New matches, projected to what the actions read."""
    keep = [F.col(c) for c in rule.needed] or [F.lit(True).alias("_any")]
    found = [v.select(*keep) for i in range(len(rule.atoms)) if (v := variant(rule, i, stores, roots)) is not None]
    if not found:
        return None
    out = found[0]
    for v in found[1:]:
        out = out.unionByName(v)
    return out
