"""Restoring canonical rows and congruence after unions.

Edges become components; in every map with a column of an affected type moved
ids are replaced; rows that then share arguments keep the smallest value, and
their other values are edges of the next round.  Rounds end when none is left.
Of a large map only the parts are rewritten that hold a row with a moved id, or
one that such a row meets; the others stay as they are.

Few edges (at most ``DRIVER_EDGES`` in a round) are united on the driver, which
saves a round's jobs but two; more are united in Spark.  Where all maps together
have at most ``DRIVER_ROWS`` rows, all rounds happen there.  Moved ids are
broadcast only up to ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from koine.operators.components import components, on_driver
from koine.sources.scratch import shuffled
from koine.sources.store import Folder, MapStore

BROADCAST_ROWS = 200_000
DRIVER_EDGES = 20_000
#: Rows of all maps up to which they are rebuilt on the driver.
DRIVER_ROWS = 50_000
#: Rows of a map up to which it is rewritten without first looking whether it must be.
SMALL_MAP = 200_000

_MOVED = "term_id long, root long"


class Roots:
    """Moved ids and their roots; an id that is not here is its own root.

    A dictionary while there are few, a table once there are more than
    ``BROADCAST_ROWS``.
    """

    def __init__(self, folder: Folder):
        self.folder = folder
        self.few: dict[int, int] | None = {}
        self.path: str | None = None
        self.count = 0

    def __bool__(self) -> bool:
        return self.count > 0

    def frame(self) -> DataFrame | None:
        if not self.count:
            return None
        spark = self.folder.spark
        if self.few is not None:
            return spark.createDataFrame(list(self.few.items()), _MOVED)
        return spark.read.schema(_MOVED).parquet(self.path)

    def canonical(self, df: DataFrame, columns: list[str]) -> DataFrame:
        uf = self.frame()
        for c in columns if uf is not None else ():
            df = replaced(df, c, uf, self.count)
        return df

    def merge(self, moved: "Moved") -> None:
        """Add former roots that have moved."""
        if self.few is not None and moved.rows is not None and self.count + moved.count <= BROADCAST_ROWS:
            onward = dict(moved.rows)
            self.few = {k: onward.get(r, r) for k, r in self.few.items()} | onward
            self.count = len(self.few)
            return
        uf, new = self.frame(), moved.frame(self.folder)
        if uf is not None:
            onward = uf.join(new.select(F.col("term_id").alias("root"), F.col("root").alias("_to")), "root", "left")
            new = onward.select("term_id", F.coalesce("_to", "root").alias("root")).unionByName(new)
        self.path, seen = self.folder.write_counted(new.select("term_id", "root"))
        self.few, self.count = None, seen["n"]

    def lookup(self, ids: list[int]) -> dict[int, int]:
        """Roots of some ids that the driver knows."""
        if not self.count or not ids:
            return {}
        if self.few is not None:
            return {i: self.few[i] for i in ids if i in self.few}
        return {r["term_id"]: r["root"] for r in self.frame().where(F.col("term_id").isin(ids)).collect()}


class Moved:
    """Ids that have a new root in this round: rows on the driver or a table."""

    def __init__(self, rows: list[tuple[int, int]] | None, path: str | None, count: int):
        self.rows, self.path, self.count = rows, path, count

    def frame(self, folder: Folder) -> DataFrame:
        if self.rows is not None:
            return folder.spark.createDataFrame(self.rows, _MOVED)
        return folder.spark.read.schema(_MOVED).parquet(self.path)


def replaced(df: DataFrame, column: str, moved: DataFrame, count: int) -> DataFrame:
    m = moved.select(F.col("term_id").alias(column), F.col("root").alias("_root"))
    return df.join(F.broadcast(m) if count <= BROADCAST_ROWS else shuffled(m), column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def _parts(store: MapStore, columns: list[str], moved: DataFrame, count: int) -> set[str]:
    """The parts of a large map that must be rewritten: those with a moved id, and
    those with the arguments that a row of them has then."""
    names = store.paths()
    held = store.read(store.base, store.delta, store.fresh, file="_file")
    rows = held.withColumn("_was", F.struct(*columns))
    for c in columns:
        rows = replaced(rows, c, moved, count)
    rows = rows.where(F.col("_was") != F.struct(*columns)).select(*store.args, "_file")
    path, seen = store.folder.write_counted(rows)
    if not seen["n"]:
        return set()
    met = store.folder.spark.read.schema(rows.schema).parquet(path)
    files = met.select("_file")
    if store.args:
        mine = met.select(*store.args)
        files = files.unionByName(held.join(F.broadcast(mine) if seen["n"] <= BROADCAST_ROWS else shuffled(mine), store.args, "left_semi").select("_file"))
    found = [r["_file"] for r in files.distinct().collect()]
    # a file lies in its part's folder; schemes are written in several ways
    plain = {p: f"/{p.split(':', 1)[-1].lstrip('/')}/" for p in names}
    return {p for p, mark in plain.items() if any(mark in f"/{f.split(':', 1)[-1].lstrip('/')}" for f in found)}


def _linked(edges: list[DataFrame], roots: Roots) -> tuple[str, int]:
    """Distinct edges between representatives as a table, and how many."""
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    linked = roots.canonical(all_edges.select("a", "b"), ["a", "b"]).where("a <> b").distinct()
    # written once: what the edges come from may be a large join
    path, seen = roots.folder.write_counted(linked)
    return path, seen["n"]


def _unite(edges: list[DataFrame], roots: Roots) -> Moved:
    path, n = _linked(edges, roots)
    linked = roots.folder.spark.read.schema("a long, b long").parquet(path)
    if n <= DRIVER_EDGES:
        rows = [(x, r) for x, r in on_driver([(e["a"], e["b"]) for e in linked.collect()]) if x != r] if n else []
        return Moved(rows, None, len(rows))
    path, seen = roots.folder.write_counted(components(linked).where("node <> root").select(F.col("node").alias("term_id"), "root"))
    return Moved(None, path, seen["n"])


def rebuild(stores: list[MapStore], roots: Roots, edges: list[tuple[DataFrame, int]]) -> int:
    """Unite ``edges``, a list of ``(a, b)`` frames each with the index of its
    type, and everything that follows by congruence; the number of rounds in
    which an id moved."""
    if edges and sum(s.rows(s.base, s.delta, s.fresh) for s in stores) <= DRIVER_ROWS:
        path, n = _linked([e for e, _ in edges], roots)
        linked = roots.folder.spark.read.schema("a long, b long").parquet(path)
        if n <= DRIVER_EDGES:
            return _rebuild_here(stores, roots, [(e["a"], e["b"]) for e in linked.collect()] if n else [])
        edges = [(linked, t) for t in {t for _, t in edges}]
    rounds = 0
    while edges:
        moved = _unite([e for e, _ in edges], roots)
        types = {t for _, t in edges}
        edges = []
        if not moved.count:
            break
        rounds += 1
        roots.merge(moved)
        frame = moved.frame(roots.folder)
        for store in stores:
            signature = store.map.signature
            columns = [c for c, t in zip([*store.args, "out"], [*signature.inputs, signature.output], strict=True) if t.index in types]
            rows = store.rows(store.base, store.delta, store.fresh)
            if not columns or not rows:
                continue
            parts = store.paths() if rows <= SMALL_MAP else _parts(store, columns, frame, moved.count)
            if parts:
                conflict = _rewrite(store, parts, columns, frame, moved.count)
                if conflict is not None:
                    edges.append((conflict, signature.output.index))
    return rounds


def _rebuild_here(stores: list[MapStore], roots: Roots, edges: list[tuple[int, int]]) -> int:
    """All rounds on the driver: congruence closure over the rows of all maps."""
    edges = [(a, b) for a, b in edges if a != b]
    if not edges:
        return 0
    tables: list[dict[tuple[int, ...], tuple[int, bool]]] = []
    users: dict[int, set[tuple[int, tuple[int, ...]]]] = {}

    def put(k: int, args: tuple[int, ...], out: int, changed: bool) -> None:
        tables[k][args] = out, changed
        for x in (*args, out):
            users.setdefault(x, set()).add((k, args))

    for k, s in enumerate(stores):
        tables.append({})
        for fresh, regions in ((False, (s.base, s.delta)), (True, (s.fresh,))):
            if s.rows(*regions):
                rows = s.read(*regions).toArrow().to_pydict()
                for *args, out in zip(*(rows[c] for c in [*s.args, "out"]), strict=True):
                    put(k, tuple(args), out, fresh)
    up: dict[int, int] = {}
    touched: set[int] = set()
    depth = 0
    while edges:
        depth += 1
        later: list[tuple[int, int]] = []
        moved = set()
        for a, b in edges:
            a, b = _top(up, a), _top(up, b)
            if a != b:
                up[max(a, b)] = min(a, b)
                moved.add(max(a, b))
        for x in moved:
            for k, args in users.pop(x, ()):
                if args not in tables[k]:
                    continue
                out, changed = tables[k].pop(args)
                touched.add(k)
                new, out = tuple(_top(up, y) for y in args), _top(up, out)
                there = tables[k].get(new)
                if there is not None and there[0] != out:
                    later.append((there[0], out))
                put(k, new, out if there is None else min(out, there[0]), True)
        edges = later
        if not moved:
            depth -= 1
    if not up:
        return 0
    for k in touched:
        s = stores[k]
        columns = [[a[i] for a in tables[k]] for i in range(len(s.args))] + [[out for out, _ in tables[k].values()]]
        names = [*s.args, "out", "changed"]
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([c for _, c in tables[k].values()], pa.bool_())]
        new = sum(c for _, c in tables[k].values())
        path = s.folder.write(s.folder.spark.createDataFrame(pa.table(arrays, names=names)).coalesce(1), "changed")
        s.replace(path, len(tables[k]) - new, new)
    roots.merge(Moved([(x, _top(up, x)) for x in list(up)], None, len(up)))
    return depth


def _top(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = y
    return x


def _rewrite(store: MapStore, parts: set[str], columns: list[str], moved: DataFrame, count: int) -> DataFrame | None:
    """Replace moved ids in the rows of some parts of a map; edges between values that met, if any."""
    folder = store.folder
    mine = lambda region: [p for p in region if p[0] in parts]
    fresh = mine(store.fresh)
    old = store.read(mine(store.base), mine(store.delta)).withColumn("_new", F.lit(False))
    rows = old.unionByName(store.read(fresh).withColumn("_new", F.lit(True))) if fresh else old
    rows = rows.withColumn("_was", F.struct(*columns))
    for c in columns:
        rows = replaced(rows, c, moved, count)
    rows = rows.withColumn("changed", F.col("_new") | (F.col("_was") != F.struct(*columns))).select(*store.args, "out", "changed")
    met = rows.groupBy(*store.args).agg(F.min("out").alias("out"), F.max("out").alias("_most"), F.max("changed").alias("changed"))
    if not store.args:
        met = met.where("out is not null")
    met = met.select(*store.args, "out", (F.col("_most") != F.col("out")).alias("_met"), "changed")
    path, seen = folder.write_counted(met, "changed", new=F.count_if(F.col("changed")), met=F.count_if(F.col("_met")))
    store.replace(path, seen["n"] - seen["new"], seen["new"], parts)
    if not seen["met"]:
        return None
    done = folder.spark.read.schema(f"{''.join(f'{a} long, ' for a in store.args)}out long, _met boolean, changed boolean").parquet(path)
    # parts are never overwritten, so these edges can be computed when they are needed
    kept = done.where("_met").select(*store.args, F.col("out").alias("_kept"))
    lost = (rows.join(kept, store.args) if store.args else rows.crossJoin(kept)).where("out <> _kept")
    return lost.select(F.col("out").alias("a"), F.col("_kept").alias("b"))
