"""Rule actions: creating absent terms and collecting unions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from koine.errors import CollisionError
from koine.functions.ids import MapId, TermId, term_column
from koine.operators.closure import closure
from koine.operators.rebuild import Roots
from koine.plans.compile import CompiledRule, Ref
from koine.sources.scratch import shuffled
from koine.sources.store import MapStore

#: Rows of a map up to which it is simply joined, and candidates up to which they are broadcast to a larger one.
SMALL_MAP = 1_000_000
BROADCAST_ROWS = 200_000


def column(ref: Ref, roots: Mapping[int, int]) -> Column:
    if isinstance(ref, TermId):
        return F.lit(roots.get(ref.value, ref.value)).cast("long")
    return F.col(ref if isinstance(ref, str) else f"c_{ref}")


def apply_actions(rule: CompiledRule, found: DataFrame, stores: Mapping[int, MapStore], roots: Mapping[int, int]) -> tuple[list[tuple[MapId, DataFrame]], list[DataFrame]]:
    """Argument tuples to insert by map, and ``(a, b)`` edges to unite."""
    for k, c in enumerate(rule.creations):
        if not c.used:
            continue
        args = [column(a, roots) for a in c.args]
        store = stores[c.map.index]
        fresh_id = term_column(c.map.index, args)
        if store.rows(store.base, store.delta):
            there = store.snapshot().select(*[F.col(n).alias(f"_{n}") for n in store.args], F.col("out").alias("_out"))
            on = [a == F.col(f"_{n}") for a, n in zip(args, store.args, strict=True)]
            joined = found.join(there, on, "left") if on else found.crossJoin(there)
            found = joined.withColumn(f"c_{k}", F.coalesce("_out", fresh_id)).drop("_out", *[f"_{n}" for n in store.args])
        else:
            found = found.withColumn(f"c_{k}", fresh_id)
    made = []
    for c in rule.creations:
        names = stores[c.map.index].args
        tuples = [column(a, roots).alias(n) for a, n in zip(c.args, names, strict=True)]
        made.append((c.map, found.select(*(tuples or [F.lit(True).alias("_any")]))))
    unions = [found.select(column(a, roots).alias("a"), column(b, roots).alias("b")).where("a <> b") for a, b in rule.unions]
    return made, unions


#: Rows of a map from which on the ids of new ones are checked; before, two of its ids are equal with odds under one in eight million.
VERIFY_ROWS = 1 << 20


def verify(store: MapStore, paths: list[str], roots: Roots | None) -> None:
    """Raise if the id of a row of these parts is another's, or that of an earlier term."""
    new = store.read([(p, 0) for p in paths]).select("out")
    twice = new.groupBy("out").count().where("count > 1").select("out")
    earlier = store.read([p for p in store.base + store.delta + store.fresh if p[0] not in paths]).select("out")
    if roots and (uf := roots.frame()) is not None:
        earlier = earlier.unionByName(uf.select(F.col("term_id").alias("out")))
    if twice.unionByName(new.join(earlier, "out", "left_semi")).limit(1).count():
        raise CollisionError(f"two terms of map {store.map.name or store.map.index} have the same id")


def verify_late(store: MapStore, roots: Roots | None) -> None:
    """Check the ids of parts that were added without, before anything looks at them."""
    if paths := sorted(store.unverified & store.paths()):
        verify(store, paths, roots)
    store.unverified = set()


def insert(store: MapStore, rows: list[DataFrame], roots: Roots | None = None, late: bool = False) -> int:
    """Add the argument tuples that the map does not have; how many those were.
    With ``late``, ids are checked when they are first looked at."""
    if not store.args:
        if store.rows(store.base, store.delta, store.fresh) or not any(r.limit(1).count() for r in rows):
            return 0
        spark = store.folder.spark
        return store.add(spark.range(1).select(term_column(store.map.index, []).alias("out")))
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    return _add_absent(store, all_rows.distinct(), roots, late)[0]


def insert_farther(store: MapStore, pairs: DataFrame) -> tuple[int, tuple[str, int]]:
    """Add distinct pairs with ``far`` that the map does not have: how many, and
    the part that they are in with how many of them are ``far``."""
    n, path, far = _add_absent(store, pairs, None, True, F.count_if("far"))
    return n, (path, far)


def insert_closure(store: MapStore) -> int:
    """Add all that composing the map with itself can find; how many rows.  They
    may be many more than the map's, so neither are they compared with those nor
    are values written."""
    path, n = store.append_bare(closure(store.folder.spark, store.snapshot()))
    if n + store.rows(store.base, store.delta) >= VERIFY_ROWS:
        store.unverified.add(path)
    return n


def _add_absent(store: MapStore, absent: DataFrame, roots: Roots | None, late: bool, far: Column | None = None) -> tuple[int, str, int]:
    held = store.rows(store.base, store.delta, store.fresh)
    if held:
        there = store.everything().select(*store.args)
        if held > SMALL_MAP and store.rows(store.delta) <= held // 8:
            # after few new rows few candidates are likely, and few candidates go to the map's rows, not the map's rows through a shuffle to them
            path, seen = store.folder.write_counted(absent)
            absent = store.folder.spark.read.schema(absent.schema).parquet(path)
            if seen["n"] <= BROADCAST_ROWS:
                there = there.join(F.broadcast(absent), store.args, "left_semi")
            else:
                there = shuffled(there)
        elif held > SMALL_MAP:
            there = shuffled(there)
        absent = absent.join(there, store.args, "left_anti")
    made = absent.withColumn("out", term_column(store.map.index, [F.col(a) for a in store.args]))
    path, seen = store.append(made, None if late or held < VERIFY_ROWS else lambda path: verify(store, [path], roots), far)
    if late and held >= VERIFY_ROWS:
        store.unverified.add(path)
    return seen["n"], path, seen.get("far", 0)
