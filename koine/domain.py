"""Rules over a database, and running them."""

from __future__ import annotations

import copy
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from koine.database import Database
from koine.functions.ids import TypeId
from koine.operators import closure
from koine.operators.act import apply_actions, insert, insert_closure, insert_farther, verify_late
from koine.operators.match import farther, matches
from koine.plans.ast import Rule, Union, Var, check_local, type_of, walk
from koine.plans.compile import CompiledRule, compile_rule


#: Tables written between two removals of those no longer needed.
SWEEP = 24


class Domain:
    """A database with rules.  All rows count as new to a new domain."""

    def __init__(self, database: Database, rules: Iterable[Rule | list[Rule]]):
        self.database = database
        flat = [r for x in rules for r in (x if isinstance(x, list) else [x])]
        for r in flat:
            check_local(r, database.id)
        self._rules: list[tuple[CompiledRule, list[TypeId | None]]] = [(compile_rule(r), _union_types(r)) for r in flat]
        self._unconditional_done = False
        self.iterations = 0
        #: Of maps that a rule composes with themselves, where all that rule can find up to a distance is
        #: there: the parts that hold it, and the one whose rows of exactly that distance are ``far``.
        self._levels: dict[int, tuple[set[str], tuple[str, int]]] = {}
        #: Of such maps that have been closed, the parts that then were; those that are to be closed once
        #: nothing else changes them, so that not all of their rows have been seen.
        self._closed: dict[int, set[str]] = {}
        self._owed: set[int] = set()
        for s in database._stores.values():
            s.restart()

    def run_rules(self, times: int) -> int:
        """Run all rules ``times`` times, each time on what was there before, and
        rebuild after each.  Ends early when nothing changes any more, which
        gives the same result; returns the iterations run."""
        return self._run(times, closing=False)

    def _run(self, times: int, closing: bool) -> int:
        done, first = 0, self.database.folder.written()
        swept = first
        while done < times and self._once(closing):
            done += 1
            # tables that this run has written and replaced again
            upto = self.database.folder.written()
            if upto - swept > SWEEP:
                self.database.folder.drop(first, upto, self.database.live())
                swept = upto
        return done

    def saturate(self, limit: int = 1000) -> int:
        """Run until nothing changes; raises if ``limit`` iterations do not suffice.
        A small map that a rule composes with itself is closed in one iteration."""
        done = self._run(limit, closing=True)
        if done == limit and self._once(closing=True):
            raise RuntimeError(f"not saturated after {limit} iterations")
        return done

    def _once(self, closing: bool = False) -> bool:
        db = self.database
        db.flush()
        if db._pending:
            db.rebuild()
        stores = db._stores
        for s in stores.values():
            s.begin()
        if self._unconditional_done and not self._owed and not any(s.delta for s in stores.values()):
            return False
        constants = {c.value for r, _ in self._rules for c in r.constants}
        roots = db.roots.lookup(sorted(constants))
        for index in {i for r, _ in self._rules for i in r.reads}:
            verify_late(stores[index], db.roots)
        inserts: dict[int, list] = {}
        composed: dict[int, DataFrame] = {}
        closed: set[int] = set()
        edges = []
        changed = False
        for rule, types in sorted(self._rules, key=lambda r: r[0].composes is not None):
            if not rule.creations and not rule.unions:
                continue
            if (m := rule.composes) and m.index not in composed:
                store = stores[m.index]
                paths, farthest = self._levels.pop(m.index, (None, None))
                if self._closed.get(m.index) == store.paths():
                    continue
                unseen = store.rows(store.delta) or m.index in self._owed
                if closing and unseen and store.rows(store.base, store.delta) <= closure.CLOSE_ROWS:
                    if edges or m.index in inserts:
                        self._owed.add(m.index)
                    else:
                        closed.add(m.index)
                    continue
                known = paths == store.paths()
                seen = stores
                if m.index in self._owed:
                    self._owed.discard(m.index)
                    seen = {**stores, m.index: copy.copy(store)}
                    seen[m.index].base, seen[m.index].delta = [], store.base + store.delta
                found = farther(store, farthest) if known else matches(rule, seen, roots)
                if found is not None:
                    composed[m.index] = found if known else apply_actions(rule, found, stores, roots)[0][0][1].distinct().withColumn("far", F.lit(True))
                continue
            if rule.atoms:
                found = matches(rule, stores, roots)
            else:
                found = None if self._unconditional_done else db.spark.range(1).selectExpr("true as _any")
            if found is None:
                continue
            if len(rule.creations) + len(rule.unions) > 1:
                found = found.distinct()
                found = db.spark.read.schema(found.schema).parquet(db.folder.write(found))
            made, unions = apply_actions(rule, found, stores, roots)
            for m, rows in made:
                inserts.setdefault(m.index, []).append(rows)
            # parts are never overwritten, so unions can be computed in the rebuild
            edges += [(u, t.index) for u, t in zip(unions, types, strict=True)]
        first = not self._unconditional_done
        self._unconditional_done = True
        others = {index: insert(stores[index], rows, db.roots, late=True) for index, rows in inserts.items()}
        changed |= any(others.values())
        levels = {}
        for index, pairs in composed.items():
            n, levels[index] = insert_farther(stores[index], pairs)
            changed |= n > 0
        for index in closed:
            changed |= insert_closure(stores[index]) > 0
        self._owed -= closed
        for s in stores.values():
            s.end()
        self._closed |= {index: stores[index].paths() for index in closed}
        # after any iteration that only composed, what is new is at twice the distance of what was there
        self._levels = {index: (stores[index].paths(), far) for index, far in levels.items() if not others.get(index)}
        if inserts or composed or closed:
            db._known = {}
        if edges:
            changed |= db.rebuild(edges) > 0
        self.iterations += 1
        return changed or first or bool(self._owed) or any(s.fresh for s in stores.values())


def _union_types(rule: Rule) -> list[TypeId]:
    types = {a: t for top in (*rule.patterns, *rule.actions) for n in walk(top) if hasattr(n, "map") for a, t in zip(n.args, n.map.signature.inputs, strict=True) if isinstance(a, Var)}
    out = []
    for a in rule.actions:
        if isinstance(a, Union):
            both = [types.get(s) if isinstance(s, Var) else type_of(s) for s in (a.left, a.right)]
            out.append(next(t for t in both if t is not None))
    return out
