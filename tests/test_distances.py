"""Composing a map with itself by distances: the same rows after every iteration, fewer matches."""

import random

import pytest

from koine import CollisionError, Database, Domain, parse_rule
from koine.operators import act, match
from koine.plans.compile import compile_rule
from koine.sources import store
from tests.naive import Naive, constant
from tests.test_engine import CLOSURE, db, graph  # noqa: F401
from tests.test_storage import short


def pairs(db, names):  # noqa: F811
    return {(r["a0"], r["a1"]) for r in db.raw(names["path"]).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_rows_after_every_iteration(spark, db, monkeypatch, seed):  # noqa: F811
    """Random graphs, with edges and unions that come in between."""
    if seed == 1:
        monkeypatch.setattr(store, "MAX_PARTS", 2)
    if seed == 2:
        monkeypatch.setattr(match, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(act, "SMALL_MAP", 0)
    rng = random.Random(seed)
    edges = [(k, (k + 1) % 23) for k in range(23)] + [(30 + k, 31 + k) for k in range(9)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(6)]
    names = graph(db, [])
    node, edge, path = names["node"], names["edge"], names["path"]
    rules = [parse_rule(r, names) for r in CLOSURE]
    plain, domain = Naive(), Domain(db, rules)
    late = {4: ([(33, 2)], []), 6: ([], [(31, 5)])}
    for k in range(9):
        more, equal = (edges, []) if k == 0 else late.get(k, ([], []))
        if more:
            db.load_facts(spark.createDataFrame(more, "a long, b long"), edge, ["a", "b"])
        for a, b in more:
            plain.insert(edge, (constant(node, a), constant(node, b)))
        for a, b in equal:
            db.unify(db.new_constant(node, a), db.new_constant(node, b))
            plain.unite(constant(node, a), constant(node, b))
            plain.rebuild()
        domain.run_rules(1)
        plain.step(rules)
        assert pairs(db, names) == {row[:2] for row in plain.of(path)}


def test_a_cycle_makes_few_matches(spark, db, monkeypatch):  # noqa: F811
    """On a cycle of n nodes there are n * n pairs; joining all that is new made n ** 3 / 2 matches."""
    n, made = 48, []
    from koine import domain

    def counted(module, name):
        own = getattr(module, name)

        def run(*a):
            found = own(*a)
            made.append(0 if found is None else found.count())
            return found

        monkeypatch.setattr(module, name, run)

    counted(domain, "farther")
    counted(domain, "matches")
    names = graph(db, [(k, (k + 1) % n) for k in range(n)])
    Domain(db, [parse_rule(r, names) for r in CLOSURE]).saturate()
    assert len(pairs(db, names)) == n * n
    assert sum(made) < 3 * n * n


def test_which_rules_compose(db):  # noqa: F811
    names = graph(db, [])
    yes = ["path('x, 'y), path('y, 'z) -> path('x, 'z)", "path('y, 'z), path('x, 'y) -> path('x, 'z)"]
    no = [
        "path('x, 'y), path('y, 'z) -> path('z, 'x)", "path('x, 'y), path('x, 'z) -> path('y, 'z)", "path('x, 'y), path('y, 'z) -> edge('x, 'z)", "path('x, 'y), path('y, 'x) -> path('x, 'x)",
        "edge('x, 'y), path('y, 'z) -> path('x, 'z)", "path('x, 'y), path('y, 'z) -> path('x, 'z), 'x == 'z",
    ]
    assert all(compile_rule(parse_rule(r, names)).composes == names["path"] for r in yes)
    assert not any(compile_rule(parse_rule(r, names)).composes for r in no)


def test_ids_are_checked_before_they_are_looked_at(spark, monkeypatch):
    monkeypatch.setattr(act, "VERIFY_ROWS", 30)
    short(monkeypatch, 9)
    d = Database(spark)
    names = graph(d, [])
    d.load_facts(spark.range(12).selectExpr("id as a", "id + 1 as b"), names["edge"], ["a", "b"])
    Domain(d, [parse_rule(r, names) for r in CLOSURE]).saturate()
    assert d.read(names["path"], ["src", "dst"]).count() == 78  # keys only
    for look in (lambda: d.raw(names["path"]), lambda: d.read(names["path"], ["src", "dst"], value="v")):
        with pytest.raises(CollisionError):
            look()
    d.close()
