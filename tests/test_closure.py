"""Closing a map that a rule composes with itself in one iteration."""

import random

import numpy as np
import pytest

from koine import Domain, parse_rule
from koine import domain as domains
from koine.operators import closure, match
from koine.queries import QUERIES
from koine.sources import store
from tests.naive import Naive, constant
from tests.test_distances import pairs
from tests.test_engine import CLOSURE, db, graph  # noqa: F401


def closed(edges):
    after, out = {}, set()
    for a, b in edges:
        after.setdefault(a, []).append(b)
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def random_edges(rng):
    n = rng.choice([1, 2, 5, 30, 150])
    edges = {(rng.randrange(n) * 7, rng.randrange(n) * 7) for _ in range(rng.choice([1, n, 2 * n]))}
    if rng.random() < 0.4:  # no cycles but loops
        edges = {tuple(sorted(e)) for e in edges}
    return sorted(edges | ({(7 * k, 7 * k + 7) for k in range(n)} if rng.random() < 0.3 else set()))


@pytest.mark.parametrize("seed", range(60))
def test_what_a_graph_lacks(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(closure, "LEAST_WORDS", rng.choice([1, 4]))
    monkeypatch.setattr(closure, "BLOCK_BYTES", rng.choice([0, 1 << 25]))
    monkeypatch.setattr(closure, "SPREAD_BITS", rng.choice([1, 200, 1 << 19]))
    edges = random_edges(rng)
    g = closure.graph(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))
    got = [p for lo in range(0, len(g.ids), g.width) for a, b in closure.block(g, lo, min(lo + g.width, len(g.ids))) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == closed(edges) - set(edges)


@pytest.mark.parametrize("bound", [200_000, 16, 0])
def test_facts_and_unions_that_come_later(spark, db, monkeypatch, bound):  # noqa: F811
    """Closed, by distances, or one after the other: the same rows in the end."""
    monkeypatch.setattr(closure, "CLOSE_ROWS", bound)
    monkeypatch.setattr(closure, "LEAST_WORDS", 1)
    if bound:
        monkeypatch.setattr(store, "MAX_PARTS", 2)
    rng = random.Random(bound)
    names = graph(db, [])
    node, edge, path = names["node"], names["edge"], names["path"]
    names["same"] = db.map("same", [node, node], names["unit"])
    rules = [parse_rule(r, names) for r in [*CLOSURE, "same('x, 'y) -> 'x == 'y"]]
    plain, domain = Naive(), Domain(db, rules)
    for _ in range(3):
        for m, n in ((edge, 14), (path, 3), (names["same"], 1)):
            more = sorted({(rng.randrange(22), rng.randrange(22)) for _ in range(n)})
            db.load_facts(spark.createDataFrame(more, "a long, b long"), m, ["a", "b"])
            for a, b in more:
                plain.insert(m, (constant(node, a), constant(node, b)))
        domain.saturate()
        while plain.step(rules):
            pass
        assert pairs(db, names) == {row[:2] for row in plain.of(path)}
        assert db.count(path) == len(pairs(db, names))


def test_a_long_chain_takes_few_iterations(spark, db, monkeypatch):  # noqa: F811
    """It took one for every doubling of the distance, each a join of all pairs and their comparison with all pairs."""
    monkeypatch.setattr(domains, "farther", lambda *a: pytest.fail("composed by distances"))
    names = graph(db, [(k, k + 1) for k in range(300)])
    domain = Domain(db, [parse_rule(r, names) for r in CLOSURE])
    assert domain.saturate() <= 4
    assert db.count(names["path"]) == 300 * 301 // 2
    assert pairs(db, names) == {(a, b) for a in range(301) for b in range(a + 1, 301)}
    # values are those that terms have, though they are not stored
    term = names["path"](db.new_constant(names["node"], 3), db.new_constant(names["node"], 270))
    made = db.raw(names["path"]).where("a0 = 3 and a1 = 270").first()["out"]
    assert db.term_id(term).value == made == db.new_term(term).value
    # what comes then meets what is there
    db.load_facts(spark.createDataFrame([(301, 0)], "a long, b long"), names["edge"], ["a", "b"])
    domain.saturate()
    assert db.count(names["path"]) == 302 * 301 // 2


def test_iterations_are_still_those_of_the_rules(db, monkeypatch):  # noqa: F811
    """A number of iterations is not cut short, nor what a closed map needs made again."""
    names = graph(db, [(k, k + 1) for k in range(40)])
    domain = Domain(db, [parse_rule(r, names) for r in CLOSURE])
    domain.run_rules(3)
    assert pairs(db, names) == {(a, b) for a in range(41) for b in range(a + 1, min(a + 5, 41))}
    domain.saturate()
    assert db.count(names["path"]) == 41 * 40 // 2
    monkeypatch.setattr(match, "variant", lambda *a: pytest.fail("matched again"))
    assert domain.run_rules(5) == 0


def test_quotient_graph_of_many_customers(spark, tmp_path, monkeypatch):
    """Half the square of the nodes in rows, with nothing joined by distances."""
    monkeypatch.setattr(domains, "farther", lambda *a: pytest.fail("composed by distances"))
    n = 1200
    spark.range(n).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    one = lambda k: k - 1 if k % 4 == 1 and k - 1 < n else k
    got = QUERIES["unify_then_rules"](spark, str(tmp_path)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == closed({(one(k), one(k + 3)) for k in range(n)})
