"""Behaviour of the engine on small worlds."""

import random

import pytest

from koine import (
    ArityError, Database, Domain, ForeignIdError, GrammarError, MapSignature, Rule, TypeMismatchError, UnboundVariableError, Union, Var, parse_equivalence,
    parse_rewrite, parse_rule, parse_signature, parse_term,
)
from koine.functions import ids
from koine.plans.compile import compile_rule
from tests.naive import Naive

CLOSURE = ["edge('x, 'y) -> path('x, 'y)", "path('x, 'y), path('y, 'z) -> path('x, 'z)"]


@pytest.fixture
def db(spark):
    d = Database(spark)
    yield d
    d.close()


def graph(db, edges):
    node, unit = db.new_type("node", integer=True), db.new_type("unit")
    names = {"edge": db.map("edge", [node, node], unit), "path": db.map("path", [node, node], unit), "node": node, "unit": unit}
    for a, b in edges:
        db.new_term(names["edge"](db.new_constant(node, a), db.new_constant(node, b)))
    return names


def paths(db, names):
    return {(r["src"], r["dst"]) for r in db.read(names["path"], ["src", "dst"]).collect()}


def rows(db, m):
    return {tuple(r) for r in db.raw(m).collect()}


def closed(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


def test_hashes_agree_with_the_plan(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(5, 7, "k é"), (-1, 1 << 60, "")], "a long, b long, s string")
    got = df.select(ids.term_column(3, [F.col("a"), F.col("b")]).alias("t"), ids.named_column(2, F.col("s")).alias("n"), "a", "b", "s").collect()
    assert all(r["t"] == ids.term_hash(3, (r["a"], r["b"])) and r["n"] == ids.named_id(2, r["s"]) for r in got)
    assert ids.integer_id(4, 9) < ids.named_id(0, "x") < ids.term_hash(0, ())


def test_constants_terms_and_lookup(db):
    t = db.new_type("relation")
    join = db.map("natural_join", [t, t], t)
    a, b, c = (db.new_constant(t) for _ in range(3))
    assert len({a, b, c}) == 3
    made = db.new_term(join(a, join(b, c)))
    assert db.new_term(join(a, join(b, c))) == made
    assert db.term_id(join(a, join(b, c))) == made
    assert db.term_id(join(c, a)) is None
    assert db.type_id(made) == t
    assert db.canonicalize(a) == a
    assert db.new_constant(t, "k") == db.new_constant(t, "k")
    db.flush()
    db._known = {}
    assert db.term_id(join(a, join(b, c))) == made and db.term_id(join(b, c)) is not None


def test_ill_typed_terms_insert_nothing(db):
    number, truth = db.new_type("int"), db.new_type("truth")
    add, wrap = db.map("add", [number, number], number), db.map("wrap", [number], number)
    a, b = db.new_constant(number), db.new_constant(truth)
    with pytest.raises(TypeMismatchError):
        db.new_term(add(a, b))
    with pytest.raises(ArityError):
        add(a)
    with pytest.raises(TypeMismatchError):
        db.unify(a, b)
    with pytest.raises(TypeMismatchError):
        db.new_term(add(wrap(a), b))
    assert db.term_id(wrap(a)) is None


def test_foreign_ids_are_refused(spark, db):
    other = Database(spark)
    t, u = db.new_type(), other.new_type()
    with pytest.raises(ForeignIdError):
        db.new_map(MapSignature([u], t))
    m, n = db.map("m", [t], t), other.map("n", [u], u)
    with pytest.raises(ForeignIdError):
        db.canonicalize(other.new_constant(u))
    with pytest.raises(ForeignIdError):
        db.new_term(n(other.new_constant(u)))
    with pytest.raises(ForeignIdError):
        Domain(db, [Rule([n(Var("x"))], [])])
    assert m.db != n.db


def test_unify_is_seen_at_once_and_rows_after_rebuild(db):
    color, unit = db.new_type("color"), db.new_type("unit")
    pair = db.map("pair", [color, color], unit)
    gray, white = db.new_constant(color), db.new_constant(color)
    p, q = db.new_term(pair(gray, white)), db.new_term(pair(white, gray))
    assert not db.equal(gray, white) and not db.equal(p, q)
    db.unify(gray, white)
    assert db.equal(gray, white) and not db.equal(p, q)
    db.rebuild()
    assert db.equal(p, q) and len(rows(db, pair)) == 1


def test_unification_of_a_random_graph(db):
    node = db.new_type("node")
    nodes = [db.new_constant(node) for _ in range(100)]
    rng = random.Random(1)
    for i in range(1, 100):
        db.unify(nodes[i], nodes[rng.randrange(i)])
    lone = db.new_constant(node)
    db.rebuild()
    assert all(db.equal(nodes[i], nodes[i + 3]) for i in range(0, 97, 8)) and not db.equal(lone, nodes[0])


def test_closure_of_two_chains_stays_apart(db):
    chains = [(a, a + 1) for a in range(0, 6)] + [(a, a + 1) for a in range(10, 16)]
    names = graph(db, chains)
    domain = Domain(db, [parse_rule(r, names) for r in CLOSURE])
    domain.run_rules(4)
    found = paths(db, names)
    assert found == {(a, b) for a, b in closed(chains) if b - a <= 8}
    domain.saturate()
    assert paths(db, names) == closed(chains)


def test_iterations_bound_the_walks(db):
    names = graph(db, [(a, a + 1) for a in range(20)])
    domain = Domain(db, [parse_rule(r, names) for r in CLOSURE])
    for k, longest in ((1, 1), (1, 2), (1, 4), (1, 8)):
        domain.run_rules(k)
        assert max(b - a for a, b in paths(db, names)) == longest
    assert domain.run_rules(0) == 0


def test_facts_between_runs(db):
    names = graph(db, [(0, 1), (1, 2)])
    domain = Domain(db, [parse_rule(r, names) for r in CLOSURE])
    domain.saturate()
    db.new_term(names["edge"](db.new_constant(names["node"], 2), db.new_constant(names["node"], 3)))
    domain.saturate()
    assert paths(db, names) == closed([(0, 1), (1, 2), (2, 3)])


def test_constant_before_a_join(db):
    n, unit = db.new_type("n", integer=True), db.new_type("unit")
    names = {"f": db.map("f", [n, n], unit), "g": db.map("g", [n, n, n], unit), "h": db.map("h", [n, n], unit), "k": db.new_constant(n, 9)}
    c = lambda i: db.new_constant(n, i)
    db.new_term(names["f"](c(1), c(2)))
    for z, last in ((3, 8), (4, 9), (5, 7), (6, 9)):
        db.new_term(names["g"](c(1), c(z), c(last)))
    Domain(db, [parse_rule("f('x, 'y), g('x, 'z, k) -> h('x, 'z)", names)]).saturate()
    assert {(r["a0"], r["a1"]) for r in db.read(names["h"]).collect()} == {(1, 4), (1, 6)}


def test_star_with_a_late_atom(db):
    n, unit = db.new_type("n", integer=True), db.new_type("unit")
    names = {x: db.map(x, [n, n], unit) for x in ("a", "b", "c", "out")}
    rng = random.Random(3)
    facts = {x: {(rng.randrange(4), rng.randrange(4)) for _ in range(6)} for x in "abc"}
    for x, own in facts.items():
        for p, q in own:
            db.new_term(names[x](db.new_constant(n, p), db.new_constant(n, q)))
    Domain(db, [parse_rule("a('x, 'y), b('y, 'z), c('x, 'w) -> out('z, 'w)", names)]).saturate()
    expected = {(z, w) for x, y in facts["a"] for y2, z in facts["b"] for x2, w in facts["c"] if y == y2 and x == x2}
    assert {(r["a0"], r["a1"]) for r in db.read(names["out"]).collect()} == expected


def test_double_negation_leaves_two_canonical_rows(db):
    b = db.new_type("boolean")
    no = db.map("not", [b], b)
    x = db.new_constant(b)
    one, three = db.new_term(no(x)), db.new_term(no(no(no(x))))
    Domain(db, [parse_rewrite("not(not('x)) -> 'x", {"not": no})]).run_rules(5)
    assert db.equal(one, three) and not db.equal(one, x)
    one, x = db.canonicalize(one), db.canonicalize(x)
    assert rows(db, no) == {(x.value, one.value), (one.value, x.value)}


def test_values_follow_unions(db):
    t, unit = db.new_type("t"), db.new_type("unit")
    names = {"f": db.map("f", [t], t), "g": db.map("g", [t], t), "hit": db.map("hit", [t], unit)}
    a, q = db.new_constant(t), db.new_constant(t)
    p = db.new_term(names["f"](a))
    db.new_term(names["g"](q))
    db.unify(p, q)
    Domain(db, [parse_rule("g(f('x)) -> hit('x)", names)]).saturate()
    assert db.term_id(names["hit"](a)) is not None and db.term_id(names["hit"](q)) is None


def test_all_rows_are_rewritten(db):
    t = db.new_type("t")
    f = db.map("f", [t], t)
    pairs = [tuple(sorted((db.new_constant(t), db.new_constant(t)), key=lambda x: x.value)) for _ in range(5)]
    for low, high in pairs:
        db.new_term(f(high))
    for low, high in pairs:
        db.unify(low, high)
    db.rebuild()
    assert all(db.term_id(f(low)) is not None and db.term_id(f(high)) is not None for low, high in pairs)
    assert {r[0] for r in rows(db, f)} == {low.value for low, _ in pairs}


def test_constants_in_rules_follow_unions(db):
    t, unit = db.new_type("t"), db.new_type("unit")
    p, f = db.map("p", [t], unit), db.map("f", [t, t], unit)
    c1, c2, x = (db.new_constant(t) for _ in range(3))
    db.new_term(p(x))
    db.unify(c1, c2)
    db.rebuild()
    Domain(db, [Rule([p(Var("x"))], [f(Var("x"), c1)])]).saturate()
    assert db.term_id(f(x, c1)) == db.term_id(f(x, c2)) is not None and len(rows(db, f)) == 1


def test_unconditional_rule_fires_once(db):
    t = db.new_type("t")
    c = db.map("c", [], t)
    x, y, z = (db.new_constant(t) for _ in range(3))
    domain = Domain(db, [parse_rule("-> x == y", {"x": x, "y": y}), parse_rule("-> c()", {"c": c}), parse_rule("->", {})])
    domain.run_rules(1)
    assert db.equal(x, y) and not db.equal(x, z) and db.term_id(c()) is not None
    assert domain.saturate() <= 1


def test_nullary_atom_and_cross_product(db):
    t, unit = db.new_type("t", integer=True), db.new_type("unit")
    names = {"flag": db.map("flag", [], unit), "f": db.map("f", [t], unit), "g": db.map("g", [t, t], unit)}
    rule = parse_rule("flag() f('x) f('y) -> g('x, 'y),", names)
    for k in (1, 2):
        db.new_term(names["f"](db.new_constant(t, k)))
    domain = Domain(db, [rule])
    domain.saturate()
    assert not db.read(names["g"]).collect()
    db.new_term(names["flag"]())
    domain.saturate()
    assert {(r["a0"], r["a1"]) for r in db.read(names["g"]).collect()} == {(a, b) for a in (1, 2) for b in (1, 2)}


def test_rules_are_checked_when_made(db):
    t, u = db.new_type("t"), db.new_type("u")
    f, g = db.map("f", [t], u), db.map("g", [u], t)
    with pytest.raises(UnboundVariableError):
        Rule([f(Var("x"))], [f(Var("y"))])
    with pytest.raises(TypeMismatchError):
        Rule([f(Var("x")), g(Var("x"))], [])
    with pytest.raises(TypeMismatchError):
        Rule([f(Var("x"))], [Union(Var("x"), f(Var("x")))])
    with pytest.raises(ArityError):
        parse_rewrite("f('x) -> f('x), f('x)", {"f": f})
    compile_rule(Rule([f(Var("x")), f(Var("y"))], [Union(Var("x"), Var("y")), f(g(f(Var("x"))))]))


@pytest.mark.parametrize("text", ["f('x) -> 'x", "f('x)", "f('x -> f('x)", "h('x) -> f('x)", "f(c) == ", "-> f(c) f(c)", "f('x) -> f('x) ;"])
def test_grammar_errors(db, text):
    t = db.new_type("t")
    with pytest.raises(GrammarError):
        parse_rule(text, {"f": db.map("f", [t], t), "c": db.new_constant(t)})


def test_grammar(db):
    t = db.new_type("t")
    f, c = db.map("f", [t, t], t), db.new_constant(t)
    names = {"f": f, "c": c, "t": t}
    assert parse_term("f(c, f(c, c),)", names) == f(c, f(c, c))
    assert parse_signature("(t, t) -> t", names) == f.signature and parse_signature("() -> t", names).inputs == ()
    assert parse_signature("(t,) -> t", names).inputs == (t,)
    assert parse_rule("f('x, c) f('y, 'x), -> f('x, 'y), 'x == c,", names) == Rule([f(Var("x"), c), f(Var("y"), Var("x"))], [f(Var("x"), Var("y")), Union(Var("x"), c)])
    there, back = parse_equivalence("f('x, f('y, 'z)) == f(f('x, 'y), 'z)", names)
    assert there.patterns == (back.actions[0].right,) and there.actions[0].left == back.actions[0].right
    with pytest.raises(GrammarError):
        parse_term("f('x, c)", names)


def test_min_max_fusion(db):
    number, pair = db.new_type("number"), db.new_type("pair")
    names = {x: db.map(x, [number, number], number) for x in ("min", "max")} | {"minmax": db.map("minmax", [number, number], pair)}
    names |= {x: db.map(x, [pair], number) for x in ("first", "second")}
    a, b = db.new_constant(number), db.new_constant(number)
    low, high = db.new_term(names["min"](a, b)), db.new_term(names["max"](a, b))
    Domain(db, [parse_rewrite("min('x, 'y), max('x, 'y) -> first(minmax('x, 'y)), second(minmax('x, 'y))", names)]).run_rules(2)
    mm = names["minmax"](a, b)
    assert db.equal(low, db.term_id(names["first"](mm))) and db.equal(high, db.term_id(names["second"](mm))) and not db.equal(low, high)


def test_surplus_left_sides_guard(db):
    t = db.new_type("t")
    f, g = db.map("f", [t], t), db.map("g", [t], t)
    x, y = db.new_constant(t), db.new_constant(t)
    fx, fy = db.new_term(f(x)), db.new_term(f(y))
    db.new_term(g(x))
    Domain(db, [parse_rewrite("f('x), g('x) -> 'x", {"f": f, "g": g})]).saturate()
    assert db.equal(fx, x) and not db.equal(fy, y)


@pytest.mark.parametrize("seed", range(4))
def test_random_worlds_against_the_naive_evaluator(db, seed):
    rng = random.Random(seed)
    t, unit = db.new_type("t", integer=True), db.new_type("unit")
    names = {"f": db.map("f", [t], t), "g": db.map("g", [t, t], t), "r": db.map("r", [t, t], unit), "s": db.map("s", [t, t], unit)}
    c = [db.new_constant(t, k) for k in range(6)]
    names |= {f"c{k}": x for k, x in enumerate(c)}
    pool = [
        "r('x, 'y) -> s('y, 'x)", "r('x, 'y), s('y, 'z) -> r('x, 'z)", "r('x, 'x) -> f('x) == 'x", "f(f('x)) -> 'x == f('x)", "s('x, c1) -> f('x)", "r('x, 'y), r('x, 'z), s('y, 'z) -> 'y == 'z",
        "f('x), r('x, 'y) -> r(f('x), f('y))", "g('x, 'y) -> g('x, 'y) == g('y, 'x)", "g('x, f('y)), r('x, 'y) -> s('x, g('x, f('y)))",
    ]
    rules = [parse_rule(x, names) for x in rng.sample(pool, 4)]
    plain = Naive()
    for _ in range(8):
        m = names[rng.choice("fgrs")]
        term = m(*[rng.choice(c) for _ in range(m.arity)])
        db.new_term(term)
        plain.build(term)
    domain = Domain(db, rules)
    for _ in range(3):
        domain.run_rules(1)
        plain.step(rules)
    for k in "fgrs":
        assert rows(db, names[k]) == plain.of(names[k])
    for k in "fgrs":  # no two rows of a map have equal arguments
        got = rows(db, names[k])
        assert len({r[:-1] for r in got}) == len(got)


def test_bulk_facts_with_values_and_string_keys(spark, db):
    doc, text = db.new_type("doc", integer=True), db.new_type("text")
    m = db.map("owner", [text], doc)
    df = spark.createDataFrame([("a", 3), ("b", 2), ("a", 1), ("b", 2)], "t string, d long")
    db.load_constants(df, "t", text)
    assert db.load_facts(df, m, ["t"], value="d") == 2
    assert {(r["text"], r["owner"]) for r in db.read(m, ["text"], value="owner").collect()} == {("a", 1), ("b", 2)}
    assert {(r["d"], r["root"]) for r in db.classes(df, "d", doc).collect()} == {(3, 1), (1, 1), (2, 2)}
    more = spark.createDataFrame([("a", 2)], "t string, d long")
    assert db.load_facts(more, m, ["t"], value="d") == 0
    assert {r["root"] for r in db.classes(df, "d", doc).collect()} == {1}


def test_null_keys_are_refused(spark, db):
    node, unit = db.new_type("node", integer=True), db.new_type("unit")
    m = db.map("m", [node], unit)
    with pytest.raises(Exception, match="null or out of range"):
        db.load_facts(spark.createDataFrame([(None,)], "k long"), m, ["k"])


def test_stream(spark, db, tmp_path):
    from koine.streaming.ingest import ingest

    names = graph(db, [])
    domain = Domain(db, [parse_rule(r, names) for r in CLOSURE])
    for k in range(3):
        spark.createDataFrame([(k, k + 1)], "a long, b long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest(stream, domain, names["edge"], ["a", "b"]).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert paths(db, names) == closed([(0, 1), (1, 2), (2, 3)])


def test_many_unions_run_in_spark(db, monkeypatch):
    """The same worlds with everything beyond the driver's and the broadcast's bounds."""
    from koine.operators import rebuild

    for bound in ("DRIVER_EDGES", "BROADCAST_ROWS", "SMALL_MAP"):
        monkeypatch.setattr(rebuild, bound, 0)
    test_random_worlds_against_the_naive_evaluator(db, 1)


def test_candidates_go_to_a_large_map(db, monkeypatch):
    from koine.operators import act
    from koine.sources import store

    monkeypatch.setattr(act, "SMALL_MAP", 5)
    monkeypatch.setattr(store, "MAX_PARTS", 2)
    edges = [(a, a + 1) for a in range(12)]
    names = graph(db, edges)
    Domain(db, [parse_rule(r, names) for r in ["edge('x, 'y) -> path('x, 'y)", "edge('x, 'y), path('y, 'z) -> path('x, 'z)"]]).saturate()
    assert paths(db, names) == closed(edges) and db.count(names["path"]) == len(closed(edges))
