"""Parts, keys and ids: what is rewritten, removed, remembered and refused."""

import os

import pytest

from koine import CollisionError, Database, Domain, parse_rule
from koine.functions import ids
from koine.operators import act, rebuild
from koine.queries import QUERIES
from tests.naive import Naive  # noqa: F401
from tests.test_engine import closed, db, graph, paths, test_random_worlds_against_the_naive_evaluator  # noqa: F401


@pytest.mark.parametrize("seed", [1, 2])
def test_the_same_worlds_round_by_round(db, monkeypatch, seed):  # noqa: F811
    monkeypatch.setattr(rebuild, "DRIVER_ROWS", 0)
    test_random_worlds_against_the_naive_evaluator(db, seed)


@pytest.mark.parametrize("seed", [0, 3])
def test_the_same_worlds_part_by_part(db, monkeypatch, seed):  # noqa: F811
    for bound in ("DRIVER_ROWS", "SMALL_MAP"):
        monkeypatch.setattr(rebuild, bound, 0)
    test_random_worlds_against_the_naive_evaluator(db, seed)


def test_parts_without_moved_ids_stay(spark, db, monkeypatch):  # noqa: F811
    for bound in ("DRIVER_ROWS", "SMALL_MAP"):
        monkeypatch.setattr(rebuild, bound, 0)
    t = db.new_type("t", integer=True)
    f = db.map("f", [t], t)
    for low in (0, 100, 200):
        db.load_facts(spark.range(low, low + 10).selectExpr("id as a", "id + 1000 as b"), f, ["a"], value="b")
    store = db._stores[f.index]
    before = {p for p, _ in store.fresh + store.base + store.delta}
    db.unify(db.new_constant(t, 103), db.new_constant(t, 7))  # f(103) meets f(7): two parts
    db.rebuild()
    after = store.paths()
    kept = {r["a0"] for r in store.read([(p, 1) for p in before & after]).collect()}
    assert {ids.integer_id(t.index, k) for k in range(200, 210)} <= kept and not {ids.integer_id(t.index, k) for k in (7, 103)} & kept
    got = {(r["a"], r["b"]) for r in db.read(f, ["a"], value="b").collect()}
    rows = {(low + k, low + k + 1000) for low in (0, 100, 200) for k in range(10)}
    assert len(got) == 29 and got - rows == set() and (103, 1103) not in got and (7, 1007) in got
    assert db.equal(db.new_constant(t, 1103), db.new_constant(t, 1007))


def tables(db):  # noqa: F811
    folder = db.folder.path.removeprefix("file:")
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def test_replaced_tables_are_removed(db, monkeypatch):  # noqa: F811
    from koine import domain

    monkeypatch.setattr(domain, "SWEEP", 2)
    edges = [(a, a + 1) for a in range(20)]
    names = graph(db, edges)
    Domain(db, [parse_rule(r, names) for r in ["edge('x, 'y) -> path('x, 'y)", "edge('x, 'y), path('y, 'z) -> path('x, 'z)"]]).saturate()
    assert paths(db, names) == closed(edges)
    assert len(tables(db)) < db.folder.written() / 2
    db.vacuum()
    assert len(tables(db)) == len({p.removeprefix(db.folder.path).split("/")[1] for p in db.live()})
    assert paths(db, names) == closed(edges)


def test_keys_of_loaded_strings_come_back(spark, db):  # noqa: F811
    t, n = db.new_type("t"), db.new_type("n", integer=True)
    m = db.map("m", [t, n], t)
    rows = [("a", 1, "x"), ("b", 2, "y"), ("é", 3, "x")]
    db.load_facts(spark.createDataFrame(rows, "s string, k long, v string"), m, ["s", "k"], value="v")
    assert {tuple(r) for r in db.read(m, ["s", "k"], value="v").collect()} == set(rows)
    db.load_facts(spark.createDataFrame([("c", 4, "z")], "s string, k long, v string"), m, ["s", "k"], value="v", keys_later=False)
    assert {tuple(r) for r in db.read(m, ["s", "k"], value="v").collect()} == {*rows, ("c", 4, "z")}


def short(monkeypatch, bits):
    monkeypatch.setattr(ids, "hash_values", lambda *v, own=ids.hash_values: own(*v) % (1 << bits))
    own = ids.F.xxhash64
    monkeypatch.setattr(ids.F, "xxhash64", lambda *c: ids.F.pmod(own(*c), ids.F.lit(1 << bits)))


def test_keys_of_one_hash_are_an_error(spark, monkeypatch):
    short(monkeypatch, 3)
    d = Database(spark)
    t = d.new_type("t")
    m = d.map("m", [t], t)
    d.load_facts(spark.range(40).selectExpr("concat('k', id) as s"), m, ["s"])
    with pytest.raises(CollisionError):
        d.read(m, ["s"]).collect()
    with pytest.raises(CollisionError):
        for k in range(40):
            d.new_constant(t, f"k{k}")
    d.close()


def test_terms_of_one_hash_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(act, "VERIFY_ROWS", 0)
    short(monkeypatch, 4)
    d = Database(spark)
    t, u = d.new_type("t", integer=True), d.new_type("u")
    r, s = d.map("r", [t], u), d.map("s", [t], u)
    with pytest.raises(CollisionError):
        for part in range(4):
            d.load_facts(spark.range(part * 10, part * 10 + 10).selectExpr("id as a"), r, ["a"])
    with pytest.raises(CollisionError):
        for k in range(40):
            d.new_term(s(d.new_constant(t, k)))
    d.close()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from koine.sources.scratch import shared_dir

    context = SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None, applicationId="x", setCheckpointDir=lambda p: None)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake)


def test_long_conversations_do_not_run_together(spark, tmp_path):
    rows = [(c, t, "user", f"{c}-{t}") for c in (0, 1) for t in (0, 1, 2)] + [(2, t, "user", "x") for t in range(1030)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"], r["parity"]) for r in QUERIES["rewrite_double_negation"](spark, str(tmp_path)).collect()}
    assert got == {(c, t, t % 2) for c, t, _, _ in rows}
