"""Registered queries of the rule engine and their DuckDB oracles.

Facts come from the driver's tables, results are natural keys; ids never leave
the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from koine.database import Database
from koine.domain import Domain
from koine.plans.ast import Rule, Union
from koine.plans.parse import parse_equivalence, parse_rewrite, parse_rule, parse_signature, parse_term

CLOSURE = ["edge('x, 'y) -> path('x, 'y)", "path('x, 'y), path('y, 'z) -> path('x, 'z)"]
LINEAR = ["edge('x, 'y) -> path('x, 'y)", "edge('x, 'y), path('y, 'z) -> path('x, 'z)"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _World:
    """A database with named types and maps, for rules as text."""

    def __init__(self, spark: SparkSession, integers: str = "", names: str = ""):
        self.db = Database(spark)
        self.names: dict = {t: self.db.new_type(t, integer=True) for t in integers.split()}
        self.names |= {t: self.db.new_type(t) for t in names.split()}

    def map(self, name: str, signature: str):
        self.names[name] = self.db.new_map(parse_signature(signature, self.names), name)
        return self.names[name]

    def run(self, rules: list, times: int | None = None) -> Domain:
        domain = Domain(self.db, [parse_rule(r, self.names) if isinstance(r, str) else r for r in rules])
        domain.saturate() if times is None else domain.run_rules(times)
        return domain


def _graph(spark: SparkSession) -> _World:
    w = _World(spark, "node", "unit")
    w.map("edge", "(node, node) -> unit")
    w.map("path", "(node, node) -> unit")
    return w


def _closure(spark: SparkSession, edges: DataFrame, rules: list[str], times: int | None = None) -> DataFrame:
    w = _graph(spark)
    w.db.load_facts(edges, w.names["edge"], ["a", "b"])
    w.run(rules, times)
    return w.db.read(w.names["path"], ["src", "dst"])


def _heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").where("c_custkey > 1").selectExpr("c_custkey as a", "c_custkey div 2 as b")


def tc_hierarchy(spark, sf_dir):
    """Transitive closure of a hierarchy, to saturation."""
    return _closure(spark, _heap(spark, sf_dir), CLOSURE)


def tc_bounded(spark, sf_dir):
    """Three iterations exactly: walks of up to four steps."""
    return _closure(spark, _heap(spark, sf_dir), CLOSURE, 3)


def _turns(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    """Conversations with a key ``k`` per turn, pairs ``k, b`` of turns that follow
    one another, and the number of keys kept for a conversation."""
    c = _table(spark, sf_dir, "conversations")
    width = (c.agg(F.max("turn")).first()[0] or 0) + 2  # a gap after the last turn
    c = c.withColumn("k", F.col("conv_id") * width + F.col("turn"))
    return c, c.select("k").join(c.selectExpr("k - 1 as k", "k as b"), "k"), width


def tc_linear(spark, sf_dir):
    """A linear rule over the turns of conversations."""
    _, edges, width = _turns(spark, sf_dir)
    out = _closure(spark, edges.selectExpr("k as a", "b"), LINEAR)
    return out.selectExpr(f"src div {width} as conv_id", f"src % {width} as src", f"dst % {width} as dst")


def tc_cyclic(spark, sf_dir):
    """Closure of cycles."""
    c = _table(spark, sf_dir, "customer")
    return _closure(spark, c.selectExpr("c_custkey as a", f"(7 * c_custkey + 3) % {c.count()} as b"), CLOSURE)


def incremental(spark, sf_dir):
    """Half of the facts, rules, the other half, rules again."""
    edges = _heap(spark, sf_dir)
    w = _graph(spark)
    w.db.load_facts(edges.where("a % 2 = 0"), w.names["edge"], ["a", "b"])
    domain = w.run(CLOSURE)
    w.db.load_facts(edges.where("a % 2 = 1"), w.names["edge"], ["a", "b"])
    domain.saturate()
    return w.db.read(w.names["path"], ["src", "dst"])


def _orders(spark, sf_dir) -> _World:
    w = _World(spark, "order customer nation region", "unit")
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    w.db.load_facts(orders, w.map("placed", "(order, customer) -> unit"), ["o_orderkey", "o_custkey"])
    w.db.load_facts(customer, w.map("lives", "(customer, nation) -> unit"), ["c_custkey", "c_nationkey"])
    w.db.load_facts(nation, w.map("lies", "(nation, region) -> unit"), ["n_nationkey", "n_regionkey"])
    return w


def join_two(spark, sf_dir):
    w = _orders(spark, sf_dir)
    m = w.map("ordered_in", "(order, nation) -> unit")
    w.run(["placed('o, 'c), lives('c, 'n) -> ordered_in('o, 'n)"])
    return w.db.read(m, ["o_orderkey", "n_nationkey"])


def join_three(spark, sf_dir):
    w = _orders(spark, sf_dir)
    m = w.map("ordered_in", "(order, region) -> unit")
    w.run(["placed('o, 'c), lives('c, 'n), lies('n, 'r) -> ordered_in('o, 'r)"])
    return w.db.read(m, ["o_orderkey", "r_regionkey"])


def join_star_skip(spark, sf_dir):
    """An atom probed early and used late."""
    w = _World(spark, "nation region supplier", "unit")
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    w.db.load_facts(n, w.map("a", "(nation, region) -> unit"), ["n_nationkey", "n_regionkey"])
    w.db.load_facts(n, w.map("b", "(region, nation) -> unit"), ["n_regionkey", "n_nationkey"])
    w.db.load_facts(s, w.map("c", "(nation, supplier) -> unit"), ["s_nationkey", "s_suppkey"])
    m = w.map("out", "(nation, supplier) -> unit")
    w.run(["a('x, 'y), b('y, 'z), c('x, 'w) -> out('z, 'w)"])
    return w.db.read(m, ["n_nationkey", "s_suppkey"])


def triangle(spark, sf_dir):
    """A cyclic query: directed triangles over the keys of lines."""
    w = _World(spark, "node", "unit")
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_partkey as a", "l_suppkey as b")
    w.db.load_facts(lines, w.map("r", "(node, node) -> unit"), ["a", "b"])
    m = w.map("tri", "(node, node, node) -> unit")
    w.run(["r('x, 'y), r('y, 'z), r('z, 'x) -> tri('x, 'y, 'z)"])
    return w.db.read(m, ["x", "y", "z"])




def cross(spark, sf_dir):
    """Atoms without a shared variable."""
    w = _World(spark, "region", "unit")
    w.db.load_facts(_table(spark, sf_dir, "region"), w.map("reg", "(region) -> unit"), ["r_regionkey"])
    m = w.map("pair", "(region, region) -> unit")
    w.run(["reg('x), reg('y) -> pair('x, 'y)"])
    return w.db.read(m, ["x", "y"])


def nested_output(spark, sf_dir):
    """A join through a map's value."""
    w = _World(spark, "node", "unit")
    w.db.load_facts(_heap(spark, sf_dir), w.map("parent", "(node) -> node"), ["a"], value="b")
    m = w.map("grandparent", "(node, node) -> unit")
    w.run(["parent(parent('x)) -> grandparent('x, parent(parent('x)))"])
    return w.db.read(m, ["node", "grandparent"])


def const_filter(spark, sf_dir):
    """A constant in a pattern; string keys."""
    w = _World(spark, "", "nation region unit")
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w.db.load_facts(rows, w.map("lies", "(nation, region) -> unit"), ["n_name", "r_name"])
    w.names["ASIA"] = w.db.new_constant(w.names["region"], "ASIA")
    m = w.map("asian", "(nation) -> unit")
    w.run(["lies('n, ASIA) -> asian('n)"])
    return w.db.read(m, ["n_name"])


def repeated_var(spark, sf_dir):
    """One variable twice in an atom."""
    w = _World(spark, "nation", "unit")
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    trade = lines.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w.db.load_facts(trade, w.map("trade", "(nation, nation) -> unit"), ["c_nationkey", "s_nationkey"])
    m = w.map("home", "(nation) -> unit")
    w.run(["trade('n, 'n) -> home('n)"])
    return w.db.read(m, ["n_nationkey"])


def _people(spark, sf_dir) -> _World:
    w = _World(spark, "nation", "unit")
    w.db.load_facts(_table(spark, sf_dir, "customer"), w.map("buys", "(nation) -> unit"), ["c_nationkey"])
    w.db.load_facts(_table(spark, sf_dir, "supplier"), w.map("sells", "(nation) -> unit"), ["s_nationkey"])
    return w


def union_rules(spark, sf_dir):
    w = _people(spark, sf_dir)
    m = w.map("trades", "(nation) -> unit")
    w.run(["buys('n) -> trades('n)", "sells('n) -> trades('n)"])
    return w.db.read(m, ["n_nationkey"])


def intersect_atoms(spark, sf_dir):
    w = _people(spark, sf_dir)
    m = w.map("both", "(nation) -> unit")
    w.run(["buys('n), sells('n) -> both('n)"])
    return w.db.read(m, ["n_nationkey"])


def guard_semijoin(spark, sf_dir):
    """An atom whose other variables no action reads."""
    w = _orders(spark, sf_dir)
    m = w.map("active", "(nation) -> unit")
    w.run(["lives('c, 'n), placed('o, 'c) -> active('n)"])
    return w.db.read(m, ["n_nationkey"])


def unify_components(spark, sf_dir):
    """Unions by rule; classes of parts (even keys) and suppliers (odd keys)."""
    w = _World(spark, "node", "unit")
    edges = _table(spark, sf_dir, "lineitem").selectExpr("l_partkey * 2 as a", "l_suppkey * 2 + 1 as b")
    w.db.load_facts(edges, w.map("edge", "(node, node) -> unit"), ["a", "b"])
    w.run(["edge('x, 'y) -> 'x == 'y"])
    nodes = edges.selectExpr("a as node").unionByName(edges.selectExpr("b as node")).distinct()
    return w.db.classes(nodes, "node", w.names["node"])


def congruence_cells(spark, sf_dir):
    """Cells of equal nations become equal."""
    w = _World(spark, "nation", "segment unit")
    customer, nation = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    w.db.load_facts(customer, w.map("cell", "(nation, segment) -> unit"), ["c_nationkey", "c_mktsegment"])
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    w.db.load_facts(nation.join(first, "n_regionkey"), w.map("same", "(nation, nation) -> unit"), ["n_nationkey", "first"])
    w.run(["same('x, 'y) -> 'x == 'y"])
    return w.db.read(w.names["cell"], ["nation", "segment"])


def congruence_chain(spark, sf_dir):
    """Turns follow turns: uniting the first of two conversations unites the rest."""
    w = _World(spark, "turn", "unit")
    c, follow, width = _turns(spark, sf_dir)
    w.db.load_facts(follow, w.map("next", "(turn) -> turn"), ["k"], value="b")
    starts = c.where("turn = 0 and conv_id % 2 = 1").selectExpr("k as a")
    pairs = starts.join(c.where("turn = 0").selectExpr(f"k + {width} as a", "k as b"), "a")
    w.db.load_facts(pairs, w.map("start", "(turn, turn) -> unit"), ["a", "b"])
    w.run(["start('x, 'y) -> 'x == 'y"])
    out = w.db.classes(c.select("k"), "k", w.names["turn"])
    return out.selectExpr(f"k div {width} as conv_id", f"k % {width} as turn", f"root div {width} as root_conv")


def unify_then_rules(spark, sf_dir):
    """Closure of a quotient graph: about half the square of the customers in rows."""
    w = _graph(spark)
    c = _table(spark, sf_dir, "customer")
    w.db.load_facts(c.selectExpr("c_custkey as a", "c_custkey + 3 as b"), w.names["edge"], ["a", "b"])
    w.db.load_facts(c.where("c_custkey % 4 = 0").selectExpr("c_custkey as a", "c_custkey + 1 as b"), w.map("same", "(node, node) -> unit"), ["a", "b"])
    w.run(["same('x, 'y) -> 'x == 'y", *CLOSURE])
    return w.db.read(w.names["path"], ["src", "dst"])


def dup_documents(spark, sf_dir):
    """A function of the text: equal texts have equal values."""
    w = _World(spark, "doc", "text")
    docs = _table(spark, sf_dir, "documents")
    w.db.load_facts(docs, w.map("owner", "(text) -> doc"), ["text"], value="doc_id")
    return w.db.classes(docs.select("doc_id"), "doc_id", w.names["doc"])


def part_classes(spark, sf_dir):
    w = _World(spark, "part size", "brand kind")
    parts = _table(spark, sf_dir, "part")
    w.db.load_facts(parts, w.map("model", "(brand, kind, size) -> part"), ["p_brand", "p_type", "p_size"], value="p_partkey")
    return w.db.classes(parts.select("p_partkey"), "p_partkey", w.names["part"])


def rewrite_double_negation(spark, sf_dir):
    w = _World(spark, "value")
    turns, follow, width = _turns(spark, sf_dir)
    w.db.load_facts(follow, w.map("not", "(value) -> value"), ["k"], value="b")
    w.run([parse_rewrite("not(not('x)) -> 'x", w.names)])
    return w.db.classes(turns.select("k"), "k", w.names["value"]).selectExpr(f"k div {width} as conv_id", f"k % {width} as turn", f"root % {width} as parity")


def rewrite_multi(spark, sf_dir):
    """Two left and two right sides; created terms are told apart."""
    w = _World(spark, "number", "pair")
    for name in ("min", "max"):
        w.map(name, "(number, number) -> number")
    w.map("minmax", "(number, number) -> pair")
    for name in ("first", "second"):
        w.map(name, "(pair) -> number")
    pairs = _table(spark, sf_dir, "nation").selectExpr("n_nationkey as a", "n_regionkey as b")
    for name in ("min", "max"):
        w.db.load_facts(pairs, w.names[name], ["a", "b"])
    w.run([parse_rewrite("min('x, 'y), max('x, 'y) -> first(minmax('x, 'y)), second(minmax('x, 'y))", w.names)])
    raw = {k: w.db.raw(w.names[k]) for k in ("min", "max", "minmax", "first", "second")}
    rows = raw["minmax"].select("a0", "a1", F.col("out").alias("m"))
    for name in ("min", "max"):
        rows = rows.join(raw[name].select("a0", "a1", F.col("out").alias(name)), ["a0", "a1"])
    for name in ("first", "second"):
        rows = rows.join(raw[name].select(F.col("a0").alias("m"), F.col("out").alias(name)), "m")
    rows = rows.select(F.col("a0").alias("a"), F.col("a1").alias("b"), F.expr("`min` = `first`").alias("min_is_first"), F.expr("`max` = `second`").alias("max_is_second"), F.expr("`min` = `max`").alias("min_is_max"))
    return w.db.decode(rows, {"a": w.names["number"], "b": w.names["number"]})


def equivalence_commute(spark, sf_dir):
    w = _World(spark, "nation", "both")
    m = w.map("pair", "(nation, nation) -> both")
    w.db.load_facts(_table(spark, sf_dir, "supplier").selectExpr("s_nationkey as a", "cast(s_suppkey % 25 as int) as b"), m, ["a", "b"])
    w.run([parse_equivalence("pair('x, 'y) == pair('y, 'x)", w.names)][0])
    rows = w.db.decode(w.db.raw(m).select(F.col("a0").alias("x"), F.col("a1").alias("y"), "out"), {"x": w.names["nation"], "y": w.names["nation"]})
    return rows.groupBy("out").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("members")).drop("out")


def peano_add(spark, sf_dir):
    """Addition by rewriting to successors; nested creation."""
    w = _World(spark, "number")
    numbers = spark.range(9).selectExpr("id as a", "id + 1 as b")
    w.db.load_facts(numbers, w.map("succ", "(number) -> number"), ["a"], value="b")
    add = w.map("add", "(number, number) -> number")
    r = _table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as bigint) as k")
    w.db.load_facts(r.selectExpr("k as a").crossJoin(r.selectExpr("k as b")), add, ["a", "b"])
    w.names["zero"] = w.db.new_constant(w.names["number"], 0)
    w.run([parse_rewrite("add('x, zero) -> 'x", w.names), parse_rewrite("add('x, succ('y)) -> succ(add('x, 'y))", w.names)])
    return w.db.read(add, ["a", "b"], value="total")


def unconditional(spark, sf_dir):
    """A rule without patterns fires once."""
    w = _World(spark, "number")
    x, y, z = (w.db.new_constant(w.names["number"], k) for k in (1, 2, 3))
    w.run([Rule([], [Union(x, y)])], 1)
    return spark.createDataFrame([("x = y", w.db.equal(x, y)), ("x = z", w.db.equal(x, z))], "claim string, holds boolean")


def lookup_term(spark, sf_dir):
    """Which ground terms exist."""
    w = _World(spark, "nation region", "unit")
    m = w.map("lies", "(nation, region) -> unit")
    w.db.load_facts(_table(spark, sf_dir, "nation"), m, ["n_nationkey", "n_regionkey"])
    nation, region = w.names["nation"], w.names["region"]
    rows = []
    for n in (0, 7, 24):
        for r in range(5):
            names = {"n": w.db.new_constant(nation, n), "r": w.db.new_constant(region, r), "lies": m}
            rows.append((n, r, w.db.term_id(parse_term("lies(n, r)", names)) is not None))
    return spark.createDataFrame(rows, "n_nationkey int, n_regionkey int, found boolean")


QUERIES = {
    f.__name__: f
    for f in (
        tc_hierarchy, tc_bounded, tc_linear, tc_cyclic, incremental, join_two, join_three, join_star_skip, triangle, cross, nested_output, const_filter,
        repeated_var, union_rules, intersect_atoms, guard_semijoin, unify_components, congruence_cells, congruence_chain, unify_then_rules, dup_documents,
        part_classes, rewrite_double_negation, rewrite_multi, equivalence_commute, peano_add, unconditional, lookup_term,
    )
}

_HEAP = "SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 1"
_RECURSIVE = "WITH RECURSIVE e AS ({edges}), p(src, dst) AS (SELECT a, b FROM e UNION SELECT p.src, e.b FROM p JOIN e ON p.dst = e.a) SELECT src, dst FROM p"
_CLOSED_HEAP = _RECURSIVE.format(edges=_HEAP)

ORACLE_SQL = {
    "tc_hierarchy": _CLOSED_HEAP,
    "incremental": _CLOSED_HEAP,
    "tc_bounded": f"WITH RECURSIVE e AS ({_HEAP}), p(src, dst, n) AS (SELECT a, b, 1 FROM e UNION SELECT p.src, e.b, n + 1 FROM p JOIN e ON p.dst = e.a WHERE n < 4) SELECT DISTINCT src, dst FROM p",
    "tc_linear": "SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn",
    "join_two": "SELECT DISTINCT o_orderkey, CAST(c_nationkey AS BIGINT) AS n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_three": "SELECT DISTINCT o_orderkey, CAST(n_regionkey AS BIGINT) AS r_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "join_star_skip": "SELECT DISTINCT CAST(b.n_nationkey AS BIGINT) AS n_nationkey, s_suppkey FROM nation a JOIN nation b USING (n_regionkey) JOIN supplier ON s_nationkey = a.n_nationkey",
    "cross": "SELECT CAST(a.r_regionkey AS BIGINT) AS x, CAST(b.r_regionkey AS BIGINT) AS y FROM region a CROSS JOIN region b",
    "nested_output": "SELECT c_custkey AS node, c_custkey // 2 // 2 AS grandparent FROM customer WHERE c_custkey // 2 > 1",
    "const_filter": "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "guard_semijoin": "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS n_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "congruence_cells": "SELECT DISTINCT CAST(f AS BIGINT) AS nation, c_mktsegment AS segment FROM customer JOIN (SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS f FROM nation) ON c_nationkey = n_nationkey",
    "congruence_chain": "SELECT conv_id, turn, min(conv_id) OVER (PARTITION BY conv_id // 2, turn) AS root_conv FROM conversations",
    "dup_documents": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS root FROM documents",
    "part_classes": "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS root FROM part",
    "rewrite_double_negation": "SELECT conv_id, turn, turn % 2 AS parity FROM conversations",
    "rewrite_multi": "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, true AS min_is_first, true AS max_is_second, false AS min_is_max FROM nation",
    "equivalence_commute": """WITH p AS (SELECT DISTINCT s_nationkey AS a, CAST(s_suppkey % 25 AS INT) AS b FROM supplier)
SELECT CAST(least(a, b) AS BIGINT) AS low, CAST(greatest(a, b) AS BIGINT) AS high, CAST(max(CASE WHEN a = b THEN 1 ELSE 2 END) AS BIGINT) AS members FROM p GROUP BY 1, 2""",
    "peano_add": "SELECT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b, (a.r_regionkey + b.r_regionkey)::BIGINT AS total FROM region a CROSS JOIN region b",
    "unconditional": "SELECT * FROM (VALUES ('x = y', true), ('x = z', false)) t(claim, holds)",
    "lookup_term": "SELECT n.k AS n_nationkey, r.k AS n_regionkey, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = n.k AND nation.n_regionkey = r.k) AS found FROM (VALUES (0), (7), (24)) n(k) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) r(k)",
    "tc_cyclic": _RECURSIVE.format(edges="SELECT c_custkey AS a, (7 * c_custkey + 3) % (SELECT count(*) FROM customer) AS b FROM customer"),
    "triangle": "WITH r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT p.a AS x, q.a AS y, s.a AS z FROM r p JOIN r q ON p.b = q.a JOIN r s ON q.b = s.a AND s.b = p.a",
    "repeated_var": "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS n_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey",
    "union_rules": "SELECT CAST(c_nationkey AS BIGINT) AS n_nationkey FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier",
    "intersect_atoms": "SELECT CAST(c_nationkey AS BIGINT) AS n_nationkey FROM customer INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier",
    "unify_components": """WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
p(node, root) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM e
  UNION
  SELECT e.b, min(p.root) FROM p JOIN e ON p.node = e.a JOIN recurring.p AS q ON q.node = e.b WHERE p.root < q.root GROUP BY e.b)
SELECT node, root FROM p""",
    "unify_then_rules": """WITH RECURSIVE c AS (SELECT c_custkey AS k FROM customer),
q AS (SELECT k, k + 3 AS n FROM c),
e AS (SELECT DISTINCT CASE WHEN k % 4 = 1 THEN k - 1 ELSE k END AS a, CASE WHEN n % 4 = 1 AND n - 1 IN (SELECT k FROM c) THEN n - 1 ELSE n END AS b FROM q),
p(src, dst) AS (SELECT a, b FROM e UNION SELECT p.src, e.b FROM p JOIN e ON p.dst = e.a) SELECT src, dst FROM p""",
}
