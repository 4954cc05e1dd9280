"""The queries read their whole tables."""

import os

import pytest

from koine.queries import QUERIES
from tests.oracle import SF_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


def test_every_customer_is_in_the_closures(spark):
    keys = {r[0] for r in spark.read.parquet(f"{SF_DIR}/customer.parquet").select("c_custkey").collect()}
    assert {r["src"] for r in QUERIES["tc_cyclic"](spark, SF_DIR).collect()} == keys
    assert {r["src"] for r in QUERIES["unify_then_rules"](spark, SF_DIR).collect()} == {k - 1 if k % 4 == 1 else k for k in keys}


def test_every_line_is_in_the_classes(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for part, supplier in lines:
        a, b = sorted((find(part * 2), find(supplier * 2 + 1)))
        up[b] = a
    got = {r["node"]: r["root"] for r in QUERIES["unify_components"](spark, SF_DIR).collect()}
    assert got == {x: find(x) for x in list(up)}
