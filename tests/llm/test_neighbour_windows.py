"""Windows on curves: the registered query against brute force, narrow windows on clustered rows, hot keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from koine.llm import neighbours
from tests.oracle import SF_DIR


def true_neighbours(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return {int(ids[o]) for o in np.lexsort((ids, d)) if ids[o] != ids[q]} if len(ids) <= k else {int(ids[o]) for o in [o for o in np.lexsort((ids, d)) if ids[o] != ids[q]][:k]}


def recall(spark, frame, x, ids, every):
    report = {}
    by = {}
    for r in neighbours.search(frame, F.col("vec_id") % every == 0, report=report).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    at = {int(i): n for n, i in enumerate(ids)}
    hits = [len(by[i] & true_neighbours(x, ids, at[i])) / 10 for i in at if i % every == 0]
    return float(np.mean(hits)), report


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_registered_query_against_brute_force(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding").toPandas()
    rows = rows[[len(v) > 0 and np.isfinite(np.array(v, float)).all() and np.any(v) for v in rows["embedding"]]]
    x, ids = np.stack(rows["embedding"]).astype(np.float64), rows["vec_id"].to_numpy()
    by = {}
    for r in neighbours.query(spark, sf).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    at = {int(i): n for n, i in enumerate(ids)}
    assert set(by) == {i for i in at if i % 100 == 0}
    assert np.mean([len(own & true_neighbours(x, ids, at[i])) / 10 for i, own in by.items()]) >= 0.9


def test_clustered_rows_need_narrow_windows(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    x = (rng.standard_normal((60, 32))[rng.integers(0, 60, n)] + 0.1 * rng.standard_normal((n, 32))).astype(np.float32)
    ids = np.arange(n)
    frame = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(4)
    share, report = recall(spark, frame, x.astype(np.float64), ids, 200)
    assert share >= 0.95 and neighbours.CURVES * (2 * report["window"] + 1) < report["rows"] / 3


def test_a_third_of_the_rows_in_one_cell(spark):
    rng = np.random.default_rng(4)
    n = 3_000
    x = rng.standard_normal((n, 8))
    x[: n // 3] = 5.0 + 1e-9 * rng.standard_normal((n // 3, 8))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    share, _ = recall(spark, frame, x, np.arange(n), 100)
    assert share >= 0.9
