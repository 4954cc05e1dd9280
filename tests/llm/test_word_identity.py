"""Distinct words that algebraic hashes confuse stay distinct."""

import numpy as np
import pyarrow as pa

from koine.llm import jaccard_join, substring_dedup
from koine.llm.text import strings, words


def mirrored(n=1024):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_fingerprints_of_words():
    rng = np.random.default_rng(0)
    own = sorted({*mirrored(), *mirrored(128), "", *("".join(rng.choice(list("ab"), n)) for n in range(1, 40) for _ in range(30)), *("x" * n for n in range(1, 700))} - {""})
    w = words(strings(pa.array(own)), 0, len(own))
    assert len(w.hashes) == len(own) == len(set(w.hashes.tolist()))
    again = words(strings(pa.array([" ".join(own)])), 0, 1)
    assert (again.hashes == w.hashes).all()


def test_operators_tell_them_apart(spark):
    x, y = mirrored()
    rows = [(1, x), (2, y), (3, " ".join([x] * 20)), (4, " ".join([y] * 20)), (5, " ".join([x] * 13)), (6, " ".join([x] * 12))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_groups(frame).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 3}
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(frame).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13, 6: 0}
