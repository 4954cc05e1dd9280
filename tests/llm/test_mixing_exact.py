"""Mixtures follow the requested weights, not rounded ones."""

from collections import Counter
from fractions import Fraction

import pytest

from koine.llm import mixing


@pytest.mark.parametrize("n, steps", [(5, 30_000), (20, 60_000), (600, 20_000)])
def test_a_long_run_stays_within_a_block_of_the_requested_weights(n, steps):
    weights = [1 / 3] + [2 / 3 / (n - 1)] * (n - 1)
    parts = mixing.exact(weights)
    total = sum(parts)
    seen = [0] * n
    for t, (i, j, slot) in enumerate(mixing.placements(parts, [steps] * n), 1):
        assert slot == t - 1 and j == seen[i]
        seen[i] += 1
        if t % 50 == 0 or i == 0:
            assert all(abs(seen[x] * total - t * parts[x]) < total for x in ((0,) if t % 50 else range(n)))
        if t == steps:
            break
    assert abs(seen[0] - steps / 3) < 1 + 1e-6


def test_exact_weights():
    parts = mixing.exact([0.4, 0.3, 0.2, 0.06, 0.04])
    assert [Fraction(p, sum(parts)) for p in parts] == [Fraction(x, 50) for x in (20, 15, 10, 3, 2)]
    assert len(list(mixing.placements(mixing.exact([1e-300, 1.0]), [5, 5]))) == 10


def test_hot_source_among_many(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 40}") for i in range(12_000)]
    weights = {"hot": 1 / 3} | {f"s{k}": 2 / 3 / 40 for k in range(40)}
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4).select("source", "slot").distinct().collect()
    order = [s for _, s in sorted((r["slot"], r["source"]) for r in got)]
    sizes = Counter(s for _, s in rows)
    ends = int(min((sizes[k] // 4) / w for k, w in weights.items()))
    seen = 0
    for t, s in enumerate(order[:ends], 1):
        seen += s == "hot"
        assert abs(seen - t / 3) < 1 + 1e-6
    assert ends > 2_000


def test_more_sources_than_twenty_thousand(spark):
    frame = spark.range(21_000).selectExpr("id as doc_id", "cast(id as string) as source")
    out = mixing.mixed(frame)
    assert out.count() == 21_000 and out.select("slot").distinct().count() == 21_000
