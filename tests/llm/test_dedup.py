"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from koine.llm import exact_dedup, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row string, sha string, id long, keep_id long, chunk int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "r", "x", 1, 2, 3) for i, t in rows], SCHEMA)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs = []
    for i in range(n):
        kind = rng.random()
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 60, 200]))]
        if kind < 0.25 and docs:
            base = WORD.findall(rng.choice(docs)[1] or "")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
        text = rng.choice([" ", "  ", "\n"]).join(base)
        if kind > 0.8:
            text += "\t" + passage
        docs.append((i * 3 if rng.random() < 0.9 else 6, text))
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (None, passage), (None, None), (5, "Ünïcode   wörds Ünïcode"), (7, "x" * 5000), docs[3], docs[3]]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed):
    docs = corpus(seed)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    expected = []
    for i, t in norm:
        own = [x for x in groups[t] if x is not None]
        keep = min(own) if own else None
        expected.append((i, keep, len(groups[t]), i == keep, sha(t)))
    got = [tuple(r) for r in exact_dedup.exact_groups(frame(spark, docs).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = exact_dedup.drop_copies(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(left) == len(groups) and {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in left} == set(groups)


def test_tree_of_many_runs(spark):
    rows = spark.range(500).select((F.col("id") % 37).cast("int").alias("run"), F.sha2((F.col("id") % 9).cast("string"), 256).alias("text_sha256"), F.lit(1).alias("n_bytes"), (F.col("id") % 9).alias("check"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    got = {r["keep_id"]: r["group_size"] for r in exact_dedup.tree_merge(rows, 37, fan=3).collect()}
    assert got == {k: len(range(k, 500, 9)) for k in range(9)}


def test_runs_of_many_batches(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 7)
    try:
        rows = [(k, f"text {k % 40}") for k in range(300)]
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(frame(spark, rows).repartition(5)).collect()}
        assert got == {k: (k % 40, len(range(k % 40, 300, 40))) for k in range(300)}
        plan = exact_dedup.exact_groups(frame(spark, rows).repartition(5))._jdf.queryExecution().executedPlan().toString()
        # two rounds over five runs: sorted runs before, between and after the exchanges
        assert plan.count("MapInArrow") >= 3 and plan.count("Sort [run") >= 3
    finally:
        spark.conf.unset(size)


def near_brute(docs):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    rows = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(lower))
        rows.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, s) for i, s in rows if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[a + 1 :]:
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return rows, find


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_groups(spark, seed):
    # ids are unique here: two texts of one id would be two sets of one node
    docs = list({i: (i, t) for i, t in corpus(seed, 90) if i is not None}.values())
    base = ["v%d" % k for k in range(100)]
    rng = random.Random(seed)
    for k in range(60):  # near copies that mostly meet through their common origin
        own = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            own[rng.randrange(100)] = f"u{k}{rng.random()}"
        docs.append((5000 + k, " ".join(own)))
    docs += [(4999, " ".join(base)), (8000, " ".join(base).upper()), (None, "a b c d e f"), (None, None)]
    rng.shuffle(docs)
    rows, find = near_brute(docs)
    expected = [(i, len(s), None if i is None else find(i)) for i, s in rows]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_groups(frame(spark, docs)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_drop_near_copies(spark):
    text = " ".join(f"v{k}" for k in range(50))
    docs = [(3, text), (1, text + " more"), (2, "another text entirely of some words"), (9, None), (10, "")]
    out = jaccard_join.drop_near_copies(frame(spark, docs))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 9, 10] and out.columns == frame(spark, docs).columns


def repeats_brute(docs, window=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k + 1 for k in sorted(gone) if k + 1 not in gone]
        out.append((i, len(w), len(gone), sha(kept), kept, list(zip(starts, ends, strict=True))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    docs = corpus(seed, 80) + [(20_000 + k, "the the the of the " * 12 + f"end{k % 3}") for k in range(20)]
    got = [(*r[:5], [(s["start"], s["end"]) for s in r["spans"]]) for r in substring_dedup.remove_repeats(frame(spark, docs), with_text=True).collect()]
    assert sorted(got, key=str) == sorted(repeats_brute(docs), key=str)


def test_chunks_and_groups_at_larger_size(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(k * 7, " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(300)) + (" " + passage if k % 3 == 0 else "")) for k in range(400)]
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()]
    assert sorted(got) == sorted(x[:4] for x in repeats_brute(docs))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    assert jaccard_join.near_groups(empty).count() == 0 and jaccard_join.drop_near_copies(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_ranges_keep_the_order_of_ids():
    import numpy as np

    from koine.llm.chunks import Ranges

    far = np.array([-(1 << 63), -5, 0, 1, 2, 3, 1 << 40, (1 << 63) - 1], dtype=np.int64)
    for r in (Ranges(int(far[0]), int(far[-1]), [0, 2, 1 << 40]), Ranges(0, 3, []), Ranges(5, 5, [5]), Ranges(0, 9, [1, 2, 2, 2, 5]), Ranges(3, 3, [3] * 4), Ranges(0, (1 << 63) - 1, [(1 << 63) - 1] * 2)):
        got = r.of(far)
        assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() < r.chunks
    hot = Ranges(0, 9, [1, 2, 2, 2, 5])
    ids = np.array([0, 1, 2, 2, 2, 3, 5, 9])
    assert hot.of(ids, lambda rows: rows).tolist() == [0, 1, 4, 2, 3, 5, 6, 6] and hot.range_of(np.arange(7)).tolist() == [0, 1, 2, 2, 2, 3, 4]


def test_ids_clustered_in_ranges_fill_their_chunks(spark):
    import numpy as np

    from koine.llm.chunks import id_ranges

    ids = [(k // 1000 << 40) + k % 1000 for k in range(6000)]  # time-prefixed
    docs = spark.createDataFrame([(i, "x" * (50_000 if n == 7 else 20)) for n, i in enumerate(ids)], "doc_id long, text string")
    for bounds in (60, 3000):
        r = id_ranges(docs, "doc_id", "text", bounds)
        counts = np.bincount(r.of(np.array(ids)), minlength=r.chunks)
        assert 0.7 * bounds <= r.chunks <= bounds + 2 and counts.max() <= 4 * 6000 / bounds


def test_one_id_over_several_chunks(spark, monkeypatch):
    from koine.llm import chunks

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2_000)
    rng = random.Random(5)
    shared = " ".join(f"p{k}" for k in range(30))
    docs = [(7 if k % 3 == 0 else k, " ".join(f"w{rng.randrange(400)}" for _ in range(40)) + (" " + shared if k % 4 == 0 else "")) for k in range(1, 240)]
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()]
    assert sorted(got) == sorted(x[:4] for x in repeats_brute(docs))


def test_layout_grows_with_the_square_root():
    from koine.llm.chunks import layout

    assert layout(0, 8) == (1, 1) and layout(100, 8) == (1, 1) and layout(1 << 24, 8) == (8, 16)
    assert layout(10**11, 8) == (23842, 15895)
    chunks, groups = layout(170 * 10**12, 1000)
    assert chunks * groups * 32 <= 170 * 10**12 / 6 * 1.1 and 10**5 < chunks < 10**7
