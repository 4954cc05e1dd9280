"""Quality ranking, mixing, encoding and neighbours."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from koine.llm import bpe, mixing, neighbours, quality

DOC = "doc_id long, text string, source string, row string, src string, block long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 0.5) if len(r) == 3 else (*r, "s", "x", "y", 1, 0.5) for r in rows], DOC)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def quality_rows(n=300):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "house", "of", "water", "green", "small"]) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(8, 80)))
    bad = [lambda: "%$# " * rng.randrange(5, 50), lambda: "BUY NOW!! " * rng.randrange(4, 40), lambda: "spam " * rng.randrange(8, 90)]
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.7)
        rows.append((i, good() if y else rng.choice(bad)()))
        labels.append((i, y, 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    frame, marks = docs(spark, [*rows, (900, None), (901, ""), (902, "x " * 50_000), (None, "the house of water")]), spark.createDataFrame([*labels, (900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, marks)
    got = {r["doc_id"]: r for r in quality.scores(frame, model).collect()}
    truth = {i: y for i, y, _ in labels}
    tested = [i for i in truth if held(i)]
    assert np.mean([got[i]["predicted"] == truth[i] for i in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values()) and len(got) == 304
    # labels of held-out rows are never read
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y, 0) for i, y, _ in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(quality.train(frame, flipped).weights, model.weights)
    kept = quality.keep_good(frame, marks)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = docs(spark, [(1, "a"), (1, "a"), (2, None)])
    assert [r["score"] for r in quality.scores(frame, quality.train(frame, none)).collect()] == pytest.approx([0.5] * 3)
    assert quality.keep_good(frame, none).count() == 3
    assert quality.scores(frame.limit(0), quality.train(frame, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))).count() == 0


def test_pairwise_scores_order_by_strength():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.1 * rng.standard_normal(2000) > 0).astype(int)
    m = quality.fit(x, y)
    assert m.weights[0] > 0 > m.weights[1] and abs(m.weights[2]) < 0.3 * m.weights[0]
    assert np.mean((m.score(x) >= 0.3) == (y == 1)) > 0.95
    assert abs(np.mean(m.score(x) < 0.3) - np.mean(y == 0)) < 0.01


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 7, "b": 1, "c": 1, "d": 1e-9}, {f"s{k}": 1 + k % 7 for k in range(50)}])
def test_schedule_stays_within_a_block(weights):
    slots = mixing.apportion(weights, 200)
    d = sum(slots.values())
    order = sorted((s, k) for k, own in mixing.schedule(slots).items() for s in own)
    assert [s for s, _ in order] == list(range(d))
    seen = Counter()
    for t, (_, k) in enumerate(order, 1):
        seen[k] += 1
        assert all(abs(seen[x] - t * slots[x] / d) < 1 for x in slots)


def test_mixing_keeps_all_rows_and_the_targets(spark):
    rng = random.Random(3)
    rows = [(i, f"t{i}", rng.choice(["hot"] * 4 + ["a", "b", "c", None])) for i in range(3000)] + [(5, "t5", "a")] * 40 + [(None, None, "a")]
    frame = docs(spark, rows).repartition(6)
    weights = {"hot": 0.4, "a": 0.3, "b": 0.2, "c": 0.06, None: 0.04}
    got = mixing.mixed(frame, weights, block_rows=4).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    counts = Counter(s for _, _, s in rows)
    by = sorted((r["slot"], r["offset"], str(r["source"])) for r in got)
    assert len({(s, o) for s, o, _ in by}) == len(by) and len({(s, x) for s, _, x in by}) == len({s for s, _, _ in by})
    ends = min((counts[k] // 4) / w for k, w in weights.items())
    seen = Counter()
    for t, s in enumerate(range(int(ends)), 1):
        seen.update({x for q, _, x in by if q == s})
        assert all(abs(seen[str(k)] - t * w) < 1 + 1e-6 for k, w in weights.items())
    ordered = mixing.in_order(frame, weights, block_rows=4)
    assert ordered.columns == frame.columns
    place = {}
    for r in got:
        place.setdefault((r["doc_id"], r["source"]), []).append((r["slot"], r["offset"]))
    walk = [min(place[r["doc_id"], r["source"]]) for r in ordered.collect() if r["doc_id"] != 5]
    assert walk == sorted(walk)


def test_mixing_defaults_and_empty(spark):
    frame = docs(spark, [(i, "t", "x" if i % 3 else "y") for i in range(100)])
    assert mixing.mixed(frame).count() == 100 and mixing.mixed(frame.limit(0)).count() == 0 and mixing.in_order(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.apportion({"a": 0.0})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_path())


@pytest.mark.parametrize("seed", range(6))
def test_encoding_equals_the_library(codec, seed):
    rng = random.Random(seed)
    pieces = ["a", "b", "ab", "the", "é", "日本", " ", "  ", "\n", "'s", "!!", "1", "<|endoftext|>", "\t", "\xa0", "\x85", "xxxxx", "\u3000", "🙂", "\x1c"]
    texts = [""]
    for n in (1, 7, 100, 4000):
        t = "".join(rng.choice(pieces) for _ in range(n))
        texts += [t, t + "".join(rng.choice("ab") for _ in range(3000)) + t, t + " " * 2000 + "word" + "\n" * 1500 + "z", "a" * 4000 + t + "!" * 3000 + "é" * 2000, (t + " ") * 30]
    assert codec.encode(texts) == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert codec.decode(codec.encode(texts)) == texts


@pytest.mark.parametrize("alphabet", ["ab", "aaab", "the", "éa", "=-", "01", "\U0001f642", " ", "\n "])
def test_tree_concatenation_is_exact(codec, alphabet):
    rng = random.Random(alphabet)
    for leaf in (1, 2, 3, 7, 64):
        for _ in range(8):
            run = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 50, 900])))
            got = [i for i, _ in bpe.encode_run(run, codec._leaves, codec._merges, leaf)]
            assert got == codec.tokenizer.encode(run, add_special_tokens=False).ids
    assert bpe.encode_run("", codec._leaves, codec._merges) == []


def test_tokenize_frame(spark, codec):
    rows = [(1, None), (2, ""), (3, "Hello world, <|endoftext|> é"), (3, "Hello world, <|endoftext|> é"), (4, "ab" * 40_000), (5, "lorem ipsum " * 9000), (None, "x")]
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.tokenize(docs(spark, rows), with_ids=True).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, t in rows:
        ids = codec.tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(codec.tokenizer.decode(ids, skip_special_tokens=False)), tuple(ids)))
    assert got == sorted(expected, key=str)
    assert bpe.tokenize(docs(spark, rows).limit(0)).count() == 0


def test_hilbert_walks_through_every_cell_by_unit_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = neighbours.hilbert(cells, bits)
        assert sorted(key) == list(range(side**dims))
        assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def vectors(spark, x, more=()):
    rows = [(i, [float(v) for v in x[i]], 0, 1, "c") for i in range(len(x))] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block int, k1 string")


def exact(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [o for o in np.lexsort((ids, d)) if ids[o] != ids[q]][:k]
    return [(int(ids[o]), float(d[o])) for o in order]


@pytest.mark.parametrize("shape", ["clusters", "noise"])
def test_recall(spark, shape):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    if shape == "clusters":
        x = (x * 0.05 + rng.standard_normal((40, 16)).astype(np.float32)[rng.integers(0, 40, 4000)]).astype(np.float32)
    x[100:140] = x[100]  # equal vectors
    bad = [(90_000, None, 0, 1, "c"), (90_100, [0.0] * 16, 0, 1, "c"), (90_200, [float("nan")] + [1.0] * 15, 0, 1, "c"), (90_300, [None] + [1.0] * 15, 0, 1, "c"), (90_400, [1.0] * 3, 0, 1, "c"), (90_500, [], 0, 1, "c"), (None, [1.0] * 16, 0, 1, "c"), (90_600, [float("inf")] * 16, 0, 1, "c")]
    got = neighbours.search(vectors(spark, x, bad), F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    xd, ids = x.astype(np.float64), np.arange(4000)
    assert set(by) == set(range(0, 4000, 100)) and all(len(v) == 10 for v in by.values())
    hits = 0
    for q, own in by.items():
        true = exact(xd, ids, q, 10)
        hits += len({i for i, _ in own} & {i for i, _ in true})
        assert own == sorted(own, key=lambda p: (p[1], p[0])) and all(s == float(np.sqrt(((xd[i] - xd[q]) ** 2).sum())) for i, s in own)
    assert hits / 400 >= 0.9
    assert by[100] == [(i, 0.0) for i in range(101, 111)]


def test_few_rows(spark):
    x = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.float32)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(vectors(spark, x), F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, pytest.approx(2**0.5))]
    assert neighbours.search(vectors(spark, x[:1]), F.col("vec_id") == 0).count() == 0
    assert neighbours.search(vectors(spark, x).limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.search(vectors(spark, x), F.col("vec_id") == 77).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = quality_rows(150)
    text = " ".join(f"word{k}" for k in range(40))
    rows += [(1000, text), (1001, text), (1002, text + " more"), (1003, text + "  more"), (1004, None)]
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "encoding":
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        counts[name] = {r["doc_id"] for r in at.collect()}
    assert 1000 in counts["near_dedup"] and not {1001, 1002, 1003} & counts["near_dedup"]
    assert counts["mixing"] == counts["near_dedup"] == counts["encoding"] and counts["exact_dedup"] < counts["quality"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r["doc_id"], r["ids_sha256"]) for r in again.collect()} == {(r["doc_id"], r["ids_sha256"]) for r in at.collect()}
