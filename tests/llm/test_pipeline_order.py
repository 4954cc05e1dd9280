"""The mixture decides the pipeline's result."""

import corpus_pipeline
from koine.llm import bpe, mixing


def test_weights_change_the_positions_of_the_result(spark, tmp_path, monkeypatch):
    words = "the house of water green small old new river stone light wind tree cloud road field".split()
    text = lambda i: " ".join(words[(i * 7 + k * (1 + i % 5) + i // 16) % 16] + str((i * 31 + k) % 97) for k in range(30))
    rows = [(i, text(i), "en", "ab"[i % 2], 100) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    source = {r[0]: r[3] for r in rows}
    orders = []
    for weights in ({"a": 0.9, "b": 0.1}, {"a": 0.1, "b": 0.9}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "position").collect()
        assert sorted(r["position"] for r in got) == list(range(len(got)))
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])]
        kept = spark.createDataFrame([r for r in rows if r[0] in set(order)], "doc_id long, text string, lang string, source string, n_chars long")
        placed = mixing.mixed(kept, weights).collect()
        assert order == [r["doc_id"] for r in sorted(placed, key=lambda r: (r["slot"], r["offset"]))]
        orders.append([source[i] for i in order])
    assert len(orders[0]) == len(orders[1]) > 200
    assert orders[0][:96].count("a") >= 80 and orders[1][:96].count("b") >= 80


def test_kept_columns_over_several_slices(spark):
    rows = [(i, f"word{i} " * 60_000, 100 + i) for i in range(6)]
    out = bpe.tokenize(spark.createDataFrame(rows, "doc_id long, text string, position long").coalesce(1), keep=("position",)).collect()
    assert sorted((r["doc_id"], r["position"]) for r in out) == [(i, 100 + i) for i in range(6)]
