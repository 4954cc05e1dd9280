"""The pipeline and its stages on empty tables, nulls, ties and clashing columns."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, block long, slot long, id long, keep_id long, position long, sha string, mix_block string"
LABELS = "doc_id long, quality int, toxic int"


def put(spark, path, rows, labels=()):
    more = ("r", 1, 2, 3, 4, 5, "s", "m")
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *more) for i, t, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def walk(spark, path):
    """Each stage's rows, by its name."""
    at = spark.read.parquet(f"{path}/documents.parquet")
    columns, out = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, at, path)
        assert name == "encoding" or got.columns == columns
        got.write.parquet(f"{path}/{name}")
        at = spark.read.parquet(f"{path}/{name}")
        out[name] = at.collect()
    return out


def test_empty_tables(spark, tmp_path):
    path = put(spark, tmp_path, [])
    assert all(not rows for rows in walk(spark, path).values()) and corpus_pipeline.run(spark, path).count() == 0


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    long = " ".join(f"w{k % 700}" for k in range(40_000))
    near = " ".join(f"v{k}" for k in range(60))
    rows = [(None, None, None), (None, "a b", None), (None, "a b", "x"), (1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "a  b", "y"), (4, "a b", "y"), (5, long, None), (6, long, "y"),
            (7, near, "x"), (7, near, "x"), (8, near + " more", "x"), (9, near.upper(), "z")]
    path = put(spark, tmp_path, rows)
    out = walk(spark, path)
    assert len(out["quality"]) == len(rows)  # no labels, no decision
    exact = [(r["doc_id"], r["text"]) for r in out["exact_dedup"]]
    assert sorted(i for i, _ in exact) == [1, 3, 4, 5, 7, 8, 9]
    left = sorted(r["doc_id"] for r in out["near_dedup"])
    assert left == [1, 3, 4, 5, 7] and sorted(r["doc_id"] for r in out["mixing"]) == left
    done = {r["doc_id"]: r for r in out["encoding"]}
    assert sorted(r["position"] for r in done.values()) == list(range(5)) and done[1]["n_tokens"] == 0 and len(done[5]["ids"]) == done[5]["n_tokens"] > 40_000
    again = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, path).collect()}
    assert again == {i: r["ids_sha256"] for i, r in done.items()}
