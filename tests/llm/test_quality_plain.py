"""Scores against a plain computation of the features, whole texts, one by one."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from koine.llm import quality
from koine.llm.text import buffers, strings, words
from tests.oracle import SF_DIR


def plain(text):
    data = (text or "").encode()
    w = data.split()
    n, some = len(w), max(len(w), 1)
    out = [sum(b in set(members) for b in data) / max(len(data), 1) for members in quality._CLASSES.values()]
    letter = lambda b: 97 <= (b | 32) <= 122 or b >= 128
    out += [math.log1p(n), sum(map(len, w)) / some / 10, sum(len(x) > 15 for x in w) / some, sum(not letter(x[0]) for x in w) / some, sum(not letter(x[-1]) for x in w) / some]
    out += [sum(w[k] == w[k - lag] for k in range(lag, n)) / some for lag in (1, 2, 3)]
    out += [len(set(w)) / some, len({(a, b) for a, b in zip(w, w[1:])}) / max(n - 1, 1)]
    classes = len(quality._CLASSES)
    return out + [math.sqrt(x) for x in out[:classes]] + [x * x for x in out[-7:]] + [x * out[classes] / 8 for x in out[-2:]]


def test_features():
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "a a a", "É! é, 12 #x", "tab\tand\nline  two", "x" * 40, *(" ".join(rng.choice(["the", "of", "Ünd", "9.9", "%%", "end.", "(a"]) for _ in range(rng.randrange(200))) for _ in range(30))]
    column = strings(pa.array(texts))
    got = quality.features(words(column, 0, len(column)), buffers(column)[1])
    assert np.allclose(got, np.array([plain(t) for t in texts]))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_the_registered_query(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality in (0, 1)").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    taught = sorted(i for i in labels if i in docs and not held[i])
    model = quality.fit(np.array([plain(docs[i]) for i in taught]), np.array([labels[i] for i in taught]))
    got = quality.query(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    scores = model.score(np.array([plain(docs[r["doc_id"]]) for r in got]))
    assert np.allclose([r["score"] for r in got], scores, atol=1e-6)
    assert all(r["held_out"] == held[r["doc_id"]] and r["predicted"] == (r["score"] >= 0.3) for r in got)
