"""Long texts are cut anywhere and joined by windows; the registered query and its digests against the library."""

import hashlib
import os
import random

import pytest

from koine.llm import bpe
from tests.oracle import SF_DIR


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_path())


PIECES = ["the", " house", " of", "é", " 日本", " ", "  ", "\n", "\n\n", "'s", "!!", " 12", "<|endoftext|>", " <|endoftext|> ", "\t", "\xa0", "\x85", " xx", "　", " 🙂", "\x1c", " 'll", "ing", " http://a.b/c?d=e", "...", " -"]


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 17, 100])
@pytest.mark.parametrize("seed", range(4))
def test_any_cut_is_exact(codec, piece, seed, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", piece)
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.choice([3, 40, 300]))) for _ in range(12)]
    texts += ["word\n" * 80, " a" * 90, "a " * 90, "\n \n" * 40, "<|endoftext|>" * 9, " the quick brown fox" * 20]
    assert codec.encode(texts) == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_windows_stay_small(codec, monkeypatch):
    text = " ".join(f"word{k % 97} and more" for k in range(20_000))
    asked = []
    own = codec._ids
    monkeypatch.setattr(codec, "_ids", lambda t: asked.append(len(t)) or own(t))
    assert codec.encode([text]) == [codec.tokenizer.encode(text, add_special_tokens=False).ids]
    assert asked and max(asked) < 200 and len(asked) < 4 * len(text) / bpe.PIECE


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_the_registered_query_joins_long_texts(spark, codec):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert any(len(t) > bpe.PIECE for t in rows.values())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.query(spark, SF_DIR).collect():
        ids = codec.tokenizer.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(codec.tokenizer.decode(ids, skip_special_tokens=False))
