"""Decoding by the bytes of tokens gives what the library's decoder gives."""

import random

from koine.llm import bpe


def test_decoding_joins_bytes(monkeypatch):
    c = bpe.codec(bpe.default_path())
    rng = random.Random(3)
    n = len(c.names)
    rows = [[i] for i in range(n)] + [[rng.randrange(n) for _ in range(4)] for _ in range(2000)] + [[]]
    want = c.tokenizer.decode_batch(rows, skip_special_tokens=False)
    assert [c.decode([x])[0] for x in rows] == want and c.decode(rows) == want
    texts = ["", "plain words, twice  spaced", "naïve 日本語 \U0001f600‍\n\t", "x<|endoftext|>y", "\x00\x7f­Ġ"]
    ids = c.encode(texts)
    monkeypatch.setattr(c, "tokenizer", None)  # texts need no decoder
    assert c.decode(ids) == texts
