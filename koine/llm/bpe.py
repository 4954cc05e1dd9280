"""Byte-level BPE encoding and decoding with tree concatenation.

Texts are encoded in batches by the ``tokenizers`` library.  A long text is cut
into leaves wherever their size says, all encoded in one batch; level by level
neighbours are joined: a window around the seam is encoded again and grows on
either side until it ends where the pre-tokeniser always cuts (a space after a
character that is no white space) and its first and last tokens are those that
its sides have there.  What lies outside the window does not depend on the cut,
so the sequence is the encoding of both parts together.

Where a text has no such places, a long run that is not split before the merges,
the run itself is cut down to leaves, which are joined likewise on the merges:
adjacent tokens then are pairs that the merges produce, on both sides and inside
the window, which makes the sequence the encoding of the whole run.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from koine.llm.tables import table
from koine.llm.text import SPACE, buffers, releasing, slices, strings

#: Characters in a leaf of a long text, longest run without a place to cut, and characters in a leaf of such a run.
PIECE = 16_384
RUN = 1_024
LEAF = 256
BATCH_BYTES = 512 << 10


Tokens = list[tuple[int, str]]


def long_runs(text: pa.Array, run: int = RUN) -> np.ndarray:
    """Which texts have ``run`` bytes or more on end that are all ASCII white
    space or all not: a run without a place to cut is among them."""
    data, offsets = buffers(text)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    space = SPACE[data]
    start = np.zeros(len(data) + 1, dtype=bool)
    start[1:-1] = space[1:] != space[:-1]
    start[offsets] = True
    at = np.flatnonzero(start)
    out = np.zeros(len(text), dtype=bool)
    out[np.searchsorted(offsets, at[:-1][np.diff(at) >= run], side="right") - 1] = True
    return out


def concatenate(left: Tokens, right: Tokens, encode: Callable[[str], Tokens]) -> Tokens:
    """The encoding of two neighbouring parts of a run from theirs."""
    if not left or not right:
        return left + right
    i = j = 1
    while True:
        i, j = min(i, len(left)), min(j, len(right))
        window = encode("".join(v for _, v in left[len(left) - i :]) + "".join(v for _, v in right[:j]))
        left_agrees = i == len(left) or window[0] == left[-i]
        right_agrees = j == len(right) or window[-1] == right[j - 1]
        if left_agrees and right_agrees:
            return left[: len(left) - i] + window + right[j:]
        i, j = i * (1 if left_agrees else 2), j * (1 if right_agrees else 2)


def encode_run(run: str, leaves: Callable[[list[str]], list[Tokens]], encode: Callable[[str], Tokens], leaf: int = LEAF) -> Tokens:
    """Encode a run that is not split before the merges: all leaves in one
    batch, then level by level joins of neighbours.  ``leaves`` takes pieces of
    text, ``encode`` a window in the byte alphabet."""
    level = leaves([run[k : k + leaf] for k in range(0, len(run), leaf)])
    while len(level) > 1:
        level = [concatenate(*level[k : k + 2], encode) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else []


class Codec:
    """Encoder and decoder for the tokenizer file at ``path``.  Only texts of
    byte-level vocabularies are cut.

    Batches, of pieces and of leaves, are encoded in parallel if the environment
    sets TOKENIZERS_PARALLELISM (for tasks of several cores)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        self.special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        said = json.loads(t.to_str())
        steps = said["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        #: The bytes of each token, where the decoder only joins them.
        self.bytes = self._spelled() if (said["decoder"] or {}).get("type") == "ByteLevel" else None
        #: Whether tokens spell the bytes of a text as it is, so that parts can be joined by their bytes.
        self.byte_level = said["normalizer"] is None and any(s.get("type") == "ByteLevel" for s in steps) and not any(s.get("add_prefix_space") for s in steps)
        vocabulary = t.get_vocab(with_added_tokens=True)
        most = max(vocabulary.values(), default=-1) + 1
        self.names = [str(i) for i in range(most)]
        # of each token: its bytes, whether it begins with a space, whether it ends with an ASCII character that is no white space
        self.size, self.opens, self.closes = [0] * most, [False] * most, [False] * most
        for token, i in vocabulary.items():
            special = i in self.special.values()
            self.size[i] = len(token.encode()) if special else len(token)
            self.opens[i] = not special and token.startswith("\u0120")  # the byte alphabet's space
            self.closes[i] = "!" <= token[-1:] <= "~"

    def _spelled(self) -> list[bytes | None]:
        """What each token stands for: its characters' bytes, or itself if one of them is not in the byte alphabet."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out: list[bytes | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            own = [alphabet.get(c) for c in token]
            out[i] = token.encode() if None in own else bytes(own)
        return out

    def _merges(self, run: str) -> Tokens:
        return [(x.id, x.value) for x in self.tokenizer.model.tokenize(run)]

    def _leaves(self, pieces: list[str]) -> list[Tokens]:
        return [list(zip(e.ids, e.tokens, strict=True)) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _unsplit(self, text: str) -> list[int]:
        """A text with a long unsplit run, pre-token by pre-token."""
        out: list[int] = []
        seen: dict[str, list[int]] = {}
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for mapped, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part) if part else ():
                ids = seen.get(mapped)
                if ids is None:
                    tokens = encode_run(part[a:z], self._leaves, self._merges) if len(mapped) > RUN else self._merges(mapped)
                    ids = [i for i, _ in tokens]
                    if len(mapped) < 64:
                        seen[mapped] = ids
                out += ids
        return out

    def _safe(self, before: int, after: int) -> bool:
        """Whether the pre-tokeniser always cuts between two tokens."""
        return self.opens[after] and self.closes[before]

    def join(self, left: list[int], right: list[int], data: bytes, seam: int) -> list[int]:
        """The encoding of two neighbouring parts of ``data`` from theirs, which meet at byte ``seam``."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            while i < len(left) and not self._safe(left[-i - 1], left[-i]):
                i += 1
            while j < len(right) and not self._safe(right[j - 1], right[j]):
                j += 1
            low = seam - sum(self.size[x] for x in left[len(left) - i :])
            high = seam + sum(self.size[x] for x in right[:j])
            window = self._ids(data[low:high].decode())
            left_agrees = i == len(left) or window[0] == left[-i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[: len(left) - i] + window + right[j:]
            i, j = min(len(left), i * (1 if left_agrees else 2)), min(len(right), j * (1 if right_agrees else 2))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def grown(self, pieces: list[str], coded: list[list[int]]) -> list[int]:
        """The encoding of a whole text from those of its pieces."""
        blobs = [x.encode() for x in pieces]
        data = b"".join(blobs)
        ends = np.cumsum([len(b) for b in blobs]).tolist()
        level = list(zip(coded, ends, strict=True))  # tokens and where the part ends
        while len(level) > 1:
            joined = [(self.join(x, y, data, seam), end) for (x, seam), (y, end) in zip(level[::2], level[1::2])]
            level = joined + level[2 * len(joined) :]
        return level[0][0]

    def encode(self, texts: pa.Array | list[str]) -> list[list[int]]:
        """Token ids of each text."""
        column = texts if isinstance(texts, pa.Array) else strings(pa.array(texts, pa.string()))
        pieces: list[str] = []
        plan: list[list[int] | tuple[int, int]] = []
        for t, unsplit in zip(column.to_pylist(), long_runs(column), strict=True):
            if unsplit:
                plan.append(self._unsplit(t))
            else:
                own = [t[k : k + PIECE] for k in range(0, len(t), PIECE)] if self.byte_level and len(t) > PIECE else [t]
                plan.append((len(pieces), len(own)))
                pieces += own
        coded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        out = []
        for p in plan:
            if isinstance(p, list):
                out.append(p)
            elif p[1] == 1:
                out.append(coded[p[0]].ids)
            else:
                out.append(self.grown(pieces[p[0] : sum(p)], [c.ids for c in coded[p[0] : sum(p)]]))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of token ids; the library decodes what is not joined bytes of a text."""
        if self.bytes is not None:
            try:
                spelled = self.bytes
                return [b"".join([spelled[i] for i in x]).decode() for x in ids]
            except (UnicodeDecodeError, IndexError, TypeError):
                pass
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def digest(self, ids: list[int]) -> str:
        names = self.names
        return hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids`` if asked for)
    of every whole text; one row per input row.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    Null text is encoded as the empty text: no tokens, digests of nothing.  A
    null id stays null; texts of any length are encoded whole.  Repeated rows give repeated results; other columns are not read, but for
    ``keep``, which are returned as they are; an empty table gives an empty result.
    """
    path = tokenizer or default_path()
    kept = [docs.schema[c] for c in keep]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            doc_ids, text = batch.column(0), strings(batch.column(1))
            for at, end in slices(text, BATCH_BYTES):
                ids = c.encode(text.slice(at, end - at))
                decoded = c.decode(ids)
                columns = [
                    doc_ids.slice(at, end - at).cast(pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([c.digest(x) for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                for k, name in enumerate(keep, 2):
                    columns.append(batch.column(k).slice(at, end - at))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col, *keep).mapInArrow(releasing(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))
