"""Repeated-passage removal with prefix-partitioned suffix trees.

The suffixes of all texts (one at every word) are split by variable-length
prefixes of words: a prefix that too many suffixes share is extended by a word
until its share is small, so that every group's subtree fits in memory.  Of a
subtree only what lies at depth ``WINDOW`` matters: an internal node there with
leaves in several documents is a repeat, and such nodes at consecutive words of
a text join to a longer, maximal one.  Edge labels are fingerprints of paths of
``WINDOW`` words.

1. Chunks are ranges of the document id, so a smaller range holds smaller ids.
2. Most suffixes end in leaves of their own above that depth.  A chunk sends
   each group the sorted fingerprints of its distinct paths of ``WINDOW`` words,
   and learns which of them other ranges have, too; only these suffixes can
   reach a node.  Copies inside a chunk are combined first, so a passage that a
   third of all documents share is one entry per chunk.
3. A chunk sends second, independent fingerprints of those paths, made from
   their words anew.  The group sorts them, and runs of equal ones are its nodes
   with their leaf sets.  Each chunk is told at which of its leaves the node has
   a leaf of a smaller range.
4. A chunk joins this with its own repeats, whose words it compares, marks the
   covered words and returns its documents.

Between chunks two paths are thus the same when 128 bits are, of hashes made
independently from the words: a path that only looks repeated needs accidents
in both, with odds of about ``(n / 2**64)**2`` among ``n`` paths of a group.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from koine.llm.chunks import id_ranges, layout, packed, text_of, text_size, unpacked
from koine.llm.tables import table
from koine.llm.text import (
    buffers, combine, mix, pack_bytes, pack_sorted, releasing, releasing_cogroup, releasing_group, slices, strings, U, unpack_bytes, unpack_sorted, Words, words,
)
from koine.sources.scratch import written

WINDOW = 13
#: Suffixes whose prefixes are counted at once, some 28 MB of text, and occurrences among them below which one is not reported.
COUNT_ROWS = 4 << 20
LEAST = 2
#: Labels in a task that builds a subtree's nodes, and windows whose words are compared at once.
LABELS = 1 << 20
SECOND = 1


def _prefix(w: Words, at: np.ndarray, depth: int) -> np.ndarray:
    return combine([w.hashes[at + j] for j in range(depth)], depth)


def heavy_prefixes(docs: DataFrame, text_col: str, groups: int, window: int) -> dict[int, np.ndarray]:
    """By length, the prefixes with more than 1 / (2 ``groups``) of all suffixes,
    counted over the whole corpus.

    A task counts ``COUNT_ROWS`` suffixes at once and leaves out prefixes with
    less than half of that share, or fewer than ``LEAST``, among them.  What is
    missing in a sum is thus under half of the share, or one per count; with as
    many suffixes in a count as there are groups that is less than a group's.
    There are at most two prefixes per group and length, so the list grows as
    ``groups`` does (``layout``: the square root of the text)."""
    share = 1.0 / (2 * groups)

    def counted(hashes: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
        own, at = np.concatenate(hashes), np.concatenate(at)
        depth, prefix, count = [0], [np.zeros(1, U)], [np.array([len(at)])]
        least = max(LEAST, share / 2 * len(at))
        for d in range(1, window):
            values, where, n = np.unique(combine([own[at + j] for j in range(d)], d), return_inverse=True, return_counts=True)
            heavy = n >= least
            if not heavy.any():
                break
            depth += [d] * int(heavy.sum())
            prefix.append(values[heavy])
            count.append(n[heavy])
            at = at[heavy[where]]
        return pa.RecordBatch.from_arrays(
            [pa.array(depth, pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)), pa.array(np.concatenate(count).astype(np.int64))], ["d", "p", "n"]
        )

    def run(batches):
        hashes, starts, words_held, held = [], [], 0, 0
        for b in batches:
            text = strings(b.column(0))
            for a, z in slices(text):
                w = words(text, a, z)
                _, at = w.windows(window)
                hashes.append(w.hashes)
                starts.append(at + words_held)
                words_held += len(w.hashes)
                held += len(at)
                if held >= COUNT_ROWS:
                    yield counted(hashes, starts)
                    hashes, starts, words_held, held = [], [], 0, 0
        if held:
            yield counted(hashes, starts)

    counts = written(docs.select(text_col).mapInArrow(releasing(run), "d int, p long, n long").groupBy("d", "p").agg(F.sum("n").alias("n")), "prefixes")
    total = counts.where("d = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    got = counts.where((F.col("d") > 0) & (F.col("n") > share * total)).select("d", "p").toArrow()
    depth, prefix = np.asarray(got["d"]), np.asarray(got["p"]).view(U)
    return {int(d): np.sort(prefix[depth == d]) for d in np.unique(depth)}


def _group_of(w: Words, at: np.ndarray, heavy: dict[int, np.ndarray], groups: int, window: int) -> np.ndarray:
    key = _prefix(w, at, 1)
    active = np.arange(len(at))
    for d in range(1, window):
        if d not in heavy or not len(active):
            break
        k = key[active]
        near = np.minimum(np.searchsorted(heavy[d], k), len(heavy[d]) - 1)
        active = active[heavy[d][near] == k]
        key[active] = _prefix(w, at[active], d + 1)
    return (mix(key) % U(groups)).astype(np.int32)


class Chunk:
    """A chunk's documents by id and its distinct paths, ordered by group and
    fingerprint; with ``second`` also the other fingerprints, with ``labels`` the words."""

    def __init__(self, packs, heavy: dict[int, np.ndarray], groups: int, window: int, second: bool = False, labels: bool = False):
        rows = unpacked(packs)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")]))
        self.window = window
        self.ids = np.asarray(rows["doc_id"].combine_chunks())
        self.text = text_of(rows)
        path, other, group, start, doc, first = [], [], [], [], [], [np.zeros(1, np.int64)]
        plain, low, high, size = [], [], [], 0
        for a, z in slices(self.text):
            w = words(self.text, a, z)
            fp, at = w.windows(window)
            path.append(fp)
            group.append(_group_of(w, at, heavy, groups, window))
            start.append(at + first[-1][-1])
            doc.append(np.searchsorted(w.first, at, side="right") - 1 + a)
            first.append(w.first[1:] + first[-1][-1])
            if second:
                other.append(w.windows(window, SECOND)[0])
            if labels:
                joined, starts, ends = w.joined()
                plain.append(joined)
                low.append(starts + size)
                high.append(ends + size)
                size += len(joined)
        self.first = np.concatenate(first)
        cat = lambda x, t: np.concatenate(x).astype(t, copy=False) if x else np.zeros(0, t)
        self.start, self.doc = cat(start, np.int64), cat(doc, np.int64)
        self.plain, self.low, self.high = cat(plain, np.uint8), cat(low, np.int64), cat(high, np.int64)
        path, group, self.second = cat(path, U), cat(group, np.int32), cat(other, U)
        # the group goes into the order, not only the fingerprint: equal paths have equal groups
        self.paths, self.at, self.where = np.unique(path, return_index=True, return_inverse=True)
        own = group[self.at]
        self.order = np.argsort(own, kind="stable")
        self.groups, self.cuts = np.unique(own[self.order], return_index=True)
        self.cuts = np.append(self.cuts, len(own))

    def parts(self):
        for g, a, z in zip(self.groups, self.cuts[:-1], self.cuts[1:], strict=True):
            yield int(g), self.order[a:z]

    def labels(self, windows: np.ndarray) -> pa.Array:
        """The words of some windows, one space between them."""
        a = self.low[self.start[windows]]
        size = self.high[self.start[windows] + self.window - 1] - a
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.plain[np.repeat(a - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(windows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])

    def covered(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Which words lie in a window that starts in a document of a smaller id."""
        seen = np.zeros(len(self.paths), dtype=bool)
        for g, own in self.parts():
            if g in answers:
                seen[own] = answers[g][: len(own)]
        ids, model = self.ids[self.doc], self.at[self.where]
        repeat = seen[self.where] | (ids > ids[model])
        again = np.flatnonzero(repeat & (model != np.arange(len(model))))
        # the words decide, here too
        for k in range(0, len(again), LABELS):
            part = again[k : k + LABELS]
            repeat[part] = np.asarray(pc.equal(self.labels(part), self.labels(model[part])))
        n = int(self.first[-1])
        marks = np.bincount(self.start[repeat], minlength=n + 1) - np.bincount(self.start[repeat] + self.window, minlength=n + 1)
        return np.cumsum(marks)[:n] > 0


def nodes(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in the order of their labels, and where each node of equal labels begins."""
    order = np.argsort(labels, kind="stable")
    ordered = labels[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _documents(text: pa.Array, ids: pa.Array, first: np.ndarray, covered: np.ndarray, with_text: bool) -> pa.Table:
    data, offsets = buffers(text)
    sums = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
    removed = sums[first[1:]] - sums[first[:-1]]
    digests, kept, spans = [], [], []
    for i in range(len(text)):
        own = data[offsets[i] : offsets[i + 1]].tobytes().split()
        if removed[i]:
            own = [x for x, c in zip(own, covered[first[i] : first[i + 1]].tolist(), strict=True) if not c]
        joined = b" ".join(own)
        digests.append(hashlib.sha256(joined).hexdigest())
        if with_text:
            kept.append(joined.decode())
            edges = np.flatnonzero(np.diff(covered[first[i] : first[i + 1]].astype(np.int8), prepend=0, append=0))
            spans.append([{"start": a, "end": z} for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
    columns = {"doc_id": ids.cast(pa.int64()), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed), "kept_sha256": pa.array(digests, pa.string())}
    if with_text:
        columns |= {"kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
    return pa.table(columns)


_TOLD = "chunk int, grp int, n int, blob binary"
_MET = "chunk int, grp int, n int, parts int, bits binary"
_SHOWN = "chunk int, grp int, part int, n int, bits binary, labels binary"
_ANSWER = "chunk int, grp int, n int, bits binary"
_ARROW = {"int": pa.int32(), "binary": pa.binary()}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(list(c), _ARROW[t]) for (_, t), c in zip(fields, columns, strict=True)], names=[f for f, _ in fields])


def _bits(blob, n: int) -> np.ndarray:
    return np.unpackbits(unpack_bytes(blob, -(-n // 8)), count=n).astype(bool)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row; with ``with_text``
    also ``kept_text`` and ``spans``, the maximal runs of removed words as
    ``[start, end)``.

    A word is removed when a run of ``window`` words around it also starts in a
    document with a smaller id.  Rows of equal id never remove each other's
    words.  Null text has no words.  Rows with a null id are returned with
    nothing removed and remove nothing.  Texts shorter than a window are kept.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, spans array<struct<start:int,end:int>>" if with_text else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")

    def whole(batches):
        for b in batches:
            text = strings(b.column(1))
            for a, z in slices(text):
                w = words(text, a, z)
                yield from _documents(text.slice(a, z - a), b.column(0).slice(a, z - a), w.first, np.zeros(len(w.hashes), bool), with_text).to_batches()

    rest = unknown.mapInArrow(releasing(whole), schema)
    _, size = text_size(known, "text")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, groups = layout(size, parallel)
    ranges = id_ranges(known, "doc_id", "text", chunks)
    if ranges is None:
        return rest
    heavy = heavy_prefixes(known, "text", groups, window)

    def chunk_of(b: pa.RecordBatch):
        spread = lambda rows: np.array([zlib.crc32(t.as_buffer()) for t in b.column(1).take(pa.array(rows)).fill_null("")], dtype=np.int64)
        return ranges.of(np.asarray(b.column(0)), spread), b

    packs = packed(known, chunk_of)

    def tell(key, rows):
        c = Chunk(rows["pack"], heavy, groups, window)
        return _table(_TOLD, [(key[0].as_py(), g, len(own), pack_sorted(c.paths[own])) for g, own in c.parts()])

    def meet(key, rows):
        """Which paths of each chunk another range has, too."""
        chunk, n = np.asarray(rows["chunk"]), np.asarray(rows["n"])
        blobs = rows["blob"]
        path = np.concatenate([unpack_sorted(blobs[k].as_buffer(), int(n[k])) for k in range(len(n))])
        at = np.repeat(ranges.range_of(chunk), n)
        _, where = np.unique(path, return_inverse=True)
        low, high = np.full(len(path), len(ranges.edges)), np.zeros(len(path), dtype=np.int64)
        np.minimum.at(low, where, at)
        np.maximum.at(high, where, at)
        shared = (low < high)[where]
        parts = -(-int(shared.sum()) // LABELS)
        ends = np.cumsum(n)
        got = [(int(c), key[0].as_py(), int(k), parts, pack_bytes(np.packbits(bits))) for c, k, z in zip(chunk, n, ends, strict=True) if (bits := shared[z - k : z]).any()]
        return _table(_MET, got)

    def show(key, left, right):
        """The second fingerprints of the paths that others have."""
        if not left.num_rows or not right.num_rows:
            return _table(_SHOWN, [])
        c = Chunk(left["pack"], heavy, groups, window, second=True)
        met = {r["grp"]: r for r in right.to_pylist()}
        got = []
        for g, own in c.parts():
            if g not in met:
                continue
            shared = _bits(met[g]["bits"], len(own))
            part = (c.paths[own] >> U(32)) % U(met[g]["parts"])
            for p in np.unique(part[shared]).tolist():
                mine = shared & (part == p)
                got.append((key[0].as_py(), g, int(p), len(own), pack_bytes(np.packbits(mine)), c.second[c.at[own[mine]]].tobytes()))
        return _table(_SHOWN, got)

    def grow(key, rows):
        """A group's nodes: which leaves have a leaf of a smaller range at theirs."""
        chunk = np.asarray(rows["chunk"])
        own = [np.frombuffer(x.as_buffer(), dtype=U) for x in rows["labels"]]
        size = np.array([len(x) for x in own])
        order, node = nodes(np.concatenate(own))
        at = np.repeat(ranges.range_of(chunk), size)[order]
        least = np.repeat(np.minimum.reduceat(at, node), np.diff(np.append(node, len(at))))
        again = np.zeros(len(at), dtype=bool)
        again[order] = at > least
        got, end = [], 0
        for c, n, k, bits in zip(chunk.tolist(), rows["n"].to_pylist(), size.tolist(), rows["bits"], strict=True):
            mine = again[end : end + k]
            end += k
            if mine.any():
                full = np.zeros(n, dtype=bool)
                full[_bits(bits.as_buffer(), n)] = mine
                got.append((c, key[0].as_py(), n, pack_bytes(np.packbits(full))))
        return _table(_ANSWER, got)

    def apply(key, left, right):
        if not left.num_rows:
            return pa.schema([("doc_id", pa.int64())]).empty_table()
        c = Chunk(left["pack"], heavy, groups, window, labels=True)
        answers: dict[int, np.ndarray] = {}
        for g, n, b in zip(*(right[x].to_pylist() for x in ("grp", "n", "bits")), strict=True):
            answers[g] = answers.get(g, False) | _bits(b, n)
        return _documents(c.text, pa.array(c.ids), c.first, c.covered(answers), with_text)

    told = packs.groupBy("chunk").applyInArrow(releasing_group(tell), _TOLD)
    met = told.groupBy("grp").applyInArrow(releasing_group(meet), _MET)
    shown = packs.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(releasing_cogroup(show), _SHOWN)
    answers = shown.groupBy("grp", "part").applyInArrow(releasing_group(grow), _ANSWER)
    done = packs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(releasing_cogroup(apply), schema)
    return done.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
g AS (SELECT r, doc_id, j, list(word) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM x),
k AS (SELECT r, doc_id, j, array_to_string(k, ' ') AS k FROM g WHERE len(k) = 13),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
c AS (SELECT DISTINCT r, unnest(range(j, j + 13)) AS j FROM k JOIN f USING (k) WHERE first < doc_id),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t FROM x ANTI JOIN c USING (r, j) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
