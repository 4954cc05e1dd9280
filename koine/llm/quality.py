"""Quality classification by Bradley-Terry pairwise ranking.

Documents of label 1 beat documents of label 0.  A linear score over text
features is learnt from such preference pairs by logistic loss on feature
differences (a Bradley-Terry model with covariates).  The threshold is a
quantile of the training documents' scores, the share of label 0 among them,
and the score is mapped so that this quantile falls on ``THRESHOLD``.

Features come from whole texts, computed in NumPy on Arrow buffers; labels,
language, source and id are no inputs.  Training uses every labelled row
outside the held-out fifth and every pair of a good and a bad one; means,
deviations and the quantile are of all those rows as well.

The loss depends on a pair only by the difference of two scores.  Rows are
therefore laid on a fine grid of scores, each on the six points around its own
with the weights of Lagrange interpolation, and the pairs are summed as pairs of
grid points: the gradient is that of all pairs to about 1e-10.  Each Newton step
is two passes over the feature vectors, and the driver holds sums by grid point
only.  All sums over rows are of integers (values times a power of two), so the
model is the same to the bit however the rows lie and wherever they are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from koine.llm.tables import table
from koine.llm.text import buffers, combine, mix, releasing, slices, strings, U, Words, words
from koine.sources.scratch import written

#: Training rows up to which the driver adds them itself, with the same result.
DRIVER_ROWS = 20_000
THRESHOLD = 0.3
RIDGE = 1e-3
#: Distance of the points of the grid of scores.
GRID = 1 / 16
#: Rows handled at once; products of matrices of so many rows are exact.
SLICE_ROWS = 8192

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": [33, 46, 63],
    "bang": [33],
    "comma": [44, 58, 59],
    "symbol": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 126],
    "bar": [47, 92, 95, 123, 124, 125],
    "quote": [34, 39, 40, 41, 91, 93, 96],
    "newline": [10],
    "high": range(128, 256),
}


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(mix(keys + doc.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(doc[at], minlength=n)


def features(w: Words, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of ``w``."""
    n = len(w.first) - 1
    offsets = (offsets - offsets[0]).astype(np.int64)
    size = np.maximum(np.diff(offsets), 1)
    count = np.diff(w.first)
    some = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), count)

    def per_text(flag: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[ends[1:]] - sums[ends[:-1]]

    columns = []
    for members in _CLASSES.values():
        lut = np.zeros(256, dtype=bool)
        lut[list(members)] = True
        columns.append(per_text(lut[w.data], offsets) / size)
    length = w.ends - w.starts
    first, last = w.data[w.starts], w.data[w.ends - 1]
    letter = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    same = lambda lag: np.concatenate([np.zeros(min(lag, len(doc)), bool), (w.hashes[lag:] == w.hashes[:-lag]) & (doc[lag:] == doc[:-lag])])
    columns += [
        np.log1p(count),
        per_text(length, w.first) / some / 10,
        per_text(length > 15, w.first) / some,
        per_text(~letter(first), w.first) / some,
        per_text(~letter(last), w.first) / some,
        per_text(same(1), w.first) / some,
        per_text(same(2), w.first) / some,
        per_text(same(3), w.first) / some,
        _distinct(w.hashes, doc, n) / some,
    ]
    pairs = combine([w.hashes[:-1], w.hashes[1:]], 1) if len(doc) > 1 else np.zeros(0, U)
    inside = doc[:-1] == doc[1:] if len(doc) > 1 else np.zeros(0, bool)
    distinct_pairs = _distinct(pairs[inside], doc[:-1][inside], n) if inside.any() else np.zeros(n)
    columns.append(distinct_pairs / np.maximum(count - 1, 1))
    base = np.stack(columns, axis=1).astype(np.float64)
    # small shares matter as much as large ones, and short texts repeat less
    return np.concatenate([base, np.sqrt(base[:, : len(_CLASSES)]), base[:, -7:] ** 2, base[:, -2:] * base[:, len(_CLASSES)][:, None] / 8], axis=1)


@dataclass(frozen=True)
class Model:
    """A linear score and its mapping to (0, 1)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _dot(_standard(x, self.mean, self.scale), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _dot(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``z @ w``, added column by column, so that equal rows get equal values in any batch."""
    total = np.zeros(len(z))
    for j in range(len(w)):
        total += z[:, j] * w[j]
    return total


def _fixed(values: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(values * 2.0**bits).astype(np.int64)


#: Of rows ``(x, y)``: keys and one vector of integers for each; keys may repeat.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _parts(part: Part, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(y), SLICE_ROWS):
        yield part(x[at : at + SLICE_ROWS], y[at : at + SLICE_ROWS])


def _by_key(keys: np.ndarray, values: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    unique, first = np.unique(keys[order], return_index=True)
    return unique, (np.add if how == "sum" else np.maximum).reduceat(values[order], first, axis=0) if len(keys) else values


class _Held:
    """Training rows in memory."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.n, self.width = x, y, len(y), x.shape[1]

    def total(self, part: Part, width: int, how: str = "sum") -> tuple[np.ndarray, np.ndarray]:
        """What ``part`` gives for all rows, added (or the largest) by key; sorted keys."""
        found = list(_parts(part, self.x, self.y))
        return _by_key(np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found]), how)


class _Spread:
    """Training rows as a table ``x binary, y int``."""

    def __init__(self, frame: DataFrame, n: int, width: int):
        self.frame, self.n, self.width = frame, n, width

    def total(self, part: Part, width: int, how: str = "sum") -> tuple[np.ndarray, np.ndarray]:
        columns = [f"v{j}" for j in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for keys, values in _parts(part, _unpacked(b.column(0)), b.column(1).to_numpy().astype(np.int64)):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], ["key", *columns])

        parts = self.frame.select("x", "y").mapInArrow(releasing(run), ", ".join(f"{c} long" for c in ["key", *columns]))
        got = parts.groupBy("key").agg(*[getattr(F, how)(c).alias(c) for c in columns]).toArrow()
        keys, *values = (got[c].to_numpy() for c in ["key", *columns])
        order = np.argsort(keys)
        return keys[order], np.stack(values, axis=1)[order]


def _largest() -> Part:
    """The largest absolute values, as the bits of floats: those sort as the values do."""
    return lambda x, y: (np.zeros(len(y), np.int64)[:1], np.ascontiguousarray(np.abs(x).max(axis=0)).view(np.int64)[None])


def _sums(value: Callable[[np.ndarray], np.ndarray], bits: int) -> Part:
    """Counts and sums of values by label."""

    def part(x, y):
        v = np.concatenate([np.ones((len(y), 1), np.int64), _fixed(value(x), bits)], axis=1)
        return np.arange(2), np.stack([v[y == label].sum(axis=0) for label in (0, 1)])

    return part


def _around(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first of the six grid points around each score, and their weights."""
    at = s / GRID
    low = np.floor(at)
    u = at - low
    weights = []
    for j in range(-2, 4):
        w = np.ones(len(s))
        for m in range(-2, 4):
            if m != j:
                w *= (u - m) / (j - m)
        weights.append(w)
    return low.astype(np.int64) - 2, weights


def _laid(model: Model, bits: int) -> Part:
    """Rows and their standardised features by grid point and label."""

    def part(x, y):
        z = _standard(x, model.mean, model.scale)
        first, weights = _around(_dot(z, model.weights))
        z = np.concatenate([np.ones((len(y), 1)), z], axis=1)
        found = [_by_key(2 * (first + j) + y, _fixed(z * w[:, None], bits), "sum") for j, w in enumerate(weights)]
        return _by_key(np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found]), "sum")

    return part


def _squares(model: Model, start: int, curve: np.ndarray, bits: int) -> Part:
    """Products of features by label, each row weighted by ``curve`` at its score."""

    def part(x, y):
        z = _standard(x, model.mean, model.scale)
        first, weights = _around(_dot(z, model.weights))
        a = sum(curve[y, first + j - start] * w for j, w in enumerate(weights))
        left, right, k = np.rint(z * a[:, None] * 2.0**bits), np.rint(z * 2.0**14), z.shape[1]
        found = [left[y == label].T @ right[y == label] for label in (0, 1)]  # of whole numbers, below 2^53
        return np.arange(2 * k), np.concatenate(found).astype(np.int64)

    return part


def _pairs(good: np.ndarray, bad: np.ndarray, points: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Over all pairs of points, weighted by the rows (column 0) and features
    laid there: mean loss, its gradient, the products of features of two rows in
    its second derivative, and by label and point the weight of a row's own."""
    loss, lost, won, cross = 0.0, np.zeros(len(points)), np.zeros(len(points)), np.zeros((good.shape[1] - 1,) * 2)
    curve = np.zeros((2, len(points)))
    for at in range(0, len(points), 256):
        own = slice(at, at + 256)
        d = points[own, None] - points[None, :]
        e = np.exp(-np.abs(d))
        miss, bend = np.where(d > 0, e, 1) / (1 + e), e / (1 + e) ** 2
        loss += good[own, 0] @ ((np.maximum(-d, 0) + np.log1p(e)) @ bad[:, 0])
        won[own], curve[1, own] = miss @ bad[:, 0], bend @ bad[:, 0]
        lost += good[own, 0] @ miss
        curve[0] += good[own, 0] @ bend
        cross += good[own, 1:].T @ (bend @ bad[:, 1:])
    return float(loss), bad[:, 1:].T @ lost - good[:, 1:].T @ won, cross, curve


def _digits(model: Model, shift: int, starts: np.ndarray | None) -> Part:
    """Counts of scores by their leading bits, of those only that begin as ``starts``."""

    def part(x, y):
        bits = (model.raw(x) + 0.0).view(np.int64)
        keys = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits) >> shift
        if starts is not None:
            keys = keys[np.isin(keys >> 16, starts)]
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.int64)[:, None]

    return part


def _quantile(rows: _Held | _Spread, model: Model, share: float) -> float:
    """The quantile of all rows' scores, between two of them linearly."""
    place = share * (rows.n - 1)
    low = min(int(place), rows.n - 1)
    found = [(0, low), (0, min(low + 1, rows.n - 1))]
    for shift in (48, 32, 16, 0):
        keys, counts = rows.total(_digits(model, shift, np.unique([s for s, _ in found]) if shift < 48 else None), 1)
        for i, (start, left) in enumerate(found):
            own = (keys >> 16 == start) if shift < 48 else np.ones(len(keys), bool)
            ends = np.cumsum(counts[own, 0])
            at = int(np.searchsorted(ends, left, side="right"))
            found[i] = int(keys[own][at]), left - (int(ends[at - 1]) if at else 0)
    bits = np.array([k for k, _ in found], dtype=np.int64)
    a, b = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64)
    return float(a + (b - a) * (place - low))


def _fit(rows: _Held | _Spread) -> Model:
    k = rows.width
    even = Model(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(THRESHOLD / (1 - THRESHOLD))), 1.0)
    if not rows.n:
        return even
    bits = 58 - rows.n.bit_length()
    most = rows.total(_largest(), k, "max")[1][0].view(np.float64)
    most = np.where(most > 0, most, 1)
    _, sums = rows.total(_sums(lambda x: x / most, bits), k + 1)
    n_bad, n_good = int(sums[0, 0]), int(sums[1, 0])
    if not n_good or not n_bad:
        return even
    mean = sums[:, 1:].sum(axis=0) / (rows.n * 2.0**bits) * most
    _, sums = rows.total(_sums(lambda x: ((x - mean) / most) ** 2, bits), k + 1)
    scale = np.maximum(np.sqrt(sums[:, 1:].sum(axis=0) / (rows.n * 2.0**bits)) * most, 1e-6)
    w, step, best = np.zeros(k), np.zeros(k), np.inf
    for _ in range(100):
        model = Model(mean, scale, w, 0.0, 1.0)
        keys, sums = rows.total(_laid(model, bits), k + 1)
        start = int(keys[0]) >> 1
        laid = np.zeros((2, (int(keys[-1]) >> 1) - start + 1, k + 1))
        laid[keys & 1, (keys >> 1) - start] = sums / 2.0**bits
        loss, grad, cross, curve = _pairs(laid[1] / n_good, laid[0] / n_bad, (start + np.arange(laid.shape[1])) * GRID)
        loss, grad = loss + RIDGE / 2 * (w @ w), grad + RIDGE * w
        if loss > best + 1e-8:  # too far
            step = step / 2
            w = w + step
            continue
        own = min(20, 44 - rows.n.bit_length())
        _, sums = rows.total(_squares(model, start, curve, own), k)
        hess = (sums[:k] / n_bad + sums[k:] / n_good) / 2.0 ** (own + 14)
        hess = (hess + hess.T) / 2 - cross - cross.T + RIDGE * np.eye(k)
        best, step = loss, np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0, 1.0)
    return Model(mean, scale, w, _quantile(rows, model, n_bad / rows.n), 1.0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Bradley-Terry by Newton steps on all preference pairs.  With one class
    only, or none, every score is 0.5."""
    return _fit(_Held(x.astype(np.float64) if x.ndim == 2 else np.zeros((0, 0)), y.astype(np.int64)))


def _feature_rows(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    _, offsets = buffers(text)
    for at, end in slices(text, 1 << 20):
        yield at, end, features(words(text, at, end), offsets[at : end + 1])


def bucket(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of features as binary values."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    data, at = buffers(column.cast(pa.large_binary()))
    return data[at[0] : at[-1]].view(np.float64).reshape(len(column), -1)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and features ``x`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = strings(b.column(1))
            for at, end, x in _feature_rows(text):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at).cast(pa.int64()), _packed(x)], ["doc_id", "x"])

    return docs.select(id_col, text_col).mapInArrow(releasing(run), "doc_id long, x binary")


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    """As ``train``, from what ``described`` gives."""
    chosen = labels.where("quality in (0, 1)").where(bucket("doc_id") != 0).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    # a repeated id counts once; features are moved, not texts
    once = rows.where(bucket("doc_id") != 0).groupBy("doc_id").agg(F.max("x").alias("x"))
    taught = written(once.join(chosen, "doc_id").select("x", "y"), "taught")
    width = features(words(strings(pa.array([""])), 0, 1), np.zeros(2, np.int64)).shape[1]
    n = taught.count()
    if n > DRIVER_ROWS:
        return _fit(_Spread(taught, n, width))
    got = taught.toArrow()
    return fit(np.frombuffer(b"".join(got["x"].to_pylist())).reshape(-1, width), got["y"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on all labelled rows outside the held-out fifth (``crc32`` of the id
    as text, modulo 5, is not 0).

    Labels other than 0 and 1, and rows without id, teach nothing; of rows that
    repeat an id one does.  Without labels, or with one class only, the model
    gives every text the same score of 0.5."""
    return learn(described(docs.where(bucket(id_col) != 0), id_col, text_col), labels)


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """As ``scores``, from what ``described`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:  # no width without rows
                s = model.score(_unpacked(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return rows.select("doc_id", "x").mapInArrow(releasing(run), "doc_id long, score double, predicted int")


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row: null text counts as empty, an
    empty text gets the score of its (zero) features, a null id stays null,
    repeated rows and equal texts get equal scores, texts of any length are read
    whole (one at a time beyond a megabyte), other columns are not read; an
    empty table gives an empty result."""
    return judged(described(docs, id_col, text_col), model)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns kept,
    whatever their names.

    Rows are judged by their text alone, so repeated rows stay or go together; a
    score of exactly ``THRESHOLD`` stays.  Null text counts as empty; null ids
    change nothing; long texts are judged whole.  Without labels of both classes
    every row stays.  An empty table gives an empty result."""
    model = train(docs, labels)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = strings(b.column(names.index(text_col)))
            keep = [model.score(x) >= THRESHOLD for _, _, x in _feature_rows(text)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(releasing(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = written(described(docs), "features")
    found = judged(rows, learn(rows, labels))
    return found.select("doc_id", (bucket("doc_id") == 0).alias("held_out"), "score", "predicted")
