"""Similarity join of documents on word-shingle sets, with set-relation skipping.

Documents of equal shingle sets form one class; only classes are joined.

* Index.  Chunks of classes exchange fingerprints of their shingles to learn in
  how many classes each occurs.  A class indexes the rarest shingles of its
  prefix (as many as a partner of the wanted similarity cannot all miss), but
  none that occurs in itself only: a class without such shingles has no
  partner and is done.
* Skipping in lists.  An entry at position ``p`` of a class of size ``n`` can
  only meet partner sizes that ``n - p`` common shingles still satisfy.  Lists
  are cut into blocks by size, and an entry visits just the blocks its position
  leaves possible.
* Skipping by known answers.  Each list block has a pivot, its class of fewest
  shingles of its own.  Classes are first compared with their pivots; whoever
  is linked shares the pivot's component, so pairs inside a component are never
  formed, however large a group of near copies is.  For the rest, an answer is
  bounded from the pivot's: ``|x & y| <= |x & p| + |y - p|``.  Only pairs that
  neither rule settles are compared, on their whole sets.

All links between different components are thus found or refuted exactly;
links inside one are implied by it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from koine.llm.chunks import layout, Packer, text_of, text_size, unpacked
from koine.llm.tables import table
from koine.llm.text import combine, mix, pack_bytes, pack_sorted, releasing, releasing_cogroup, releasing_group, slices, strings, U, unpack_bytes, unpack_sorted, words
from koine.operators.components import components
from koine.sources.scratch import written

SHINGLE = 5
#: A pair links at ``PERCENT`` / 100 or more.
PERCENT = 75
#: Pivots that a class is compared with in the first round.
PIVOTS = 3


def shingle_sets(text: pa.Array, a: int, z: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts ``a:z``, ascending in each text, and where each text's begin."""
    w = words(text, a, z, lower=True)
    fp, at = w.windows(k)
    doc = np.searchsorted(w.first, at, side="right") - 1
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = [combine([w.hashes[w.first[i] + j : w.first[i] + j + 1] for j in range(count[i])], 50 + int(count[i]))[0] for i in short]
        fp, doc = np.concatenate([fp, np.array(own, dtype=U)]), np.concatenate([doc, short])
    order = np.lexsort((fp, doc))
    fp, doc = fp[order], doc[order]
    if len(fp):
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
        fp, doc = fp[new], doc[new]
    return fp, np.searchsorted(doc, np.arange(z - a + 1))


def set_digests(fp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(fp ^ U(salt)), dtype=U)])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + U(salt)).view(np.int64))
    return out[0], out[1]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


class Classes:
    """The distinct sets of a chunk."""

    def __init__(self, packs, groups: int):
        rows = unpacked(packs)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("d1", "ascending"), ("d2", "ascending"), ("doc_id", "ascending")]))
        d1, d2 = np.asarray(rows["d1"]), np.asarray(rows["d2"])
        new = np.ones(len(d1), dtype=bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        rows = rows.filter(pa.array(new)).combine_chunks()
        self.rep, self.text = np.asarray(rows["doc_id"]), text_of(rows)
        fps, owner = [], []
        for a, z in slices(self.text):
            fp, first = shingle_sets(self.text, a, z)
            fps.append(fp)
            owner.append(np.repeat(np.arange(a, z), np.diff(first)))
        self.fp, self.owner = np.concatenate(fps), np.concatenate(owner)
        self.n = np.bincount(self.owner, minlength=len(self.rep))
        # 48 bits tell a shingle's frequency well enough; comparisons use all 64
        self.token, self.where, self.df = np.unique(self.fp >> U(16), return_inverse=True, return_counts=True)
        group = ((self.token >> U(16)) * U(groups) >> U(32)).astype(np.int32)
        present, at = np.unique(group, return_index=True)
        self.cuts = {int(g): (int(a), int(z)) for g, a, z in zip(present, at, [*at[1:], len(self.token)], strict=True)}

    def parts(self):
        for g, (a, z) in self.cuts.items():
            yield g, self.token[a:z], self.df[a:z]

    def index(self, answers: dict[int, np.ndarray]) -> pa.Table:
        """Classes with a shared shingle in their prefix."""
        bucket = np.zeros(len(self.token), dtype=np.uint8)
        for g, own in answers.items():
            bucket[slice(*self.cuts[g])] = own
        b = bucket[self.where]
        order = np.lexsort((self.fp, b, self.owner))
        first = np.concatenate([[0], np.cumsum(self.n)])
        place = np.arange(len(order)) - first[self.owner[order]]
        keep = (place < prefix_length(self.n)[self.owner[order]]) & (b[order] > 0)
        own, fp, place = self.owner[order][keep], self.fp[order][keep], place[keep]
        cls, at = np.unique(own, return_index=True)
        offsets = np.append(at, len(own)).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(fp.view(np.int64)))
        return pa.table(
            {
                "rep": pa.array(self.rep[cls], pa.int64()),
                "n": pa.array(self.n[cls], pa.int32()),
                "own": pa.array(place[at], pa.int32()),
                "tokens": tokens,
                "body": pa.array([_squeeze(self.text[int(c)].as_py()) for c in cls], pa.binary()),
            }
        )


def _squeeze(text: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(text.encode())


def _unpressed(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)


def _spread(body: bytes) -> np.ndarray:
    return shingle_sets(strings(pa.array([_unpressed(body).decode()])), 0, 1)[0]


def word_shingles(text: bytes, k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The set of a text in words, not fingerprints."""
    w = text.lower().split()
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


_PREPARED = "chunk int, pack binary, doc_id long, n_shingles long, d1 long, d2 long"


def _prepared(docs: DataFrame, chunks: int) -> DataFrame:
    """In one pass over ``doc_id, text``: each row's set size and digests, and
    the texts of distinct sets packed by chunk (rows of ``chunk, pack``)."""
    names = [f.split()[0] for f in _PREPARED.split(", ")]

    def out(packs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        none = pa.array([None], pa.int64())
        for number, blob in packs:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([blob], pa.binary()), none, none, none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for b in batches:
            text = strings(b.column(1))
            for a, z in slices(text):
                fp, first = shingle_sets(text, a, z)
                x, y = set_digests(fp, first)
                n = np.diff(first)
                ids = b.column(0).slice(a, z - a)
                yield pa.RecordBatch.from_arrays([pa.nulls(z - a, pa.int32()), pa.nulls(z - a, pa.binary()), ids, pa.array(n), pa.array(x), pa.array(y)], names)
                # of equal sets here only the smallest id goes on
                order = np.lexsort((np.asarray(ids.fill_null(0)), y, x))
                order = order[(n[order] > 0) & np.asarray(ids.is_valid())[order]]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
                keep = order[new]
                rows = pa.RecordBatch.from_arrays([ids, pa.array(x), pa.array(y), text.slice(a, z - a)], ["doc_id", "d1", "d2", "text"])
                yield from out(packer.add((mix(x[keep].view(U)) % U(chunks)).astype(np.int32), rows.take(pa.array(keep))))
        yield from out(packer.flush())

    return docs.mapInArrow(releasing(run), _PREPARED)


def _candidates(packs: DataFrame, groups: int) -> DataFrame:
    """``rep, n, own, tokens, body`` of the classes that index something."""

    def tell(key, rows):
        got = [(key[0].as_py(), g, len(t), pack_sorted(t), pack_bytes(np.minimum(df, 255))) for g, t, df in Classes(rows["pack"], groups).parts()]
        c, g, n, blob, df = zip(*got, strict=True) if got else ((),) * 5
        return pa.table([pa.array(c, pa.int32()), pa.array(g, pa.int32()), pa.array(n, pa.int32()), pa.array(blob, pa.binary()), pa.array(df, pa.binary())], names=["chunk", "grp", "n", "blob", "df"])

    def count(key, rows):
        chunk, n = np.asarray(rows["chunk"]), np.asarray(rows["n"])
        token = np.concatenate([unpack_sorted(b.as_buffer(), int(k)) for b, k in zip(rows["blob"], n, strict=True)])
        df = np.concatenate([unpack_bytes(b.as_buffer(), int(k)) for b, k in zip(rows["df"], n, strict=True)]).astype(np.int64)
        _, where = np.unique(token, return_inverse=True)
        total = np.bincount(where, weights=df)
        bucket = np.minimum(np.ceil(np.log2(np.maximum(total, 1))), 30).astype(np.uint8)[where]
        ends = np.cumsum(n)
        got = [(int(c), int(k), pack_bytes(own)) for c, k, z in zip(chunk, n, ends, strict=True) if (own := bucket[z - k : z]).any()]
        return pa.table(
            [pa.array([x[0] for x in got], pa.int32()), pa.array([key[0].as_py()] * len(got), pa.int32()), pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.binary())],
            names=["chunk", "grp", "n", "bucket"],
        )

    schema = "rep long, n int, own int, tokens array<long>, body binary"

    def index(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "own": pa.array([], pa.int32()), "tokens": pa.array([], pa.list_(pa.int64())), "body": pa.array([], pa.binary())})
        answers = {g: unpack_bytes(b, n) for g, n, b in zip(*(right[x].to_pylist() for x in ("grp", "n", "bucket")), strict=True)}
        return Classes(left["pack"], groups).index(answers)

    told = packs.groupBy("chunk").applyInArrow(releasing_group(tell), "chunk int, grp int, n int, blob binary, df binary")
    counted = told.groupBy("grp").applyInArrow(releasing_group(count), "chunk int, grp int, n int, bucket binary")
    return packs.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(releasing_cogroup(index), schema)


def _compared(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """``x, y, nx, ny, common`` of pairs ``(x, y)``: by fingerprints, and where
    those link a pair by the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def get(i: int, body) -> np.ndarray:
            if i not in held:
                held[i] = _spread(body.as_buffer())
                if len(held) > 64:
                    held.popitem(last=False)
            return held[i]

        for b in batches:
            x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = ([], [], [])
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                s, t = get(p, b.column(2)[i]), get(q, b.column(3)[i])
                found = len(s), len(t), len(np.intersect1d(s, t, assume_unique=True))
                if 100 * found[2] >= PERCENT * (found[0] + found[1] - found[2]):
                    s, t = (word_shingles(_unpressed(b.column(c)[i].as_buffer())) for c in (2, 3))
                    found = len(s), len(t), len(s & t)
                for out, v in zip(sizes, found, strict=True):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s, pa.int32()) for s in sizes)], ["x", "y", "nx", "ny", "common"])

    left = bodies.select(F.col("rep").alias("x"), F.col("body").alias("bx"))
    right = bodies.select(F.col("rep").alias("y"), F.col("body").alias("by"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "bx", "by")
    return both.mapInArrow(releasing(run), "x long, y long, nx int, ny int, common int")


def linked() -> str:
    return f"100 * cast(common as long) >= {PERCENT} * (cast(nx as long) + ny - common)"


#: Common shingles that a pair of sizes nx, ny needs, and what positions px, py leave possible.
_POSSIBLE = f"least(nx - px, ny - py) >= ceil({PERCENT} * (nx + ny) / {100 + PERCENT}.0)"


def _labelled(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    return entries.join(nodes.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")


def links(packs: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(x, y)`` between classes that connect all components,
    and ``(node, root)`` of those components; ``packs`` holds the classes' texts."""
    found = written(_candidates(packs, groups), "classes")
    bodies = found.select("rep", "body")
    # size blocks: partners differ by at most a factor of 100 / PERCENT
    step = float(np.log(100 / PERCENT))
    block = lambda n: F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
    entries = found.select("rep", "n", "own", F.posexplode("tokens").alias("i", "token")).select("rep", "n", "own", (F.col("own") + F.col("i")).alias("p"), "token", block(F.col("n")).alias("block"))
    entries = written(entries, "entries")

    # answers of pivots: of each list block the class with the smallest share of shingles of its own
    central = F.struct((F.col("own") / F.col("n")).alias("share"), F.col("rep").alias("pivot"), F.col("n").alias("pn"), F.col("p").alias("pp"))
    pivots = entries.groupBy("token", "block").agg(F.min(central).alias("c"), F.count("*").alias("k")).where("k > 1").select("token", "block", "c.pivot", "c.pn", "c.pp")
    offered = entries.join(pivots, ["token", "block"]).where("rep <> pivot").selectExpr("rep as x", "pivot as y", "n as nx", "pn as ny", "p as px", "pp as py").where(_POSSIBLE)
    best = offered.groupBy("x", "y").agg(F.count("*").alias("k"))
    best = best.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "y")), asc=False), 1, PIVOTS).alias("b")).select("x", F.explode("b.y").alias("y"))
    known = written(_compared(best, bodies), "pivots")
    edges = known.where(linked()).select("x", "y")
    nodes = components(edges, "x", "y")

    # the components' own pivots meet those of their lists
    lists = written(_labelled(entries, nodes), "labelled")
    by_label = lists.groupBy("token", "label").agg(F.min(central).alias("c"), F.count("*").alias("k"))
    main = by_label.groupBy("token").agg(F.max(F.struct("k", "label", "c")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    meet = by_label.join(main, "token").where("label <> m.label").selectExpr("c.pivot as x", "m.c.pivot as y", "c.pn as nx", "m.c.pn as ny", "c.pp as px", "m.c.pp as py").where(_POSSIBLE)
    meet = meet.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    met = written(_compared(meet, bodies), "met")
    edges = edges.unionByName(met.where(linked()).select("x", "y"))
    if met.where(linked()).limit(1).count():
        nodes = components(edges, "x", "y")
        lists = written(_labelled(entries, nodes), "labelled")

    # what is left: pairs across components, from the blocks that sizes and positions leave
    open_lists = lists.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
    left = lists.join(open_lists, "token", "left_semi")
    most = F.floor(F.lit((100 + PERCENT) / PERCENT) * (F.col("n") - F.col("p")) - F.col("n") + 1e-6)
    least = F.ceil(F.col("n") * PERCENT / 100)
    large = left.withColumn("most", F.least(most, F.col("n"))).where(F.col("most") >= least)
    large = large.withColumn("block", F.explode(F.sequence(block(least), block(F.col("most")))))
    a = left.selectExpr("token", "block", "rep as x", "n as nx", "p as px", "label as lx")
    b = large.selectExpr("token", "block", "rep as y", "n as ny", "p as py", "label as ly")
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.block") == F.col("b.block")) & (F.col("lx") != F.col("ly")) & F.expr("(nx < ny or nx = ny and x < y)") & F.expr(_POSSIBLE)
    pairs = a.alias("a").join(b.alias("b"), on).select("x", "y", "nx", "ny").distinct()
    # answers known from a pivot that y is close to
    tried = known.unionByName(met)
    tried = tried.select("x", "y", "nx", "ny", "common").unionByName(tried.selectExpr("y as x", "x as y", "ny as nx", "nx as ny", "common"))
    near = tried.where(linked()).groupBy("x").agg(F.max(F.struct("common", "y")).alias("m")).selectExpr("x as y", "m.y as p", "m.common as yp")
    bound = pairs.join(near, "y", "left").join(tried.selectExpr("x", "y as p", "common as xp"), ["x", "p"], "left")
    needed = f"ceil({PERCENT} * (nx + ny) / {100 + PERCENT}.0)"
    rest = bound.where(f"xp is null or xp + (ny - yp) >= {needed}").select("x", "y").distinct()
    rest = rest.join(tried.select("x", "y").distinct(), ["x", "y"], "left_anti")
    last = written(_compared(rest, bodies), "rest").where(linked()).select("x", "y")
    if last.limit(1).count():
        edges = edges.unionByName(last)
        nodes = components(edges, "x", "y")
    return edges, nodes


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for each row.

    Two rows link when their sets' Jaccard similarity reaches ``PERCENT``;
    ``component_id`` is the smallest id reachable by links.  ``class_id`` is the
    smallest id of an equal set.  Null and empty texts, and texts of white space,
    have empty sets and are linked with nothing.  Rows that repeat an id are in
    their own sets' components.  Rows with a null id are returned with null
    component and link nothing.  Other columns are not read; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, size = text_size(rows, "text")
    chunks, groups = layout(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prepared = written(_prepared(rows, chunks), "prepared")
    sigs = prepared.where("chunk is null").drop("chunk", "pack")
    _, nodes = links(prepared.where("chunk is not null").select("chunk", "pack"), groups)
    classes = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    roots = classes.join(nodes.select(F.col("node").alias("class_id"), "root"), "class_id", "left").select("d1", "d2", "class_id", F.coalesce("root", "class_id").alias("root"))
    full = F.col("n_shingles") > 0
    joined = sigs.join(roots, ["d1", "d2"], "left")
    own = F.col("doc_id")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(own.isNull(), None).when(full, F.col("root")).otherwise(own).alias("component_id"),
        F.when(own.isNull(), None).when(full, F.col("class_id")).otherwise(own).alias("class_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each group, all columns kept,
    whatever their names.  Rows that share an id are kept or dropped together;
    rows without id, text or words stay.  An empty table gives an empty result."""
    groups = near_groups(docs, id_col, text_col).where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("keep_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    kept = rows.join(written(groups, "kept"), F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
g AS (SELECT doc_id, n, j, list(word) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM x),
s AS (SELECT DISTINCT doc_id, array_to_string(k, ' ') AS k FROM g WHERE len(k) = 5 OR n < 5 AND j = 1),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
p(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, p.root FROM p JOIN e ON p.node = e.a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, root AS component_id
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT node, min(root) AS root FROM p GROUP BY node) ON node = d.doc_id
"""
