"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is sorted into a run of ``(digest, smallest id, count)``
whose equal neighbours are combined.  In each round the runs of ``fan``
neighbouring nodes of a binomial tree are exchanged by digest slice and merged:
a task receives the same slice of its sources' runs, brings them into one sorted
sequence (Spark's sort, which spills) and a streaming pass combines neighbours
whose keys agree, keeping the smallest identifier and the sum of the counts.
The merged run is dealt over as many slices as it has sources, so all levels
have the same parallelism and no task ever sees a whole level.  A run meets its
partners already combined: a digest that a third of all rows share is one row
per run, at every level.

A digest is SHA-256 of the normalised text; the byte length and an independent
64-bit hash travel with it and are part of the key, so two texts are only
ever merged when all three agree (the verification at every level).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from koine.llm.tables import table
from koine.llm.text import releasing
from koine.sources.scratch import written

KEY = ["text_sha256", "n_bytes", "check"]
#: Runs merged at once: about the square root of their number, within these bounds.
FAN = (2, 16)
_RUN = "run int, slice int, text_sha256 string, n_bytes int, check long, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the key of each row's text."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check"))


def _combined(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted rows with equal neighbours as one."""
    new = np.ones(rows.num_rows, dtype=bool)
    same = np.ones(rows.num_rows - 1, dtype=bool)
    for c in ("run", "slice", *KEY):
        col = rows.column(c)
        same &= np.asarray(pc.equal(col.slice(1), col.slice(0, len(col) - 1)))
    new[1:] = ~same
    at = np.flatnonzero(new)
    ids = rows.column("keep_id")
    known = np.logical_or.reduceat(np.asarray(ids.is_valid()), at)
    least = np.minimum.reduceat(np.asarray(ids.fill_null(np.iinfo(np.int64).max)), at)
    size = np.add.reduceat(np.asarray(rows.column("group_size")), at)
    kept = rows.take(pa.array(at))
    columns = {"keep_id": pa.array(least, mask=~known), "group_size": pa.array(size)}
    return pa.RecordBatch.from_arrays([columns.get(n, kept.column(n)) for n in rows.schema.names], rows.schema.names)


def _combine_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted stream with equal neighbours as one; holds a batch and a row."""
    last: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if last is not None:
            b = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(last.columns, b.columns, strict=True)], b.schema.names)
        b = _combined(b)
        last = b.slice(b.num_rows - 1)  # what follows may equal it
        yield b.slice(0, b.num_rows - 1)
    if last is not None:
        yield last


def _merged(runs: DataFrame) -> DataFrame:
    """Each partition as one sorted sequence of distinct keys."""
    ordered = runs.select(*[f.split()[0] for f in _RUN.split(", ")]).sortWithinPartitions("run", "slice", *KEY)
    return ordered.mapInArrow(releasing(_combine_neighbours), _RUN)


def tree_merge(rows: DataFrame, n_runs: int, fan: int | None = None) -> DataFrame:
    """Merge ``(run, *KEY, keep_id, group_size)`` up the tree; returns
    ``(*KEY, keep_id, group_size)``, one row per distinct key.  With ``fan`` 2
    the exchange pattern is a binomial tree's; a larger one merges more runs at
    once and saves rounds."""
    fan = fan or max(FAN[0], min(FAN[1], int(np.ceil(n_runs**0.5))))
    runs = _merged(rows.withColumn("slice", F.lit(0)))
    width = 1
    while width < n_runs:
        width *= fan
        slices = min(width, n_runs)
        node = F.floor(F.col("run") / F.lit(fan)).cast("int")
        sent = runs.withColumn("run", node).withColumn("slice", F.pmod("check", F.lit(slices)).cast("int"))
        runs = _merged(sent.repartition("run", "slice"))
    return runs.select(*KEY, "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text equals empty text.  Null ids never win against an id; a group of
    null ids only has a null ``keep_id`` and its rows are kept.  Rows that repeat
    both id and text all count in ``group_size`` and share one decision.  Other
    columns of ``docs`` are not read; an empty table gives an empty result.
    Texts are read whole and never leave the first pass, however long.
    """
    found = written(digests(docs, id_col, text_col), "digests")
    n_runs = max(1, found.rdd.getNumPartitions())
    runs = found.select(F.spark_partition_id().alias("run"), *KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    merged = tree_merge(runs, n_runs, fan)
    return found.join(merged, KEY).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept
    whatever their names.  Null and empty texts are one group; a group without
    ids keeps one row; of rows that repeat both id and text one stays.  An empty
    table gives an empty result."""
    groups = written(exact_groups(docs, id_col, text_col).where("kept"), "kept")
    keep = groups.select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha")).distinct()
    # the row as one column, so that no name of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    out = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    if groups.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():  # rows that repeat id and text
        out = out.dropDuplicates(["id", "sha"])
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
