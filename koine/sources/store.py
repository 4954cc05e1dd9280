"""The rows of a map as Parquet parts in the shared folder.

``base`` holds rows that all rules have seen, ``delta`` those new since the last
iteration, ``fresh`` those that arrived after the iteration began.  A part is
written once and read by name, so plans stay short whatever the number of
iterations, and a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from koine.functions.ids import MapId, term_column
from koine.sources.scratch import remove, shared_dir

#: Parts of one region before they are merged into one.
MAX_PARTS = 12


class Folder:
    """A database's own folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/db-{uuid.uuid4().hex}"
        self._next = 0
        self._there: set[int] = set()

    def write(self, df: DataFrame, partition: str | None = None) -> str:
        self._next += 1
        self._there.add(self._next)
        path = f"{self.path}/{self._next:06d}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(partition) if partition else out).parquet(path)
        return path

    def write_counted(self, df: DataFrame, partition: str | None = None, **more: Column) -> tuple[str, dict[str, int]]:
        """Write and count in one pass: the path, and ``n`` rows with further aggregates."""
        seen = Observation()
        path = self.write(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]), partition)
        return path, {k: v or 0 for k, v in seen.get.items()}

    def written(self) -> int:
        """How many tables have been written so far."""
        return self._next

    def drop(self, after: int, upto: int, live: set[str]) -> None:
        """Remove the tables of these numbers but for those of ``live`` paths."""
        kept = {int(p.removeprefix(self.path).split("/")[1]) for p in live if p.startswith(self.path)}
        for n in sorted(n for n in self._there - kept if after < n <= upto):
            self._there.discard(n)
            remove(self.spark, f"{self.path}/{n:06d}")

    def remove(self) -> None:
        remove(self.spark, self.path)


class MapStore:
    def __init__(self, folder: Folder, map_id: MapId):
        self.folder, self.map = folder, map_id
        self.args = [f"a{i}" for i in range(map_id.arity)]
        self.schema = T.StructType([T.StructField(c, T.LongType()) for c in [*self.args, "out"]])
        self.base: list[tuple[str, int]] = []
        self.delta: list[tuple[str, int]] = []
        self.fresh: list[tuple[str, int]] = []
        #: Parts whose ids are still to be checked.
        self.unverified: set[str] = set()
        #: Parts without values: those of new terms, which follow from the arguments.
        self.bare: set[str] = set()

    def read(self, *regions: list[tuple[str, int]], file: str | None = None) -> DataFrame:
        """The rows of some parts; with ``file``, a column of that name with the file of each."""
        paths = [p for r in regions for p, _ in r]
        if not paths:
            return self.folder.spark.createDataFrame([], self.schema)
        more = [F.col("_metadata.file_path").alias(file)] if file else []
        full, bare = ([p for p in paths if (p in self.bare) == b] for b in (False, True))
        frames = [self.folder.spark.read.schema(self.schema).parquet(*full).select("*", *more)] if full else []
        if bare:
            rows = self.folder.spark.read.schema(T.StructType(self.schema.fields[:-1])).parquet(*bare)
            frames.append(rows.select("*", term_column(self.map.index, [F.col(a) for a in self.args]).alias("out"), *more))
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def old(self) -> DataFrame:
        return self.read(self.base)

    def new(self) -> DataFrame:
        return self.read(self.delta)

    def snapshot(self) -> DataFrame:
        return self.read(self.base, self.delta)

    def everything(self) -> DataFrame:
        return self.read(self.base, self.delta, self.fresh)

    def paths(self) -> set[str]:
        return {p for region in (self.base, self.delta, self.fresh) for p, _ in region}

    @staticmethod
    def rows(*regions: list[tuple[str, int]]) -> int:
        return sum(n for r in regions for _, n in r)

    def add(self, df: DataFrame) -> int:
        """Append rows that are known to be absent; how many there were."""
        return self.append(df)[1]["n"]

    def append(self, df: DataFrame, check: Callable[[str], None] | None = None, far: Column | None = None) -> tuple[str, dict[str, int]]:
        """Append rows that are known to be absent: the part, and how many.
        ``check`` sees the written part before it belongs to the map; with a count
        ``far`` of the column of that name, the part keeps it beside the map's."""
        more = {} if far is None else {"far": far}
        path, seen = self.folder.write_counted(df.select(*self.args, "out", *more), **more)
        if seen["n"]:
            if check:
                check(path)
            self.fresh.append((path, seen["n"]))
        return path, seen

    def append_bare(self, rows: DataFrame) -> tuple[str, int]:
        """Append the arguments of new terms that are known to be absent: the part, and how many."""
        path, seen = self.folder.write_counted(rows.select(*self.args))
        if seen["n"]:
            self.bare.add(path)
            self.fresh.append((path, seen["n"]))
        return path, seen["n"]

    def begin(self) -> None:
        self.delta, self.fresh = self.fresh, []

    def end(self) -> None:
        self.base, self.delta = self.base + self.delta, []
        if len(self.base) > MAX_PARTS:  # all but the largest, so a row is rewritten a logarithmic number of times
            largest = max(self.base, key=lambda p: p[1])
            rest = [p for p in self.base if p is not largest]
            self.base = [largest, (self.folder.write(self.read(rest)), self.rows(rest))]
            if self.unverified & {p for p, _ in rest}:
                self.unverified.add(self.base[1][0])

    def restart(self) -> None:
        """All rows count as new."""
        self.fresh, self.base, self.delta = self.base + self.delta + self.fresh, [], []

    def replace(self, path: str, old: int, new: int, parts: set[str] | None = None) -> None:
        """Take rewritten rows, which lie in ``changed=false`` and ``changed=true``,
        for some parts, or for all."""
        stay = lambda region: [p for p in region if parts is not None and p[0] not in parts]
        self.base = stay(self.base) + stay(self.delta) + ([(f"{path}/changed=false", old)] if old else [])
        self.fresh = stay(self.fresh) + ([(f"{path}/changed=true", new)] if new else [])
        self.delta = []
