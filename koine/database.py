"""The database: types, maps, terms and their equality."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from koine.errors import ArityError, CollisionError, ForeignIdError, TypeMismatchError
from koine.functions.ids import (
    MAX_TYPES, MapId, MapSignature, TermId, TypeId, integer_column, integer_id, integer_key, named_column, named_id, term_hash,
)
from koine.operators.act import insert, verify_late
from koine.operators.rebuild import Roots, rebuild
from koine.plans.ast import Apply, Var
from koine.sources.store import Folder, MapStore


class Database:
    """Maps over uninterpreted terms, with equality.

    Single terms go through a buffer on the driver; whole tables are loaded with
    ``load_facts`` and never pass through it.  Rows live in the shared folder
    until ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.id = uuid.uuid4().hex
        self.folder = Folder(spark)
        self.roots = Roots(self.folder)
        self._types: list[TypeId] = []
        self._maps: list[MapId] = []
        self._stores: dict[int, MapStore] = {}
        self._keys: dict[int, list[str]] = {}
        #: Columns of keys that have been loaded but not yet been asked for.
        self._unread_keys: dict[int, list[tuple[DataFrame, str]]] = {}
        self._named: dict[int, dict[int, str]] = {}
        self._checked: dict[int, int] = {}
        self._fresh_keys = 0
        #: Rows created on the driver, by map and arguments; those not yet in a part.
        self._known: dict[tuple[int, tuple[int, ...]], int] = {}
        self._buffer: dict[int, dict[tuple[int, ...], int]] = {}
        self._buffer_ids: set[int] = set()
        self._pending: list[tuple[int, int, int]] = []
        self._parent: dict[int, int] = {}
        self._types_of: dict[int, TypeId] = {}

    def close(self) -> None:
        """Remove the database's files."""
        self.folder.remove()

    # -- catalogue

    def new_type(self, name: str = "", integer: bool = False) -> TypeId:
        """Declare a type; with ``integer`` its constants have keys in
        ``[0, 2**48)`` and ids that lead back to them."""
        if len(self._types) >= MAX_TYPES:
            raise ValueError(f"more than {MAX_TYPES} types")
        self._types.append(TypeId(self.id, len(self._types), name, integer))
        return self._types[-1]

    def new_map(self, signature: MapSignature, name: str = "") -> MapId:
        """Declare a map; its rows are an empty table at first."""
        for t in (*signature.inputs, signature.output):
            self._local(t)
        m = MapId(self.id, len(self._maps), signature, name)
        self._maps.append(m)
        self._stores[m.index] = MapStore(self.folder, m)
        return m

    def map(self, name: str, inputs: Iterable[TypeId], output: TypeId) -> MapId:
        return self.new_map(MapSignature(inputs, output), name)

    def _local(self, x: TypeId | TermId | MapId) -> None:
        if x.db != self.id:
            raise ForeignIdError(f"{x} belongs to another database")

    def type_id(self, term: TermId) -> TypeId:
        """The type of a term."""
        self._local(term)
        return self._types_of.get(term.value, term.type)

    # -- terms

    def new_constant(self, type_id: TypeId, key: int | str | None = None) -> TermId:
        """The constant of a key; without a key, a new one at each call."""
        self._local(type_id)
        if key is None:
            self._fresh_keys += 1
            value = named_id(type_id.index, f"\0{self.id}:{self._fresh_keys}")
        elif type_id.integer:
            value = integer_id(type_id.index, int(key))
        else:
            value = named_id(type_id.index, str(key))
            if self._named.setdefault(type_id.index, {}).setdefault(value, str(key)) != str(key):
                raise CollisionError(f"two keys of type {type_id.name or type_id.index} have the same id")
        self._types_of[value] = type_id
        return TermId(self.id, value, type_id)

    def _check(self, term: Apply) -> None:
        self._local(term.map)
        for a, expected in zip(term.args, term.map.signature.inputs, strict=True):
            if isinstance(a, Var):
                raise TypeMismatchError("a term has no variables")
            self._local(a.map if isinstance(a, Apply) else a)
            if isinstance(a, Apply):
                self._check(a)
            elif self.type_id(a) != expected:
                raise TypeMismatchError(f"type {self.type_id(a).index} instead of {expected.index}")

    def new_term(self, term: Apply) -> TermId:
        """The id of a nested term, created with all its parts where absent.
        Nothing is created if any part is ill-typed."""
        self._check(term)
        return self._insert(term)

    def _insert(self, term: Apply | TermId) -> TermId:
        if isinstance(term, TermId):
            return self.canonicalize(term)
        args = tuple(self._insert(a).value for a in term.args)
        value = self._row(term.map, args)
        if value is None:
            value = term_hash(term.map.index, args)
            if value in self._buffer_ids:
                raise CollisionError(f"two terms of map {term.map.name or term.map.index} have the same id")
            self._buffer_ids.add(value)
            self._buffer.setdefault(term.map.index, {})[args] = value
            self._known[term.map.index, args] = value
        self._types_of[value] = term.map.signature.output
        return self.canonicalize(TermId(self.id, value, term.map.signature.output))

    def _row(self, m: MapId, args: tuple[int, ...]) -> int | None:
        """The value of a map at arguments, by buffer or by a point lookup."""
        known = self._known.get((m.index, args))
        store = self._stores[m.index]
        if known is not None or not store.rows(store.base, store.delta, store.fresh):
            return known
        verify_late(store, self.roots)
        rows = store.everything()
        for c, a in zip(store.args, args, strict=True):
            rows = rows.where(F.col(c) == F.lit(a))
        got = rows.select("out").head()
        if got is not None:
            self._known[m.index, args] = got["out"]
        return got["out"] if got is not None else None

    def term_id(self, term: Apply | TermId) -> TermId | None:
        """The id of a nested term if it exists; never creates."""
        if isinstance(term, TermId):
            self._local(term)
            return self.canonicalize(term)
        self._local(term.map)
        args = [self.term_id(a) for a in term.args]
        if any(a is None for a in args):
            return None
        value = self._row(term.map, tuple(a.value for a in args))
        return None if value is None else self.canonicalize(TermId(self.id, value, term.map.signature.output))

    # -- equality

    def _find(self, value: int) -> int:
        while (up := self._parent.get(value, value)) != value:
            self._parent[value] = self._parent.get(up, up)
            value = up
        return value

    def canonicalize(self, term: TermId) -> TermId:
        """The representative of a term's class, pending unions included."""
        self._local(term)
        root = self.roots.lookup([term.value]).get(term.value, term.value)
        return TermId(self.id, self._find(root), term.type)

    def equal(self, a: TermId, b: TermId) -> bool:
        return self.canonicalize(a).value == self.canonicalize(b).value

    def unify(self, a: TermId, b: TermId) -> None:
        """Make two terms equal at once; rows follow at the next rebuild."""
        if self.type_id(a) != self.type_id(b):
            raise TypeMismatchError("a union of two types")
        x, y = self.canonicalize(a).value, self.canonicalize(b).value
        if x != y:
            self._parent[max(x, y)] = min(x, y)
            self._pending.append((x, y, self.type_id(a).index))

    def rebuild(self, edges: Iterable[tuple[DataFrame, int]] = ()) -> int:
        """Bring all rows to representatives and unite what congruence demands."""
        self.flush()
        edges = list(edges)
        if self._pending:
            by_type: dict[int, list[tuple[int, int]]] = {}
            for a, b, t in self._pending:
                by_type.setdefault(t, []).append((a, b))
            edges += [(self.spark.createDataFrame(rows, "a long, b long"), t) for t, rows in by_type.items()]
        for s in self._stores.values() if edges else ():
            verify_late(s, self.roots)
        rounds = rebuild(list(self._stores.values()), self.roots, edges) if edges else 0
        if edges:
            self._pending, self._parent, self._known = [], {}, {}
        return rounds

    # -- tables

    def _ids(self, type_id: TypeId, column: str):
        return (integer_column if type_id.integer else named_column)(type_id.index, F.col(column))

    def load_constants(self, df: DataFrame, key: str, type_id: TypeId) -> None:
        """Remember the keys of a type's constants at once; ``load_facts`` does
        so when they are first asked for."""
        self._local(type_id)
        if not type_id.integer:
            rows = df.select(self._ids(type_id, key).alias("term_id"), F.col(key).cast("string").alias("key"))
            self._keys.setdefault(type_id.index, []).append(self.folder.write(rows.distinct()))

    def check_keys(self, type_id: TypeId) -> None:
        """Raise if two keys of a type that have been loaded share an id."""
        self._local(type_id)
        if (known := self._key_rows(type_id)) is not None:
            if known.groupBy("term_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").limit(1).count():
                raise CollisionError(f"two keys of type {type_id.name or type_id.index} have the same id")

    def load_facts(self, df: DataFrame, m: MapId, columns: list[str], value: str | None = None, keys_later: bool = True) -> int:
        """Insert a row of ``m`` for each row of keys in ``columns``; with
        ``value`` the map's value there becomes equal to that key's constant.
        How many rows were absent before.

        String keys are read from ``df`` again when results first show them;
        with ``keys_later`` false they are kept at once, for frames that do not
        last, as those of streams.  A null key, or a whole number that is not in
        ``[0, 2**48)``, is an error and nothing is inserted."""
        self._local(m)
        if len(columns) != m.arity:
            raise ArityError(f"map {m.name} takes {m.arity} arguments, not {len(columns)}")
        self.flush()
        for t, c in zip((*m.signature.inputs, *([m.signature.output] if value else [])), (*columns, *([value] if value else [])), strict=True):
            if not t.integer:
                self._unread_keys.setdefault(t.index, []).append((df, c))
                if not keys_later:
                    self._key_rows(t)
        store = self._stores[m.index]
        args = [self._ids(t, c).alias(a) for t, c, a in zip(m.signature.inputs, columns, store.args, strict=True)]
        rows = df.select(*args, *([self._ids(m.signature.output, value).alias("_value")] if value else []))
        rows = self.roots.canonical(rows, store.args)
        if not value:
            return insert(store, [rows], self.roots)
        rows = self.roots.canonical(rows, ["_value"])
        first = rows.groupBy(*store.args).agg(F.min("_value").alias("out")) if store.args else rows.agg(F.min("_value").alias("out")).where("out is not null")
        if store.rows(store.base, store.delta, store.fresh):
            first = first.join(store.everything().select(*store.args), store.args, "left_anti") if store.args else first.limit(0)
        n = store.add(first)
        edges = (store.everything().join(rows, store.args) if store.args else store.everything().crossJoin(rows)).where("out <> _value")
        edges = edges.select(F.col("out").alias("a"), F.col("_value").alias("b")).distinct()
        self.rebuild([(edges, m.signature.output.index)])
        return n

    def flush(self) -> None:
        """Write the rows created on the driver."""
        for index, rows in self._buffer.items():
            store = self._stores[index]
            store.add(self.spark.createDataFrame([(*a, v) for a, v in rows.items()], store.schema))
        self._buffer, self._buffer_ids = {}, set()

    def live(self) -> set[str]:
        """Paths of the tables that the database needs."""
        out = {p for paths in self._keys.values() for p in paths}
        for s in self._stores.values():
            out |= s.paths()
        return out | ({self.roots.path} if self.roots.path else set())

    def vacuum(self) -> None:
        """Remove tables that have been replaced.  Frames that were read before
        the last change of the database cannot be computed any more."""
        self.folder.drop(0, self.folder.written(), self.live())

    def _key_rows(self, type_id: TypeId) -> DataFrame | None:
        """Ids and keys of a type, as loaded; both are the same for a key loaded twice."""
        for df, c in self._unread_keys.pop(type_id.index, []):
            self.load_constants(df, c, type_id)
        frames = []
        if paths := self._keys.get(type_id.index):
            frames.append(self.spark.read.schema("term_id long, key string").parquet(*paths))
        if named := self._named.get(type_id.index):
            frames.append(self.spark.createDataFrame(list(named.items()), "term_id long, key string"))
        if not frames:
            return None
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def keys(self, type_id: TypeId, column: str = "term_id") -> DataFrame | None:
        """Ids and keys of a type's constants; that two share an id is an error."""
        if self._keys_changed(type_id):
            self.check_keys(type_id)
        out = self._key_rows(type_id)
        if out is None:
            return None
        # a class shows its smallest key
        return self.roots.canonical(out, ["term_id"]).groupBy("term_id").agg(F.min("key").alias("key")).select(F.col("term_id").alias(column), "key")

    def _keys_changed(self, type_id: TypeId) -> bool:
        """Whether keys have been loaded since they were last checked."""
        now = len(self._keys.get(type_id.index, ())) + len(self._unread_keys.get(type_id.index, ()))
        before, self._checked[type_id.index] = self._checked.get(type_id.index), now
        return now > 0 and now != before

    def decode(self, df: DataFrame, columns: dict[str, TypeId]) -> DataFrame:
        """Replace ids by keys; a class shows its smallest key, a created term null."""
        order = df.columns
        for c, t in columns.items():
            if t.integer:
                df = df.withColumn(c, F.when(F.col(c) < F.lit(1 << 61), integer_key(F.col(c))))
            elif (k := self.keys(t, c)) is not None:
                df = df.join(k, c, "left").withColumn(c, F.col("key")).drop("key")
            else:
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df.select(*order)

    def read(self, m: MapId, names: list[str] | None = None, value: str | None = None) -> DataFrame:
        """A map's rows as keys: its arguments under ``names``, and its value if asked for."""
        self.flush()
        store = self._stores[m.index]
        if value:
            verify_late(store, self.roots)
        names = names or store.args
        df = store.everything().select(*[F.col(a).alias(n) for a, n in zip(store.args, names, strict=True)], *([F.col("out").alias(value)] if value else []))
        return self.decode(df, dict(zip(names, m.signature.inputs, strict=True)) | ({value: m.signature.output} if value else {}))

    def count(self, m: MapId) -> int:
        """A map's number of rows."""
        store = self._stores[m.index]
        return store.rows(store.base, store.delta, store.fresh) + len(self._buffer.get(m.index, ()))

    def raw(self, m: MapId) -> DataFrame:
        """A map's rows as ids."""
        self.flush()
        verify_late(self._stores[m.index], self.roots)
        return self._stores[m.index].everything()

    def classes(self, df: DataFrame, key: str, type_id: TypeId, name: str = "root") -> DataFrame:
        """``df`` with the representative's key of the class of each ``key``."""
        self._local(type_id)
        out = self.roots.canonical(df.withColumn(name, self._ids(type_id, key)), [name])
        return self.decode(out, {name: type_id})
