"""Term identities.

An id is a BIGINT that needs no counter and is stable when a task is run again:

* ``[0, 2**61)``        constants with a whole-number key: type and key themselves, so an id leads back to its key;
* ``[2**61, 2**62)``    other constants: a hash of type and key;
* ``[2**62, 2**63)``    created terms: a hash of map and arguments.

A class of equal terms is represented by its smallest id: a constant if there
is one, and of whole-number constants the one of the smallest key.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, functions as F

KEY_BITS = 48
MAX_TYPES = 1 << 13
_SEED = 42
_NAMED = 1 << 61
_TERM = 1 << 62


def hash_values(*values: int | str) -> int:
    """What ``xxhash64`` gives in a plan for BIGINT and STRING values, unsigned."""
    h = _SEED
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h


def integer_id(type_index: int, key: int) -> int:
    if not 0 <= key < 1 << KEY_BITS:
        raise ValueError(f"key {key} is not in [0, 2**{KEY_BITS})")
    return (type_index << KEY_BITS) | key


def named_id(type_index: int, key: str) -> int:
    return hash_values(type_index, key) & (_NAMED - 1) | _NAMED


def term_hash(map_index: int, args: tuple[int, ...]) -> int:
    return hash_values(map_index, *args) & (_TERM - 1) | _TERM


def integer_column(type_index: int, key: Column) -> Column:
    k = key.cast("long")
    ok = (k >= 0) & (k < F.lit(1 << KEY_BITS))
    return F.when(ok, k + F.lit(type_index << KEY_BITS)).otherwise(F.raise_error(F.lit("a key is null or out of range")).cast("long"))


def integer_key(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def named_column(type_index: int, key: Column) -> Column:
    h = F.xxhash64(F.lit(type_index).cast("long"), key.cast("string"))
    made = h.bitwiseAND(F.lit(_NAMED - 1)).bitwiseOR(F.lit(_NAMED))
    return F.when(key.isNotNull(), made).otherwise(F.raise_error(F.lit("a key is null")).cast("long"))


def term_column(map_index: int, args: list[Column]) -> Column:
    h = F.xxhash64(F.lit(map_index).cast("long"), *args)
    return h.bitwiseAND(F.lit(_TERM - 1)).bitwiseOR(F.lit(_TERM))


@dataclass(frozen=True)
class TypeId:
    db: str
    index: int
    name: str = field(default="", compare=False)
    #: Whether its constants have whole-number keys.
    integer: bool = field(default=False, compare=False)


@dataclass(frozen=True)
class TermId:
    db: str
    value: int
    type: TypeId = field(compare=False)


@dataclass(frozen=True)
class MapSignature:
    """Types of the arguments, and the type of the value."""

    inputs: tuple[TypeId, ...]
    output: TypeId

    def __init__(self, inputs, output):
        object.__setattr__(self, "inputs", tuple(inputs))
        object.__setattr__(self, "output", output)


@dataclass(frozen=True)
class MapId:
    """A declared map; calling it builds a term or pattern over it."""

    db: str
    index: int
    signature: MapSignature = field(compare=False)
    name: str = field(default="", compare=False)

    def __call__(self, *args):
        from koine.plans.ast import Apply

        return Apply(self, tuple(args))

    @property
    def arity(self) -> int:
        return len(self.signature.inputs)
