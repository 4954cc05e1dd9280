"""Terms, patterns, actions and rules as trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from koine.errors import ArityError, ForeignIdError, TypeMismatchError, UnboundVariableError
from koine.functions.ids import MapId, TermId, TypeId


@dataclass(frozen=True)
class Var:
    """A variable of one rule."""

    name: str


@dataclass(frozen=True)
class Apply:
    """A map applied to inputs: a ground term without variables, else a pattern."""

    map: MapId
    args: tuple["Input", ...]

    def __post_init__(self):
        if len(self.args) != self.map.arity:
            raise ArityError(f"map {self.map.name or self.map.index} takes {self.map.arity} arguments, not {len(self.args)}")
        for a, expected in zip(self.args, self.map.signature.inputs, strict=True):
            got = type_of(a)
            if got is not None and got != expected:
                raise TypeMismatchError(f"argument of map {self.map.name or self.map.index}: type {got.index} instead of {expected.index}")


Input = Var | TermId | Apply


@dataclass(frozen=True)
class Union:
    """The action of making two inputs equal."""

    left: Input
    right: Input


Action = Apply | Union


@dataclass(frozen=True)
class Rule:
    """For all matches of the patterns, take the actions."""

    patterns: tuple[Apply, ...]
    actions: tuple[Action, ...]

    def __init__(self, patterns: Iterable[Apply] = (), actions: Iterable[Action] = ()):
        object.__setattr__(self, "patterns", tuple(patterns))
        object.__setattr__(self, "actions", tuple(actions))
        check_rule(self)


def type_of(node: Input) -> TypeId | None:
    """The type of an input, None for a variable on its own."""
    if isinstance(node, TermId):
        return node.type
    return node.map.signature.output if isinstance(node, Apply) else None


def walk(node) -> Iterator:
    yield node
    for child in node.args if isinstance(node, Apply) else (node.left, node.right) if isinstance(node, Union) else ():
        yield from walk(child)


def check_rule(rule: Rule) -> None:
    """Each variable has one type, and actions use bound variables only; both
    sides of a union have one type."""
    types: dict[Var, TypeId] = {}
    bound = {n for p in rule.patterns for n in walk(p) if isinstance(n, Var)}
    for top in (*rule.patterns, *rule.actions):
        for node in walk(top):
            if not isinstance(node, Apply):
                continue
            for a, expected in zip(node.args, node.map.signature.inputs, strict=True):
                if isinstance(a, Var) and types.setdefault(a, expected) != expected:
                    raise TypeMismatchError(f"variable {a.name} stands for two types")
    for action in rule.actions:
        for node in walk(action):
            if isinstance(node, Var) and node not in bound:
                raise UnboundVariableError(f"no pattern binds variable {node.name}")
        if isinstance(action, Union):
            left, right = (types.get(s) if isinstance(s, Var) else type_of(s) for s in (action.left, action.right))
            if left is not None and right is not None and left != right:
                raise TypeMismatchError("a union of two types")


def check_local(rule: Rule, db: str) -> None:
    for top in (*rule.patterns, *rule.actions):
        for node in walk(top):
            if isinstance(node, (TermId,)) and node.db != db or isinstance(node, Apply) and node.map.db != db:
                raise ForeignIdError("a rule uses an id of another database")


def rewrite(left: Input | Iterable[Input], right: Input | Iterable[Input]) -> Rule:
    """``L -> R``: wherever the patterns of L match, each item of L equals the
    item of R at its place.  Items of L beyond those of R only guard."""
    left = (left,) if isinstance(left, (Var, TermId, Apply)) else tuple(left)
    right = (right,) if isinstance(right, (Var, TermId, Apply)) else tuple(right)
    if len(right) > len(left):
        raise ArityError("a rewrite has more right sides than left sides")
    return Rule([x for x in left if isinstance(x, Apply)], [Union(a, b) for a, b in zip(left, right, strict=False)])


def equivalence(left: Input | Iterable[Input], right: Input | Iterable[Input]) -> list[Rule]:
    """``L == R``: the rewrites both ways."""
    return [rewrite(left, right), rewrite(right, left)]
