"""A plain evaluator of rules over sets and a union-find, as an oracle for small worlds."""

from __future__ import annotations

from koine.functions.ids import TermId, integer_id, term_hash
from koine.plans.ast import Apply, Rule, Union, Var


class Naive:
    def __init__(self):
        self.rows: dict[tuple[int, tuple[int, ...]], int] = {}
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def insert(self, m, args: tuple[int, ...]) -> int:
        args = tuple(map(self.find, args))
        return self.rows.setdefault((m.index, args), term_hash(m.index, args))

    def build(self, node, env: dict | None = None) -> int:
        if isinstance(node, Var):
            return env[node]
        if isinstance(node, TermId):
            return self.find(node.value)
        return self.insert(node.map, tuple(self.build(a, env) for a in node.args))

    def lookup(self, node, env) -> int | None:
        if isinstance(node, Apply):
            args = tuple(self.lookup(a, env) for a in node.args)
            return self.rows.get((node.map.index, args))
        return env[node] if isinstance(node, Var) else self.find(node.value)

    def match(self, pattern: Apply, out: int | None, env: dict):
        for (m, args), value in list(self.rows.items()):
            if m != pattern.map.index or out is not None and value != out:
                continue
            yield from self._args(pattern.args, args, env)

    def _args(self, patterns, values, env):
        if not patterns:
            yield env
            return
        p, v = patterns[0], values[0]
        if isinstance(p, Var):
            options = [env | {p: v}] if env.get(p, v) == v else []
        elif isinstance(p, TermId):
            options = [env] if self.find(p.value) == v else []
        else:
            options = self.match(p, v, env)
        for e in options:
            yield from self._args(patterns[1:], values[1:], e)

    def step(self, rules: list[Rule]) -> bool:
        before = (dict(self.rows), dict(self.up))
        found = []
        for r in rules:
            envs = [{}]
            for p in r.patterns:
                envs = [e2 for e in envs for e2 in self.match(p, None, e)]
            found += [(r, e) for e in envs]
        unions = []
        for r, e in found:
            for a in r.actions:
                if isinstance(a, Union):
                    unions.append((self.build(a.left, e), self.build(a.right, e)))
                else:
                    self.build(a, e)
        for a, b in unions:
            self.unite(a, b)
        self.rebuild()
        return before != (self.rows, self.up)

    def rebuild(self) -> None:
        again = True
        while again:
            again, rows = False, {}
            for (m, args), out in self.rows.items():
                key, out = (m, tuple(map(self.find, args))), self.find(out)
                if key in rows and rows[key] != out:
                    again |= self.unite(rows[key], out)
                rows[key] = min(out, rows.get(key, out))
            self.rows = rows

    def of(self, m) -> set[tuple[int, ...]]:
        return {(*args, self.find(out)) for (i, args), out in self.rows.items() if i == m.index}


def constant(t, key: int) -> int:
    return integer_id(t.index, key)
