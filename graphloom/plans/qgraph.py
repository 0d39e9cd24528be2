"""The query's graph: connectivity, cycles, walks and shape of a basic graph pattern."""

from __future__ import annotations

from dataclasses import dataclass

from .syntax import Const, Pattern, Var


def node_key(x: Var | Const) -> str:
    return f"?{x.name}" if isinstance(x, Var) else x.term


@dataclass
class QueryGraph:
    """Nodes are subjects and objects; edge i is pattern i. Joins run over variables only."""

    patterns: list[Pattern]

    def edges(self) -> list[tuple[str, str]]:
        return [(node_key(p.s), node_key(p.o)) for p in self.patterns]

    def components(self) -> list[list[int]]:
        """Patterns that shared variables connect, in order of first appearance."""
        left, out = set(range(len(self.patterns))), []
        while left:
            todo, seen = [min(left)], []
            left -= {todo[0]}
            while todo:
                i = todo.pop()
                seen.append(i)
                near = {j for j in left if set(self.patterns[i].vars()) & set(self.patterns[j].vars())}
                left -= near
                todo += sorted(near, reverse=True)
            out.append(sorted(seen))
        return out

    def cycles(self) -> int:
        """Independent cycles of the graph over nodes: edges - nodes + connected parts."""
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        n = 0
        for a, b in self.edges():
            a, b = root(a), root(b)
            n += a == b
            parent[a] = b
        return n

    def walk(self, root: int = 0) -> list[tuple[int, int]]:
        """(child, parent) patterns of a spanning tree over shared variables, from the root down, parent -1 for the root.

        A pattern that meets the tree in several places hangs on the first; its
        other meetings are closed by the join on all shared variables.
        """
        out, todo, seen = [], [(root, -1)], {root}
        while todo:
            i, parent = todo.pop(0)
            out.append((i, parent))
            for j, p in enumerate(self.patterns):
                if j not in seen and set(p.vars()) & set(self.patterns[i].vars()):
                    seen.add(j)
                    todo.append((j, i))
        return out

    def shape(self) -> str:
        """single, star, linear, snowflake or cyclic (one connected pattern), else disconnected."""
        if len(self.components()) > 1:
            return "disconnected"
        if self.cycles():
            return "cyclic"
        if len(self.patterns) == 1:
            return "single"
        degree: dict[str, int] = {}
        for a, b in self.edges():
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
        hubs = sum(d > 1 for d in degree.values())
        if hubs == 1 and max(degree.values()) > 2 or hubs == 1 and len({node_key(p.s) for p in self.patterns}) == 1:
            return "star"
        return "linear" if max(degree.values()) <= 2 else "snowflake"
