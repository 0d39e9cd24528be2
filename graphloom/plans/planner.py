"""Join order and semi-join programs for basic graph patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.store import GraphStore
from .qgraph import QueryGraph
from .syntax import Const, Pattern, Var

#: Triples of a predicate that is not analyzed.
UNKNOWN = 1_000_000.0


def estimate(p: Pattern, store: GraphStore) -> float:
    """Triples that a pattern is likely to match by itself."""
    constant = lambda x: isinstance(x, Const)
    if store.stats is not None:
        if constant(p.p):
            n, s, o = store.stats.get(p.p.term, (0, 1, 1))
        else:
            n, s, o = (sum(x[i] for x in store.stats.values()) for i in range(3))
        out = float(n)
        if constant(p.s):
            out /= max(s, 1)
        if constant(p.o):
            out /= max(o, 1)
        return out
    return UNKNOWN * (1 if constant(p.p) else 20) * (1e-4 if constant(p.s) else 1) * (1e-2 if constant(p.o) else 1)


@dataclass
class Plan:
    """existence: patterns without variables; components: orders of the others, each one connected."""

    existence: list[int] = field(default_factory=list)
    components: list[list[int]] = field(default_factory=list)
    #: (pattern, pattern that prunes it), in order: backward from the leaves, then forward from the root
    semijoins: list[tuple[int, int]] = field(default_factory=list)


def star(patterns: list[Pattern], store: GraphStore) -> float:
    """Solutions of patterns with one subject and constant predicates, by characteristic sets: subjects that have all the predicates, times what they have of each."""
    out = 0.0
    for has, subjects in store.sets or []:
        if all(p.p.term in has for p in patterns):
            rows = float(subjects)
            for p in patterns:
                rows *= has[p.p.term] / subjects
            out += rows
    for p in patterns:
        _, s, o = store.stats.get(p.p.term, (0, 1, 1))
        out /= max(o, 1) if isinstance(p.o, Const) else 1
    return out / max(max(store.stats.get(p.p.term, (0, 1, 1))[1] for p in patterns), 1) if isinstance(patterns[0].s, Const) else out


def growth(p: Pattern, done: list[Pattern], bound: set[str], store: GraphStore) -> float:
    """How many times as many solutions there are once p is joined to the patterns done."""
    if not isinstance(p.p, Const) or store.stats is None:
        return estimate(p, store)
    n, s, o = store.stats.get(p.p.term, (0, 1, 1))
    same = [q for q in done if q.s == p.s and isinstance(q.p, Const)]
    subject = isinstance(p.s, Const) or p.s.name in bound
    object_ = isinstance(p.o, Const) or p.o.name in bound
    if same and store.sets is not None:
        before = star(same, store)
        fan = star([*same, p], store) / before if before else 0.0
        return fan / max(o, 1) if object_ and not isinstance(p.o, Const) else fan
    return n / (max(s, 1) if subject else 1) / (max(o, 1) if object_ else 1)


def order(patterns: list[Pattern], members: list[int], store: GraphStore) -> list[int]:
    """Greedy: the most selective pattern first, then always one that only closes cycles if there is any, else the most selective connected one.

    With statistics, that is the one by which solutions grow least: patterns with
    a subject in common by characteristic sets, which know what goes together.
    """
    if store.stats is not None and store.sets is not None:
        return _by_growth(patterns, members, store)
    left = list(members)
    cost = {i: (estimate(patterns[i], store), i) for i in left}
    out = [min(left, key=cost.get)]
    left.remove(out[0])
    bound = set(patterns[out[0]].vars())
    while left:
        near = [i for i in left if bound & set(patterns[i].vars())]
        closing = [i for i in near if set(patterns[i].vars()) <= bound]
        out.append(min(closing or near, key=cost.get))
        left.remove(out[-1])
        bound |= set(patterns[out[-1]].vars())
    return out


def _by_growth(patterns: list[Pattern], members: list[int], store: GraphStore) -> list[int]:
    left = list(members)
    out = [min(left, key=lambda i: (estimate(patterns[i], store), i))]
    left.remove(out[0])
    bound = set(patterns[out[0]].vars())
    while left:
        near = [i for i in left if bound & set(patterns[i].vars())]
        closing = [i for i in near if set(patterns[i].vars()) <= bound]
        done = [patterns[i] for i in out]
        out.append(min(closing or near, key=lambda i: (growth(patterns[i], done, bound, store), i)))  # noqa: B023
        left.remove(out[-1])
        bound |= set(patterns[out[-1]].vars())
    return out


def selective(p: Pattern, store: GraphStore) -> bool:
    """Whether a pattern leaves out most triples of its predicate: only then can it, or what it prunes, be worth a semi-join."""
    whole = Pattern(Var("s"), p.p, Var("o"))
    return estimate(p, store) <= estimate(whole, store) / 2


def plan(patterns: list[Pattern], store: GraphStore, reduce: bool = False) -> Plan:
    out = Plan(existence=[i for i, p in enumerate(patterns) if not p.vars()])
    for members in QueryGraph(patterns).components():
        if members[0] in out.existence:
            continue
        ordered = order(patterns, members, store)
        out.components.append(ordered)
        if reduce and len(ordered) > 1:
            walk = QueryGraph([patterns[i] for i in ordered]).walk()
            steps = [(ordered[c], ordered[p]) for c, p in walk if p >= 0]
            pruned = {i for i in ordered if selective(patterns[i], store)}
            for target, by in [(p, c) for c, p in reversed(steps)] + steps:
                if by in pruned:  # one that nothing has pruned can't prune but by dangling nodes, at the price of a scan
                    out.semijoins.append((target, by))
                    pruned.add(target)
    out.components.sort(key=lambda c: min(estimate(patterns[i], store) for i in c))
    return out
