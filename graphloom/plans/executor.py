"""Queries as DataFrame plans: scans, joins on shared variables, filters, modifiers."""

from __future__ import annotations


from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import Registry, compile_filter
from ..functions.terms import order_keys
from ..operators.store import GraphStore, Mapped, TermMap, apart, made_term
from . import planner
from .syntax import Const, Expr, Group, Pattern, Select, Update, Var, parse


@dataclass
class Bindings:
    """Solutions: a column for each variable; maybe: those that may be unbound (null)."""

    df: DataFrame
    vars: list[str]
    maybe: set[str] = field(default_factory=set)


@dataclass
class Engine:
    """Runs queries over a store. reduce: prune patterns by semi-joins before joining them."""

    store: GraphStore
    reduce: bool = False
    registry: Registry = field(default_factory=dict)
    #: scans that stand in for patterns by their number in the group (streams, say)
    sources: dict[int, DataFrame] = field(default_factory=dict)

    # column names: variables differ by case, Spark's names don't
    @staticmethod
    def _name(var: str) -> str:
        return "v_" + "".join(f"{c.lower()}^" if c.isupper() else c for c in var)

    def _col(self, var: str) -> Column:
        return F.col(f"`{self._name(var)}`")

    # patterns
    def scan(self, p: Pattern, source: DataFrame | None = None, keep: tuple[str, ...] = ()) -> Bindings:
        """One pattern: constants and repeated variables are filters, variables are columns. keep: columns of the source that stay."""
        if source is not None:
            df = source.select("s", "p", "o", *keep)
            df = df.where(F.col("p") == p.p.term) if isinstance(p.p, Const) else df
        elif isinstance(p.p, Const):
            df = self.store.layer(p.p.term, *[x.term if isinstance(x, Const) else None for x in (p.s, p.o)])
        else:
            df = self.store.triples()
        names: dict[str, str] = {}
        for at, x in zip(("s", "p", "o"), p.nodes(), strict=True):
            if isinstance(x, Const):
                if at != "p" and (source is not None or not isinstance(p.p, Const)):
                    df = df.where(F.col(at) == x.term)
            elif x.name in names:
                df = df.where(F.col(at) == F.col(names[x.name]))
            else:
                names[x.name] = at
        return Bindings(df.select(*[F.col(at).alias(self._name(v)) for v, at in names.items()], *keep) if names or keep else df.select(F.lit(True).alias("__there")).limit(1), list(names))

    def bgp(self, patterns: list[Pattern], first: int = 0) -> Bindings:
        """All solutions of a basic graph pattern, with their multiplicity. first: the number of its first pattern in the group."""
        todo = planner.plan(patterns, self.store, self.reduce)
        keyed, parts = self._keys(patterns, first)
        found = {i: self._scan_keys(p, parts[i], keyed) if i in parts else self.scan(p, self.sources.get(first + i)) for i, p in enumerate(patterns)}
        for target, by in todo.semijoins:
            shared = [v for v in found[target].vars if v in found[by].vars]
            keys = found[by].df.select(*[self._col(v) for v in shared]).distinct()
            found[target] = Bindings(found[target].df.join(keys, [self._name(v) for v in shared], "left_semi"), found[target].vars)
        joined = []
        for members in todo.components:
            joined.append(fold(self.join, self._filtered(patterns, members, found)))
        out = fold(self.join, joined) if joined else None
        if out is not None and keyed:
            out = Bindings(out.df.select(*[(replace(keyed[v], column=self._name(v)).term() if v in keyed else self._col(v)).alias(self._name(v)) for v in out.vars]), out.vars)
        for i in todo.existence:  # one row at most: keeps or empties the rest
            there = found[i].df
            out = Bindings(there if out is None else out.df.join(F.broadcast(there), F.lit(True), "left_semi"), [] if out is None else out.vars)
        return out if out is not None else Bindings(self.store.spark.range(1).select(F.lit(True).alias("__there")), [])

    def _filtered(self, patterns: list[Pattern], members: list[int], found: dict[int, Bindings]) -> list[Bindings]:
        """What is joined in turn: a pattern that only restricts one variable goes to the pattern that brings it in, before that is joined."""
        out, bound, left = [], set(), list(members)
        while left:
            i = left.pop(0)
            mine = found[i]
            for j in [j for j in left if out and len(set(patterns[j].vars())) == 1 and set(patterns[j].vars()) <= set(mine.vars) - bound]:
                mine = self.join(mine, found[j])
                left.remove(j)
            bound |= set(mine.vars)
            out.append(mine)
        return out

    def _keys(self, patterns: list[Pattern], first: int) -> tuple[dict[str, TermMap], dict[int, list[Mapped]]]:
        """Variables that can be joined by the keys of mapped tables instead of terms, with their maps; and what is left of each pattern's tables.

        Tables that can't make a term that another pattern asks for have no solutions.
        """
        if not self.store.keyed() or not all(isinstance(p.p, Const) for p in patterns) or any(first + i in self.sources for i in range(len(patterns))):
            return {}, {}
        terms = lambda p: [x.term if isinstance(x, Const) else None for x in (p.s, p.o)]
        parts = {i: [m for m in self.store.parts(p.p.term) if m.rows(*terms(p)) is not None] for i, p in enumerate(patterns) if p.vars()}
        made = lambda m, p, v: [x for at, x in ((p.s, m.s), (p.o, m.o)) if isinstance(at, Var) and at.name == v]
        meets = lambda m, p, v, j: any(not apart(x, y) for other in parts[j] for y in made(other, patterns[j], v) for x in made(m, p, v))
        while True:
            kept = {i: [m for m in parts[i] if all(meets(m, patterns[i], v, j) for v in patterns[i].vars() for j in parts if v in patterns[j].vars())] for i in parts}
            if not all(kept.values()):
                return {}, {}
            if kept == parts:
                break
            parts = kept
        keyed: dict[str, TermMap] = {}
        for v in dict.fromkeys(v for i in parts for v in patterns[i].vars()):
            maps = {x if isinstance(x, str) else x.family() for i in parts for m in parts[i] for x in made(m, patterns[i], v)}
            if len(maps) == 1 and isinstance(x := maps.pop(), TermMap) and x.kind != "string":
                keyed[v] = x
        return keyed, parts

    def _scan_keys(self, p: Pattern, parts: list[Mapped], keyed: dict[str, TermMap]) -> Bindings:
        """One pattern over some mapped tables: keyed variables as keys, others as terms."""
        where = [x.term if isinstance(x, Const) else None for x in (p.s, p.o)]
        names: dict[str, str] = {}
        for at, x in (("s", p.s), ("o", p.o)):
            if isinstance(x, Var):
                names.setdefault(x.name, at)
        value = lambda x, at: (at.key() if x.name in keyed else made_term(at))
        found = []
        for m in parts:
            df = m.rows(*where).select(*[value(x, made).alias(at) for at, x, made in (("s", p.s, m.s), ("o", p.o, m.o)) if isinstance(x, Var)])
            found.append(df.where(F.col("s") == F.col("o")) if len(names) == 1 and len(df.columns) == 2 else df)
        return Bindings(fold(DataFrame.unionAll, found).select(*[F.col(at).alias(self._name(v)) for v, at in names.items()]), list(names))

    def join(self, a: Bindings, b: Bindings, how: str = "inner", filters: list[Expr] | None = None) -> Bindings:
        """Compatible solutions: equal on shared variables, an unbound one fitting everything. Two or more shared ones close a cycle.

        how: inner, or left, which keeps solutions of a that no solution of b fits;
        filters say what fits, too.
        """
        shared = [v for v in a.vars if v in b.vars]
        every = [*a.vars, *[v for v in b.vars if v not in a.vars]]
        maybe = {v for v in every if (v in a.maybe or v not in a.vars) and (v in b.maybe or v not in b.vars)}
        if how == "left":
            maybe |= (a.maybe | set(b.vars) - set(a.vars)) & set(every)
        if (a.maybe | b.maybe) & set(shared):
            return Bindings(self._compatible(a, b, shared, every, how, filters), every, maybe)
        if how == "inner" and not filters and shared:
            return Bindings(a.df.join(b.df, [self._name(v) for v in shared]).select(*[self._col(v) for v in every]), every, maybe)
        left, right = self._sides(a, b)
        conditions = [self._col(v) == self._theirs(v) for v in shared] + self._fits(a, b, shared, every, filters)
        df = left.join(right, fold(Column.__and__, conditions, F.lit(True)), how) if conditions or how != "inner" else left.crossJoin(right)
        return Bindings(df.select(*[self._value(a, b, v, shared).alias(self._name(v)) for v in every]) if every else df.select(F.lit(True).alias("__there")), every, maybe)

    def _theirs(self, v: str) -> Column:
        return F.col(f"`r_{self._name(v)}`")

    def _sides(self, a: Bindings, b: Bindings, *more: Column) -> tuple[DataFrame, DataFrame]:
        """Both sides, the right one's columns renamed."""
        right = b.df.select(*[self._col(v).alias(f"r_{self._name(v)}") for v in b.vars], *more) if b.vars else b.df.select(F.lit(True).alias("r___there"), *more)
        return (a.df if a.vars else a.df.select(F.lit(True).alias("__there"))), right

    def _value(self, a: Bindings, b: Bindings, v: str, equal: list[str]) -> Column:
        """What a joined row binds v to."""
        if v not in a.vars:
            return self._theirs(v)
        return F.coalesce(self._col(v), self._theirs(v)) if v in b.vars and v not in equal else self._col(v)

    def _fits(self, a: Bindings, b: Bindings, equal: list[str], every: list[str], filters: list[Expr] | None) -> list[Column]:
        return [compile_filter(e, lambda v: self._value(a, b, v, equal) if v in every else None, self.registry) for e in filters or []]

    def _compatible(self, a: Bindings, b: Bindings, shared: list[str], every: list[str], how: str, filters: list[Expr] | None) -> DataFrame:
        """The join where shared variables may be unbound, as one equi-join that reads each side once.

        A set of variables is a number, a bit for each. Each row goes under the sets
        that it may have in common with a row of the other side: what it binds, less
        any of those that the other side may leave unbound. Rows meet under equal
        sets and equal values in them, if the set is all that both bind.
        """
        bit = {v: 1 << i for i, v in enumerate(shared)}
        sets = [sum(bit[v] for v in shared if v not in a.maybe | b.maybe)]
        for v in shared:
            if v in a.maybe | b.maybe:
                sets += [x | bit[v] for x in sets]
        bound = lambda col, side: fold(Column.__add__, [F.when(col(v).isNotNull(), bit[v]).otherwise(0) if v in side.maybe else F.lit(bit[v]) for v in shared])
        sure = lambda side: sum(bit[v] for v in shared if v not in side.maybe)
        within = lambda mine, other: F.filter(F.array(*[F.lit(x) for x in sets]), lambda x: (x.bitwiseAND(mine) == x) & (mine.bitwiseAND(F.lit(sure(other))).bitwiseAND(x) == mine.bitwiseAND(F.lit(sure(other)))))
        keys = lambda col, under: [F.when(F.col(under).bitwiseAND(F.lit(bit[v])) != 0, col(v)).otherwise(F.lit("")) for v in shared]
        left, right = self._sides(a, b)
        many = how == "left" and bool(b.maybe & set(shared))
        if many:
            left = left.withColumn("__row", F.monotonically_increasing_id())
        left = left.withColumn("__mine", bound(self._col, a)).withColumn("__under", F.explode(within(F.col("__mine"), b)))
        right = right.withColumn("r___mine", bound(self._theirs, b)).withColumn("r___under", F.explode(within(F.col("r___mine"), a)))
        left = left.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys(self._col, "__under"))])
        right = right.select("*", *[k.alias(f"r___k{i}") for i, k in enumerate(keys(self._theirs, "r___under"))])
        conditions = [F.col("__under") == F.col("r___under")] + [F.col(f"__k{i}") == F.col(f"r___k{i}") for i in range(len(shared))]
        conditions += [F.col("__mine").bitwiseAND(F.col("r___mine")) == F.col("__under"), *self._fits(a, b, [], every, filters)]
        df = left.join(right, fold(Column.__and__, conditions), how)
        if many:
            # a row that went under several sets: what it met, or once, alone, if it met nothing
            own = Window.partitionBy("__row")
            met = F.col("r___under").isNotNull()
            df = df.withColumn("__met", F.max(met).over(own)).withColumn("__nth", F.row_number().over(own.orderBy("__under"))).where(met | (~F.col("__met") & (F.col("__nth") == 1)))
        return df.select(*[self._value(a, b, v, []).alias(self._name(v)) for v in every])

    # groups
    def group(self, g: Group) -> Bindings:
        out = self.parts(g)
        for e in g.filters:
            out = Bindings(out.df.where(compile_filter(e, lambda v, out=out: self._col(v) if v in out.vars else None, self.registry)), out.vars, out.maybe)
        return out

    def parts(self, g: Group) -> Bindings:
        """A group without its filters: what stands between optionals is joined in any order, an optional to all that stands before it."""
        out, done = None, (0, 0, 0)
        sizes = len(g.patterns), len(g.unions), len(g.nested)
        for upto, optional in [*zip(g.before, g.optionals, strict=True), (sizes, None)]:
            found = []
            if patterns := g.patterns[done[0] : upto[0]]:
                found.append(self.bgp(patterns, done[0]))
            found += [self.union([self.group(b) for b in branches]) for branches in g.unions[done[1] : upto[1]]]
            found += [self.group(x) for x in g.nested[done[2] : upto[2]]]
            for x in found:
                out = x if out is None else self.join(out, x)
            done = upto
            if optional is not None:
                # its filters see what it is joined to
                out = self.join(self.bgp([]) if out is None else out, self.parts(optional), "left", optional.filters)
        return out or self.bgp([])

    def union(self, branches: list[Bindings]) -> Bindings:
        every = list(dict.fromkeys(v for b in branches for v in b.vars))
        fill = lambda b: b.df.select(*[(self._col(v) if v in b.vars else F.lit(None).cast("string")).alias(self._name(v)) for v in every])
        maybe = {v for v in every if any(v not in b.vars or v in b.maybe for b in branches)}
        return Bindings(fold(DataFrame.unionAll, [fill(b) for b in branches]), every, maybe)

    # queries
    def select(self, q: Select) -> DataFrame:
        names = q.columns()
        found = self.group(q.where)
        column = lambda v: self._col(v) if v in found.vars else F.lit(None).cast("string")
        keys = [v for v, _ in q.order if v != "count" and v not in names]
        df = found.df.select(*[column(v).alias(self._name(v)) for v in dict.fromkeys([*names, *([] if q.modifier in ("distinct", "reduced", "count") else keys)])])
        if q.modifier in ("distinct", "reduced"):
            df = df.distinct()
        elif q.modifier == "count":
            df = df.groupBy(*df.columns).agg(F.count("*").alias("__count"))
        for_order: list[Column] = []
        for v, down in q.order:
            if v == "count":
                for_order.append(F.desc("__count") if down else F.asc("__count"))
            elif self._name(v) in df.columns:
                for_order += [k.desc_nulls_last() if down else k.asc_nulls_first() for k in order_keys(self._col(v))]
        if for_order:
            df = df.orderBy(*for_order)
        if q.limit is not None:
            df = df.limit(q.limit)
        out = [self._col(v).alias(v) for v in names]
        return df.select(*out, F.col("__count").alias("count")) if q.modifier == "count" else df.select(*out)

    def query(self, text: str) -> DataFrame:
        q = parse(text)
        if isinstance(q, Update):
            raise TypeError("an update changes a store: use update()")
        return self.select(q)

    def update(self, text: str) -> GraphStore:
        """The store after INSERT DATA or DELETE DATA; this one stays as it is."""
        q = parse(text)
        if isinstance(q, Select):
            raise TypeError("not an update")
        return self.store.with_triples(q.triples) if q.kind == "insert" else self.store.without_triples(q.triples)

    def ask(self, text: str) -> bool:
        return not self.query(text).isEmpty()

    def explain(self, text: str) -> str:
        """Spark's formatted plan of a query."""
        df = self.query(text)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
