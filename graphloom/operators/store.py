"""A graph as DataFrames of triples.

A store is a set of predicate layers, each a lazy DataFrame (s, o) of distinct
pairs, or one DataFrame (s, p, o) of distinct triples, or both views of the same
thing. Scans of a constant predicate read its layer only, so filters, pruned
columns and partitions reach the files below.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import fresh, merged, skew_join, small
from .ranking import numbered
from .storage import stored

TRIPLE = ["s", "p", "o"]
CHANGE = "s string, p string, o string, there boolean"


@dataclass(frozen=True)
class TermMap:
    """Terms made of a column: before + value + after. Inverted for constants, so that they become filters on the column itself."""

    column: str
    before: str
    after: str
    kind: str = "string"  # of the column: bigint, int or string

    def term(self) -> Column:
        return F.concat(F.lit(self.before), F.col(self.column).cast("string"), F.lit(self.after))

    def family(self) -> TermMap:
        """The map for keys of its sort, of whatever column: two columns with equal families have equal terms where their keys are equal."""
        return replace(self, column="key", kind="string" if self.kind == "string" else "bigint")

    def key(self) -> Column:
        return F.col(self.column).cast(self.family().kind).alias("key")

    def apart(self, other: TermMap | str) -> bool:
        """Whether it can be told from the maps that no term is of both."""
        if isinstance(other, str):
            return self.value(other) is None
        ends = lambda a, b, within: not (within(a, b) or within(b, a))
        return ends(self.before, other.before, str.startswith) or ends(self.after, other.after, str.endswith)

    def value(self, term: str) -> str | int | None:
        """The column's value for a term, None if no value gives it."""
        end = len(term) - len(self.after)
        if end < len(self.before) or not (term.startswith(self.before) and term.endswith(self.after)):
            return None
        inner = term[len(self.before) : end]
        if self.kind == "string":
            return inner
        limit = 2**63 if self.kind == "bigint" else 2**31
        return int(inner) if re.fullmatch(r"0|-?[1-9][0-9]*", inner) and -limit <= int(inner) < limit else None


@dataclass(frozen=True)
class Mapped:
    """One predicate's pairs from one table, subject and object each a TermMap or a constant term. The pairs are distinct as they are, unless the table repeats them."""

    df: DataFrame
    s: TermMap | str
    o: TermMap | str
    repeats: bool = False

    def rows(self, s: str | None = None, o: str | None = None) -> DataFrame | None:
        """The key columns of distinct pairs, where s and o are the terms given; None if the table can't hold them: it needs no scan."""
        df = self.df
        for wanted, made in ((s, self.s), (o, self.o)):
            if wanted is None:
                continue
            if isinstance(made, str):
                if made != wanted:
                    return None
                continue
            value = made.value(wanted)
            if value is None:
                return None
            df = df.where(F.col(made.column) == F.lit(value))
        columns = list(dict.fromkeys(made.column for made in (self.s, self.o) if isinstance(made, TermMap)))
        # distinct on the keys, before they become strings; hardly a pair is repeated, so they are dealt out first: a task that reads need not hold all its pairs
        return df.select(*columns).repartition(columns[0]).distinct() if self.repeats else df

    def named(self) -> Column:
        """Whether a row has keys for both terms: what lacks one makes a null."""
        return reduce(Column.__and__, [F.col(made.column).isNotNull() for made in (self.s, self.o) if isinstance(made, TermMap)])

    def pairs(self, s: str | None = None, o: str | None = None, only: Column | None = None) -> DataFrame | None:
        """(s, o), where s and o are the terms given; None as in rows(). only: a condition on the table."""
        df = self.rows(s, o) if only is None else replace(self, df=self.df.where(only)).rows(s, o)
        return None if df is None else df.select(made_term(self.s).alias("s"), made_term(self.o).alias("o"))


def apart(a: TermMap | str, b: TermMap | str) -> bool:
    """Whether it can be told that the two make no term in common."""
    return a != b if isinstance(a, str) and isinstance(b, str) else b.apart(a) if isinstance(a, str) else a.apart(b)


def made_term(made: TermMap | str) -> Column:
    return F.lit(made) if isinstance(made, str) else made.term()


def _number(column: str) -> TermMap:
    return TermMap(column, "<", ">", "bigint")


@dataclass
class GraphStore:
    spark: SparkSession
    table: DataFrame | None = None
    layers: dict[str, DataFrame | list[Mapped]] = field(default_factory=dict)
    #: predicate -> (triples, distinct subjects, distinct objects), once analyzed
    stats: dict[str, tuple[int, int, int]] | None = None
    #: characteristic sets, once analyzed: (predicates of a subject -> triples of each, how many subjects have just these), most subjects first
    sets: list[tuple[dict[str, int], int]] | None = None
    #: (s, p, o, there) of distinct triples that were put in (there) or taken out since
    changes: DataFrame | None = None
    #: (s, p, o) of numbers in any multiplicity, if the table's terms are just these, as `<number>`s
    ids: DataFrame | None = None

    @classmethod
    def from_triples(cls, df: DataFrame) -> GraphStore:
        """From (s, p, o) in any multiplicity: a graph is a set."""
        return cls(df.sparkSession, df.select(*TRIPLE).repartition(*TRIPLE).dropDuplicates())  # dealt out first: a task that reads need not hold all its triples

    @classmethod
    def from_ids(cls, ids: DataFrame) -> GraphStore:
        """From (s, p, o) of numbers in any multiplicity, whose terms are `<number>`s: patterns are joined by the numbers."""
        df = ids.select(*TRIPLE)
        return cls(ids.sparkSession, cls.from_triples(df).table.select(*[_number(c).term().alias(c) for c in TRIPLE]), ids=df)

    @classmethod
    def from_layers(cls, spark: SparkSession, layers: dict[str, DataFrame | list[Mapped]]) -> GraphStore:
        """From {predicate: distinct (s, o)}; a layer of several mapped tables is their union, and they have no pair in common."""
        return cls(spark, None, dict(layers))

    def triples(self) -> DataFrame:
        if self.table is not None:
            return self._changed(self.table, TRIPLE, self.changes)
        if not self.layers:
            return self._changed(self.spark.createDataFrame([], "s string, p string, o string"), TRIPLE, self.changes)
        return self._changed(reduce(DataFrame.unionAll, [self._base_layer(p, None, None).select("s", F.lit(p).alias("p"), "o") for p in self.layers]), TRIPLE, self.changes)

    @staticmethod
    def _changed(df: DataFrame, keys: list[str], changes: DataFrame | None) -> DataFrame:
        """df without the triples that changes has, and with those that it puts in: the base is neither shuffled nor made distinct, unless there are many."""
        if changes is None:
            return df.select(*keys)
        return df.join(changes.select(*keys), keys, "left_anti").select(*keys).unionAll(changes.where("there").select(*keys))

    def layer(self, predicate: str, s: str | None = None, o: str | None = None) -> DataFrame:
        """(s, o) of one predicate, with the subject and object given if any; empty if it is unknown."""
        df = self._base_layer(predicate, s, o)
        if self.changes is not None:
            mine = self.changes.where(F.col("p") == predicate)
            for column, value in (("s", s), ("o", o)):
                mine = mine if value is None else mine.where(F.col(column) == value)
            df = self._changed(df, ["s", "o"], mine)
        return df

    def _base_layer(self, predicate: str, s: str | None, o: str | None) -> DataFrame:
        none = lambda: self.spark.createDataFrame([], "s string, o string")
        if self.table is not None:
            df = self.table.where(F.col("p") == predicate).select("s", "o")
        elif predicate not in self.layers:
            return none()
        elif isinstance(layer := self.layers[predicate], DataFrame):
            df = layer.select("s", "o")
        else:
            parts = [x for m in layer if (x := m.pairs(s, o)) is not None]
            return reduce(DataFrame.unionAll, parts) if parts else none()
        df = df if s is None else df.where(F.col("s") == s)
        return df if o is None else df.where(F.col("o") == o)

    def knows(self, predicate: str) -> bool:
        """False only if the store can tell without a scan that it has no such predicate."""
        return self.table is not None or self.changes is not None or predicate in self.layers

    # profiles
    def predicate_stats(self) -> DataFrame:
        """p, n_triples, n_subjects, n_objects."""
        if self.mapped():
            rows = []
            for p, layer in self.layers.items():  # by keys: a table is counted without its strings
                subjects = self._counted([(m.rows(), m.s) for m in layer]).agg(F.sum("n").alias("n_triples"), F.count("*").alias("n_subjects"), F.lit(0).cast("long").alias("n_objects"))
                objects = self._counted([(m.df, m.o) for m in layer]).agg(F.lit(0).cast("long"), F.lit(0).cast("long"), F.count("*"))
                rows.append(subjects.unionAll(objects).unionAll(self._unnamed(layer).select("n", F.lit(0).cast("long"), F.lit(0).cast("long"))).agg(*[F.sum(c).alias(c) for c in subjects.columns]).where("n_triples > 0").select(F.lit(p).alias("p"), *subjects.columns))
            return reduce(DataFrame.unionAll, rows)
        t = self.triples()
        by_subject = t.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(F.sum("n").alias("n_triples"), F.count("*").alias("n_subjects"))
        return by_subject.join(t.select("p", "o").distinct().groupBy("p").agg(F.count("*").alias("n_objects")), "p")  # a row for each predicate

    def analyze(self, most: int = 10_000) -> GraphStore:
        """The store with statistics for the planner: approximate counts for each predicate, and the `most` commonest characteristic sets.

        A row for each predicate, and for each predicate of these sets, reaches the driver.
        """
        t = self.triples()
        rows = t.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o")).collect()
        subjects = t.groupBy("s", "p").agg(F.count("*").alias("n")).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("has"))
        kinds = subjects.select(F.transform("has", lambda x: x["p"]).alias("kind"), F.inline("has")).groupBy("kind", "p").agg(F.sum("n").alias("n"), F.count("*").alias("subjects"))
        sets = kinds.groupBy("kind").agg(F.collect_list(F.struct("p", "n")).alias("n"), F.max("subjects").alias("subjects")).orderBy(F.desc("subjects"), "kind").limit(most)
        found = [({x.p: x.n for x in r.n}, r.subjects) for r in sets.collect()]
        return replace(self, stats={r.p: (r.n, r.s, r.o) for r in rows}, sets=found)

    def term_frequency(self) -> DataFrame:
        """term, as_subject, as_object, n: occurrences of each term."""
        t = self.triples()
        ends = t.select(F.col("s").alias("term"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(t.select("o", F.lit(0), F.lit(1)))
        return ends.groupBy("term").agg(F.sum("x").alias("as_subject"), F.sum("y").alias("as_object"), F.count("*").alias("n"))

    def position_counts(self) -> DataFrame:
        """position (s, p or o), term, n: occurrences of each term in each position."""
        t = self.triples()
        parts = [t.select(F.lit(c).alias("position"), F.col(c).alias("term")) for c in TRIPLE]
        return reduce(DataFrame.unionAll, parts).groupBy("position", "term").agg(F.count("*").alias("n"))

    # edges and dictionaries
    def remove_double_edges(self) -> GraphStore:
        """One predicate, the least, for each (s, o)."""
        if not self.mapped():
            return GraphStore(self.spark, self.triples().groupBy("s", "o").agg(F.min("p").alias("p")).select(*TRIPLE))
        # mapped tables whose maps tell that they have no edge in common need no comparing; predicates are compared by their rank
        ranked = sorted(self.layers, key=lambda p: p.encode())
        parts = [(i, m) for i, p in enumerate(ranked) for m in self.layers[p]]
        alone = [not any(i != j and not apart(m.s, x.s) and not apart(m.o, x.o) for j, x in parts) for i, m in parts]
        out, shared = [], []
        for (i, m), single in zip(parts, alone, strict=True):
            if single:
                named = m.named()
                out.append(m.pairs(only=named).select("s", F.lit(ranked[i]).alias("p"), "o"))
                shared.append(m.pairs(only=~named).withColumn("i", F.lit(i)))  # no term is equal to no term
            else:
                shared.append(m.pairs().withColumn("i", F.lit(i)))
        least = reduce(DataFrame.unionAll, shared).repartition("s", "o").groupBy("s", "o").agg(F.min("i").alias("i"))
        out.append(least.select("s", F.array(*map(F.lit, ranked))[F.col("i")].alias("p"), "o"))
        return GraphStore(self.spark, reduce(DataFrame.unionAll, out))

    def subject_counts(self) -> DataFrame:
        """n: for each subject, how many triples it has."""
        if self.mapped():
            parts = [m for layer in self.layers.values() for m in layer]
            return self._counted([(m.rows(), m.s) for m in parts]).select("n").unionAll(self._unnamed(parts).where("n > 0"))
        return self.triples().groupBy("s").agg(F.count("*").alias("n")).select("n")

    @staticmethod
    def _unnamed(parts: list[Mapped]) -> DataFrame:
        """n: how many triples have a null for their subject, in one row."""
        found = [replace(m, df=m.df.where(F.col(m.s.column).isNull())).rows().agg(F.count("*").alias("n")) for m in parts if isinstance(m.s, TermMap)]
        return reduce(DataFrame.unionAll, found or [parts[0].df.limit(0).agg(F.count("*").alias("n"))]).agg(F.sum("n").alias("n"))

    def dictionary(self) -> Dictionary:
        if not self.mapped():
            return Dictionary.of(self.triples())
        known = [p for p in self.layers if any(not m.df.isEmpty() for m in self.layers[p])]
        return Dictionary.numbered(self._terms(), self.spark.createDataFrame([(p,) for p in known], "term string"))

    def mapped(self) -> bool:
        """Whether all triples come from mapped tables."""
        return self.table is None and self.changes is None and bool(self.layers) and not any(isinstance(x, DataFrame) for x in self.layers.values())

    def keyed(self) -> bool:
        """Whether parts() has every predicate's triples."""
        return self.mapped() or (self.ids is not None and self.changes is None)

    def parts(self, predicate: str) -> list[Mapped]:
        """The mapped tables of a predicate, if the store is keyed."""
        if self.ids is None:
            return self.layers.get(predicate, [])
        value = _number("p").value(predicate)
        return [] if value is None else [Mapped(self.ids.where(F.col("p") == value), _number("s"), _number("o"), repeats=True)]

    def _terms(self) -> DataFrame:
        """term, n: the terms of mapped tables, and about how often each occurs (a table's repetitions count)."""
        return self._counted([(m.df, made) for layer in self.layers.values() for m in layer for made in (m.s, m.o)])

    @staticmethod
    def _counted(ends: list[tuple[DataFrame, TermMap | str]]) -> DataFrame:
        """term, n: the terms that the maps make of the tables, and how often.

        Each column is counted once, by its keys: strings are made of what is left. Only maps
        that may make the same term are counted again by term.
        """
        times: dict[tuple[int, TermMap | str], int] = {}
        tables = {}
        for df, made in ends:
            tables[id(df)] = df
            times[id(df), made] = times.get((id(df), made), 0) + 1
        families: dict[TermMap | str, list[DataFrame]] = {}
        for (table, made), n in times.items():
            if isinstance(made, str):
                families.setdefault(made, []).append(tables[table].agg((F.count("*") * n).alias("n")).where("n > 0"))
            else:
                families.setdefault(made.family(), []).append(tables[table].select(made.key(), F.lit(n).cast("long").alias("n")).where("key IS NOT NULL"))
        counted = {}
        for made, parts in families.items():
            df = reduce(DataFrame.unionAll, parts)
            df = df if isinstance(made, str) else df.groupBy("key").agg(F.sum("n").alias("n"))
            counted[made] = df.select(made_term(made).alias("term"), "n")
        alone = [made for made, parts in families.items() if all(apart(made, x) for x in families if x is not made) and (not isinstance(made, str) or len(parts) == 1)]
        others = [counted[made] for made in families if made not in alone]
        out = [counted[made] for made in alone]
        if others:
            out.append(reduce(DataFrame.unionAll, others).groupBy("term").agg(F.sum("n").alias("n")))
        return reduce(DataFrame.unionAll, out)

    def encoded(self, d: Dictionary, predicates: list[str] | None = None) -> DataFrame:
        """(s, p, o) of all triples, or those of some predicates, as ids: mapped tables meet the dictionary by their keys, so that no string is made or moved for a triple."""
        wanted = list(self.layers) if predicates is None else predicates
        if not self.mapped():
            return d.encode(self.triples() if predicates is None else self.triples().where(F.col("p").isin(wanted)))
        ids, parts, met = d.lookup(wanted, predicates=True), [], {}
        for p in wanted:
            for m in self.layers.get(p, []) if p in ids else []:
                rows = m.rows().select(*[made.key().alias(at) for at, made in (("s", m.s), ("o", m.o)) if isinstance(made, TermMap)])
                for at, made in (("s", m.s), ("o", m.o)):
                    rows = d.met(rows, at, made, met)
                parts.append(rows.select("s", F.lit(ids[p]).cast("long").alias("p"), "o"))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "s bigint, p bigint, o bigint")

    def with_triples(self, more: Iterable[tuple[str, str, str]]) -> GraphStore:
        return self._with([(*t, True) for t in more])

    def without_triples(self, gone: Iterable[tuple[str, str, str]]) -> GraphStore:
        return self._with([(*t, False) for t in gone])

    def _with(self, rows: list[tuple[str, str, str, bool]]) -> GraphStore:
        """The store after changes that a text lists; the base isn't read."""
        new = self.spark.createDataFrame(list(dict.fromkeys(rows)), CHANGE)
        return self.changed(new)

    def changed(self, new: DataFrame) -> GraphStore:
        """The store after the changes new (s, p, o, there; distinct triples), which come after those before."""
        old = self.changes
        return replace(self, changes=small(new if old is None else old.join(new, TRIPLE, "left_anti").select(*TRIPLE, "there").unionAll(new.select(*TRIPLE, "there"))))

    def save(self, path: str) -> None:
        """Parquet, a directory for each predicate, so that a scan of one reads no other."""
        self.triples().repartition("p", F.pmod(F.xxhash64("s"), F.lit(64))).write.mode("errorifexists").partitionBy("p").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphStore:
        return cls(spark, spark.read.option("basePath", path).schema("s string, o string, p string").parquet(path).select(*TRIPLE))


@dataclass
class Dictionary:
    """Numbers for terms: (id, term) of nodes from 0, of predicates from 2. An id, once given, never changes."""

    nodes: DataFrame
    predicates: DataFrame
    #: (id, term, n) of nodes: how often each was seen, as far as known; only used to deal out hot ones
    seen: DataFrame | None = None
    FIRST_PREDICATE = 2
    #: Bytes of a dictionary that is broadcast; a larger one is joined by shuffle, with hot terms dealt out.
    BROADCAST = 8_000_000

    @classmethod
    def of(cls, triples: DataFrame) -> Dictionary:
        return cls.numbered(cls._terms(triples), triples.select(F.col("p").alias("term")).distinct())

    @classmethod
    def numbered(cls, terms: DataFrame, predicates: DataFrame) -> Dictionary:
        """Of distinct terms (term, n) and predicates (term)."""
        nodes = numbered(terms, ["term"], "id").select("id", "term", "n")
        return cls(nodes.select("id", "term"), numbered(predicates, ["term"], "id", cls.FIRST_PREDICATE).select("id", "term"), nodes)

    @staticmethod
    def _terms(triples: DataFrame) -> DataFrame:
        return triples.select(F.explode(F.array("s", "o")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))

    def extended(self, triples: DataFrame) -> Dictionary:
        """The dictionary with the terms of more triples: old ids stay, new terms follow the greatest id, densely, in their order."""
        following = lambda d, first: max(first, (d.agg(F.max("id")).first()[0] or 0) + 1) if not d.isEmpty() else first
        new = self._terms(triples).join(merged(self.nodes.select("term")), "term", "left_anti")
        nodes = numbered(new, ["term"], "id", following(self.nodes, 0)).select("id", "term", "n")
        new = triples.select(F.col("p").alias("term")).distinct().join(self.predicates.select("term"), "term", "left_anti")
        predicates = numbered(new, ["term"], "id", following(self.predicates, self.FIRST_PREDICATE)).select("id", "term")
        seen = self.seen if self.seen is not None else self.nodes.withColumn("n", F.lit(1).cast("long"))
        return Dictionary(self.nodes.unionAll(nodes.select("id", "term")), self.predicates.unionAll(predicates), seen.unionAll(nodes))

    def save(self, path: str) -> None:
        """Parquet under path; append() adds to it."""
        seen = self.seen if self.seen is not None else self.nodes.withColumn("n", F.lit(1).cast("long"))
        seen.write.mode("errorifexists").parquet(f"{path}/nodes")
        self.predicates.write.mode("errorifexists").parquet(f"{path}/predicates")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        seen = spark.read.schema("id bigint, term string, n bigint").parquet(f"{path}/nodes")
        return cls(seen.select("id", "term"), spark.read.schema("id bigint, term string").parquet(f"{path}/predicates"), seen)

    @classmethod
    def append(cls, spark: SparkSession, path: str, triples: DataFrame) -> Dictionary:
        """The saved dictionary with the terms of more triples, of which only the new ones are written."""
        old = cls.load(spark, path)
        new = old.extended(triples)
        more = new.seen.join(merged(old.nodes.select("id")), "id", "left_anti").select("id", "term", "n"), new.predicates.join(old.predicates.select("id"), "id", "left_anti").select("id", "term")
        for rows, name in zip(more, ("nodes", "predicates"), strict=True):
            rows, _ = stored(spark, rows)  # written apart first: the folder can't be read and added to at once
            rows.write.mode("append").parquet(f"{path}/{name}")
        return cls.load(spark, path)

    def _looked_up(self, df: DataFrame, key: str, value: str, by: str, how: str = "inner") -> DataFrame:
        """df with column value (of kind the other of id and term) for its column key (of kind `by`)."""
        other = "term" if by == "id" else "id"
        (at,) = fresh(df, "__key")  # the key may be called n, as the counts are
        table = self.nodes.select(F.col(by).alias(at), F.col(other).alias(value))
        df = df.withColumnRenamed(key, at)
        near = small(table, self.BROADCAST)
        if near is not table:
            found = df.join(near, at, how)
        else:
            seen = self.seen.select(F.col(by).alias(at), "n") if self.seen is not None else stored(df.sparkSession, df.groupBy(at).agg(F.count("*").alias("n")))[0]
            found = skew_join(df, table, seen, [at], how)
        return found.withColumnRenamed(at, key)

    def met(self, df: DataFrame, at: str, made: TermMap | str, known: dict) -> DataFrame:
        """df with ids in place of the keys in column `at`, whose terms made gives; known: tables of keys that earlier calls made, to be used again."""
        if isinstance(made, str):
            return df.withColumn(at, F.lit(self.lookup([made]).get(made)).cast("long")).where(F.col(at).isNotNull())
        family, id_ = made.family(), f"{at}_id"
        slot = family if family.kind != "string" else None
        if slot not in known or slot is None:
            seen = self.seen if self.seen is not None else self.nodes.withColumn("n", F.lit(1).cast("long"))
            text = F.expr("substring(term, {}, length(term) - {})".format(len(family.before) + 1, len(family.before) + len(family.after)))
            keys = seen.where(F.col("term").startswith(family.before) & F.col("term").endswith(family.after)).withColumn("key", text.try_cast(family.kind)).where(family.term() == F.col("term")).select("key", "id", "n")
            if slot is None:  # strings of all sorts have one family: those of this column
                keys = keys.join(df.select(F.col(at).alias("key")).distinct(), "key")
            known[slot] = keys = stored(df.sparkSession, keys)[0]
            table = keys.select("key", "id")
            known[slot, "near"] = small(table, self.BROADCAST) is not table
        keys = known[slot]
        one = keys.select(F.col("key").alias(at), F.col("id").alias(id_))
        if known[slot, "near"]:
            rows = df.join(F.broadcast(one), at)
        else:
            rows = skew_join(df, one, keys.select(F.col("key").alias(at), "n"), [at])
        return rows.drop(at).withColumnRenamed(id_, at)

    def encode(self, triples: DataFrame) -> DataFrame:
        """(s, p, o) of terms to ids. The predicates' table is small by nature and left to the optimizer."""
        p = self.predicates.select(F.col("id").alias("p_id"), F.col("term").alias("p"))
        rows = self._looked_up(self._looked_up(triples.join(p, "p"), "s", "s_id", "term"), "o", "o_id", "term")
        return rows.select(F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o"))

    def decode(self, encoded: DataFrame) -> DataFrame:
        p = self.predicates.select(F.col("id").alias("p"), F.col("term").alias("p_term"))
        rows = self._looked_up(self._looked_up(encoded, "s", "s_term", "id"), "o", "o_term", "id").join(p, "p")  # last: their strings would go through both shuffles
        return rows.select(F.col("s_term").alias("s"), F.col("p_term").alias("p"), F.col("o_term").alias("o"))

    def lookup(self, terms: list[str], predicates: bool = False) -> dict[str, int]:
        """Ids of a query's constants; unknown ones are left out."""
        d = self.predicates if predicates else self.nodes
        return {r.term: r.id for r in d.where(F.col("term").isin(terms)).collect()} if terms else {}

    def decode_column(self, df: DataFrame, column: str) -> DataFrame:
        return self._looked_up(df, column, "__term", "id", "left").drop(column).withColumnRenamed("__term", column)

    def decode_columns(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """decode_column for several columns: the rows are stored, and the dictionary is read once, for the ids that they have."""
        rows, _ = stored(df.sparkSession, df)
        ids = rows.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("at", "id")).where("id IS NOT NULL")
        counts, _ = stored(df.sparkSession, ids.groupBy("at", "id").agg(F.count("*").alias("n")))
        near = small(counts, self.BROADCAST)
        terms, _ = stored(df.sparkSession, self.nodes.join(near if near is not counts else merged(counts), "id").select("at", "id", "term", "n"))
        many = {r.at: r["count"] for r in counts.groupBy("at").count().collect()}
        for i in sorted(range(len(columns)), key=lambda i: -many.get(i, 0)):  # those of few terms last: their strings would go through the others' shuffles
            seen = terms.where(F.col("at") == i).drop("at")
            rows = Dictionary(seen.select("id", "term"), self.predicates, seen).decode_column(rows, columns[i])
        return rows.select(*[F.col(f"`{c}`") for c in df.columns])
