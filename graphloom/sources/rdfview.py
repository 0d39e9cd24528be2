"""The driver's relational tables as a graph.

Each predicate is a lazy layer over its tables, so a pattern reads two columns of
their files, and its constants become filters on key columns that reach the scan
(or show that a table needs no scan). Keys make pairs distinct; only order-part and order-supplier pairs,
which lineitem repeats, are deduplicated.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.terms import TYPE, XSD
from ..operators.store import GraphStore, Mapped, TermMap

NS = "urn:p:"


def entity(kind: str, column: str, integer: str = "bigint") -> TermMap:
    return TermMap(column, f"<urn:{kind}:", ">", integer)


def plain(column: str) -> TermMap:
    return TermMap(column, '"', '"')


def integer(column: str) -> TermMap:
    return TermMap(column, '"', f'"^^<{XSD}integer>', "int")


def p(name: str) -> str:
    return f"<{NS}{name}>"


def rdf_view(spark: SparkSession, sf_dir: str) -> GraphStore:
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    keys = {"region": entity("region", "r_regionkey", "int"), "nation": entity("nation", "n_nationkey", "int"), "customer": entity("customer", "c_custkey"), "supplier": entity("supplier", "s_suppkey"), "part": entity("part", "p_partkey"), "orders": entity("order", "o_orderkey")}
    of = lambda table, o: Mapped(t[table], keys[table], o)
    item = lambda o: Mapped(t["lineitem"], entity("order", "l_orderkey"), o, repeats=True)
    layers = {
        TYPE: [of(table, f"<urn:c:{kind}>") for table, kind in (("region", "Region"), ("nation", "Nation"), ("customer", "Customer"), ("supplier", "Supplier"), ("part", "Part"), ("orders", "Order"))],
        p("name"): [of("region", plain("r_name")), of("nation", plain("n_name")), of("customer", plain("c_name")), of("supplier", plain("s_name"))],
        p("inRegion"): [of("nation", entity("region", "n_regionkey", "int"))],
        p("nationCode"): [of("nation", integer("n_nationkey"))],
        p("regionCode"): [of("nation", integer("n_regionkey"))],
        p("fromNation"): [of("customer", entity("nation", "c_nationkey", "int")), of("supplier", entity("nation", "s_nationkey", "int"))],
        p("segment"): [of("customer", plain("c_mktsegment"))],
        p("brand"): [of("part", plain("p_brand"))],
        p("size"): [of("part", integer("p_size"))],
        p("placedBy"): [of("orders", entity("customer", "o_custkey"))],
        p("status"): [of("orders", plain("o_orderstatus"))],
        p("priority"): [of("orders", plain("o_orderpriority"))],
        p("hasPart"): [item(entity("part", "l_partkey"))],
        p("hasSupplier"): [item(entity("supplier", "l_suppkey"))],
    }
    return GraphStore.from_layers(spark, layers)


def _sql_pairs(s: str, key: str, predicate: str, o: str, table: str) -> str:
    return f"SELECT DISTINCT '<urn:{s}:' || {key} || '>' AS s, '{predicate}' AS p, {o} AS o FROM {table}"


def view_sql() -> str:
    """The same graph as a SELECT of (s, p, o), for DuckDB."""
    ent = lambda kind, key: f"'<urn:{kind}:' || {key} || '>'"
    txt = lambda v: f"'\"' || {v} || '\"'"
    num = lambda v: f"'\"' || {v} || '\"^^<{XSD}integer>'"
    rows = []
    for table, kind, key, cls in (("region", "region", "r_regionkey", "Region"), ("nation", "nation", "n_nationkey", "Nation"), ("customer", "customer", "c_custkey", "Customer"), ("supplier", "supplier", "s_suppkey", "Supplier"), ("part", "part", "p_partkey", "Part"), ("orders", "order", "o_orderkey", "Order")):
        rows.append((kind, key, TYPE, f"'<urn:c:{cls}>'", table))
    for table, kind, key, name, o in (
        ("region", "region", "r_regionkey", "name", txt("r_name")), ("nation", "nation", "n_nationkey", "name", txt("n_name")),
        ("customer", "customer", "c_custkey", "name", txt("c_name")), ("supplier", "supplier", "s_suppkey", "name", txt("s_name")),
        ("nation", "nation", "n_nationkey", "inRegion", ent("region", "n_regionkey")), ("nation", "nation", "n_nationkey", "nationCode", num("n_nationkey")), ("nation", "nation", "n_nationkey", "regionCode", num("n_regionkey")),
        ("customer", "customer", "c_custkey", "fromNation", ent("nation", "c_nationkey")), ("supplier", "supplier", "s_suppkey", "fromNation", ent("nation", "s_nationkey")),
        ("customer", "customer", "c_custkey", "segment", txt("c_mktsegment")), ("part", "part", "p_partkey", "brand", txt("p_brand")), ("part", "part", "p_partkey", "size", num("p_size")),
        ("orders", "order", "o_orderkey", "placedBy", ent("customer", "o_custkey")), ("orders", "order", "o_orderkey", "status", txt("o_orderstatus")), ("orders", "order", "o_orderkey", "priority", txt("o_orderpriority")),
        ("lineitem", "order", "l_orderkey", "hasPart", ent("part", "l_partkey")), ("lineitem", "order", "l_orderkey", "hasSupplier", ent("supplier", "l_suppkey")),
    ):
        rows.append((kind, key, p(name), o, table))
    return "\nUNION ALL ".join(_sql_pairs(*r) for r in rows)
