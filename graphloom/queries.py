"""The engine's queries over the driver's tables, each with SQL for DuckDB.

The SQL of graph patterns is written by hand over the relational tables, so it
shares nothing with the engine; the SQL of matrix operators runs over the same
graph as a common table expression t(s, p, o).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import TYPE, XSD
from .operators import relalg as M
from .operators.store import GraphStore
from .plans.executor import Engine
from .plans.syntax import Pattern, Var
from .sources.encoded import matrix_market
from .sources.rdfview import p, rdf_view, view_sql

PREFIXES = f"PREFIX p: <urn:p:> PREFIX c: <urn:c:> PREFIX xsd: <{XSD}> "

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _ent(kind: str, key: str) -> str:
    return f"'<urn:{kind}:' || {key} || '>'"


def _txt(v: str) -> str:
    return f"'\"' || {v} || '\"'"


def _int(v: str) -> str:
    return f"'\"' || {v} || '\"^^<{XSD}integer>'"


def _sparql(name: str, text: str, sql: str, reduce: bool = False, analyze: bool = False) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        store = rdf_view(spark, sf)
        return Engine(store.analyze() if analyze else store, reduce).query(PREFIXES + text)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _over_graph(name: str, sql: str):
    """Registers f(store) with SQL over t(s, p, o)."""

    def register(f: Callable[[GraphStore], DataFrame]):
        QUERIES[name] = lambda spark, sf: f(rdf_view(spark, sf))
        ORACLE_SQL[name] = f"WITH t AS ({view_sql()}) {sql}"
        return f

    return register


def _over_tables(name: str, sql: str):
    """Registers f(store) with SQL over the relational tables."""

    def register(f: Callable[[GraphStore], DataFrame]):
        QUERIES[name] = lambda spark, sf: f(rdf_view(spark, sf))
        ORACLE_SQL[name] = sql
        return f

    return register


O, C, N, S, P, R = _ent("order", "o_orderkey"), _ent("customer", "c_custkey"), _ent("nation", "n_nationkey"), _ent("supplier", "s_suppkey"), _ent("part", "l_partkey"), _ent("region", "r_regionkey")  # noqa: E741
LP = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
LS = "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"

# basic graph patterns
_sparql(
    "bgp_star",
    'SELECT ?c ?nm ?n WHERE { ?c a c:Customer ; p:segment "BUILDING" ; p:name ?nm ; p:fromNation ?n }',
    f"SELECT {C} AS c, {_txt('c_name')} AS nm, {_ent('nation', 'c_nationkey')} AS n FROM customer WHERE c_mktsegment = 'BUILDING'",
)
_sparql(
    "bgp_chain",
    'SELECT ?o ?c ?n ?r WHERE { ?o p:placedBy ?c . ?c p:fromNation ?n . ?n p:inRegion ?r . ?r p:name "ASIA" }',
    f"SELECT {O} AS o, {C} AS c, {N} AS n, {R} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
_SNOWFLAKE = 'SELECT ?o ?c ?nn ?pt ?b WHERE { ?o p:status "F" ; p:placedBy ?c ; p:hasPart ?pt . ?c p:segment "BUILDING" ; p:fromNation ?n . ?n p:name ?nn . ?pt p:brand ?b }'
_SNOWFLAKE_SQL = f"""SELECT {O} AS o, {C} AS c, {_txt('n_name')} AS nn, {P} AS pt, {_txt('p_brand')} AS b FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN {LP} ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'"""
_sparql("bgp_snowflake", _SNOWFLAKE, _SNOWFLAKE_SQL)
_sparql("bgp_snowflake_reduced", _SNOWFLAKE, _SNOWFLAKE_SQL, reduce=True)
_sparql("bgp_snowflake_analyzed", _SNOWFLAKE, _SNOWFLAKE_SQL, analyze=True)
_CYCLE = "SELECT ?o ?c ?s ?n WHERE { ?o p:placedBy ?c . ?o p:hasSupplier ?s . ?c p:fromNation ?n . ?s p:fromNation ?n }"
_CYCLE_SQL = f"""SELECT {O} AS o, {C} AS c, {S} AS s, {_ent('nation', 'c_nationkey')} AS n FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN {LS} ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey"""
_sparql("bgp_cycle", _CYCLE, _CYCLE_SQL)
_sparql("bgp_cycle_reduced", _CYCLE, _CYCLE_SQL, reduce=True)
_sparql(
    "bgp_selfjoin",
    'SELECT ?a ?b ?x WHERE { ?a p:hasPart ?x . ?b p:hasPart ?x . ?a p:status "P" . ?b p:status "P" }',
    f"""WITH q AS (SELECT o_orderkey, l_partkey FROM orders JOIN {LP} ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')
    SELECT {_ent('order', 'a.o_orderkey')} AS a, {_ent('order', 'b.o_orderkey')} AS b, {_ent('part', 'a.l_partkey')} AS x FROM q a JOIN q b ON a.l_partkey = b.l_partkey""",
)
_sparql("bgp_bag", "SELECT ?c WHERE { ?o p:placedBy ?c . ?o p:hasPart ?p }", f"SELECT {_ent('customer', 'o_custkey')} AS c FROM orders JOIN {LP} ON l_orderkey = o_orderkey")
_sparql(
    "bgp_const_subject",
    "SELECT ?c ?z WHERE { <urn:order:1> p:placedBy ?c . ?z p:placedBy ?c }",
    f"SELECT {_ent('customer', 'a.o_custkey')} AS c, {_ent('order', 'b.o_orderkey')} AS z FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey = 1",
)
_sparql(
    "bgp_two_const",
    "SELECT ?r WHERE { <urn:nation:1> p:nationCode 1 . <urn:nation:1> p:inRegion ?r }",
    f"SELECT {_ent('region', 'n_regionkey')} AS r FROM nation WHERE n_nationkey = 1",
)
_sparql(
    "bgp_two_const_mid",
    "SELECT ?c ?n WHERE { ?c p:fromNation ?n . ?n p:inRegion <urn:region:1> . <urn:region:1> a c:Region . ?c p:segment \"HOUSEHOLD\" }",
    f"SELECT {C} AS c, {N} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'HOUSEHOLD'",
)
_sparql("bgp_parallel", "SELECT ?n ?k WHERE { ?n p:nationCode ?k . ?n p:regionCode ?k }", f"SELECT {N} AS n, {_int('n_nationkey')} AS k FROM nation WHERE n_nationkey = n_regionkey")
_sparql(
    "bgp_var_predicate",
    "SELECT ?p ?v WHERE { <urn:nation:1> ?p ?v }",
    f"""WITH n AS (SELECT * FROM nation WHERE n_nationkey = 1) SELECT '{TYPE}' AS p, '<urn:c:Nation>' AS v FROM n UNION ALL SELECT '{p("name")}', {_txt('n_name')} FROM n
    UNION ALL SELECT '{p("inRegion")}', {_ent('region', 'n_regionkey')} FROM n UNION ALL SELECT '{p("nationCode")}', {_int('n_nationkey')} FROM n UNION ALL SELECT '{p("regionCode")}', {_int('n_regionkey')} FROM n""",
)
_sparql("bgp_cross", "SELECT ?r ?n WHERE { ?r a c:Region . ?n a c:Nation }", f"SELECT {R} AS r, {N} AS n FROM region, nation")
_sparql("bgp_unknown_const", "SELECT ?c WHERE { ?c p:segment \"NO SUCH\" . ?o p:placedBy ?c }", f"SELECT {C} AS c FROM customer WHERE false")
_sparql("bgp_unknown_predicate", "SELECT ?c ?x WHERE { ?c p:noSuch ?x . ?o p:placedBy ?c }", f"SELECT {C} AS c, {C} AS x FROM customer WHERE false")
_sparql("bgp_blank_nodes", "SELECT ?c ?b WHERE { [] p:placedBy ?c ; p:hasPart [ p:brand ?b ; p:size 7 ] }",
        f"SELECT {_ent('customer', 'o_custkey')} AS c, {_txt('p_brand')} AS b FROM orders JOIN {LP} ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7")
_sparql("select_star", "SELECT * WHERE { ?o p:placedBy ?c . ?c p:segment ?s }", f"SELECT {C} AS c, {O} AS o, {_txt('c_mktsegment')} AS s FROM orders JOIN customer ON o_custkey = c_custkey")
_sparql("optional_group", "SELECT ?c ?o WHERE { ?c a c:Customer OPTIONAL { ?o p:placedBy ?c . ?o p:status \"P\" } }",
        f"SELECT {C} AS c, {O} AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")

_sparql("optional_filter_outer", "SELECT ?n ?k ?r WHERE { ?n p:nationCode ?k OPTIONAL { ?n p:regionCode ?r FILTER (?r * 3 > ?k) } }",
        f"SELECT {N} AS n, {_int('n_nationkey')} AS k, CASE WHEN n_regionkey * 3 > n_nationkey THEN {_int('n_regionkey')} END AS r FROM nation")
_sparql("optional_then_pattern", "SELECT ?r ?n ?k WHERE { ?r a c:Region OPTIONAL { ?n p:inRegion ?r . ?n p:nationCode 3 } ?n p:regionCode ?k }",
        f"SELECT {R} AS r, {N} AS n, {_int('n_regionkey')} AS k FROM region, nation WHERE CASE WHEN r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) THEN n_nationkey = 3 ELSE true END")
_sparql("join_maybe_unbound", 'SELECT ?c ?n WHERE { ?c p:segment "BUILDING" OPTIONAL { ?c p:fromNation ?n . ?n p:inRegion <urn:region:1> } ?c p:fromNation ?n }',
        f"SELECT {C} AS c, {_ent('nation', 'c_nationkey')} AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
_sparql("union_unbound_both", 'SELECT ?n ?k ?r WHERE { { ?n p:nationCode ?k } UNION { ?n p:inRegion ?r } { ?n p:regionCode ?k } UNION { ?n p:inRegion ?r } }',
        f"""SELECT {N} AS n, {_int('n_nationkey')} AS k, NULL AS r FROM nation WHERE n_nationkey = n_regionkey UNION ALL SELECT {N}, {_int('n_nationkey')}, {_ent('region', 'n_regionkey')} FROM nation
    UNION ALL SELECT {N}, {_int('n_regionkey')}, {_ent('region', 'n_regionkey')} FROM nation UNION ALL SELECT {N}, NULL, {_ent('region', 'n_regionkey')} FROM nation""")  # fmt: skip
_sparql("nested_optional", "SELECT ?n ?k ?r WHERE { ?n p:nationCode ?k { ?n p:inRegion ?r OPTIONAL { ?r p:name \"ASIA\" . ?n p:regionCode ?k } } }",
        f"SELECT {N} AS n, {_int('n_nationkey')} AS k, {_ent('region', 'n_regionkey')} AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' OR n_nationkey = n_regionkey")

# FILTER
_sparql("filter_compare", "SELECT ?x ?z WHERE { ?x p:size ?z FILTER (?z >= 10 && ?z < 20) }", f"SELECT {_ent('part', 'p_partkey')} AS x, {_int('p_size')} AS z FROM part WHERE p_size >= 10 AND p_size < 20")
_sparql("filter_regex", 'SELECT ?c ?m WHERE { ?c a c:Customer ; p:name ?m FILTER REGEX(?m, "CUSTOMER#0*1[0-9]$", "i") }', f"SELECT {C} AS c, {_txt('c_name')} AS m FROM customer WHERE regexp_matches(c_name, '(?i)CUSTOMER#0*1[0-9]$')")
_sparql("filter_in", 'SELECT ?c ?g WHERE { ?c p:segment ?g FILTER in(?g, "BUILDING", "MACHINERY") }', f"SELECT {C} AS c, {_txt('c_mktsegment')} AS g FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_sparql("filter_bool", 'SELECT ?o ?s WHERE { ?o p:status ?s ; p:priority ?q FILTER (!(?s = "F") || ?q = "1-URGENT") }', f"SELECT {O} AS o, {_txt('o_orderstatus')} AS s FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT'")
_sparql("filter_arith", "SELECT ?n WHERE { ?n p:nationCode ?a ; p:regionCode ?b FILTER (?a + ?b * 2 - 1 = 10 / 2 || -?a = -3) }", f"SELECT {N} AS n FROM nation WHERE n_nationkey + n_regionkey * 2 - 1 = 5 OR n_nationkey = 3")
_sparql("filter_is_kind", "SELECT ?v WHERE { <urn:nation:1> ?p ?v FILTER (isLITERAL(?v) && !isIRI(?v) && !isBLANK(?v) || ?v = c:Nation) }",
        f"WITH n AS (SELECT * FROM nation WHERE n_nationkey = 1) SELECT '<urn:c:Nation>' AS v FROM n UNION ALL SELECT {_txt('n_name')} FROM n UNION ALL SELECT {_int('n_nationkey')} FROM n UNION ALL SELECT {_int('n_regionkey')} FROM n")
_sparql("filter_bound", 'SELECT ?c ?o WHERE { ?c a c:Customer OPTIONAL { ?o p:placedBy ?c . ?o p:status "P" } FILTER (!BOUND(?o)) }',
        f"SELECT {C} AS c, NULL::VARCHAR AS o FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_sparql("filter_sameterm", "SELECT ?n WHERE { ?n p:nationCode ?a ; p:regionCode ?b FILTER sameTerm(?a, ?b) }", f"SELECT {N} AS n FROM nation WHERE n_nationkey = n_regionkey")
_sparql("filter_cast", 'SELECT ?n WHERE { ?n a c:Nation ; p:nationCode ?a FILTER (xsd:integer(STR(?a)) > 20 && DATATYPE(xsd:double(?a)) = xsd:double) }', f"SELECT {N} AS n FROM nation WHERE n_nationkey > 20")

_sparql("syntax_forms", "PREFIX : <urn:p:> # a comment, a default prefix, small keywords, the other variable sign\nselect $c $g where { $c :segment $g, 'BUILDING' ; :fromNation <urn:nation:3> . }",
        f"SELECT {C} AS c, {_txt('c_mktsegment')} AS g FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
QUERIES["filter_registered"] = lambda spark, sf: Engine(rdf_view(spark, sf), registry={"<urn:last>": lambda t: F.concat(F.lit('"'), F.substring(t, -2, 2))}).query(
    PREFIXES + 'SELECT ?n ?m WHERE { ?n p:name ?m ; p:nationCode ?k FILTER (<urn:last>(STR(?m)) = "7") }'
)
ORACLE_SQL["filter_registered"] = f"SELECT {N} AS n, {_txt('n_name')} AS m FROM nation WHERE n_name LIKE '%7'"

_LABEL = p("label")
_TAG = "CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr-ca' END"


def _labelled(spark: SparkSession, sf: str) -> GraphStore:
    """The view with language-tagged labels of nations."""
    store = rdf_view(spark, sf)
    n = spark.read.parquet(f"{sf}/nation.parquet")
    tag = F.when(F.col("n_nationkey") % 2 == 0, '"@en').otherwise('"@fr-ca')
    store.layers[_LABEL] = n.select(F.concat(F.lit("<urn:nation:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.concat(F.lit('"'), "n_name", tag).alias("o"))
    return store


def _labelled_sparql(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf, text=text: Engine(_labelled(spark, sf)).query(PREFIXES + text)
    ORACLE_SQL[name] = sql


_labelled_sparql("filter_str_lang_datatype", 'SELECT ?n ?v WHERE { ?n p:label ?v ; p:nationCode ?k FILTER (LANG(?v) = "en" && DATATYPE(?k) = xsd:integer && STR(?k) != "4") }',
                 f"SELECT {N} AS n, {_txt('n_name')} || '@en' AS v FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <> 4")
_labelled_sparql("filter_langmatches", 'SELECT ?n ?v WHERE { ?n p:label ?v FILTER LANGMATCHES(LANG(?v), "FR") }', f"SELECT {N} AS n, {_txt('n_name')} || '@fr-ca' AS v FROM nation WHERE n_nationkey % 2 = 1")



def _numbered_nations(spark: SparkSession, sf: str) -> GraphStore:
    """The view with large integers and plain strings of digits."""
    store = rdf_view(spark, sf)
    n = spark.read.parquet(f"{sf}/nation.parquet")
    s = F.concat(F.lit("<urn:nation:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s")
    store.layers[p("big")] = n.select(s, F.concat(F.lit('"'), (F.col("n_nationkey") + F.lit(9007199254740990)).cast("string"), F.lit(f'"^^<{XSD}integer>')).alias("o"))
    store.layers[p("digits")] = n.select(s, F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('"')).alias("o"))
    return store


def _numbered_sparql(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf, text=text: Engine(_numbered_nations(spark, sf)).query(PREFIXES + text)
    ORACLE_SQL[name] = sql


_numbered_sparql("filter_bigint", "SELECT ?n WHERE { ?n p:big ?v FILTER (?v = 9007199254740993 || ?v > 9007199254741006 && ?v != 9007199254741008) }",
                 f"SELECT {N} AS n FROM nation WHERE n_nationkey = 3 OR n_nationkey > 16 AND n_nationkey <> 18")
_numbered_sparql("filter_string_not_number", 'SELECT ?n ?t WHERE { ?n p:digits ?t ; p:nationCode ?k FILTER (?t = "7" || ?k = 5 || ?t = 6 || ?t > 20 || ?t + 1 = 3) }',
                 f"SELECT {N} AS n, {_txt('n_nationkey')} AS t FROM nation WHERE n_nationkey IN (5, 7)")




def _measured_nations(spark: SparkSession, sf: str) -> GraphStore:
    """The view with values of several datatypes: tenths as decimals, halves as doubles, evenness as a boolean written both ways, a date and a tagged string."""
    store = rdf_view(spark, sf)
    n, key = spark.read.parquet(f"{sf}/nation.parquet"), F.col("n_nationkey")
    s = F.concat(F.lit("<urn:nation:"), key.cast("string"), F.lit(">")).alias("s")
    typed = lambda text, name: n.select(s, F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{name}>')).alias("o"))
    store.layers[p("tenth")] = typed((key / 10).cast("decimal(20,1)").cast("string"), "decimal")
    store.layers[p("half")] = typed((key / 2).cast("string"), "double")
    store.layers[p("even")] = typed(F.when(key % 4 == 0, "true").when(key % 4 == 2, "1").when(key % 4 == 1, "false").otherwise("0"), "boolean")
    store.layers[p("day")] = typed(F.date_add(F.lit("2020-01-01").cast("date"), key).cast("string"), "date")
    store.layers[p("label")] = n.select(s, F.concat(F.lit('"'), "n_name", F.lit('"@en')).alias("o"))
    store.layers[p("big")] = _numbered_nations(spark, sf).layers[p("big")]
    return store


def _measured_sparql(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf, text=text: Engine(_measured_nations(spark, sf)).query(PREFIXES + text)
    ORACLE_SQL[name] = sql


_measured_sparql("filter_arith_exact", "SELECT ?n ?v WHERE { ?n p:big ?v ; p:nationCode ?k FILTER (?v + 1 = 9007199254740994 || ?v - ?k = 9007199254740990 && ?k * 3 < 9) }",
                 f"SELECT {N} AS n, {_int('(n_nationkey + 9007199254740990)')} AS v FROM nation WHERE n_nationkey = 3 OR n_nationkey < 3")
_measured_sparql("filter_datatype_of_sum", 'SELECT ?n ?k WHERE { ?n p:nationCode ?k ; p:tenth ?t ; p:half ?h FILTER (DATATYPE(?k + 1) = xsd:integer && DATATYPE(?k + ?t) = xsd:decimal && DATATYPE(?t * ?h) = xsd:double && DATATYPE(?k / 2) = xsd:decimal && STR(?k + 1) >= "2") }',
                 f"SELECT {N} AS n, {_int('n_nationkey')} AS k FROM nation WHERE (n_nationkey + 1)::VARCHAR >= '2'")
_measured_sparql("filter_boolean_value", "SELECT ?n WHERE { ?n p:even ?b FILTER (?b = true && ?b) }", f"SELECT {N} AS n FROM nation WHERE n_nationkey % 2 = 0")
_measured_sparql("filter_decimal", "SELECT ?n ?t WHERE { ?n p:tenth ?t FILTER (?t + 0.2 = 0.5 || ?t * 3 > 6.30000000000000000001 || ?t = 0.10000000000000000001 || ?t / 4 = 0.425) }",
                 f"SELECT {N} AS n, '\"' || (n_nationkey / 10)::DECIMAL(20,1) || '\"^^<{XSD}decimal>' AS t FROM nation WHERE n_nationkey = 3 OR n_nationkey > 21 OR n_nationkey = 17")
_measured_sparql("filter_incomparable", 'SELECT ?n WHERE { ?n p:day ?d ; p:even ?b ; p:label ?l FILTER (?d < ?l || ?b < ?l || ?l < "Z" || ?d >= "2020-01-20"^^xsd:date && ?d != ?l || !(?b > ?l) ) }',
                 f"SELECT {N} AS n FROM nation WHERE n_nationkey >= 19")


# a small graph with loops and paths of equal labels
_SMALL_SQL = f"""WITH t AS (SELECT {N} AS s, '{p("next")}' AS p, '<urn:nation:' || n_nationkey % 7 || '>' AS o FROM nation
    UNION ALL SELECT {N}, '{p("jump")}', '<urn:nation:' || (n_nationkey + 5) % 25 || '>' FROM nation)"""


def _small(spark: SparkSession, sf: str) -> GraphStore:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    nation = lambda c: F.concat(F.lit("<urn:nation:"), c.cast("string"), F.lit(">"))
    key = F.col("n_nationkey")
    return GraphStore.from_layers(spark, {p("next"): n.select(nation(key).alias("s"), nation(key % 7).alias("o")), p("jump"): n.select(nation(key).alias("s"), nation((key + 5) % 25).alias("o"))})


QUERIES["bgp_self_loop"] = lambda spark, sf: Engine(_small(spark, sf)).query(PREFIXES + "SELECT ?x WHERE { ?x p:next ?x }")
ORACLE_SQL["bgp_self_loop"] = f"{_SMALL_SQL} SELECT s AS x FROM t WHERE p = '{p('next')}' AND s = o"
QUERIES["bgp_loop_in_cycle"] = lambda spark, sf: Engine(_small(spark, sf)).query(PREFIXES + "SELECT ?x ?y WHERE { ?x p:jump ?y . ?y ?q ?z . ?z p:next ?z . ?z ?q ?y }")
ORACLE_SQL["bgp_loop_in_cycle"] = f"{_SMALL_SQL} SELECT a.s AS x, a.o AS y FROM t a JOIN t b ON b.s = a.o JOIN t c ON c.s = b.o AND c.o = c.s JOIN t d ON d.s = b.o AND d.p = b.p AND d.o = a.o WHERE a.p = '{p('jump')}' AND c.p = '{p('next')}'"


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    found = Engine(_small(spark, sf)).scan(Pattern(Var("x"), Var("q"), Var("x")))
    return found.df.select(F.col("`v_x`").alias("x"), F.col("`v_q`").alias("q"))


QUERIES["scan_repeated"] = _repeated
ORACLE_SQL["scan_repeated"] = f"{_SMALL_SQL} SELECT s AS x, p AS q FROM t WHERE s = o"


def _equal_paths(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _small(spark, sf).triples().select(F.col("s").alias("u"), F.col("o").alias("v"), F.col("p").alias("x"))
    return M.compose_equal(labelled, labelled)


QUERIES["mxm_equal"] = _equal_paths
ORACLE_SQL["mxm_equal"] = f"{_SMALL_SQL} SELECT DISTINCT a.s AS u, b.o AS v FROM t a JOIN t b ON a.o = b.s AND a.p = b.p"

# modifiers and sets
_sparql("mod_distinct", "SELECT DISTINCT ?g ?n WHERE { ?c p:segment ?g ; p:fromNation ?n }", f"SELECT DISTINCT {_txt('c_mktsegment')} AS g, {_ent('nation', 'c_nationkey')} AS n FROM customer")
_sparql("mod_reduced", "SELECT REDUCED ?s WHERE { ?o p:status ?s }", f"SELECT DISTINCT {_txt('o_orderstatus')} AS s FROM orders")
_sparql("mod_duplicates", "SELECT DUPLICATES ?s WHERE { ?o p:status ?s }", f"SELECT {_txt('o_orderstatus')} AS s FROM orders")
_sparql("mod_count", "SELECT COUNT ?s ?q WHERE { ?o p:status ?s ; p:priority ?q }", f"SELECT {_txt('o_orderstatus')} AS s, {_txt('o_orderpriority')} AS q, count(*) AS \"count\" FROM orders GROUP BY ALL")
_sparql("order_limit", "SELECT ?x ?z WHERE { ?x p:size ?z } ORDER BY DESC(?z) ASC(?x) LIMIT 25", f"SELECT {_ent('part', 'p_partkey')} AS x, {_int('p_size')} AS z FROM part ORDER BY p_size DESC, 'urn:part:' || p_partkey LIMIT 25")
_sparql("order_count", "SELECT COUNT ?n WHERE { ?c p:fromNation ?n } ORDER BY DESC(count) ?n LIMIT 5",
        f"SELECT * FROM (SELECT {_ent('nation', 'k')} AS n, count(*) AS \"count\" FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL) ORDER BY \"count\" DESC, rtrim(n, '>') LIMIT 5")
_sparql("union_groups", 'SELECT ?x ?s ?g WHERE { { ?x p:status "P" . ?x p:priority ?s } UNION { ?x p:segment ?g . ?x p:fromNation <urn:nation:3> } }',
        f"SELECT {O} AS x, {_txt('o_orderpriority')} AS s, NULL::VARCHAR AS g FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT {C}, NULL, {_txt('c_mktsegment')} FROM customer WHERE c_nationkey = 3")
_sparql("union_joined", 'SELECT ?o ?c ?g WHERE { ?o p:placedBy ?c . ?o p:status "P" { ?c p:segment "BUILDING" } UNION { ?c p:segment ?g . ?c p:fromNation <urn:nation:3> } }',
        f"WITH q AS (SELECT {O} AS o, {C} AS c, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P') SELECT o, c, NULL::VARCHAR AS g FROM q WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT o, c, {_txt('c_mktsegment')} FROM q WHERE c_nationkey = 3")
_sparql("nested_group", 'SELECT ?c ?n WHERE { ?c p:segment "FURNITURE" { ?c p:fromNation ?n { ?n p:inRegion <urn:region:2> } } }',
        f"SELECT {C} AS c, {N} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'FURNITURE' AND n_regionkey = 2")


# updates
def _inserted(spark: SparkSession, sf: str) -> DataFrame:
    store = Engine(rdf_view(spark, sf)).update(PREFIXES + 'INSERT DATA { <urn:nation:900> a c:Nation ; p:name "NOWHERE" ; p:inRegion <urn:region:1> . <urn:nation:1> p:inRegion <urn:region:1> }')
    return Engine(store).query(PREFIXES + "SELECT ?n ?m ?r WHERE { ?n p:inRegion ?r . ?n p:name ?m }")


def _deleted(spark: SparkSession, sf: str) -> DataFrame:
    store = Engine(rdf_view(spark, sf)).update(PREFIXES + "DELETE DATA { <urn:nation:1> p:inRegion <urn:region:1> . <urn:nation:2> p:inRegion <urn:region:4> }")
    return Engine(store).query(PREFIXES + "SELECT ?n ?r WHERE { ?n p:inRegion ?r }")


QUERIES |= {"insert_data": _inserted, "delete_data": _deleted}
ORACLE_SQL["insert_data"] = f"""SELECT DISTINCT * FROM (SELECT {N} AS n, {_txt('n_name')} AS m, {_ent('region', 'n_regionkey')} AS r FROM nation
    UNION ALL SELECT '<urn:nation:900>', '"NOWHERE"', '<urn:region:1>' UNION ALL SELECT {N}, {_txt('n_name')}, '<urn:region:1>' FROM nation WHERE n_nationkey = 1)"""
ORACLE_SQL["delete_data"] = f"SELECT {N} AS n, {_ent('region', 'n_regionkey')} AS r FROM nation WHERE NOT (n_nationkey = 1 AND n_regionkey = 1) AND NOT (n_nationkey = 2 AND n_regionkey = 4)"


# matrix operators
def _m(store: GraphStore, name: str) -> DataFrame:
    return store.layer(p(name)).select(F.col("s").alias("u"), F.col("o").alias("v"))


def _sel(name: str, cols: str = "s AS u, o AS v", alias: str = "t", extra: str = "") -> str:
    return f"SELECT {cols} FROM t {alias} WHERE {alias}.p = '{p(name)}'{extra}"


@_over_graph("mxm_compose", f"SELECT DISTINCT a.s AS u, b.o AS v FROM t a JOIN t b ON a.o = b.s WHERE a.p = '{p('placedBy')}' AND b.p = '{p('fromNation')}'")
def _(g):
    return M.compose(_m(g, "placedBy"), _m(g, "fromNation"))


@_over_graph("transpose", _sel("fromNation", "o AS u, s AS v"))
def _(g):
    return M.transpose(_m(g, "fromNation"))


@_over_graph("diag_rows", _sel("hasPart", "DISTINCT s AS v"))
def _(g):
    return M.reduce_rows(_m(g, "hasPart"))


@_over_graph("diag_cols", _sel("hasPart", "DISTINCT o AS v"))
def _(g):
    return M.reduce_cols(_m(g, "hasPart"))


@_over_graph("nnz_profile", _sel("hasSupplier", "count(*) AS nnz, count(DISTINCT s) AS rows, count(DISTINCT o) AS cols"))
def _(g):
    return M.profile(_m(g, "hasSupplier"))


@_over_graph("all_nonzeros", _sel("inRegion"))
def _(g):
    return _m(g, "inRegion")


@_over_graph("row_extract", _sel("hasPart", "o AS v", extra=" AND s = '<urn:order:1>'"))
def _(g):
    return M.row(_m(g, "hasPart"), "<urn:order:1>")


@_over_graph("col_extract", _sel("placedBy", "s AS v", extra=" AND o = '<urn:customer:1>'"))
def _(g):
    return M.col(_m(g, "placedBy"), "<urn:customer:1>")


@_over_graph("point_lookup", _sel("inRegion", extra=" AND s = '<urn:nation:1>' AND o = '<urn:region:1>'"))
def _(g):
    return M.point(_m(g, "inRegion"), "<urn:nation:1>", "<urn:region:1>")


@_over_graph("point_set", _sel("inRegion") + " UNION SELECT '<urn:nation:901>', '<urn:region:0>'")
def _(g):
    m = _m(g, "inRegion")
    return m.unionByName(M.cell(m, "<urn:nation:901>", "<urn:region:0>")).distinct()


@_over_graph("existence", f"SELECT count(*) > 0 AS has_row FROM t WHERE p = '{p('inRegion')}' AND s = '<urn:nation:1>'")
def _(g):
    return M.row(_m(g, "inRegion"), "<urn:nation:1>").limit(1).agg((F.count("*") > 0).alias("has_row"))


@_over_tables("semijoin_forward", f"SELECT {C} AS u, {_ent('nation', 'c_nationkey')} AS v FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(g):
    return M.prune_forward(_m(g, "fromNation"), _m(g, "placedBy"))


@_over_graph("semijoin_backward", _sel("placedBy", "a.s AS u, a.o AS v", "a", f" AND EXISTS (SELECT 1 FROM t b WHERE b.p = '{p('segment')}' AND b.s = a.o AND b.o = '\"BUILDING\"')"))
def _(g):
    return M.prune_backward(_m(g, "placedBy"), _m(g, "segment").where(F.col("v") == '"BUILDING"'))


@_over_graph(
    "semijoin_cycle",
    f"""SELECT 'closing' AS side, a.s AS u, a.o AS v FROM t a WHERE a.p = '{p('placedBy')}' AND EXISTS (SELECT 1 FROM t b WHERE b.p = '{p('fromNation')}' AND b.s = a.o)
    UNION ALL SELECT 'leaving', b.s, b.o FROM t b WHERE b.p = '{p('fromNation')}' AND EXISTS (SELECT 1 FROM t a WHERE a.p = '{p('placedBy')}' AND a.o = b.s)""",
)
def _(g):
    closing, leaving = M.close_cycle(_m(g, "placedBy"), _m(g, "fromNation"))
    return closing.select(F.lit("closing").alias("side"), "u", "v").unionByName(leaving.select(F.lit("leaving").alias("side"), "u", "v"))


_BUILDING = f"SELECT s FROM t WHERE p = '{p('segment')}' AND o = '\"BUILDING\"'"


def _building(g: GraphStore) -> DataFrame:
    return M.col(_m(g, "segment"), '"BUILDING"')


@_over_graph("mxv", _sel("placedBy", "DISTINCT s AS v", extra=f" AND o IN ({_BUILDING})"))
def _(g):
    return M.mxv(_m(g, "placedBy"), _building(g))


@_over_graph("mxv_trans", _sel("fromNation", "DISTINCT o AS v", extra=f" AND s IN ({_BUILDING})"))
def _(g):
    return M.mxv_trans(_m(g, "fromNation"), _building(g))


@_over_graph("vandv", f"{_BUILDING.replace('SELECT s', 'SELECT s AS v')} AND s IN (SELECT o FROM t WHERE p = '{p('placedBy')}')")
def _(g):
    return M.vandv(_building(g), M.reduce_cols(_m(g, "placedBy")))


@_over_tables("binding_matrix", f"SELECT {O} AS u, {C} AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def _(g):
    return M.binding_matrix(_m(g, "placedBy"), M.col(_m(g, "status"), '"F"'), _building(g))


@_over_tables("r_join", f"SELECT {C} AS c, {O} AS o, {_ent('nation', 'c_nationkey')} AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def _(g):
    return M.r_join(_m(g, "placedBy").select(F.col("u").alias("o"), F.col("v").alias("c")), _m(g, "fromNation"), "c", "n").select("c", "o", "n")


@_over_tables("r_filter", f"SELECT {_ent('nation', 'a.c_nationkey')} AS n, {_txt('a.c_mktsegment')} AS k FROM customer a JOIN customer b ON b.c_custkey = 1 AND a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment")
def _(g):
    r = M.r_join(_m(g, "fromNation").select(F.col("u").alias("c"), F.col("v").alias("n")), _m(g, "segment"), "c", "k")
    mine = r.where(F.col("c") == "<urn:customer:1>").select(F.col("n").alias("u"), F.col("k").alias("v"))
    return M.r_filter(r, mine, "n", "k").select("n", "k")


# layers, statistics, dictionaries, exports
@_over_graph("predicate_layer", _sel("brand", "s, o"))
def _(g):
    return g.layer(p("brand"))


@_over_graph("predicate_stats", "SELECT p, count(*) AS n_triples, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM t GROUP BY p")
def _(g):
    return g.predicate_stats()


@_over_graph("term_frequency", "SELECT term, sum(x)::BIGINT AS as_subject, sum(y)::BIGINT AS as_object, count(*) AS n FROM (SELECT s AS term, 1 AS x, 0 AS y FROM t UNION ALL SELECT o, 0, 1 FROM t) GROUP BY term")
def _(g):
    return g.term_frequency()


@_over_graph("remove_double_edges", "SELECT s, min(p) AS p, o FROM t GROUP BY s, o")
def _(g):
    return g.remove_double_edges().triples()


@_over_graph("dict_terms", "SELECT row_number() OVER (ORDER BY term) - 1 AS id, term FROM (SELECT s AS term FROM t UNION SELECT o FROM t)")
def _(g):
    return g.dictionary().nodes


@_over_graph("dict_predicates", "SELECT row_number() OVER (ORDER BY p) + 1 AS id, p AS term FROM (SELECT DISTINCT p FROM t)")
def _(g):
    return g.dictionary().predicates


@_over_graph("dict_roundtrip", "SELECT s, p, o FROM t")
def _(g):
    d = g.dictionary()
    return d.decode(g.encoded(d))


@_over_graph(
    "mm_export",
    """, n AS (SELECT term, row_number() OVER (ORDER BY term) AS id FROM (SELECT s AS term FROM t UNION SELECT o FROM t)), q AS (SELECT p, row_number() OVER (ORDER BY p) + 1 AS pid FROM (SELECT DISTINCT p FROM t))
    SELECT a.id AS row, b.id AS col, pid AS val FROM t JOIN n a ON a.term = t.s JOIN n b ON b.term = t.o JOIN q USING (p)""",
)
def _(g):
    return matrix_market(g.encoded(g.dictionary()))


@_over_graph("gini", "SELECT round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT n::DOUBLE AS n, row_number() OVER (ORDER BY n) AS i FROM (SELECT count(*) AS n FROM t GROUP BY s))")
def _(g):
    return M.gini(g.subject_counts(), "n").select(F.round("gini", 6).alias("gini"))


@_over_graph("position_counts", "SELECT position, term, count(*) AS n FROM (SELECT 's' AS position, s AS term FROM t UNION ALL SELECT 'p', p FROM t UNION ALL SELECT 'o', o FROM t) GROUP BY ALL")
def _(g):
    return g.position_counts()


from . import file_queries  # noqa: E402, F401  (registers more, with the helpers above)
