"""Queries that go through files and streams: sources and sinks over the driver's tables, written, read back and compared with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions.terms import TYPE, XSD
from .operators import bitvec as B
from .operators.storage import new_path, stored
from .operators.store import Dictionary, GraphStore
from .operators.versions import GraphLog
from .plans.executor import Engine
from .plans.to_sql import encode_query, to_sql
from .queries import _CYCLE, _CYCLE_SQL, ORACLE_SQL, PREFIXES, QUERIES, C, N, _ent, _int, _txt
from .sources import encoded, turtle
from .sources.rdfview import p, rdf_view, view_sql
from .sources.turtle_split import read_split
from .streaming.match import match_stream, match_streams, predicate_rates

_GRAPH = f"WITH t AS ({view_sql()})"
_CODED = f"""{_GRAPH}, n AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT s AS term FROM t UNION SELECT o FROM t)), q AS (SELECT p AS term, row_number() OVER (ORDER BY p) + 1 AS id FROM (SELECT DISTINCT p FROM t)),
    e AS (SELECT a.id AS s, q.id AS p, b.id AS o FROM t JOIN n a ON a.term = t.s JOIN q ON q.term = t.p JOIN n b ON b.term = t.o)"""
_SEGMENTS = "SELECT ?c ?g WHERE { ?c p:segment ?g ; p:fromNation <urn:nation:3> }"


def _query(name: str, sql: str):
    """Registers f(spark, sf_dir)."""

    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _lines(spark: SparkSession, write) -> DataFrame:
    """What write(path) wrote, as lines."""
    path = new_path(spark)
    write(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _nations(spark: SparkSession, sf: str, *lines) -> str:
    """The path of text files with a line for each nation and column of lines."""
    path = new_path(spark)
    spark.read.parquet(f"{sf}/nation.parquet").select(F.explode(F.array(*lines)).alias("value")).write.text(path)
    return path


def _key(column: str = "n_nationkey") -> Column:
    return F.col(column).cast("string")


# sources
@_query("scan_ntriples", f"{_GRAPH} SELECT s, p, o FROM t")
def _(spark, sf):
    path = new_path(spark)
    encoded.write_ntriples(rdf_view(spark, sf).triples(), path)
    return turtle.read_ntriples(spark, path, keep_labels=True)[0]


def _escaped_nations(spark: SparkSession, sf: str) -> str:
    good = F.concat(F.lit("<urn:nation:"), _key(), F.lit(">\t<urn:p:says> \"\\u00e9 \\\\u00e9 \\\""), F.col("n_name"), F.lit("\\\" \\U0001F600\\n\"@EN-gb . # note"))
    bad = F.concat(F.lit("<urn:nation:"), _key(), F.when(F.col("n_nationkey") % 2 == 0, "> <urn:p:says> \"\\uD800\" .").otherwise("> <urn:p:says> \"open ."))
    return _nations(spark, sf, good, bad, F.lit("# comment"), F.lit(""))


@_query("scan_ntriples_escapes", rf"""SELECT {N} AS s, '{p("says")}' AS p, '"' || chr(233) || ' \u00e9 "' || n_name || '" ' || chr(128512) || chr(10) || '"@en-gb' AS o FROM nation""")
def _(spark, sf):
    return turtle.read_ntriples(spark, _escaped_nations(spark, sf))[0]


@_query("scan_ntriples_errors", r"""SELECT '<urn:nation:' || n_nationkey || '> <urn:p:says> "' || CASE WHEN n_nationkey % 2 = 0 THEN '\uD800" .' ELSE 'open .' END AS error FROM nation""")
def _(spark, sf):
    return turtle.read_ntriples(spark, _escaped_nations(spark, sf))[1]


def _turtle_nations(spark: SparkSession, sf: str) -> str:
    """A statement of every form for each nation, prefixes before it."""
    head = F.lit("@prefix n: <urn:nation:> . @base <urn:region:> . PREFIX q: <urn:p:>")
    body = F.concat(
        F.lit("n:"), _key(), F.lit(" a <urn:c:Nation> ; q:nationCode "), _key(), F.lit(" ; q:both "), _key(), F.lit(", "), _key("n_regionkey"), F.lit('.5 ; q:name """'), F.col("n_name"), F.lit('"""@en ; q:list ( true n:'), _key(),
        F.lit(" ) ; q:has [ q:region <"), _key("n_regionkey"), F.lit("> ] . # end"),
    )
    return _nations(spark, sf, head, body, F.lit("this is no statement ."))


@_query("scan_turtle", f"""SELECT {N} AS s, '{TYPE}' AS p, '<urn:c:Nation>' AS o FROM nation UNION ALL SELECT {N}, '{p("nationCode")}', {_int('n_nationkey')} FROM nation
    UNION ALL SELECT {N}, '{p("both")}', {_int('n_nationkey')} FROM nation UNION ALL SELECT {N}, '{p("both")}', '"' || n_regionkey || '.5"^^<{XSD}decimal>' FROM nation UNION ALL SELECT {N}, '{p("name")}', {_txt('n_name')} || '@en' FROM nation""")
def _(spark, sf):
    triples = turtle.read_turtle(spark, _turtle_nations(spark, sf))[0]
    return triples.where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:"))


@_query("scan_turtle_blank_nodes", f"SELECT {N} AS n, {_ent('region', 'n_regionkey')} AS r, {N} AS x FROM nation")
def _(spark, sf):
    store = GraphStore.from_triples(turtle.read_turtle(spark, _turtle_nations(spark, sf))[0])
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    return Engine(store).query(f"PREFIX p: <urn:p:> PREFIX r: <{rdf}> SELECT ?n ?r ?x {{ ?n p:has [ p:region ?r ] ; p:list ?l . ?l r:first true ; r:rest [ r:first ?x ; r:rest r:nil ] }}")


@_query("scan_turtle_pieces", f"""SELECT {C} AS s, '{p("name")}' AS p, '"' || c_name || ' . ' || repeat(chr(39), 3) || chr(10) || '@prefix q: <no> . "' || c_mktsegment || '""' AS o FROM customer
    UNION ALL SELECT {C}, '{p("fromNation")}', {_ent('nation', 'c_nationkey')} FROM customer UNION ALL SELECT {C}, '{p("rank")}', '"' || c_custkey || '.5"^^<{XSD}decimal>' FROM customer""")
def _(spark, sf):
    """One file, its long strings over line breaks, parsed in pieces of a few statements."""
    path = new_path(spark)
    head = F.lit('@prefix p: <urn:p:> .\n@prefix c: <urn:customer:> .\n@base <urn:nation:> .')
    body = F.concat(F.lit("c:"), _key("c_custkey"), F.lit(' p:name """'), F.col("c_name"), F.lit(" . '''\n@prefix q: <no> . \""), F.col("c_mktsegment"), F.lit('\\""""'), F.lit(" ;\n  p:fromNation <"), _key("c_nationkey"), F.lit("> ; p:rank "), _key("c_custkey"), F.lit(".5 ."))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit(1).alias("i"), body.alias("value")).unionAll(spark.range(1).select(F.lit(0), head)).coalesce(1).sortWithinPartitions("i").select("value")
    rows.write.text(path)
    return read_split(spark, path, 2_000).where("error IS NULL").select("s", "p", "o")


@_query("scan_turtle_errors", "SELECT count(*) AS n FROM nation")
def _(spark, sf):
    return turtle.read_turtle(spark, _turtle_nations(spark, sf))[1].agg(F.count("*").alias("n"))


@_query("load_two_files", f"SELECT {N} AS n, count(*) AS nodes FROM nation, (VALUES (1), (2)) GROUP BY ALL")
def _(spark, sf):
    path = new_path(spark)
    line = F.concat(F.lit("_:x <urn:p:of> <urn:nation:"), _key(), F.lit("> ."))
    lines = spark.read.parquet(f"{sf}/nation.parquet").select(line.alias("value"))
    for name in ("a", "b"):  # the same label in each: two nodes
        lines.coalesce(1).write.text(f"{path}/{name}")
    return turtle.read_ntriples(spark, [f"{path}/a", f"{path}/b"])[0].groupBy(F.col("o").alias("n")).agg(F.countDistinct("s").alias("nodes"))


@_query("clean_pass", f"""{_GRAPH} SELECT s, p, '"' || replace(replace(o[2:-2], ' ', ''), '"', '') || '"' AS o FROM t WHERE p = '{p("priority")}'""")
def _(spark, sf):
    spaced = rdf_view(spark, sf).layer(p("priority")).select(F.concat(F.lit("<urn: "), F.substring("s", 6, 100)).alias("s"), F.lit(p("priority").replace("p:", "p:\t")).alias("p"), F.concat(F.lit('"\t"'), F.substring("o", 2, 100)).alias("o"))
    return turtle.clean_spaces(spaced)


@_query("lexical_only", f"""{_GRAPH} SELECT DISTINCT s, p, CASE WHEN o LIKE '"%' THEN '<' || regexp_extract(o, '^"(.*)"', 1) || '>' ELSE o END AS o FROM t""")
def _(spark, sf):
    return GraphStore.from_triples(turtle.lexical_only(rdf_view(spark, sf).triples())).triples()


# encoded graphs, dictionaries, queries
def _encoded(spark: SparkSession, sf: str) -> tuple[str, Dictionary]:
    store, path = rdf_view(spark, sf), new_path(spark)
    dictionary = store.dictionary()
    encoded.write_encoded(store.encoded(dictionary), path)
    encoded.write_dictionary(dictionary, f"{path}/dictionary")
    return path, Dictionary(*[encoded.read_dictionary(spark, f"{path}/dictionary/{x}") for x in ("nodes", "predicates")])


@_query("scan_encoded", f"{_CODED} SELECT s, p, o FROM e")
def _(spark, sf):
    return encoded.read_encoded(spark, f"{_encoded(spark, sf)[0]}/edges")


@_query("encoded_counts", f"{_CODED} SELECT count(*)::VARCHAR AS line FROM e UNION ALL SELECT count(*)::VARCHAR FROM n")
def _(spark, sf):
    return spark.read.text(f"{_encoded(spark, sf)[0]}/counts").select(F.col("value").alias("line"))


@_query("scan_dictionary", f"{_CODED} SELECT 'node' AS kind, id, term FROM n UNION ALL SELECT 'predicate', id, term FROM q")
def _(spark, sf):
    _, d = _encoded(spark, sf)
    return d.nodes.select(F.lit("node").alias("kind"), "id", "term").unionAll(d.predicates.select(F.lit("predicate"), "id", "term"))


@_query("encoded_query", _CYCLE_SQL)
def _(spark, sf):
    """The graph and the query as ids, the solutions decoded."""
    path, d = _encoded(spark, sf)
    text = encode_query(PREFIXES + _CYCLE, d).replace("#EOQ#", "")
    found = Engine(cli.load_graph(spark, path, keep=True)).query(text)
    return d.decode_columns(found.select(*[F.regexp_extract(c, "[0-9]+", 0).cast("long").alias(c) for c in found.columns]), found.columns)


@_query("query_files", f"SELECT 'one' AS name, 0 AS i, {C} AS c, {_txt('c_mktsegment')} AS g FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'one', 1, {C}, {_txt('c_mktsegment')} FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def _(spark, sf):
    path = new_path(spark)
    cli._write(spark, f"{path}/one", f"{PREFIXES}{_SEGMENTS}\n#EOQ#\n{PREFIXES}SELECT ?c ?g WHERE {{ ?c p:segment ?g , \"BUILDING\" ; p:fromNation <urn:nation:3> }}\n")
    engine = Engine(rdf_view(spark, sf))
    parts = [engine.query(text).select(F.lit(name).alias("name"), F.lit(i).alias("i"), "c", "g") for name, i, text in encoded.read_queries(spark, path)]
    return parts[0].unionAll(parts[1])


@_query("program_sql", f"{_GRAPH} SELECT a.s AS x, b.o AS z FROM t a JOIN t b ON a.o = b.s WHERE a.p = '{p('placedBy')}' AND b.p = '{p('segment')}'")
def _(spark, sf):
    """A query's SQL text, run by Spark."""
    rdf_view(spark, sf).triples().createOrReplaceTempView("graphloom_triples")
    return spark.sql(to_sql(PREFIXES + "SELECT ?x ?z { ?x p:placedBy ?y . ?y p:segment ?z }", "graphloom_triples").replace('"', "`"))


@_query("saved_store", f"{_GRAPH} SELECT s, p, o FROM t")
def _(spark, sf):
    path = new_path(spark)
    rdf_view(spark, sf).save(path)
    return GraphStore.load(spark, path).triples()


# sinks
@_query("result_lines", f"SELECT {C} || ' ' || {_txt('c_mktsegment')} AS line FROM customer WHERE c_nationkey = 3")
def _(spark, sf):
    return _lines(spark, lambda path: encoded.write_results(Engine(rdf_view(spark, sf)).query(PREFIXES + _SEGMENTS), path))


@_query("result_id_lines", f"{_CODED} SELECT '<' || s || '> <' || o || '>' AS line FROM e JOIN q ON q.id = e.p WHERE q.term = '{p('segment')}'")
def _(spark, sf):
    path, d = _encoded(spark, sf)
    layer = encoded.read_encoded(spark, f"{path}/edges").join(d.predicates.where(F.col("term") == p("segment")).select(F.col("id").alias("p")), "p")
    return _lines(spark, lambda out: encoded.write_results(layer.select("s", "o"), out, ids=True))


@_query("result_text", f"SELECT '?c ?g' AS line UNION ALL SELECT {C} || ' ' || {_txt('c_mktsegment')} FROM customer WHERE c_nationkey = 3 AND c_custkey < 500")
def _(spark, sf):
    shown = Engine(rdf_view(spark, sf)).query(PREFIXES + _SEGMENTS).where(F.regexp_extract("c", "[0-9]+", 0).cast("long") < 500)
    return spark.range(1).select(F.explode(F.split(F.lit(encoded.result_text(shown)), "\n")).alias("line"))


@_query("matrix_lines", f"SELECT '(' || {N} || ', ' || {_ent('region', 'n_regionkey')} || '): ' || n_regionkey AS line FROM nation")
def _(spark, sf):
    m = rdf_view(spark, sf).layer(p("inRegion")).select(F.col("s").alias("u"), F.col("o").alias("v"), F.regexp_extract("o", "[0-9]+", 0).alias("x"))
    return _lines(spark, lambda path: encoded.write_cells(m, path))


@_query("matrix_market_lines", f"{_CODED} SELECT (s + 1) || chr(9) || (o + 1) || chr(9) || p AS line FROM e UNION ALL SELECT '%%MatrixMarket matrix coordinate real general' UNION ALL SELECT (SELECT count(*) FROM n) || ' ' || (SELECT count(*) FROM n) || ' ' || count(*) FROM e")
def _(spark, sf):
    path, _ = _encoded(spark, sf)
    encoded.write_matrix_market(encoded.read_encoded(spark, f"{path}/edges"), f"{path}/mm")
    return spark.read.text([f"{path}/mm/cells", f"{path}/mm/header"]).select(F.col("value").alias("line"))


@_query("statistics_lines", f"{_GRAPH} SELECT count(*) || ' ' || term AS line FROM (SELECT s AS term FROM t UNION ALL SELECT o FROM t) GROUP BY term")
def _(spark, sf):
    return _lines(spark, lambda path: encoded.write_statistics(rdf_view(spark, sf).term_frequency(), path))


@_query("vector_lines", "SELECT DISTINCT c_nationkey || '' AS line FROM customer")
def _(spark, sf):
    return _lines(spark, lambda path: encoded.write_vector(spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey").distinct(), "c_nationkey", path))


@_query("map_lines", f"{_GRAPH} SELECT p || ' ' || count(*) AS line FROM t GROUP BY p")
def _(spark, sf):
    return _lines(spark, lambda path: encoded.write_map(rdf_view(spark, sf).predicate_stats(), "p", "n_triples", path))


# versions and growing dictionaries
_REGIONS = "SELECT ?n ?r WHERE { ?n p:inRegion ?r }"


def _history(spark: SparkSession, sf: str) -> GraphLog:
    """Version 1 puts a nation in (and a triple that is there), 2 takes all nations of region 2 out and one that isn't there, 3 puts one of them back."""
    log = GraphLog.create(spark, new_path(spark), rdf_view(spark, sf))
    at = p("inRegion")
    log.insert([("<urn:nation:900>", at, "<urn:region:1>"), ("<urn:nation:1>", at, "<urn:region:1>")])
    gone = log.at().layer(at, o="<urn:region:2>").select("s", F.lit(at).alias("p"), "o")
    log.delete(gone.unionAll(spark.createDataFrame([("<urn:nation:901>", at, "<urn:region:2>")], gone.schema)))
    log.insert(gone.orderBy("s").limit(1))
    return log


_NATIONS = f"""WITH t AS (SELECT {N} AS n, {_ent('region', 'n_regionkey')} AS r FROM nation UNION SELECT '<urn:nation:900>', '<urn:region:1>' UNION SELECT '<urn:nation:1>', '<urn:region:1>')"""


@_query("insert_delta", f"{_NATIONS} SELECT * FROM t WHERE r <> '<urn:region:2>' OR n = (SELECT min(n) FROM t WHERE r = '<urn:region:2>')")
def _(spark, sf):
    return Engine(_history(spark, sf).at()).query(PREFIXES + _REGIONS)


@_query("store_at_version", f"{_NATIONS} SELECT 1 AS version, * FROM t UNION ALL SELECT 2, * FROM t WHERE r <> '<urn:region:2>' UNION ALL SELECT 0, {N}, {_ent('region', 'n_regionkey')} FROM nation")
def _(spark, sf):
    log = _history(spark, sf)
    log.compact()
    parts = [Engine(log.at(v)).query(PREFIXES + _REGIONS).select(F.lit(v).alias("version"), "n", "r") for v in (0, 1, 2)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@_query("log_compacted", f"{_NATIONS} SELECT * FROM t WHERE r <> '<urn:region:2>' OR n = (SELECT min(n) FROM t WHERE r = '<urn:region:2>') UNION ALL SELECT '<urn:nation:902>', '<urn:region:3>'")
def _(spark, sf):
    log = _history(spark, sf)
    log.compact()
    log.insert([("<urn:nation:902>", p("inRegion"), "<urn:region:3>")])
    return Engine(log.at()).query(PREFIXES + _REGIONS)


_FIRST = ("segment", "brand", "inRegion")


@_query(
    "dict_append",
    f"""{_GRAPH}, a AS (SELECT s AS term FROM t WHERE p IN ('{"', '".join(map(p, _FIRST))}') UNION SELECT o FROM t WHERE p IN ('{"', '".join(map(p, _FIRST))}')),
    b AS (SELECT s AS term FROM t UNION SELECT o FROM t EXCEPT SELECT term FROM a)
    SELECT row_number() OVER (ORDER BY term) - 1 AS id, term FROM a UNION ALL SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY term) - 1, term FROM b""",
)
def _(spark, sf):
    """Some layers' terms first, saved; then the whole graph's: old ids stay, new ones follow densely."""
    store, path = rdf_view(spark, sf), new_path(spark)
    Dictionary.of(store.triples().where(F.col("p").isin([p(x) for x in _FIRST]))).save(path)
    return Dictionary.append(spark, path, store.triples()).nodes


# streams
def _streamed(spark: SparkSession, source: DataFrame, build, mode: str) -> DataFrame:
    """What a streaming query over the rows of source gives, once all of them are read."""
    path = new_path(spark)
    source.write.parquet(f"{path}/in")
    stream = build(spark.readStream.schema(source.schema).parquet(f"{path}/in"))
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out/batch=-1")
    # a batch that is tried again writes over its own rows; of a complete result the last batch holds
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else n}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").drop("batch")


@_query("stream_match", f"SELECT {_ent('order', 'o_orderkey')} AS o, {C} AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    store = rdf_view(spark, sf)
    placed = store.layer(p("placedBy")).select("s", F.lit(p("placedBy")).alias("p"), "o")
    return _streamed(spark, placed, lambda s: match_stream(s, store, PREFIXES + 'SELECT ?o ?c { ?o p:placedBy ?c . ?c p:segment "BUILDING" }'), "append")


@_query("stream_rates", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS p, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("s"), F.col("event_type").alias("p"), F.col("value").cast("string").alias("o"), F.col("ts").cast("timestamp").alias("ts"))
    rates = _streamed(spark, events, lambda s: predicate_rates(s, "1 hour", "3650 days"), "complete")
    return rates.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "p", "n")


@_query(
    "stream_joined",
    """SELECT '<urn:user:' || a.user_id || '>' AS u, '"' || a.event_id || '"' AS v, '"' || b.event_id || '"' AS b, strftime(greatest(a.ts, b.ts), '%Y-%m-%d %H:%M:%S') AS at FROM events a JOIN events b ON a.user_id = b.user_id
    WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 6 * 3600000000""",
)
def _(spark, sf):
    """Two streaming patterns: purchases within six hours of a click of the same user."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("<urn:user:"), _key("user_id"), F.lit(">")).alias("s"), F.concat(F.lit("<urn:p:"), F.col("event_type"), F.lit(">")).alias("p"), F.concat(F.lit('"'), _key("event_id"), F.lit('"')).alias("o"), F.col("ts").cast("timestamp").alias("ts")
    )
    text = PREFIXES + "SELECT ?u ?v ?b { ?u p:click ?v . ?u p:purchase ?b }"
    found = _streamed(spark, events, lambda s: match_streams({0: s, 1: s}, GraphStore(spark), text, "6 hours", "3650 days"), "append")
    return found.select("u", "v", "b", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


# binding vectors as bits over ids
def _bits(spark: SparkSession, sf: str):
    """The dictionary, and f(layer) -> its encoded cells (u, v), stored."""
    store = rdf_view(spark, sf)
    d = store.dictionary()
    layer = lambda name: stored(spark, store.encoded(d, [p(name)]).select(F.col("s").alias("u"), F.col("o").alias("v")))[0]
    return d, layer


def _building(spark: SparkSession, d: Dictionary, layer) -> DataFrame:
    return stored(spark, B.of_ids(layer("segment").where(F.col("v") == d.lookup(['"BUILDING"'])['"BUILDING"']), "u"))[0]


@_query("bits_mxv", f"SELECT {_ent('order', 'o_orderkey')} AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    d, layer = _bits(spark, sf)
    return d.decode_column(B.ids(B.mxv(layer("placedBy"), _building(spark, d, layer))), "v")


@_query("bits_vandv", f"SELECT {C} AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    d, layer = _bits(spark, sf)
    return d.decode_column(B.ids(B.vandv(_building(spark, d, layer), B.of_ids(layer("placedBy"), "v"))), "v")


@_query("bits_binding_matrix", f"SELECT {_ent('order', 'o_orderkey')} AS u, {C} AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def _(spark, sf):
    d, layer = _bits(spark, sf)
    rows = stored(spark, B.of_ids(layer("status").where(F.col("v") == d.lookup(['"F"'])['"F"']), "u"))[0]
    return d.decode_column(d.decode_column(B.binding_matrix(layer("placedBy"), rows, _building(spark, d, layer)), "u"), "v").select("u", "v")
