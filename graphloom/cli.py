"""Command line: encode, encode-queries, run, explain, to-sql.

    python -m graphloom.cli encode INPUT OUTPUT [--remove-double-edges] [--lexical]
    python -m graphloom.cli encode-queries ENCODED QUERIES OUTPUT
    python -m graphloom.cli run GRAPH QUERIES OUTPUT [--reduce] [--analyze] [--show]
    python -m graphloom.cli explain GRAPH QUERIES [--analyze]
    python -m graphloom.cli to-sql QUERIES
"""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .operators.storage import file_system, names, stored
from .operators.store import Dictionary, GraphStore
from .plans.executor import Engine
from .plans.syntax import SparqlError
from .plans.to_sql import UnknownConstant, encode_query, to_sql
from .sources import encoded, turtle


_NTRIPLES = (".nt", ".nt.gz", ".nt.bz2")


def load_rdf(spark: SparkSession, path: str, remove_double_edges: bool = False, lexical: bool = False) -> GraphStore:
    """A store from a file, or the files of a folder: N-Triples (*.nt, split by lines) and Turtle."""
    files = [f"{path.rstrip('/')}/{name}" for name, is_folder in names(spark, path) if not is_folder and name[0] not in "_."] or [path]
    lines, rest = ([f for f in files if f.endswith(_NTRIPLES) == of_lines] for of_lines in (True, False))
    found = [read(spark, some)[0] for read, some in ((turtle.read_ntriples, lines), (turtle.read_turtle, rest)) if some]
    triples = reduce(DataFrame.unionAll, found)
    store = GraphStore.from_triples(turtle.lexical_only(triples) if lexical else triples)
    return store.remove_double_edges() if remove_double_edges else store


def load_encoded(spark: SparkSession, path: str, keep: bool = False) -> GraphStore:
    """A store whose terms are `<id>`s, so that encoded queries run on it as they are. keep: the ids are stored, so that patterns don't parse the lines again."""
    edges = encoded.read_encoded(spark, path)
    return GraphStore.from_ids(stored(spark, edges)[0] if keep else edges)


def load_graph(spark: SparkSession, path: str, analyze: bool = False, keep: bool = False) -> GraphStore:
    """Encoded edges (path/edges, or a file ending in .encoded), a saved store (a directory of p=...), or RDF text; on any storage that Spark reads."""
    inside = [name for name, is_folder in names(spark, path) if is_folder]
    if "edges" in inside or path.endswith(".encoded"):
        store = load_encoded(spark, f"{path}/edges" if "edges" in inside else path, keep)
    elif any(name.startswith("p=") for name in inside):
        store = GraphStore.load(spark, path)
    else:
        store = load_rdf(spark, path)
    return store.analyze() if analyze else store


def run_queries(spark: SparkSession, store: GraphStore, queries: str, out: str | None, reduce: bool = False, show: bool = False) -> list[tuple[str, int, float]]:
    """(name, rows, seconds) of every query; results go to out/<name>.results, and their first rows to the console if asked."""
    done = []
    engine = Engine(store, reduce)
    for name, i, text in encoded.read_queries(spark, queries):
        began = time.time()
        df = engine.query(text).persist()
        rows = df.count()
        if out is not None:
            encoded.write_results(df, f"{out}/{name}.{i}.results")
        if show:
            print(encoded.result_text(df))
        df.unpersist()
        done.append((f"{name}.{i}", rows, time.time() - began))
    return done


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, on any storage."""
    files, place = file_system(spark, path)
    out = files.create(place)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, places in (("encode", ["input", "output"]), ("encode-queries", ["encoded", "queries", "output"]), ("run", ["graph", "queries", "output"]), ("explain", ["graph", "queries"]), ("to-sql", ["queries"])):
        one = sub.add_parser(name)
        for place in places:
            one.add_argument(place)
        if name == "encode":
            one.add_argument("--remove-double-edges", action="store_true")
            one.add_argument("--lexical", action="store_true")
        if name == "run":
            one.add_argument("--reduce", action="store_true")
            one.add_argument("--show", action="store_true")
        if name in ("run", "explain"):
            one.add_argument("--analyze", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "encode":
        store = load_rdf(spark, a.input, a.remove_double_edges, a.lexical)
        dictionary = store.dictionary()
        edges, nodes = encoded.write_encoded(dictionary.encode(store.triples()), a.output)
        encoded.write_dictionary(dictionary, f"{a.output}/dictionary")
        print(f"{edges} edges, {nodes} nodes")
    elif a.command == "encode-queries":
        dictionary = Dictionary(*[encoded.read_dictionary(spark, f"{a.encoded}/dictionary/{x}") for x in ("nodes", "predicates")])
        for name, i, text in encoded.read_queries(spark, a.queries):
            try:
                _write(spark, f"{a.output.rstrip('/')}/{name}.{i}.encoded", encode_query(text, dictionary))
            except (SparqlError, UnknownConstant) as e:
                print(f"{name}.{i}: {e!r}")
    elif a.command == "run":
        for name, rows, seconds in run_queries(spark, load_graph(spark, a.graph, a.analyze), a.queries, a.output, a.reduce, a.show):
            print(f"{name}: {rows} rows, {seconds:.2f} s")
    elif a.command == "explain":
        engine = Engine(load_graph(spark, a.graph, a.analyze))
        for name, i, text in encoded.read_queries(spark, a.queries):
            print(f"-- {name}.{i}\n{engine.explain(text)}")
    else:
        for name, _, text in encoded.read_queries(spark, a.queries):
            print(f"-- {name}\n{to_sql(text)};")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
