"""Dictionaries that are joined by shuffle, as large ones are."""

import pytest

from graphloom import cli
from graphloom.file_queries import QUERIES
from graphloom.operators.store import Dictionary, GraphStore
from graphloom.plans.executor import Engine
from graphloom.sources import encoded

from .conftest import rows


@pytest.fixture
def shuffled(spark, monkeypatch):
    monkeypatch.setattr(Dictionary, "BROADCAST", -1)
    triples = [(f"<s{i}>", "<p>", "<o>") for i in range(20)]
    return GraphStore.from_triples(spark.createDataFrame(triples, "s string, p string, o string")).dictionary()


def test_rows_that_are_nothing_but_an_id(spark, shuffled):
    known = {r.id: r.term for r in shuffled.nodes.collect()}
    ids = [0, 3, 3, 3, 99, None]
    assert rows(shuffled.decode_column(spark.createDataFrame([(i,) for i in ids], "v bigint"), "v")) == sorted([(known.get(i),) for i in ids], key=repr)


@pytest.mark.parametrize("name", ["n", "term", "id"])
def test_a_column_named_as_the_counts(spark, shuffled, name):
    known = {r.id: r.term for r in shuffled.nodes.collect()}
    df = shuffled.decode_column(spark.createDataFrame([(0, "a"), (3, "b")], f"{name} bigint, x string"), name)
    assert rows(df.select("x", name)) == [("a", known[0]), ("b", known[3])]


@pytest.mark.parametrize("limit", [-1, 8_000_000])
def test_columns_are_decoded_of_rows_that_are_computed_once(spark, shuffled, monkeypatch, limit):
    monkeypatch.setattr(Dictionary, "BROADCAST", limit)
    known, read = {r.id: r.term for r in shuffled.nodes.collect()}, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    ids = [(0, 3, 7), (3, 3, 7), (None, 99, 7), (5, None, 7)]
    df = spark.createDataFrame(ids, "at bigint, id bigint, term bigint").mapInPandas(counted, "at bigint, id bigint, term bigint")
    got = Dictionary(shuffled.nodes, shuffled.predicates).decode_columns(df, df.columns)
    assert got.columns == df.columns and rows(got) == sorted([tuple(known.get(i) for i in r) for r in ids], key=repr) and read.value == len(ids)


def test_an_encoded_query_is_solved_before_it_is_decoded(spark, monkeypatch):
    monkeypatch.setattr(Dictionary, "BROADCAST", -1)
    df = QUERIES["encoded_query"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan  # no line is parsed again for what is read
    assert df.count() == QUERIES["bgp_cycle"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("keep", [False, True])
def test_encoded_lines_of_any_form_are_joined_by_their_numbers(spark, tmp_path, keep):
    lines = ["3", "4", "<0> <2> <1> .", "<0> <2> <1> .", "<00> <02> <1> .", " 1\t<2>  3", "<1> 3 <0>.", "<3> <2> <3> .", "<-1> <2> <0> .", "<0> <2> <+1> .", "<0> <2> <1> . x", "<0> <2> < 1> .", "<> <2> <1> ."]
    (tmp_path / "edges").mkdir()
    (tmp_path / "edges/part").write_text("\n".join(lines))
    assert rows(encoded.read_encoded(spark, str(tmp_path / "edges"))) == [(0, 2, 1)] * 3 + [(1, 2, 3), (1, 3, 0), (3, 2, 3)]
    store = cli.load_graph(spark, str(tmp_path), keep=keep)
    assert rows(store.triples()) == [("<0>", "<2>", "<1>"), ("<1>", "<2>", "<3>"), ("<1>", "<3>", "<0>"), ("<3>", "<2>", "<3>")]
    for more in (store, store.with_triples([("<0>", "<3>", "<9>")]).without_triples([("<0>", "<3>", "<9>")])):
        query = lambda text: rows(Engine(more).query(text))  # noqa: B023, E731
        assert query("SELECT ?x ?y ?z { ?x <2> ?y . ?y <2> ?z }") == [("<0>", "<1>", "<3>"), ("<1>", "<3>", "<3>"), ("<3>", "<3>", "<3>")]
        assert query("SELECT ?x { ?x <2> ?x }") == [("<3>",)] and query("SELECT ?x { ?x <2> ?y . ?y <3> <0> }") == [("<0>",)]
        assert query("SELECT ?x { ?x <2> ?y . ?y <u:none> ?z }") == query("SELECT ?x { ?x <2> <02> }") == []
        assert query("SELECT ?p ?y { <1> ?p ?y }") == [("<2>", "<3>"), ("<3>", "<0>")]
    plan = Engine(store).query("SELECT ?x ?z { ?x <2> ?y . ?y <2> ?z }")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not [x for x in plan.splitlines() if "Join" in x and "concat" in x]


def test_terms_with_separators_are_read_whole(spark, tmp_path):
    terms = [(0, "\"a\u2028b c\""), (1, "\"\u0085\""), (2, "\"  \""), (3, "")]
    df = spark.createDataFrame(terms, "id bigint, term string")
    encoded.write_dictionary(Dictionary(df, df), str(tmp_path / "d"))
    assert rows(encoded.read_dictionary(spark, str(tmp_path / "d/nodes"))) == terms
