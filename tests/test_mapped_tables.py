"""Mapped tables meet dictionaries by their keys: the same ids and terms as by strings."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators.store import Dictionary, GraphStore, Mapped, TermMap
from graphloom.sources import encoded

from .conftest import rows

INT = '"^^<urn:int>'


@pytest.fixture
def store(spark):
    a = spark.createDataFrame([(1, 2, "x", 7), (2, 2, '5"', 7), (3, None, "x", None), (3, 9, None, 2)], "k bigint, other int, name string, n int")
    b = spark.createDataFrame([(2, 7), (2, 7), (2, 8), (11, 7)], "s bigint, o bigint")
    none = spark.createDataFrame([], "k bigint, v string")
    key = TermMap("k", "<u:a:", ">", "bigint")
    layers = {
        "<p>": [Mapped(a, key, TermMap("other", "<u:a:", ">", "int"))],
        "<q>": [Mapped(a, key, TermMap("name", '"', '"')), Mapped(a, key, TermMap("n", '"', INT, "int"))],
        "<t>": [Mapped(a.where("k < 3"), key, "<u:a:3>"), Mapped(none, key, "<none>")],
        "<r>": [Mapped(b, TermMap("s", "<u:a:", ">", "bigint"), TermMap("o", "<u:", ">", "bigint"), repeats=True)],
        "<gone>": [Mapped(none, key, TermMap("v", '"', '"'))],
    }
    return GraphStore.from_layers(spark, layers)


@pytest.mark.parametrize("limit", [8_000_000, -1])
def test_ids_by_keys(spark, store, monkeypatch, limit):
    monkeypatch.setattr(Dictionary, "BROADCAST", limit)
    triples = store.triples().where("s IS NOT NULL AND o IS NOT NULL")
    want, got = Dictionary.of(triples), store.dictionary()
    assert rows(got.nodes) == rows(want.nodes) and rows(got.predicates) == rows(want.predicates)
    assert rows(store.encoded(got)) == rows(want.encode(triples)) and triples.count() == 14
    assert rows(got.decode(store.encoded(got))) == rows(triples)
    assert rows(store.encoded(got, ["<r>"])) == rows(want.encode(triples.where("p = '<r>'")))


def test_a_graph_is_encoded_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(x):
        runs.add(1)
        return x

    df = spark.createDataFrame([(0, 2, 1), (1, 2, 300), (1, 3, 0)], "s bigint, p bigint, o bigint").withColumn("s", F.udf(seen, "bigint")("s"))
    assert encoded.write_encoded(df, str(tmp_path / "e")) == (3, 3) and runs.value == 3
    assert encoded.write_encoded(df.where("p > 9"), str(tmp_path / "none")) == (0, 0)


def test_maps_that_share_no_term():
    number, text, order = TermMap("a", '"', INT, "int"), TermMap("b", '"', '"'), TermMap("c", "<u:o:", ">", "bigint")
    assert number.apart(text) and text.apart(order) and order.apart("<u:o:x>")
    assert not order.apart(TermMap("d", "<u:", ">")) and not order.apart("<u:o:7>") and not text.apart('"x"')
