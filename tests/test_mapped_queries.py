"""Patterns, profiles and edges over mapped tables, by their keys: as over the same triples without their tables."""

import pytest

from graphloom.operators.store import GraphStore, Mapped, TermMap
from graphloom.plans.executor import Engine
from graphloom.plans.syntax import parse

from .conftest import rows
from .test_changes import plan_of


@pytest.fixture
def store(spark):
    a = spark.createDataFrame([(1, 2, "x", "x"), (2, 2, "y", "z"), (3, 3, "x", None), (4, None, None, None), (5, 1, "x", "y")], "k bigint, other int, name string, kind string")
    b = spark.createDataFrame([(2, 7), (2, 7), (1, 7), (3, 8), (11, 7)], "s bigint, o int")
    key, text = TermMap("k", "<u:a:", ">", "bigint"), lambda c: TermMap(c, '"', '"')
    layers = {
        "<other>": [Mapped(a, key, TermMap("other", "<u:a:", ">", "int"))],
        "<name>": [Mapped(a, key, text("name")), Mapped(b, TermMap("o", "<u:b:", ">", "int"), "<c>", repeats=True)],
        "<kind>": [Mapped(a, key, text("kind"))],
        "<has>": [Mapped(b, TermMap("s", "<u:a:", ">", "bigint"), TermMap("o", "<u:b:", ">", "int"), repeats=True)],
    }
    return GraphStore.from_layers(spark, layers)


@pytest.fixture
def plain(store):
    return GraphStore(store.spark, store.triples())


@pytest.mark.parametrize("reduce", [False, True])
@pytest.mark.parametrize(
    "text",
    [
        "{ ?a <has> ?x . ?b <has> ?x . ?a <name> \"x\" . ?b <name> \"x\" }",
        "{ ?a <other> ?b . ?b <has> ?x . ?a <has> ?x }",
        "{ ?a <other> ?a . ?a <name> ?n }",
        "{ ?a <has> ?x . ?x <name> ?n }",
        "{ ?a <name> ?n . ?b <kind> ?n . ?a <has> ?x OPTIONAL { ?b <other> ?c } }",
        "{ ?a <name> ?x . ?x <name> ?n }",
        "{ <u:a:2> <other> ?a . ?a <has> <u:b:7> . ?c <kind> ?k }",
        "{ ?a <has> ?x . ?a ?p ?n }",
        "{ ?a <has> ?a }",
        "{ ?a <other> ?b . <u:a:1> <name> \"x\" }",
    ],
)
def test_patterns_by_keys(store, plain, text, reduce):
    assert rows(Engine(store, reduce).query(f"SELECT * {text}")) == rows(Engine(plain).query(f"SELECT * {text}"))


def test_joins_run_on_numbers(store):
    assert set(Engine(store)._keys(parse("SELECT * { ?a <has> ?x . ?a <name> ?n . ?b <has> ?x }").where.patterns, 0)[0]) == {"a", "b", "x"}


def test_profiles_and_edges(store, plain):
    assert sorted(r.n for r in store.subject_counts().collect()) == sorted(r.n for r in plain.subject_counts().collect())
    assert rows(store.remove_double_edges().triples()) == rows(plain.remove_double_edges().triples())
    got, want = ({r.p: (r.n_triples, r.n_subjects) for r in x.predicate_stats().collect()} for x in (store, plain))
    assert got == want


def test_what_hardly_repeats_is_dealt_out_before_it_is_grouped(store):
    """An aggregate before the exchange would hold all that a task reads."""
    plan = plan_of(GraphStore.from_triples(store.table if store.table is not None else store.layer("<other>").selectExpr("s", "s AS p", "o")).triples())
    assert plan.rindex("HashAggregate") < plan.index("Exchange")
