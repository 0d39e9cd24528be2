import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.functions.terms import TYPE, XSD
from graphloom.plans.qgraph import QueryGraph
from graphloom.plans.syntax import Const, SparqlError, Update, Var, parse, split_queries


def patterns(text):
    return parse(text).where.patterns


def test_prefixes_lists_and_a():
    got = patterns("PREFIX x: <urn:x:> select ?s where { ?s a x:K ; x:p ?o , <urn:q> . $t x:p ?s }")
    assert [(p.s, p.p, p.o) for p in got] == [
        (Var("s"), Const(TYPE), Const("<urn:x:K>")), (Var("s"), Const("<urn:x:p>"), Var("o")),
        (Var("s"), Const("<urn:x:p>"), Const("<urn:q>")), (Var("t"), Const("<urn:x:p>"), Var("s")),
    ]


def test_literals():
    got = patterns("""SELECT ?s { ?s <p> "a\\"b", 'c'@EN, "1"^^<urn:t>, 5, 1.5, 2e3, true, '''x
y''', -7 }""")
    assert [p.o.term for p in got] == ['"a"b"', '"c"@en', '"1"^^<urn:t>', f'"5"^^<{XSD}integer>', f'"1.5"^^<{XSD}decimal>', f'"2e3"^^<{XSD}double>', f'"true"^^<{XSD}boolean>', '"x\ny"', f'"-7"^^<{XSD}integer>']


def test_blank_nodes():
    got = patterns("SELECT ?a { [ <p> ?a ; <q> [] ] <r> _:x . _:x <s> ?a . [ <t> 1 ] . }")
    assert len(got) == 5 and got[2].o == got[3].s and got[0].s != got[4].s
    assert parse("SELECT * { ?b <p> [] . ?a <q> ?b }").columns() == ["a", "b"]


def test_groups_and_modifiers():
    q = parse("SELECT COUNT ?x WHERE { ?x <p> ?y { ?y <q> ?z FILTER(?z > 1) } { ?x <a> ?b } UNION { ?x <c> ?b } UNION {} OPTIONAL { ?x <d> ?e } } ORDER BY DESC(count) ASC(?x) ?y LIMIT 7")
    assert (q.modifier, q.limit, q.order) == ("count", 7, [("count", True), ("x", False), ("y", False)])
    assert len(q.where.patterns) == 2 and len(q.where.filters) == 1 and len(q.where.unions[0]) == 3 and len(q.where.optionals) == 1


def test_filter_precedence():
    e = parse("SELECT ?x { ?x <p> ?y FILTER (!(?y <= 3) || ?y * 2 + 1 = 7 && in(?y, 1, 2)) }").where.filters[0]
    assert e.op == "||" and e.args[0].op == "not" and e.args[1].op == "&&" and e.args[1].args[0].args[0].op == "+"


def test_updates():
    got = parse("PREFIX x: <urn:> INSERT DATA { x:a x:p x:b ; x:q 'l' . x:c a x:D }")
    assert isinstance(got, Update) and got.kind == "insert" and len(got.triples) == 3
    assert parse("DELETE DATA { <a> <b> <c> }").triples == [("<a>", "<b>", "<c>")]


@pytest.mark.parametrize("bad", [
    "SELECT ?x", "SELECT { ?x <p> ?y }", "SELECT ?x { ?x ?p }", "SELECT ?x { ?x 'lit' ?y }", "SELECT ?x FROM <g> { ?x <p> ?y }", "SELECT ?x { ?x <p> ?y } LIMIT 0", "SELECT ?x { ?x u:p ?y }",
    "PREFIX a: <x> PREFIX a: <y> SELECT ?x { ?x <p> ?y }", "SELECT ?x { ?x <p> ?y } nonsense", "INSERT DATA { ?x <p> <y> }", "SELECT ?x { ?x <p> ?y FILTER NOSUCH(?x) }", "SELECT ?x { ?x <p> ?y FILTER REGEX(?x) }", "SELECT ?x { ?x <p> ?y . ", "SELECT ?x { ?x <p> ?y } ORDER BY count",
])
def test_errors(bad):
    with pytest.raises(SparqlError):
        parse(bad)


def test_split_keeps_the_last_query():
    assert len(split_queries("SELECT ?x { ?x <p> ?y }\n#EOQ#\n\nSELECT ?y { ?x <p> ?y }\n")) == 2
    assert split_queries("\n#EOQ#\n") == []


@given(st.text(alphabet='ab"\\\n\'é@^<>', max_size=12))
def test_any_literal_round_trips(text):
    written = '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    assert patterns(f"SELECT ?s {{ ?s <p> {written} }}")[0].o.term == f'"{text}"'


@pytest.mark.parametrize(("body", "shape", "cycles"), [
    ("?x <a> ?y", "single", 0), ("?x <a> ?y . ?x <b> ?z . ?x <c> <k>", "star", 0), ("?x <a> ?y . ?y <b> ?z . ?z <c> ?w", "linear", 0),
    ("?x <a> ?y . ?x <b> ?z . ?z <c> ?w . ?z <d> ?v . ?y <e> ?u", "snowflake", 0), ("?x <a> ?y . ?y <b> ?z . ?z <c> ?x", "cyclic", 1), ("?x <a> ?y . ?z <b> ?w", "disconnected", 0),
])
def test_shapes(body, shape, cycles):
    g = QueryGraph(patterns(f"SELECT * {{ {body} }}"))
    assert (g.shape(), g.cycles()) == (shape, cycles)
    assert len(g.walk()) == len(g.components()[0])
