import json
import subprocess
import sys
import time

from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions.terms import RDF, XSD, escaped, lexical
from graphloom.operators.store import GraphStore
from graphloom.plans.executor import Engine
from graphloom.sources import encoded, turtle
from graphloom.streaming.match import match_stream, predicate_rates

from .conftest import ROOT, rows
from .test_changes import plan_of

TURTLE = '''@prefix x: <urn:x:> .
@base <http://base/> .
PREFIX y: <urn:y:>
# comment
x:a a x:K ; y:p <rel>, "two"@EN-gb ;
    y:q 1, 1.5, 1e3, true, "z"^^x:t, """long "quoted"
text""" ;
    .
_:b y:p ( x:a "l" ) .
[ y:p [ ] ] y:r () .
[ y:s 'single' ] .
x:bad oops .
x:a y:u "\\u00e9\\U0001F600\\n" .
'''


def test_turtle_parser():
    p = turtle.TurtleParser(TURTLE)
    got = p.parse()
    objects = {(s, q): [o for s2, q2, o in got if (s2, q2) == (s, q)] for s, q, _ in got}
    assert objects["<urn:x:a>", "<urn:y:p>"] == ["<http://base/rel>", '"two"@en-gb']
    assert objects["<urn:x:a>", "<urn:y:q>"] == [f'"1"^^<{XSD}integer>', f'"1.5"^^<{XSD}decimal>', f'"1e3"^^<{XSD}double>', f'"true"^^<{XSD}boolean>', '"z"^^<urn:x:t>', '"long "quoted"\ntext"']
    assert objects["<urn:x:a>", "<urn:y:u>"] == ['"é😀\n"']
    assert sum(q == f"<{RDF}first>" for _, q, _ in got) == 2 and sum(o == f"<{RDF}nil>" for *_, o in got) == 2
    assert [line for line, _ in p.errors] == [12] and len(got) == 18


def test_turtle_files_and_ntriples(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.ttl").write_text(TURTLE)
    (d / "b.ttl").write_text("_:b <urn:p> <urn:o> .\nnot a triple\n<urn:s> <urn:p> 'x' .")
    triples, errors = turtle.read_turtle(spark, str(d))
    assert triples.count() == 20 and errors.count() == 2
    nt = tmp_path / "c.nt"
    nt.write_text('<s:a> <p:p> "q\\"uote \\u00e9 \\\\n"@EN .\n# c\n\n<s:a> <p:p> <o:o> . # tail\n_:x <p:p> "1"^^<t:t>.\nbroken\n<s:a> <p:p> "plain"^^<http://www.w3.org/2001/XMLSchema#string> .\n')
    triples, errors = turtle.read_ntriples(spark, str(nt), keep_labels=True)
    assert rows(triples) == sorted([("<s:a>", "<p:p>", '"q"uote é \\n"@en'), ("<s:a>", "<p:p>", "<o:o>"), ("_:x", "<p:p>", '"1"^^<t:t>'), ("<s:a>", "<p:p>", '"plain"')], key=repr)
    assert rows(errors) == [("broken",)]
    encoded.write_ntriples(triples, str(tmp_path / "out"))
    again, bad = turtle.read_ntriples(spark, str(tmp_path / "out"), keep_labels=True)
    assert rows(again) == rows(triples) and bad.count() == 0
    assert rows(turtle.lexical_only(triples)) == sorted([("<s:a>", "<p:p>", "<quote é \\n>"), ("<s:a>", "<p:p>", "<o:o>"), ("_:x", "<p:p>", "<1>"), ("<s:a>", "<p:p>", "<plain>")], key=repr)
    assert rows(turtle.clean_spaces(spark.createDataFrame([("<a b>", "<p\t>", '"x "y"\t"@en')], "s string, p string, o string"))) == [("<ab>", "<p>", '"xy"@en')]


def test_blank_nodes_of_different_files_stay_apart(spark, tmp_path):
    for name in ("a.nt", "b.nt", "c.ttl", "d.ttl"):
        (tmp_path / name).write_text("_:x <urn:p> _:x .\n_:g1 <urn:p> <urn:o> .\n" + ("[] <urn:p> <urn:o> .\n_:lg1 <urn:p> _:b.1 ." if name[2:] == "ttl" else ""))
    store = cli.load_rdf(spark, str(tmp_path))
    assert rows(Engine(store).query("SELECT COUNT ?p { ?x ?p ?x }")) == [("<urn:p>", 4)]
    subjects = [r.s for r in store.triples().select("s").distinct().collect()]
    assert len(subjects) == 2 * 4 + 2 * 2 and all(s[2:34].isalnum() for s in subjects)


def test_ntriples_of_any_length_and_every_escape(spark, tmp_path):
    long = "x" * 300_000 + "\\\\" * 100_000 + "\\u00e9" * 50_000
    lines = [f'<u:a> <u:p> "{long}" .', '<u:\\u0061b> <u:p> "\\t\\b\\n\\r\\f\\"\\\'\\\\U0041"^^<u:\\u0074> .', '<u:a><u:p>"x"@en-GB.', '<u:a> <u:p> "\\x" .', '<u:a> <u:p> "\\U00110000" .', '<u:a> <u:p> "\\uDFFF" .', '<u: a> <u:p> "x" .', '"x" <u:p> "x" .', "_:b. <u:p> _:c ."]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    triples, errors = turtle.read_ntriples(spark, str(tmp_path / "x.nt"), keep_labels=True)
    want = [("<u:a>", "<u:p>", '"' + "x" * 300_000 + "\\" * 100_000 + "é" * 50_000 + '"'), ("<u:ab>", "<u:p>", '"\t\b\n\r\f"\'\\U0041"^^<u:t>'), ("<u:a>", "<u:p>", '"x"@en-gb')]
    assert rows(triples) == sorted(want, key=repr) and errors.count() == 6


def test_ntriples_lines_are_matched_once(spark, tmp_path):
    """Also where the matched lines make up several columns; parts of a statement stay apart, whatever stands in them."""
    lines = ['_:x <u:p> _:y.z .', '<u:a> <u:p> "" .', '<u:a> <u:p> ""@EN .', '<u:a> <u:p> "a\u2028b $1 \\n <x> . #"^^<u:t> . # c', '<u:a> <u:p> <u:b> . # c\u2028', '<u:a> <u:p> "x" . # c\u2028d', "<u:a> <u:p> <> .", '<u:a> "x" <u:b> .', "", "# <u:a> <u:p> <u:b> ."]
    (tmp_path / "x.nt").write_text("\n".join(lines), encoding="utf-8")
    triples, errors = turtle.read_ntriples(spark, str(tmp_path / "x.nt"), keep_labels=True)
    want = [("_:x", "<u:p>", "_:y.z"), ("<u:a>", "<u:p>", '""'), ("<u:a>", "<u:p>", '""@en'), ("<u:a>", "<u:p>", '"a\u2028b $1 \n <x> . #"^^<u:t>'), ("<u:a>", "<u:p>", "<u:b>"), ("<u:a>", "<u:p>", "<>")]
    assert rows(triples) == sorted(want, key=repr) and {r.error for r in errors.collect()} == {lines[5], lines[7]}
    for keep in (True, False):
        assert plan_of(turtle.read_ntriples(spark, str(tmp_path / "x.nt"), keep)[0]).count(turtle.LINE) == 1


def test_literals_as_ntriples_writes_them(spark):
    terms = ["<u:a>", "_:b", '""', '"', '"a"b"', '"a\\\n\r\t"', '"x"@en"', '"x"@en-gb', '"1"^^<u:t>', '"a"^^<u:t>"@de']
    got = spark.createDataFrame([(t,) for t in terms], "t string").select(lexical(F.col("t")), escaped(F.col("t")))
    want = [("u:a", "<u:a>"), ("_:b", "_:b"), ("", '""'), ("", '""'), ('a"b', '"a\\"b"'), ("a\\\n\r\t", '"a\\\\\\n\\r\\t"'), ('x"@en', '"x\\"@en"'), ("x", '"x"@en-gb'), ("1", '"1"^^<u:t>'), ('a"^^<u:t>', '"a\\"^^<u:t>"@de')]
    assert rows(got) == sorted(want, key=repr)


def test_turtle_parser_is_linear_and_counts_lines():
    text = "bad line\n" * 20_000 + "<u:a> <u:p> <u:b> ."
    p = turtle.TurtleParser(text)
    began = time.perf_counter()
    assert len(p.parse()) == 1 and [p.errors[i][0] for i in (0, 1, -1)] == [1, 2, 20_000] and time.perf_counter() - began < 10


def test_console_and_line_writers(spark, tmp_path, capsys):
    df = spark.createDataFrame([("<a>", None), ("<b>", '"x"')], "x string, y string")
    assert encoded.result_text(df.orderBy("x")) == '?x ?y\n<a> \n<b> "x"'
    (tmp_path / "g.ttl").write_text("<u:a> <u:p> <u:b> .")
    (tmp_path / "q").write_text("SELECT ?x { ?x <u:p> ?y }")
    assert cli.main(["run", str(tmp_path / "g.ttl"), str(tmp_path / "q"), str(tmp_path / "out"), "--analyze", "--show"]) == 0
    assert "?x\n<u:a>\n" in capsys.readouterr().out
    # a path that only Spark's file systems know
    assert cli.main(["run", f"file:{tmp_path}/g.ttl", f"file:{tmp_path}/q", f"file:{tmp_path}/out3"]) == 0


def test_encoded_files(spark, tmp_path):
    edges = [(0, 2, 1), (1, 2, 3), (1, 3, 0)]
    df = spark.createDataFrame(edges, "s bigint, p bigint, o bigint")
    assert encoded.write_encoded(df, str(tmp_path / "e")) == (3, 3)
    assert rows(encoded.read_encoded(spark, str(tmp_path / "e/edges"))) == edges
    (tmp_path / "dump").write_text("3\n4\n0 1 2\n1 3 2\n1 0 3\n")
    assert rows(encoded.read_encoded(spark, str(tmp_path / "dump"), "sop")) == edges
    encoded.write_matrix_market(df, str(tmp_path / "mm"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "mm/cells")).collect()) == ["1\t2\t2", "2\t1\t3", "2\t4\t2"]
    assert [r.value for r in spark.read.text(str(tmp_path / "mm/header")).collect()][1] == "4 4 3"
    store = cli.load_graph(spark, str(tmp_path / "e"))
    assert rows(Engine(store).query("SELECT ?x ?y { ?x <2> ?y . ?y <3> <0> }")) == [("<0>", "<1>")]
    encoded.write_results(Engine(store).query("SELECT ?x ?y { ?x <2> ?y }"), str(tmp_path / "res"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "res")).collect()) == ["<0> <1>", "<1> <3>"]
    encoded.write_statistics(store.term_frequency(), str(tmp_path / "freq"))
    assert spark.read.text(str(tmp_path / "freq")).count() == 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/g.ttl").write_text("<u:a> <u:p> <u:b> , <u:c> . <u:b> <u:q> <u:c> . <u:a> <u:q> <u:b> .")
    (tmp_path / "q").mkdir()
    (tmp_path / "q/one").write_text("SELECT ?x ?y WHERE { <u:a> <u:p> ?x . ?x <u:q> ?y }\n#EOQ#\nSELECT ?x WHERE { ?x <u:p> <u:none> }")
    assert cli.main(["encode", str(tmp_path / "in"), str(tmp_path / "enc"), "--remove-double-edges"]) == 0
    assert "3 edges, 3 nodes" in capsys.readouterr().out
    assert cli.main(["encode-queries", str(tmp_path / "enc"), str(tmp_path / "q"), str(tmp_path / "qe")]) == 0
    assert "UnknownConstant" in capsys.readouterr().out
    assert cli.main(["run", str(tmp_path / "enc"), str(tmp_path / "qe"), str(tmp_path / "out"), "--reduce"]) == 0
    assert "one.0.encoded.0: 1 rows" in capsys.readouterr().out
    assert cli.main(["run", str(tmp_path / "in"), str(tmp_path / "q"), str(tmp_path / "out2")]) == 0
    assert "one.1: 0 rows" in capsys.readouterr().out
    assert cli.main(["to-sql", str(tmp_path / "q")]) == 0
    assert "FROM triples t0, triples t1" in capsys.readouterr().out
    assert cli.main(["explain", str(tmp_path / "in"), str(tmp_path / "q")]) == 0
    assert "Physical Plan" in capsys.readouterr().out


def test_stream_static_match(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"s": s, "p": "<p>", "o": o, "ts": "2024-01-01 00:00:10"}) for s, o in (("<a>", "<b>"), ("<c>", "<d>"))))
    stream = spark.readStream.schema("s string, p string, o string, ts timestamp").json(str(src))
    store = GraphStore.from_triples(spark.createDataFrame([("<b>", "<q>", "<x>")], "s string, p string, o string"))
    for df, name, want in ((match_stream(stream, store, "SELECT ?a ?x { ?a <p> ?b . ?b <q> ?x }"), "m1", [("<a>", "<x>")]), (predicate_rates(stream).select("p", "n"), "m2", [("<p>", 2)])):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "m2" else "append").start()
        query.processAllAvailable()
        for _ in range(50):
            if rows(spark.table(name)) == want:
                break
            time.sleep(0.1)
        query.stop()
        assert rows(spark.table(name)) == want


def test_help_runs_without_spark():
    assert subprocess.run([sys.executable, "-m", "graphloom.cli", "--help"], cwd=ROOT, capture_output=True, check=True).stdout
