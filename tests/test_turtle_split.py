"""Turtle files in pieces: the same triples and errors as one parser over the whole file."""

import random
import re

import pytest

from graphloom.sources import turtle, turtle_split

GOOD = [
    "<s{i}> <p> <o{i}> .", "a:s{i} a b:T ;\n  b:p 1.5 , 2 ,\n 'x.y' .", '<s{i}> <p> """long . text\n@prefix a: <no> .\n"quote" and \'\'\' . \n""" .', "<s{i}> <p> '''other\n\"\"\" . <x> <y>\n''' ; <q> true .",
    "@prefix a: <urn:a{i}:> .", "PREFIX b: <urn:b{i}:>", "@base <http://base{i}/> .", "# a comment . \"\"\" '", "_:x{i} <p> [ <q> ( 1 2 'a#b' ) ; <r> \"c\\\"d\" ] .", "<s{i}> <p#frag> \"\"\"q\"\"\" , \"\" , '' .", "<s{i}> <p>\n\n\n <o> ; ; .", "<a> <b> \"x\"@en-gb . <c> <d> \"1\"^^<t> .",
]
BAD = ["<s{i}> <p> nonsense .", "z:unknown <p> <o> . <s> <p> <o> .", "<s> <p> \"open\n<s{i}> <p> <o> .", "<s> bad <p> \"\"\" . <x> <y> <z> .\n", "<s> <p> <o> ; . . <s> <p> [ .", "'''", "<s> <p> <o>", "@prefix c <x> ."]


def whole(spark, paths):
    triples, errors = [], []
    scheme = spark.read.text(str(paths[-1])).select("_metadata.file_path").first()[0].removesuffix(str(paths[-1]))
    for path in paths:
        p = turtle.TurtleParser(path.read_text(), blank_prefix=turtle.file_tag(f"{scheme}{path}"))
        triples += p.parse()
        errors += [f"{scheme}{path}:{line}: {message}" for line, message in p.errors]
    return alike(triples), sorted(errors)


def alike(triples):
    """New blank nodes, whose labels differ, are told apart by what is said of them only."""
    return sorted(tuple(re.sub(r"^(_:[0-9a-f]{32})g.*", r"\1g", t) for t in x) for x in triples)


def pieces(spark, folder, size):
    rows = turtle_split.read_split(spark, str(folder), size).collect()
    return alike([(r.s, r.p, r.o) for r in rows if r.error is None]), sorted(r.error for r in rows if r.error is not None)


def text_of(rng, n, bad):
    out = ["@prefix a: <urn:a:> . @prefix b: <urn:b:> ."]
    for i in range(n):
        out.append((rng.choice(BAD) if rng.random() < bad else rng.choice(GOOD)).format(i=i))
    return rng.choice(["\n", "\n\n"]).join(out) + rng.choice(["", "\n", " # end"])


@pytest.mark.parametrize("size", [1, 60, 400])
def test_pieces_equal_one_parser(spark, tmp_path, size):
    rng = random.Random(size)
    for i, (n, bad) in enumerate([(1, 0), (60, 0), (40, 0.1), (12, 0.5), (0, 0)]):
        (tmp_path / f"f{i}.ttl").write_text(text_of(rng, n, bad))
    (tmp_path / "empty.ttl").write_text("")
    (tmp_path / "open.ttl").write_text('<a> <b> """never closed\n' + "\n".join(f"<s{i}> <p> <o> ." for i in range(40)))
    want = whole(spark, sorted(tmp_path.glob("*.ttl")))
    assert len(want[0]) > 200 and len(want[1]) > 5
    assert pieces(spark, tmp_path, size) == want


def test_a_well_formed_file_takes_one_round_and_many_units(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    (tmp_path / "f.ttl").write_text(text_of(rng, 400, 0))
    made = []
    monkeypatch.setattr(turtle_split, "stored", lambda s, df, real=turtle_split.stored: made.append(df) or real(s, df))
    got = pieces(spark, tmp_path, 300)
    assert got == whole(spark, [tmp_path / "f.ttl"]) and got[1] == []
    plans = [df for df in made if "unit" in df.columns and "cut" in df.columns]
    assert len(plans) == 1 and plans[0].select("unit").distinct().count() > 20


def test_sums_of_pieces():
    states = {t: [turtle_split._end_state(t, s) for s in (0, 1, 2)] for t in ("", "<a> .\n", 'x """ y\n', "''' \"\"\" '''\n", '# """\n', '" \\" """" \n')}
    assert states[""] == [0, 1, 2] and states["<a> .\n"] == [0, 1, 2] and states['x """ y\n'][:2] == [1, 0] and states['# """\n'][0] == 0
    assert turtle_split._first_statement('. "a.b" . x', 0) == 1 and turtle_split._first_statement("x 1.5 <a.b> ex:a.b . y", 0) == 20 and turtle_split._first_statement('x . """ . y', 1) == 9
