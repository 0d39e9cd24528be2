"""Turtle files parsed by many tasks each.

A file is read in pieces of whole lines. At a line's start the lexer is outside
of any string or in one of the two long kinds of it, so a piece is summed up by
three cases: for each state at its start, the state at its end, where the first
statement ends, and which directives it holds. Composing these sums in order
gives every piece its true state, the first statement that starts in it, and the
prefixes in force. A unit, what one task parses, runs from there to the first
statement of the next piece that has one; only that stretch of text, the end of
one statement, goes to the task of the piece before.

Sums are made without knowing what comes before, so each unit's parse is held
against them: it must end with a statement's end just where the next unit
starts, have no long string left open, and find the directives that were
assumed. Where that fails (a bad statement or an open string across a border) the
next piece joins the unit, the directives found are taken, and the file is parsed
once more. The first unit that was wrong is right then, so the rounds end, and
triples and errors equal those of one parser over the whole file, whatever it
holds, but for the labels of new blank nodes. A well-formed file takes one round.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small
from ..operators.storage import stored
from .turtle import TurtleParser, file_tag

#: Characters of a piece, or one line if that is longer.
PIECE = 4_000_000
OUT, LONG = 0, {1: '"""', 2: "'''"}
_QUOTES = {mark: state for state, mark in LONG.items()}
_DIRECTIVE = re.compile(r"@prefix|@base|\bprefix\b|\bbase\b", re.I)
#: What a quote may hide in, and long strings that end.
_HIDING = re.compile(r"""#[^\n]*|<[^<>"{}|^`\s]*>|(?P<open>\"{3}|'{3})|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*'""", re.S)
_CLOSE = {state: re.compile(rf"(?:(?:{mark[0]}|{mark[0]}{mark[0]})?(?:[^{mark[0]}\\]|\\.))*{mark}", re.S) for state, mark in LONG.items()}

_KEY = "path string, at bigint, piece int"


def _pieces(size: int):
    """Lines (path, at: where their part of the file starts, value), in order, to pieces of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, piece, held, n = None, 0, [], 0
        made = lambda: pd.DataFrame([(*key, piece, "".join(held))], columns=["path", "at", "piece", "text"])
        for batch in batches:
            for path, at, line in zip(batch["path"], batch["at"], batch["value"], strict=True):
                if (path, at) != key or n >= size:
                    if held:
                        yield made()
                    piece, held, n = (0 if (path, at) != key else piece + 1), [], 0
                    key = (path, at)
                held.append(f"{line}\n")
                n += len(line) + 1
        if held:
            yield made()

    return run


def _end_state(text: str, state: int) -> int:
    """The lexer's state after a text that starts at a line's start in `state`."""
    at = 0
    while True:
        if state != OUT:
            m = _CLOSE[state].match(text, at) if LONG[state] in text else None
            if not m:
                return state
            state, at = OUT, m.end()
        if all(text.find(mark, at) < 0 for mark in LONG.values()):
            return OUT
        m = next((m for m in _HIDING.finditer(text, at) if m["open"]), None)
        if m is None:
            return OUT
        state, at = _QUOTES[m["open"]], m.end()


def _first_statement(text: str, state: int) -> int:
    """Where the first statement starts that isn't open at the text's start; -1 if none does."""
    at = 0
    if state != OUT:
        m = _CLOSE[state].match(text) if LONG[state] in text else None
        if not m:
            return -1
        at = m.end()
    lexer = TurtleParser(text)
    lexer.at = at
    before = "str" if state != OUT else ""
    lexer._next()
    while lexer.token[0] != "end":
        kind, token = lexer.token
        if (kind, token) == ("op", "."):
            return lexer.at
        # a directive begins a statement (but for a language of that name)
        if kind == "word" and token.upper() in ("PREFIX", "BASE") or kind == "at" and token in ("@prefix", "@base") and before not in ("str", "long"):
            return lexer.start
        before = kind
        if lexer.opened:  # a long string that goes on in the next piece
            return -1
        lexer._next()
    return -1


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each piece and each state at its start: the state at its end, the first statement (cut), the line breaks before it, the directives from there on (JSON)."""
    columns = ["path", "at", "piece", "state", "after", "cut", "breaks", "lines", "directives"]
    for batch in batches:
        for path, at, piece, text in zip(batch["path"], batch["at"], batch["piece"], batch["text"], strict=True):
            rows = []
            for state in (OUT, *LONG):
                cut = _first_statement(text, state)
                found = []
                if _DIRECTIVE.search(text):
                    # a piece that begins a file begins with a statement
                    parser = TurtleParser(text[0 if (at, piece, state) == (0, 0, OUT) else cut if cut >= 0 else len(text) :], lenient=True)
                    for _ in parser.statements():
                        if parser.opened:  # what follows is in a string that goes on in the next piece
                            break
                        found = list(parser.directives)
                rows.append((path, at, piece, state, _end_state(text, state), cut, text.count("\n", 0, max(cut, 0)), text.count("\n"), json.dumps(found)))
            yield pd.DataFrame(rows, columns=columns)


def _in_force(directives: list[list[str]]) -> list[list[str]]:
    """The directives that still matter: each base, and the last of each prefix, in order; all if one is written with another."""
    if any(not iri.startswith("<") for _, _, iri in directives):
        return directives
    last = {(kind, name): i for i, (kind, name, _) in enumerate(directives)}
    return [d for i, d in enumerate(directives) if d[0] == "base" or last[d[0], d[1]] == i]


def _composed(sums: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """A file's pieces in order, numbered: the unit of each, and what a unit starts with. told: pieces that the next one joins (joins), and directives that a unit has found."""
    told = told.sort_values("round")
    joins = set(told.loc[told["found"].isna(), "unit"])
    found = {r.unit: r.found for r in told.itertuples() if isinstance(r.found, str)}
    cases: dict[tuple[int, int], dict[int, tuple]] = {}
    for r in sums.itertuples(index=False):
        cases.setdefault((r.at, r.piece), {})[r.state] = r
    state, unit, line, directives, out = OUT, -1, 1, [], []
    for number, key in enumerate(sorted(cases)):
        r, before = cases[key][state], unit
        starts = number == 0 or (r.cut >= 0 and number - 1 not in joins)
        env, cut, own = "", -1, json.loads(r.directives)
        if starts:
            unit, env, cut = number, json.dumps(_in_force(directives)), r.cut if number else 0
            own = json.loads(found[unit]) if unit in found else own
        elif unit in found:  # which has this piece's, too
            own = []
        directives = directives + own
        out.append((r.path, r.at, r.piece, number, unit, before if starts else unit, cut, env, line + (r.breaks if number else 0), json.dumps(own)))
        state, line = r.after, line + r.lines
    return pd.DataFrame([(*x, x[4] == unit) for x in out], columns=["path", "at", "piece", "number", "unit", "before", "cut", "env", "line", "assumed", "final"])


def _parsed(parts: pd.DataFrame) -> pd.DataFrame:
    """Triples and errors of a unit; rows of what was not as assumed: its last piece's number if the next one joins it, the directives found if they are others."""
    parts = parts.sort_values(["number", "own"])
    first = parts[parts["env"] != ""].iloc[0]
    path, unit = first["path"], int(first["unit"])
    parser = TurtleParser("".join(parts["text"]), blank_prefix=file_tag(path), directives=json.loads(first["env"]), line=int(first["line"]), new_label=f"g{unit}x" if unit else "g")
    rows = [(s, p, o, None, None, None) for part in parser.statements() for s, p, o in part]
    rows += [(None, None, None, f"{path}:{line}: {message}", None, None) for line, message in parser.errors]
    own = parts[parts["own"]]
    if not own["final"].any() and (parser.opened or parser.cut):
        rows.append((None, None, None, None, int(own["number"].max()), None))
    elif parser.directives != sum((json.loads(x) for x in own["assumed"]), []):
        rows.append((None, None, None, None, unit, json.dumps(parser.directives)))
    out = pd.DataFrame(rows, columns=["s", "p", "o", "error", "told", "found"], dtype=object)
    out.insert(0, "path", path)
    return out


_ROWS = "path string, s string, p string, o string, error string, told int, found string"
_PLAN = f"{_KEY}, number int, unit int, before int, cut int, env string, line int, assumed string, final boolean"


def read_split(spark: SparkSession, path: str | list[str], size: int = PIECE) -> DataFrame:
    """(s, p, o, error) of the Turtle files at path, a triple or an error each. A stored table: files are parsed once."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    pieces = lines.mapInPandas(_pieces(size), f"{_KEY}, text string")
    sums, _ = stored(spark, pieces.mapInPandas(_summed, f"{_KEY}, state int, after int, cut int, breaks int, lines int, directives string"))
    told = spark.createDataFrame([], "path string, unit int, found string, round int")
    todo, out, n = sums, [], 0
    while True:
        plan, _ = stored(spark, todo.groupBy("path").cogroup(told.groupBy("path")).applyInPandas(_composed, _PLAN))
        # a piece's text from its cut on is its unit's; what stands before belongs to the unit before
        halves = F.array(
            F.struct(F.lit(True).alias("own"), F.col("unit").alias("unit"), F.expr("IF(cut > 0, substring(text, cut + 1), text)").alias("text")),
            F.struct(F.lit(False).alias("own"), F.col("before").alias("unit"), F.expr("IF(cut > 0, substring(text, 1, cut), '')").alias("text")),
        )
        columns = ["path", "number", "line", "assumed", "final", "env"]
        parts = pieces.join(small(plan), ["path", "at", "piece"]).select(*columns, F.inline(halves)).where("own OR text <> ''").withColumn("env", F.when(F.col("own"), F.col("env")).otherwise(""))
        rows, _ = stored(spark, parts.groupBy("path", "unit").applyInPandas(_parsed, _ROWS))
        wrong = rows.where("told IS NOT NULL")
        if wrong.isEmpty():
            return reduce(DataFrame.unionAll, [*out, rows]).select("s", "p", "o", "error")
        # only files with a wrong unit are parsed again; pieces that join it are twice as many each time
        more = wrong.select("path", F.expr(f"explode(IF(found IS NULL, sequence(told, told + {2**n - 1}), array(told)))").alias("unit"), "found", F.lit(n).alias("round"))
        told, _ = stored(spark, told.unionAll(more))
        paths, _ = stored(spark, wrong.select("path").distinct())
        out.append(rows.join(paths, "path", "left_anti"))
        todo = todo.join(paths, "path", "left_semi")
        n += 1
