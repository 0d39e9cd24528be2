"""Turtle and N-Triples.

N-Triples is read line by line with built-in functions; Turtle through a parser
of our own, statement by statement (turtle_split says how its files are split). Bad
statements don't end a load: they come out as rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, TYPE, XSD, literal
from ..plans.syntax import SparqlError, unescape

_CODE = r"\\(?:u(?![Dd][89A-Fa-f])[0-9A-Fa-f]{4}|U(?:0000(?![Dd][89A-Fa-f])|000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4})"
_IN_IRI = r'[^<>"{}|^`\\\x00-\x20]*+'
_IRI = rf'<{_IN_IRI}(?:{_CODE}{_IN_IRI})*+>'
_BLANK = r'_:[^\s<>".](?:[^\s<>"]*[^\s<>".])?'
_IN_TEXT = r'[^"\\\n\r]*+'
_TEXT = rf'{_IN_TEXT}(?:(?:\\[tbnrf"\'\\]|{_CODE}){_IN_TEXT})*+'
#: One N-Triples statement: subject, predicate, object that is no literal, or a literal's text and tag. Loops are possessive: literals of any length match without a deep stack.
LINE = rf'^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*(?:({_IRI}|{_BLANK})|"({_TEXT})"(@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{_IRI})?)\s*\.\s*(?:#.*)?$'

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\s]*>)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)
  | (?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<pname>(?:[^\W\d_][\w.\-]*)?:(?:[\w:](?:[\w.:\-]*[\w:\-])?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<op>\^\^|[\[\]().,;])
    """,
    re.X | re.S,
)


class TurtleParser:
    """Triples of one text, as (s, p, o); errors as (line, message). Labels of blank nodes begin with blank_prefix, then l for the text's own and g for new ones.

    A text may be part of a file: directives are those in force at its start, as
    [prefix or base, name, IRI as written], line is its first line's number, and
    new_label begins new blank nodes' labels. Afterwards, directives has those of
    the text itself; opened tells of a long string that doesn't end in the text,
    cut of a statement or a bad line that doesn't. lenient: unknown prefixes are no errors.
    """

    def __init__(self, text: str, base: str = "", blank_prefix: str = "", directives: list[list[str]] = (), line: int = 1, new_label: str = "g", lenient: bool = False) -> None:
        self.text, self.at, self.base, self.blank_prefix = text, 0, base, blank_prefix
        self.counted, self.line, self.new_label, self.lenient = 0, line, new_label, lenient
        self.opened = self.cut = False
        self.solid = len(text.rstrip())
        self.prefixes: dict[str, str] = {}
        for kind, name, iri in directives:
            self._declare(kind, name, iri)
        self.directives: list[list[str]] = []
        self.fresh = 0
        self.out: list[tuple[str, str, str]] = []
        self.errors: list[tuple[int, str]] = []
        self.token: tuple[str, str] = ("", "")

    def parse(self) -> list[tuple[str, str, str]]:
        return [x for part in self.statements() for x in part]

    def statements(self) -> Iterator[list[tuple[str, str, str]]]:
        """The triples of each statement. A bad one gives none but an error, and its line is skipped."""
        self._next()
        while self.token[0] != "end":
            self.out, start = [], self.start
            try:
                self._statement()
            except (SparqlError, KeyError, ValueError) as e:
                self.out = []
                # what is missing at the end is missed on the last line that isn't blank
                upto = max(self.counted, min(self.start, self.solid))
                self.line += self.text.count("\n", self.counted, upto)
                self.counted = upto
                self.errors.append((self.line, str(e)))
                at = self.text.find("\n", max(self.start, start))
                self.cut |= at < 0 or self.token[0] == "end"
                self.at = len(self.text) if at < 0 else at
                self._next()
            yield self.out

    def _next(self) -> None:
        while True:
            self.start = self.at
            if self.at >= len(self.text):
                self.token = ("end", "")
                return
            m = _TOKEN.match(self.text, self.at)
            if self.text.startswith(('"""', "'''"), self.at) and (not m or m.lastgroup != "long"):
                self.opened = True
            if not m:
                self.token = ("bad", self.text[self.at])
                self.at += 1
                return
            self.at = m.end()
            if m.lastgroup != "skip":
                self.token = (m.lastgroup, m[0])
                return

    def _op(self, text: str) -> None:
        if self.token != ("op", text):
            raise SparqlError(f"expected {text}, found {self.token[1]!r}")
        self._next()

    def _statement(self) -> None:
        kind, text = self.token
        if kind == "at" and text in ("@prefix", "@base") or kind == "word" and text.upper() in ("PREFIX", "BASE"):
            self._next()
            name = ""
            if prefix := text.lower().endswith("prefix"):
                if self.token[0] != "pname" or not self.token[1].endswith(":"):
                    raise SparqlError("expected a prefix")
                name = self.token[1][:-1]
                self._next()
            told = ["prefix" if prefix else "base", name, self.token[1]]
            self._resolved(*self.token)
            self._next()
            self._declare(*told)
            self.directives.append(told)
            if kind == "at":
                self._op(".")
            return
        if kind == "at":
            raise SparqlError(f"unknown directive {text}")
        if self.token == ("op", "["):
            s = self._blank_list()
            if self.token == ("op", "."):
                self._next()
                return
        else:
            s = self._subject()
        self._predicates(s)
        self._op(".")

    def _subject(self) -> str:
        if self.token == ("op", "("):
            return self._collection()
        if self.token[0] == "blank":
            return self._labelled()
        return self._iri()

    def _labelled(self) -> str:
        return f"_:{self.blank_prefix}l{self._take()[2:]}"

    def _take(self) -> str:
        text = self.token[1]
        self._next()
        return text

    def _declare(self, kind: str, name: str, iri: str) -> None:
        inner = self._resolved("iri" if iri.startswith("<") else "pname", iri)[1:-1]
        if kind == "prefix":
            self.prefixes[name] = inner
        else:
            self.base = inner

    def _iri(self) -> str:
        out = self._resolved(*self.token)
        self._next()
        return out

    def _resolved(self, kind: str, text: str) -> str:
        if kind == "iri":
            inner = unescape(text[1:-1]) if "\\" in text else text[1:-1]
            return f"<{inner}>" if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", inner) else f"<{self.base}{inner}>"
        if kind != "pname":
            raise SparqlError(f"expected an IRI, found {text!r}")
        prefix, _, name = text.partition(":")
        if prefix not in self.prefixes and not self.lenient:
            raise SparqlError(f"unknown prefix {prefix}:")
        return f"<{self.prefixes.get(prefix, '')}{name}>"

    def _new(self) -> str:
        self.fresh += 1
        return f"_:{self.blank_prefix}{self.new_label}{self.fresh}"

    def _predicates(self, s: str) -> None:
        while True:
            if self.token == ("word", "a"):
                self._next()
                p = TYPE
            else:
                p = self._iri()
            while True:
                o = self._object()
                self.out.append((s, p, o))
                if self.token != ("op", ","):
                    break
                self._next()
            if self.token != ("op", ";"):
                return
            while self.token == ("op", ";"):
                self._next()
            if self.token in (("op", "."), ("op", "]")):
                return

    def _blank_list(self) -> str:
        self._op("[")
        b = self._new()
        if self.token != ("op", "]"):
            self._predicates(b)
        self._op("]")
        return b

    def _collection(self) -> str:
        self._op("(")
        items = []
        while self.token != ("op", ")"):
            items.append(self._object())
        self._next()
        head = f"<{RDF}nil>"
        for item in reversed(items):
            b = self._new()
            self.out += [(b, f"<{RDF}first>", item), (b, f"<{RDF}rest>", head)]
            head = b
        return head

    def _object(self) -> str:
        kind, text = self.token
        if (kind, text) == ("op", "["):
            return self._blank_list()
        if (kind, text) == ("op", "("):
            return self._collection()
        if kind == "blank":
            return self._labelled()
        if kind in ("iri", "pname"):
            return self._iri()
        if kind == "num":
            self._next()
            return literal(text, datatype=XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            self._next()
            return literal(text, datatype=XSD + "boolean")
        if kind not in ("str", "long"):
            raise SparqlError(f"unexpected {text!r}")
        raw = unescape(text[3:-3] if kind == "long" else text[1:-1])
        self._next()
        if self.token[0] == "at":
            return literal(raw, lang=self._take()[1:])
        if self.token == ("op", "^^"):
            self._next()
            return literal(raw, datatype=self._iri()[1:-1])
        return literal(raw)


def file_tag(path: str) -> str:
    """What the labels of a file's blank nodes begin with: 128 bits, so that no two files share one."""
    return hashlib.md5(path.encode()).hexdigest()


def read_turtle(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(triples, errors) of the files at path, large ones parsed by many tasks; blank nodes of different files stay apart."""
    from .turtle_split import read_split

    rows = read_split(spark, path)
    return rows.where("error IS NULL").select("s", "p", "o"), rows.where("error IS NOT NULL").select("error")


def _unescaped(c):
    """Undoing of N-Triples escapes, in one pass; a text without a backslash, the usual case, passes at once."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]++"), 0)
    char = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
    named = lambda x: F.translate(F.substring(x, 2, 1), "tbnrf", "\t\b\n\r\f")
    one = lambda x: F.when(x.startswith("\\u") | x.startswith("\\U"), char(x)).when(x.startswith("\\"), named(x)).otherwise(x)
    return F.when(F.instr(c, "\\") > 0, F.array_join(F.transform(pieces, one), "")).otherwise(c)


def read_ntriples(spark: SparkSession, path: str | list[str], keep_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(triples, errors): errors are the lines that are neither a statement, a comment nor blank. Splits files.

    Blank nodes of different files stay apart. keep_labels: the files are parts of
    one document, as Spark writes them, and labels stay as they are.
    """
    lines = spark.read.text(path).select("value", F.md5(F.col("_metadata.file_path").cast("binary")).alias("tag"))
    # matched once a line: a statement becomes its parts, each with a line break, which no line has; behind explode, the filter isn't pushed down to match again
    split = lines.select("tag", F.explode(F.array(F.regexp_replace("value", LINE, "$1\n$2\n$3\n$4\n$5\n"))).alias("parts")).where(F.instr("parts", "\n") > 0)
    part = lambda i: F.col("part")[i]
    scoped = lambda t: t if keep_labels else F.when(t.startswith("_:"), F.concat(F.lit("_:"), F.col("tag"), F.lit("l"), F.substring(t, 3, 2**31 - 1))).otherwise(t)
    tail = F.when(part(4).startswith("@"), F.lower(part(4))).when(part(4) == f"^^<{XSD}string>", "").otherwise(_unescaped(part(4)))
    whole = F.when(part(2) != "", scoped(_unescaped(part(2)))).otherwise(F.concat(F.lit('"'), _unescaped(part(3)), F.lit('"'), tail))
    triples = split.select("tag", F.split("parts", "\n").alias("part")).select(scoped(_unescaped(part(0))).alias("s"), _unescaped(part(1)).alias("p"), whole.alias("o"))
    errors = lines.where(~F.col("value").rlike(LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$")).select(F.col("value").alias("error"))
    return triples, errors


def clean_spaces(triples: DataFrame) -> DataFrame:
    """A cleanup pass: no blanks inside subjects and predicates; literals lose quotes, tabs and blanks."""
    squeezed = lambda c: F.regexp_replace(c, r"[ \t]", "")
    inner = F.regexp_replace(F.regexp_extract("o", r'(?s)^"(.*)"', 1), r'["\t ]', "")
    tail = F.regexp_extract("o", r'(?s)^".*"(.*)$', 1)
    return triples.select(squeezed("s").alias("s"), squeezed("p").alias("p"), F.when(F.col("o").startswith('"'), F.concat(F.lit('"'), inner, F.lit('"'), tail)).otherwise(F.col("o")).alias("o"))


def lexical_only(triples: DataFrame) -> DataFrame:
    """Compatibility: objects that differ only in kind, language or datatype become one IRI; line breaks in them turn into spaces, quotes go."""
    from ..functions.terms import lexical

    text = F.regexp_replace(F.regexp_replace(lexical(F.col("o")), r"[\n\r]", " "), '"', "")
    return triples.select("s", "p", F.when(F.col("o").startswith("_:"), F.col("o")).otherwise(F.concat(F.lit("<"), text, F.lit(">"))).alias("o"))
