"""SPARQL text to a syntax tree: SELECT queries and INSERT / DELETE DATA.

Covers prefixes and base-less IRIs, basic graph patterns with `;` and `,` lists,
`a`, blank nodes and `[ ... ]`, literals of every form, nested groups, UNION,
OPTIONAL, FILTER expressions, the solution modifiers DISTINCT, REDUCED, COUNT
and DUPLICATES, ORDER BY and LIMIT. Keywords are case-insensitive but for `a`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.terms import TYPE, XSD, iri, literal


class SparqlError(ValueError):
    """The text isn't a query of the supported grammar."""


@dataclass(frozen=True)
class Var:
    name: str
    hidden: bool = False


@dataclass(frozen=True)
class Const:
    term: str


Node = Var | Const


@dataclass(frozen=True)
class Pattern:
    s: Node
    p: Node
    o: Node

    def nodes(self) -> tuple[Node, Node, Node]:
        return self.s, self.p, self.o

    def vars(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in self.nodes() if isinstance(x, Var)))


@dataclass(frozen=True)
class Expr:
    """op with arguments: an operator or function name; "var" and "const" are the leaves."""

    op: str
    args: tuple = ()


def variables(e: Expr) -> set[str]:
    """Names of the variables in an expression."""
    if e.op == "var":
        return {e.args[0]}
    return {v for x in e.args if isinstance(x, Expr) for v in variables(x)}


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list[Expr] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    #: groups that are solved by themselves, as a union of one
    nested: list[Group] = field(default_factory=list)
    #: for each optional, how many patterns, unions and nested groups stand before it
    before: list[tuple[int, int, int]] = field(default_factory=list)

    def optional(self, g: Group) -> None:
        self.before.append((len(self.patterns), len(self.unions), len(self.nested)))
        self.optionals.append(g)

    def merge(self, inner: Group) -> None:
        """Takes in a nested group: its patterns become this group's where that is the same, which its optionals, unions and filters on outer variables may hinder."""
        if inner.optionals or inner.unions or inner.nested or any(not variables(e) <= set(inner.named()) for e in inner.filters):
            self.nested.append(inner)
        else:
            self.patterns += inner.patterns
            self.filters += inner.filters

    def named(self) -> list[str]:
        """Names of the visible variables, sorted."""
        out = {x.name for p in self.patterns for x in p.nodes() if isinstance(x, Var) and not x.hidden}
        for g in [*(b for u in self.unions for b in u), *self.optionals, *self.nested]:
            out |= set(g.named())
        return sorted(out)


@dataclass
class Select:
    projection: list[str] | None  # None: all named variables
    modifier: str  # "", distinct, reduced, duplicates, count
    where: Group
    order: list[tuple[str, bool]] = field(default_factory=list)  # (variable or "count", descending)
    limit: int | None = None

    def columns(self) -> list[str]:
        return self.where.named() if self.projection is None else self.projection


@dataclass
class Update:
    kind: str  # insert or delete
    triples: list[tuple[str, str, str]]


_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\s]*>)
  | (?P<var>[?$][A-Za-z0-9_]+)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<blank>_:[A-Za-z0-9_][A-Za-z0-9_.-]*)
  | (?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<pname>(?:[A-Za-z][A-Za-z0-9_-]*)?:(?:[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)?)
  | (?P<word>[A-Za-z][A-Za-z0-9_]*)
  | (?P<op>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].,;=<>!+\-*/])
    """,
    re.X | re.S,
)
_UNESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "uU":
            return chr(int(e[1:], 16))
        if e not in _UNESCAPE:
            raise SparqlError(f"unknown escape \\{e}")
        return _UNESCAPE[e]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


#: Functions of FILTER by number of arguments (least, most).
FUNCTIONS = {"STR": (1, 1), "LANG": (1, 1), "LANGMATCHES": (2, 2), "DATATYPE": (1, 1), "BOUND": (1, 1), "SAMETERM": (2, 2), "ISIRI": (1, 1), "ISURI": (1, 1), "ISBLANK": (1, 1), "ISLITERAL": (1, 1), "REGEX": (2, 3), "IN": (1, 10_000)}


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens = tokens(text)
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.fresh = 0
        self.blanks: dict[str, Var] = {}

    # tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def is_op(self, *ops: str) -> bool:
        kind, text = self.peek()
        return kind == "op" and text in ops

    def op(self, *ops: str) -> str:
        if not self.is_op(*ops):
            raise SparqlError(f"expected {' or '.join(ops)}, found {self.peek()[1]!r}")
        return self.take()[1]

    def is_word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def word(self, *words: str) -> str:
        if not self.is_word(*words):
            raise SparqlError(f"expected {' or '.join(words)}, found {self.peek()[1]!r}")
        return self.take()[1].upper()

    # query forms
    def query(self) -> Select | Update:
        while self.is_word("PREFIX"):
            self.take()
            kind, name = self.take()
            if kind != "pname" or not name.endswith(":"):
                raise SparqlError(f"expected a prefix, found {name!r}")
            kind, target = self.take()
            if kind != "iri":
                raise SparqlError(f"expected an IRI, found {target!r}")
            if name[:-1] in self.prefixes:
                raise SparqlError(f"prefix {name} is declared twice")
            self.prefixes[name[:-1]] = target[1:-1]
        if self.is_word("INSERT", "DELETE"):
            kind = self.take()[1].lower()
            self.word("DATA")
            out: Select | Update = self.update(kind)
        else:
            out = self.select()
        if self.peek()[0] != "end":
            raise SparqlError(f"syntax error at {self.peek()[1]!r}")
        return out

    def select(self) -> Select:
        self.word("SELECT")
        modifier = self.take()[1].lower() if self.is_word("DISTINCT", "REDUCED", "COUNT", "DUPLICATES") else ""
        names: list[str] | None = []
        if self.is_op("*"):
            self.take()
            names = None
        else:
            while self.peek()[0] == "var" or self.is_op(","):
                kind, text = self.take()
                if kind == "var":
                    names.append(text[1:])
            if not names:
                raise SparqlError("no projection")
        if self.is_word("FROM"):
            raise SparqlError("FROM is not implemented")
        if self.is_word("WHERE"):
            self.take()
        where = self.group()
        order, limit = [], None
        if self.is_word("ORDER"):
            self.take()
            self.word("BY")
            order = self.order()
        if self.is_word("LIMIT"):
            self.take()
            kind, text = self.take()
            if kind != "num" or not text.isdigit() or int(text) < 1:
                raise SparqlError(f"LIMIT takes a positive number, found {text!r}")
            limit = int(text)
        query = Select(names, modifier, where, order, limit)
        for name, _ in order:
            if name == "count" and modifier != "count":
                raise SparqlError("ORDER BY count needs SELECT COUNT")
        return query

    def order(self) -> list[tuple[str, bool]]:
        out = []
        while True:
            down, wrapped = False, False
            if self.is_word("ASC", "DESC"):
                down, wrapped = self.take()[1].upper() == "DESC", True
                self.op("(")
            kind, text = self.peek()
            if kind == "var":
                out.append((text[1:], down))
            elif kind == "word" and text.lower() == "count":
                out.append(("count", down))
            elif wrapped or not out:
                raise SparqlError(f"cannot order by {text!r}")
            else:
                return out
            self.take()
            if wrapped:
                self.op(")")

    def update(self, kind: str) -> Update:
        self.op("{")
        group = Group()
        while not self.is_op("}"):
            self.triples(group)
        self.take()
        for p in group.patterns:
            if any(isinstance(x, Var) and not x.hidden for x in p.nodes()) or kind == "delete" and p.vars():
                raise SparqlError(f"no variables in {kind.upper()} DATA")
        term = lambda x: x.term if isinstance(x, Const) else f"_:{x.name}"
        return Update(kind, [(term(p.s), term(p.p), term(p.o)) for p in group.patterns])

    # groups
    def group(self) -> Group:
        self.op("{")
        out = Group()
        while not self.is_op("}"):
            if self.is_op("{"):
                branches = [self.group()]
                while self.is_word("UNION"):
                    self.take()
                    branches.append(self.group())
                if len(branches) > 1:
                    out.unions.append(branches)
                else:
                    out.merge(branches[0])
                self.dot()
            elif self.is_word("FILTER"):
                self.take()
                out.filters.append(self.constraint())
                self.dot()
            elif self.is_word("OPTIONAL"):
                self.take()
                out.optional(self.group())
                self.dot()
            else:
                self.triples(out)
        self.take()
        return out

    def dot(self) -> None:
        if self.is_op("."):
            self.take()

    def new_blank(self) -> Var:
        self.fresh += 1
        return Var(f"__b{self.fresh}", True)

    def triples(self, group: Group) -> None:
        """Subject with its predicate-object lists; the dot may be missing before a brace or FILTER."""
        anonymous = self.is_op("[")
        s = self.node(group)
        if not (anonymous and self.is_op(".", "}")):
            self.predicates(group, s)
        if self.is_op("."):
            self.take()
        elif not (self.is_op("}", "{") or self.is_word("FILTER", "OPTIONAL", "UNION")):
            raise SparqlError(f"expected '.', found {self.peek()[1]!r}")

    def predicates(self, group: Group, s: Node) -> None:
        while True:
            kind, text = self.peek()
            if kind == "word" and text == "a":
                self.take()
                p: Node = Const(TYPE)
            else:
                p = self.node(group, predicate=True)
            while True:
                group.patterns.append(Pattern(s, p, self.node(group)))
                if not self.is_op(","):
                    break
                self.take()
            if self.is_word("FILTER"):
                self.take()
                group.filters.append(self.constraint())
            if not self.is_op(";"):
                return
            while self.is_op(";"):
                self.take()
            if self.is_op(".", "}", "]"):
                return

    def node(self, group: Group, predicate: bool = False) -> Node:
        kind, text = self.peek()
        if kind == "var":
            self.take()
            return Var(text[1:])
        if kind in ("iri", "pname"):
            return Const(self.iri())
        if predicate:
            raise SparqlError(f"not a predicate: {text!r}")
        if kind == "blank":
            self.take()
            if text not in self.blanks:
                self.blanks[text] = self.new_blank()
            return self.blanks[text]
        if self.is_op("["):
            self.take()
            b = self.new_blank()
            if not self.is_op("]"):
                self.predicates(group, b)
            self.op("]")
            return b
        return Const(self.literal())

    def iri(self) -> str:
        kind, text = self.take()
        if kind == "iri":
            return text
        prefix, _, name = text.partition(":")
        if prefix not in self.prefixes:
            if prefix:
                raise SparqlError(f"unknown prefix {prefix}:")
            return iri(name)
        return iri(self.prefixes[prefix] + name)

    def literal(self) -> str:
        sign = self.take()[1] if self.is_op("+", "-") else ""
        kind, text = self.take()
        if kind == "num":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return literal(("-" if sign == "-" else "") + text, datatype=XSD + name)
        if kind == "word" and text.lower() in ("true", "false") and not sign:
            return literal(text.lower(), datatype=XSD + "boolean")
        if kind not in ("str", "long") or sign:
            raise SparqlError(f"invalid pattern element {text!r}")
        raw = unescape(text[3:-3] if kind == "long" else text[1:-1])
        if self.peek()[0] == "lang":
            return literal(raw, lang=self.take()[1][1:])
        if self.is_op("^^"):
            self.take()
            return literal(raw, datatype=self.iri()[1:-1])
        return literal(raw)

    # expressions
    def constraint(self) -> Expr:
        if self.is_op("("):
            self.take()
            e = self.expression()
            self.op(")")
            return e
        return self.primary()

    def chain(self, ops: tuple[str, ...], below) -> Expr:
        e = below()
        while self.is_op(*ops):
            e = Expr(self.take()[1], (e, below()))
        return e

    def expression(self) -> Expr:
        return self.chain(("||",), lambda: self.chain(("&&",), self.relation))

    def relation(self) -> Expr:
        e = self.sum()
        if self.is_op("=", "!=", "<", "<=", ">", ">="):
            return Expr(self.take()[1], (e, self.sum()))
        return e

    def sum(self) -> Expr:
        return self.chain(("+", "-"), lambda: self.chain(("*", "/"), self.unary))

    def unary(self) -> Expr:
        if self.is_op("!", "+", "-"):
            op = self.take()[1]
            return Expr({"!": "not", "+": "plus", "-": "minus"}[op], (self.unary(),))
        return self.primary()

    def arguments(self) -> tuple[Expr, ...]:
        self.op("(")
        args = []
        while not self.is_op(")"):
            args.append(self.expression())
            if not self.is_op(")"):
                self.op(",")
        self.take()
        return tuple(args)

    def primary(self) -> Expr:
        kind, text = self.peek()
        if self.is_op("("):
            self.take()
            e = self.expression()
            self.op(")")
            return e
        if kind == "var":
            self.take()
            return Expr("var", (text[1:],))
        if kind == "word" and text.upper() in FUNCTIONS:
            self.take()
            args = self.arguments()
            least, most = FUNCTIONS[text.upper()]
            if not least <= len(args) <= most:
                raise SparqlError(f"{text} takes {least} to {most} arguments")
            if text.upper() == "BOUND" and args[0].op != "var":
                raise SparqlError("BOUND takes a variable")
            return Expr(text.upper(), args)
        if kind in ("iri", "pname"):
            name = self.iri()
            return Expr("call", (name, *self.arguments())) if self.is_op("(") else Expr("const", (name,))
        if kind == "word" and text.lower() not in ("true", "false"):
            raise SparqlError(f"unknown function {text!r}")
        return Expr("const", (self.literal(),))


def parse(text: str) -> Select | Update:
    """The syntax tree of one query; SparqlError if it is none."""
    return _Parser(text).query()


END_OF_QUERY = "#EOQ#"


def split_queries(text: str) -> list[str]:
    """The queries of a file, each ended by a line that says so; the last one may lack it."""
    out, lines = [], []
    for line in [*text.splitlines(), END_OF_QUERY]:
        if line.strip() == END_OF_QUERY:
            if "".join(lines).strip():
                out.append("\n".join(lines))
            lines = []
        else:
            lines.append(line)
    return out
