"""FILTER expressions as columns.

A compiled expression is a term (string column), a typed number (functions.numbers)
or a truth value (boolean). SPARQL's type errors are nulls: `where` drops them, and && and
|| of SQL's three-valued logic treat them as SPARQL treats errors.

Numbers, booleans, strings without a tag, dates and times compare by value with
their own kind, and are unequal to other kinds. Literals of a datatype that isn't
known, or that are no values of theirs, are equal if they are the same term, and else neither equal
nor unequal: an error, as is any order of different kinds, tagged strings, IRIs and blank nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.syntax import Expr, SparqlError
from . import numbers as N
from . import terms as T


@dataclass(eq=False)
class Value:
    kind: str  # term, number, bool
    col: Column
    #: the text of a constant
    const: str | None = None
    #: a column as it is
    read: bool = False

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "number":
            return N.literal(self.col)
        return F.concat(F.lit('"'), self.col.cast("string"), F.lit(f'"^^<{T.XSD}boolean>'))

    def number(self) -> Column:
        if self.kind == "number":
            return self.col
        if self.kind != "term":
            return N.none()
        return N.of_term(self.col) if self.const is None else N.of_literal(self.const)

    def boolean(self) -> Column:
        """The value of a boolean; null for anything else."""
        if self.kind == "bool":
            return self.col
        return T.boolean(self.col) if self.kind == "term" else F.lit(None).cast("boolean")

    def known(self) -> Column:
        """Whether it is a literal whose value is known."""
        if self.kind != "term":
            return F.lit(True)
        value = self.number()["rank"].isNotNull() | self.boolean().isNotNull() | T.moment(self.col, "dateTime").isNotNull() | T.moment(self.col, "date").isNotNull()
        return T.is_plain(self.col) | T.is_tagged(self.col) | value

    def truth(self) -> Column:
        """The effective boolean value; null is an error."""
        if self.kind == "bool":
            return self.col
        if self.kind == "number":
            return N.truth(self.col)
        text, kind = T.lexical(self.col), T.datatype(self.col)
        return (
            F.when(kind == f"<{T.XSD}boolean>", F.coalesce(T.boolean(self.col), F.lit(False)))
            .when(kind == f"<{T.XSD}string>", text != "")
            .when(kind.isin([f"<{T.XSD}{x}>" for x in T.NUMBERS]), F.coalesce(N.truth(self.number()), F.lit(False)))
        )

    def text(self) -> Column:
        return T.lexical(self.term())


Registry = dict[str, Callable[..., Column]]


def _compare(op: str, a: Value, b: Value) -> Column:
    """Terms that are computed, not read, are computed once."""
    made = [x for x in (a, b) if x.kind == "term" and x.const is None and not x.read]
    if not made:
        return _compared(op, a, b)
    bound = lambda p: [replace(x, col=p[n], read=True) if x in made else x for n, x in (("a", a), ("b", b))]
    return N.let(F.struct(*[x.col.alias(n) for n, x in (("a", a), ("b", b)) if x in made]), lambda p: _compared(op, *bound(p)))


def _compared(op: str, a: Value, b: Value) -> Column:
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    f, found = ops[op], F.lit(None).cast("boolean")
    if "bool" not in (a.kind, b.kind):
        found = N.compare(f, op == "!=", a.number(), b.number())
    if "number" not in (a.kind, b.kind):
        x, y = a.boolean(), b.boolean()
        found = F.coalesce(found, F.when(x.isNotNull() & y.isNotNull(), f(x, y)))
    if a.kind == b.kind == "term":
        plain = T.is_plain(a.col) & T.is_plain(b.col)
        found = F.coalesce(found, F.when(plain, f(a.text(), b.text())))
        for name in ("dateTime", "date"):
            x, y = T.moment(a.col, name), T.moment(b.col, name)
            found = F.coalesce(found, F.when(x.isNotNull() & y.isNotNull(), f(x, y)))
    if op in ("=", "!="):
        same = a.term() == b.term()
        found = F.coalesce(found, F.when(same | (a.known() & b.known()) | ~(T.is_literal(a.term()) & T.is_literal(b.term())), same if op == "=" else ~same))
    return found


def _cast(name: str) -> Callable[[Column], Column]:
    kinds = {"integer": "bigint", "int": "int", "long": "bigint", "decimal": "decimal(38,10)", "double": "double", "float": "float", "boolean": "boolean", "string": "string"}
    return lambda t: T.lexical(t).try_cast(kinds[name]).cast("string")


#: Functions that an IRI names: term column in, lexical form out.
CASTS = {f"<{T.XSD}{x}>": _cast(x) for x in ("integer", "int", "long", "decimal", "double", "float", "boolean", "string")}


def compile_filter(e: Expr, column: Callable[[str], Column | None], registry: Registry | None = None) -> Column:
    """A truth column for e; column gives a variable's term, None if no pattern binds it."""
    return _compile(e, column, registry or {}).truth()


def _compile(e: Expr, column: Callable[[str], Column | None], registry: Registry) -> Value:
    sub = lambda x: _compile(x, column, registry)
    if e.op == "var":
        c = column(e.args[0])
        return Value("term", F.lit(None).cast("string") if c is None else c, read=True)
    if e.op == "const":
        return Value("term", F.lit(e.args[0]), const=e.args[0])
    if e.op == "call":
        name, *args = e.args
        values = [sub(x).term() for x in args]
        if name in registry:
            return Value("term", registry[name](*values))
        if name in CASTS and len(values) == 1:
            done = CASTS[name](values[0])
            return Value("term", F.when(done.isNotNull(), F.concat(F.lit('"'), done, F.lit('"' if name == f"<{T.XSD}string>" else f'"^^{name}'))))
        raise SparqlError(f"unknown function {name}")
    args = [sub(x) for x in e.args]
    match e.op:
        case "||":
            return Value("bool", args[0].truth() | args[1].truth())
        case "&&":
            return Value("bool", args[0].truth() & args[1].truth())
        case "not":
            return Value("bool", ~args[0].truth())
        case "=" | "!=" | "<" | "<=" | ">" | ">=":
            return Value("bool", _compare(e.op, *args))
        case "+" | "-" | "*" | "/":
            f = {"+": N.add, "-": N.subtract, "*": N.multiply, "/": N.divide}[e.op]
            return Value("number", f(args[0].number(), args[1].number()))
        case "plus":
            return Value("number", args[0].number())
        case "minus":
            return Value("number", N.negate(args[0].number()))
        case "STR":
            return Value("term", F.concat(F.lit('"'), args[0].text(), F.lit('"')))
        case "LANG":
            return Value("term", F.concat(F.lit('"'), T.lang(args[0].term()), F.lit('"')))
        case "LANGMATCHES":
            tag, wanted = F.lower(args[0].text()), F.lower(args[1].text())
            return Value("bool", F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))
        case "DATATYPE":
            return Value("term", T.datatype(args[0].term()))
        case "BOUND":
            return Value("bool", args[0].term().isNotNull())
        case "SAMETERM":
            return Value("bool", args[0].term() == args[1].term())
        case "ISIRI" | "ISURI":
            return Value("bool", T.is_iri(args[0].term()))
        case "ISBLANK":
            return Value("bool", T.is_blank(args[0].term()))
        case "ISLITERAL":
            return Value("bool", T.is_literal(args[0].term()))
        case "REGEX":
            flags = args[2].text() if len(args) > 2 else F.lit("")
            pattern = F.concat(F.when(flags != "", F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(""), args[1].text())
            return Value("bool", F.when(T.is_literal(args[0].term()), F.regexp_like(args[0].text(), pattern)))
        case "IN":
            out = F.lit(False)
            for other in args[1:]:
                out = out | _compare("=", args[0], other)
            return Value("bool", out)
    raise SparqlError(f"unknown expression {e.op}")
