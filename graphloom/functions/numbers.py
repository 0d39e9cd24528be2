"""Numbers with their types: arithmetic and comparison by promotion.

A number is one struct column: its rank (integer, decimal, float, double) and
its value in each of the forms that ranks compute in. Integers are exact to 38
digits; decimals to 17 digits before the point and 20 after it, beyond that as
doubles; floats are computed as doubles. A null rank is no number: an error.

Each operation names its operands once and uses them by that name, so an
expression grows with its text, not with a power of its depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T

INTEGER, DECIMAL, FLOAT, DOUBLE = 1, 2, 3, 4
_NAMES = {INTEGER: "integer", DECIMAL: "decimal", FLOAT: "float", DOUBLE: "double"}
_WHOLE, _EXACT = "decimal(38,0)", "decimal(37,20)"
#: Products and quotients of decimals of this size are exact (to 18 and 19 digits after the point).
_SHORT = "decimal(18,9)"
_PATTERN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _on(f: Callable[..., Column]) -> Callable[..., Column]:
    """An operation on one or two numbers, each computed once."""
    return lambda *x: let(F.struct(*[c.alias(n) for n, c in zip("ab", x, strict=False)]), lambda p: f(*[p[n] for n, _ in zip("ab", x, strict=False)]))


def _number(rank: Column, whole: Column, exact: Column, approx: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), whole.cast(_WHOLE).alias("whole"), exact.cast(_EXACT).alias("exact"), approx.cast("double").alias("approx"))


def none() -> Column:
    return _number(*[F.lit(None)] * 4)


def of_literal(term: str) -> Column:
    """The number that a constant term stands for."""
    m = re.fullmatch(rf'"({_PATTERN})"\^\^<{re.escape(T.XSD)}(\w+)>', term)
    if not m or m[2] not in T.NUMBERS or (m[2] in T.INTEGERS and not re.fullmatch(r"[+-]?[0-9]{1,38}", m[1])) or (m[2] == "decimal" and re.search("[eEN]", m[1])):
        return none()
    rank = INTEGER if m[2] in T.INTEGERS else {"decimal": DECIMAL, "float": FLOAT, "double": DOUBLE}[m[2]]
    text = F.lit(m[1])
    exact = text.try_cast(_EXACT) if rank <= DECIMAL and len(m[1].partition(".")[2].rstrip("0")) <= 20 else F.lit(None)
    return _number(F.lit(rank), text.try_cast(_WHOLE) if rank == INTEGER else F.lit(None), exact, F.lit(float(m[1].replace("INF", "inf"))))


def of_term(t: Column) -> Column:
    """The number that a literal of a numeric datatype stands for."""
    mark = f'"^^<{T.XSD}'
    kind = F.substring_index(t, mark, -1)
    body = F.substring(t, F.lit(2), F.length(t) - F.length(kind) - (len(mark) + 1))
    rank = F.when(kind.isin([f"{x}>" for x in T.INTEGERS]), INTEGER).when(kind == "decimal>", DECIMAL).when(kind == "float>", FLOAT).when(kind == "double>", DOUBLE)

    def parsed(p: Column) -> Column:
        fits = F.when(p["rank"].isNotNull() & p["body"].rlike(rf"^(?:{_PATTERN})$") & ((p["rank"] >= FLOAT) | ~p["body"].rlike("[eEN]")) & ((p["rank"] != INTEGER) | ~F.contains(p["body"], F.lit("."))), p["rank"])
        whole = F.when(fits == INTEGER, p["body"].try_cast(_WHOLE))
        # digits that don't fit are left out of the exact form, not rounded
        exact = F.when((fits == DECIMAL) & ~p["body"].rlike(r"\.[0-9]{20}[0-9]*[1-9]"), p["body"].try_cast(_EXACT)).when(fits == INTEGER, whole.try_cast(_EXACT))
        return _number(F.when((fits != INTEGER) | whole.isNotNull(), fits), whole, exact, F.when(fits.isNotNull(), F.replace(p["body"], F.lit("INF"), F.lit("Infinity")).try_cast("double")))

    return let(F.struct(rank.alias("rank"), body.alias("body")), parsed)


@_on
def literal(a: Column) -> Column:
    """The number as a term."""
    exact = F.regexp_replace(F.regexp_replace(a["exact"].cast("string"), r"(\.\d*[1-9])0+$", "$1"), r"\.0+$", "")
    approx = F.replace(a["approx"].cast("string"), F.lit("Infinity"), F.lit("INF"))
    name = F.element_at(F.array(*[F.lit(_NAMES[r]) for r in sorted(_NAMES)]), a["rank"])
    text = F.when(a["rank"] == INTEGER, a["whole"].cast("string")).when((a["rank"] == DECIMAL) & a["exact"].isNotNull(), exact).otherwise(approx)
    return F.when(a["rank"].isNotNull(), F.concat(F.lit('"'), text, F.lit(f'"^^<{T.XSD}'), name, F.lit(">")))


@_on
def truth(a: Column) -> Column:
    return F.when(a["rank"].isNotNull(), (a["approx"] != 0) & ~F.isnan(a["approx"]))


def _both(a: Column, b: Column) -> Column:
    """The rank that two numbers are computed in; null if either is none."""
    return F.when(a["rank"].isNotNull() & b["rank"].isNotNull(), F.greatest(a["rank"], b["rank"]))


def _made(rank: Column, whole: Column, exact: Column, approx: Column) -> Column:
    """A result. An integer beyond 38 digits is an error; a decimal beyond its digits goes on as a double."""

    def result(p: Column) -> Column:
        integer = p["rank"] == INTEGER
        exact = F.when(integer, p["whole"].try_cast(_EXACT)).when(p["rank"] == DECIMAL, p["exact"])
        approx = F.when(integer, p["whole"].cast("double")).otherwise(F.coalesce(exact.cast("double"), p["approx"]))
        return _number(F.when(~integer | p["whole"].isNotNull(), p["rank"]), F.when(integer, p["whole"]), exact, approx)

    return let(_number(rank, whole, exact, approx), result)


@_on
def add(a: Column, b: Column) -> Column:
    return _made(_both(a, b), F.try_add(a["whole"], b["whole"]).try_cast(_WHOLE), F.try_add(a["exact"], b["exact"]).try_cast(_EXACT), a["approx"] + b["approx"])


@_on
def subtract(a: Column, b: Column) -> Column:
    return _made(_both(a, b), F.try_subtract(a["whole"], b["whole"]).try_cast(_WHOLE), F.try_subtract(a["exact"], b["exact"]).try_cast(_EXACT), a["approx"] - b["approx"])


@_on
def multiply(a: Column, b: Column) -> Column:
    return _made(_both(a, b), F.try_multiply(a["whole"], b["whole"]).try_cast(_WHOLE), F.try_multiply(_short(a["exact"]), _short(b["exact"])).try_cast(_EXACT), a["approx"] * b["approx"])


@_on
def divide(a: Column, b: Column) -> Column:
    """Integers divide to a decimal; only floats and doubles divide by zero."""
    x, y = a["approx"], b["approx"]
    rank = F.greatest(_both(a, b), F.when(_both(a, b).isNotNull(), DECIMAL))
    units = lambda c: F.try_multiply(_short(c), F.lit(10**9).cast("decimal(10,0)")).try_cast("decimal(18,0)")
    approx = F.when(y != 0, F.try_divide(x, y)).when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
    return _made(F.when((rank >= FLOAT) | (y != 0), rank), F.lit(None), F.try_divide(units(a["exact"]), units(b["exact"])).try_cast(_EXACT), approx)


@_on
def negate(a: Column) -> Column:
    return _number(a["rank"], -a["whole"], -a["exact"], -a["approx"])


def _short(x: Column) -> Column:
    """x if it has nine digits at most on either side of the point, else null."""
    return F.when(x.try_cast(_SHORT) == x, x.try_cast(_SHORT))


def compare(f: Callable[[Column, Column], Column], unequal: bool, a: Column, b: Column) -> Column:
    """f by value; null unless both are numbers. NaN is unequal to everything, and neither less nor greater."""

    def compared(a: Column, b: Column) -> Column:
        rank = _both(a, b)
        nan = F.isnan(a["approx"]) | F.isnan(b["approx"])
        return (
            F.when(rank == INTEGER, f(a["whole"], b["whole"])).when((rank == DECIMAL) & a["exact"].isNotNull() & b["exact"].isNotNull(), f(a["exact"], b["exact"]))
            .when(rank.isNotNull(), F.when(nan, F.lit(unequal)).otherwise(f(a["approx"], b["approx"])))
        )

    return _on(compared)(a, b)
