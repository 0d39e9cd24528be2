"""RDF terms as strings.

A term is one string: ``<iri>``, ``_:label``, or ``"lexical"`` followed by
nothing, ``@lang`` or ``^^<datatype>``. The lexical form is kept unescaped, so
equal terms are equal strings and joins need one column. The functions below
take terms apart with built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE = f"<{RDF}type>"


def iri(text: str) -> str:
    return f"<{text}>"


def literal(lexical: str, lang: str | None = None, datatype: str | None = None) -> str:
    return f'"{lexical}"' + (f"@{lang.lower()}" if lang else f"^^<{datatype}>" if datatype and datatype != f"{XSD}string" else "")


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """The text between the brackets of an IRI or the outer quotes of a literal; a blank node as it is."""
    inner = F.regexp_extract(t, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^<>"]*>)?$', 1)
    return F.when(is_iri(t) | is_plain(t), F.substring(t, F.lit(2), F.length(t) - 2)).when(is_literal(t), inner).otherwise(t)


def lang(t: Column) -> Column:
    """The language tag of a literal, "" if it has none; null for other terms."""
    return F.when(is_literal(t), F.regexp_extract(t, r'"@([A-Za-z0-9-]+)$', 1))


def datatype(t: Column) -> Column:
    """The datatype of a literal as a term; null for other terms."""
    tagged = F.regexp_extract(t, r'"\^\^(<[^<>"]*>)$', 1)
    named = F.when(lang(t) != "", F.lit(f"<{RDF}langString>")).otherwise(F.lit(f"<{XSD}string>"))
    return F.when(is_literal(t), F.when(tagged != "", tagged).otherwise(named))


#: Datatypes of numbers: the integer ones, and all.
INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
NUMBERS = (*INTEGERS, "decimal", "double", "float")


def _typed(t: Column, pattern: str, names: tuple[str, ...]) -> Column:
    return F.regexp_extract(t, rf'^"({pattern})"\^\^<{XSD.replace(".", "[.]")}(?:{"|".join(names)})>$', 1)


def number(t: Column) -> Column:
    """The value of a literal whose datatype is one of numbers, as a double; else null."""
    return _typed(t, r"[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN", NUMBERS).try_cast("double")


def integer(t: Column) -> Column:
    """The value of a literal whose datatype is one of integers, exactly, if it has 38 digits at most; else null."""
    return _typed(t, r"[+-]?[0-9]+", INTEGERS).try_cast("decimal(38,0)")


def is_plain(t: Column) -> Column:
    """Whether it is a string without a tag; is_tagged: with a language."""
    return t.startswith('"') & t.endswith('"')


def is_tagged(t: Column) -> Column:
    return t.startswith('"') & ~t.endswith('"') & ~t.endswith(">")


def boolean(t: Column) -> Column:
    """The value of a boolean literal; else null."""
    of = lambda *texts: t.isin([f'"{x}"^^<{XSD}boolean>' for x in texts])
    return F.when(of("true", "1"), True).when(of("false", "0"), False)


def moment(t: Column, name: str) -> Column:
    """The value of a literal of datatype dateTime or date; else null."""
    end = f'"^^<{XSD}{name}>'
    body = F.substring(t, F.lit(2), F.length(t) - (len(end) + 1))
    pattern = r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}" + (r"T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?$" if name == "dateTime" else "$")
    return F.when(t.endswith(end) & body.rlike(pattern), body.try_cast("timestamp" if name == "dateTime" else "date"))


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escaped(t: Column) -> Column:
    """The term as N-Triples writes it."""
    text = lexical(t)
    for raw, written in _ESCAPES.items():
        text = F.replace(text, F.lit(raw), F.lit(written))
    tail = F.when(is_plain(t), "").when(lang(t) != "", F.concat(F.lit("@"), lang(t))).otherwise(F.regexp_extract(t, r'"(\^\^<[^<>"]*>)$', 1))
    return F.when(is_literal(t), F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(t)


def order_keys(t: Column) -> list[Column]:
    """SPARQL's order as sort keys: unbound, blank nodes, IRIs, literals; numbers by value, before other literals."""
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).when(number(t).isNotNull(), 3).otherwise(4)
    return [kind, number(t), integer(t), lexical(t), t]
