"""RDF terms: identity, ids, value columns and canonical text of numbers.

A term is (kind, lex, dt, lang).  Its id is a 64-bit hash of those four, computed
by Spark, so that constants need no lookup, ids agree between loads and a term
that is not in the data matches nothing.  ``collisions`` finds ids that stand for
two terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IRI, BNODE, LITERAL = 1, 2, 3

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
TYPE = RDF + "type"
STRING, INTEGER, DECIMAL, DOUBLE, BOOLEAN, DATETIME = (XSD + x for x in ("string", "integer", "decimal", "double", "boolean", "dateTime"))
LANG_STRING = RDF + "langString"

#: The numeric datatypes of XML Schema that SPARQL names.
NUMERIC = tuple(
    XSD + x
    for x in (
        "integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "nonPositiveInteger",
        "negativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
    )
)


@dataclass(frozen=True)
class Term:
    kind: int
    lex: str
    dt: str = ""
    lang: str = ""

    def nt(self) -> str:
        if self.kind == IRI:
            return f"<{self.lex}>"
        if self.kind == BNODE:
            return f"_:{self.lex}"
        text = self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        if self.lang:
            return f'"{text}"@{self.lang}'
        return f'"{text}"' if self.dt in ("", STRING) else f'"{text}"^^<{self.dt}>'


def iri(lex: str) -> Term:
    return Term(IRI, lex)


def literal(lex: str, dt: str = STRING, lang: str = "") -> Term:
    return Term(LITERAL, lex, LANG_STRING if lang else dt, lang.lower())


def integer(n: int) -> Term:
    return literal(str(n), INTEGER)


#: The parts of a variable's term next to its id column, which bears the variable's name.
PARTS = ("k", "x", "d", "l")


def part(name: str, p: str) -> str:
    return f"{name}__{p}"


def columns(name: str) -> list[str]:
    """Of a variable: id, parts, and the numeric value as a double (n) and exactly (e), which a source may know without parsing the text."""
    return [name, *(part(name, p) for p in PARTS), part(name, "n"), part(name, "e")]


def id_of(k: Column, x: Column, d: Column, lang: Column) -> Column:
    return F.xxhash64(k.cast("int"), x, d, lang)


def id_lit(t: Term) -> Column:
    return id_of(F.lit(t.kind), F.lit(t.lex), F.lit(t.dt), F.lit(t.lang))


def constant(t: Term) -> dict[str, Column]:
    return {"k": F.lit(t.kind), "x": F.lit(t.lex), "d": F.lit(t.dt), "l": F.lit(t.lang)}


def number(x: Column, d: Column) -> Column:
    """The value of a numeric literal as a double, else null."""
    return F.when(d.isin(*NUMERIC), x.try_cast("double"))


#: Exact numbers: integers and decimals of at most 25 digits before and 12 after the point.  All others are doubles only.
EXACT = "decimal(37,12)"
INEXACT = (DOUBLE, XSD + "float")


def exact(x: Column, d: Column) -> Column:
    """The exact value of an integer or decimal literal, else null."""
    fits = d.isin(*[t for t in NUMERIC if t not in INEXACT]) & F.rlike(x, F.lit(r"^[+-]?[0-9]{0,25}(?:\.[0-9]{0,12})?$"))
    return F.when(fits, x.try_cast(EXACT))


def no_exact() -> Column:
    return F.lit(None).cast(EXACT)


def instant(x: Column, d: Column) -> Column:
    return F.when(d.isin(DATETIME, XSD + "date"), x.try_cast("timestamp"))


def truth(x: Column, d: Column) -> Column:
    return F.when(d == BOOLEAN, F.when(x.isin("true", "1"), True).when(x.isin("false", "0"), False))


def rank(k: Column, d: Column) -> Column:
    """numeric < dateTime < boolean < other."""
    return F.when(d.isin(*NUMERIC), 0).when(d.isin(DATETIME, XSD + "date"), 1).when(d == BOOLEAN, 2).otherwise(3)


def render(n: Column) -> Column:
    """Canonical text of a number: no fraction for whole ones, no trailing zeros, no exponent in the usual range."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e18)
    fixed = F.regexp_replace(F.format_string("%.12f", n), r"\.?0+$", "")
    small = (F.abs(n) >= 1e-6) & (F.abs(n) < 1e15)
    return F.when(n.isNull(), None).when(F.isnan(n), F.lit("NaN")).when(whole, n.cast("decimal(20,0)").cast("string")).when(small, fixed).otherwise(n.cast("string"))


def render_exact(e: Column) -> Column:
    return F.regexp_replace(F.replace(F.format_number(e, 12), F.lit(","), F.lit("")), r"\.?0+$", "")


QUAD = ["s", "s__k", "s__x", "p", "p__x", "o", "o__k", "o__x", "o__d", "o__l", "g", "inferred"]


def collisions(quads: DataFrame) -> DataFrame:
    """Ids that stand for more than one term."""
    terms = quads.select("s", "s__k", "s__x", F.lit(""), F.lit("")).toDF("id", "k", "x", "d", "l").union(
        quads.select("p", F.lit(IRI), "p__x", F.lit(""), F.lit(""))).union(quads.select("o", "o__k", "o__x", "o__d", "o__l"))
    return terms.distinct().groupBy("id").count().where("count > 1")
