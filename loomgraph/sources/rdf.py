"""RDF text: N-Triples and N-Quads as splittable Spark reads, Turtle and TriG by a parser, and writing.

Lines of N-Triples and N-Quads are taken apart by one regular expression inside
the JVM, so a file of any size is read in parallel and never leaves Spark.  Turtle
and TriG need their prefixes, so each file is parsed as a whole by one task.
Blank nodes are told apart by a prefix for each load.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..plans.parser import ESCAPES, unescape, unquote


class RdfSyntaxError(ValueError):
    pass


# N-Triples and N-Quads

# Possessive throughout: Java's engine walks such loops without recursion, so a literal may have any length.
_ESCAPE = (
    r"u(?![Dd][89A-Fa-f])[0-9A-Fa-f]{4}|u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}"
    r"|U(?!0000[Dd][89A-Fa-f])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
)
_IRI = r"(?:[^<>\"{}|^`\\\x00-\x20]++|\\(?:" + _ESCAPE + r"))*+"
_LABEL = r"[^\x00-\x2c\x2e\x2f\x3b-\x40\x5b-\x5e\x60\x7b-\x7f]"
_BNODE = r"_:(" + _LABEL + r"++(?:\.++" + _LABEL + r"++)*+)"
_TEXT = r"\"[^\"\\\n\r]*+(?:\\(?:[tbnrf\"'\\]|" + _ESCAPE + r")[^\"\\\n\r]*+)*+"
#: Groups: subject IRI, subject node, predicate, <object IRI, object node, "text, datatype, language, graph.
LINE = (
    r"\A[ \t]*+(?:<(" + _IRI + r")>|" + _BNODE + r")[ \t]*+<(" + _IRI + r")>[ \t]*+"
    r"(?:(<" + _IRI + r")>|" + _BNODE + r"|(" + _TEXT + r")\"(?:\^\^<(" + _IRI + r")>|@([A-Za-z]++(?:-[A-Za-z0-9]++)*+))?+)"
    r"[ \t]*+(?:<(" + _IRI + r")>[ \t]*+)?+\.[ \t]*+(?:#[\s\S]*+)?+(?![\s\S])"
)
#: Only a literal's text may hold blanks, so it comes last and the others are cut off at blanks.
_FIELDS = "! $1 $2 $3 $4 $5 $7 $8 $9 $6"
_PIECES = r"(\\U[0-9A-Fa-f]{8}|(?:\\u[0-9A-Fa-f]{4})++|\\.|[^\\]++)"


def _unescaped(c: Column) -> Column:
    """A text with its escapes replaced; LINE has let none through that does not stand for a character."""

    def one(p: Column) -> Column:
        wide = F.decode(F.unhex(F.substring(p, 3, 8)), "UTF-32")
        run = F.decode(F.unhex(F.replace(p, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        named = F.translate(F.substring(p, 2, 1), "tbnrf", "\t\b\n\r\f")
        return F.when(F.startswith(p, F.lit("\\U")), wide).when(F.startswith(p, F.lit("\\u")), run).when(F.startswith(p, F.lit("\\")), named).otherwise(p)

    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(1))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def parse_lines(lines: DataFrame, prefix: str, lenient: bool = True, column: str = "value") -> DataFrame:
    """(s__k, s__x, p__x, o__k, o__x, o__d, o__l, graph) of lines; blank lines, comments and (if ``lenient``) broken lines are dropped.

    A line is taken apart by one replacement, which puts a mark before it, so a line that stays as it is is broken.
    """
    cut = lines.select(F.col(column).alias("line"), F.regexp_replace(F.col(column), LINE, _FIELDS).alias("cut"))
    if not lenient:
        row = cut.where((F.col("cut") == F.col("line")) & F.rlike("line", F.lit(r"\A[ \t]*+[^# \t]"))).select("line").first()
        if row:
            raise RdfSyntaxError(f"parse error: {row[0][:120]!r}")
    rows = cut.where(F.col("cut") != F.col("line")).select(F.split("cut", " ", 10).alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    node = lambda c: F.concat(F.lit(prefix), c)
    is_literal = f(9) != ""
    datatype = F.when(f(7) != "", T.LANG_STRING).when(f(6) != "", _unescaped(f(6))).otherwise(T.STRING)
    return rows.select(
        F.when(f(2) != "", T.BNODE).otherwise(T.IRI).alias("s__k"),
        F.when(f(2) != "", node(f(2))).otherwise(_unescaped(f(1))).alias("s__x"),
        _unescaped(f(3)).alias("p__x"),
        F.when(is_literal, T.LITERAL).when(f(5) != "", T.BNODE).otherwise(T.IRI).alias("o__k"),
        F.when(is_literal, _unescaped(F.substr(f(9), F.lit(2)))).when(f(5) != "", node(f(5))).otherwise(_unescaped(F.substr(f(4), F.lit(2)))).alias("o__x"),
        F.when(is_literal, datatype).otherwise("").alias("o__d"),
        F.when(is_literal, F.lower(f(7))).otherwise("").alias("o__l"),
        F.when(f(8) != "", _unescaped(f(8))).alias("graph"),
    )


def sniff(head: str) -> str:
    """``ntriples`` if up to 200 lines of the first 64 KiB all are plain statements, else ``turtle``."""
    lines = [x for x in head[: 64 << 10].splitlines()[:200] if x.strip() and not x.lstrip().startswith("#")]
    if len(head) >= 64 << 10 and len(lines) > 1:
        lines = lines[:-1]
    return "ntriples" if lines and all(re.match(LINE, x) for x in lines) else "turtle"


def line_digest(lines: DataFrame, column: str = "value") -> str:
    """A digest of a bag of lines: the sums of four 60-bit pieces of each line's sha256 and the number of lines, hashed."""
    h = F.sha2(F.col(column), 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    told = lines.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(":".join(str(int(x or 0)) for x in told).encode()).hexdigest()


def source_digest(spark: SparkSession, path: str, how: str = "auto") -> str:
    """See GraphStore.load."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.globStatus(where) or [])
    if how == "auto":
        how = "bytes" if len(found) == 1 and found[0].isFile() else "lines"
    if how == "lines":
        return line_digest(spark.read.text(path))
    if how != "bytes":
        raise ValueError(f"unknown digest {how!r}")
    each = []
    for status in found:
        stream = fs.open(status.getPath())
        try:
            each.append(spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream))
        finally:
            stream.close()
    return each[0] if len(each) == 1 else hashlib.sha256("".join(sorted(each)).encode()).hexdigest()


# Turtle and TriG

_TURTLE = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
  | (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<at>@(?:prefix|base)\b)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
  | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<punct>\^\^|<<|[{}()\[\].;,=])
""",
    re.X | re.S,
)


class Turtle:
    """Turtle, or TriG with ``graphs``: statements() gives (s, p, o, graph IRI or None)."""

    def __init__(self, text: str, base: str = "", graphs: bool = False, prefix: str = ""):
        if base and not re.match(r"[A-Za-z][\w+.\-]*:", base):
            raise RdfSyntaxError(f"invalid base IRI {base!r}")
        self.tokens, at = [], 0
        text = text.removeprefix("\ufeff")
        while at < len(text):
            m = _TURTLE.match(text, at)
            if not m:
                raise RdfSyntaxError(f"turtle parse error at {at}: {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i, self.base, self.graphs, self.prefix, self.names, self.count = 0, base, graphs, prefix, {}, 0
        self.out: list[tuple] = []
        self.graph: T.Term | None = None

    def fail(self, what: str):
        raise RdfSyntaxError(f"turtle parse error: expected {what}, found {self.tokens[self.i][1][:40]!r}")

    @property
    def kind(self):
        return self.tokens[self.i][0]

    @property
    def text(self):
        return self.tokens[self.i][1]

    def next(self):
        self.i += 1
        return self.tokens[self.i - 1][1]

    def need(self, text: str):
        if self.text != text:
            self.fail(text)
        self.next()

    def statements(self) -> list[tuple]:
        while self.kind != "end":
            word = self.text.lower().lstrip("@") if self.kind in ("at", "word") else ""
            if word in ("prefix", "base"):
                at = self.kind == "at"
                self.next()
                if word == "prefix":
                    name = self.next()
                    if not name.endswith(":"):
                        self.fail("a prefix")
                    self.names[name[:-1]] = self.iriref()
                else:
                    self.base = self.iriref()
                if at:
                    self.need(".")
            elif self.graphs and (word == "graph" or self.text == "{" or self.tokens[self.i + 1][1] == "{"):
                if word == "graph":
                    self.next()
                self.graph = None
                if self.text != "{":
                    if self.kind == "bnode" or self.text == "[":
                        raise RdfSyntaxError("parse_trig: blank node graph labels are not supported")
                    self.graph = T.iri(self.iri())
                self.need("{")
                while self.text != "}":
                    self.triples()
                    if self.text != "}":
                        self.need(".")
                self.next()
                self.graph = None
            else:
                self.triples()
                self.need(".")
        return self.out

    def triples(self):
        bracket = self.text == "["
        s = self.subject()
        if not (bracket and self.text in (".", "}")):
            self.predicates(s)

    def predicates(self, s):
        while True:
            if self.kind == "word" and self.text == "a":
                self.next()
                p = T.iri(T.TYPE)
            else:
                p = T.iri(self.iri())
            while True:
                self.out.append((s, p, self.object(), self.graph.lex if self.graph else None))
                if self.text != ",":
                    break
                self.next()
            if self.text != ";":
                return
            while self.text == ";":
                self.next()
            if self.text in (".", "]", "}"):
                return

    def fresh(self):
        self.count += 1
        return T.Term(T.BNODE, f"{self.prefix}g{self.count}")

    def subject(self):
        if self.kind in ("iri", "pname"):
            return T.iri(self.iri())
        return self.blank() or self.fail("a subject")

    def blank(self):
        if self.text == "<<":
            raise RdfSyntaxError("turtle parse error: quoted triples are not supported")
        if self.kind == "bnode":
            return T.Term(T.BNODE, self.prefix + "b" + self.next()[2:])
        if self.text == "[":
            self.next()
            me = self.fresh()
            if self.text != "]":
                self.predicates(me)
            self.need("]")
            return me
        if self.text == "(" and self.kind == "punct":
            self.next()
            items = []
            while self.text != ")":
                items.append(self.object())
            self.next()
            head = T.iri(T.RDF + "nil")
            g = self.graph.lex if self.graph else None
            for x in reversed(items):
                cell = self.fresh()
                self.out += [(cell, T.iri(T.RDF + "first"), x, g), (cell, T.iri(T.RDF + "rest"), head, g)]
                head = cell
            return head
        return None

    def object(self):
        if self.kind in ("iri", "pname"):
            return T.iri(self.iri())
        found = self.blank()
        if found:
            return found
        if self.kind == "string":
            value = unquote(self.next())
            if self.kind == "lang":
                return T.literal(value, lang=self.next()[1:])
            if self.text == "^^":
                self.next()
                return T.literal(value, self.iri())
            return T.literal(value)
        if self.kind == "number":
            x = self.next()
            return T.literal(x, T.DOUBLE if re.search("[eE]", x) else T.DECIMAL if "." in x else T.INTEGER)
        if self.kind == "word" and self.text in ("true", "false"):
            return T.literal(self.next(), T.BOOLEAN)
        self.fail("an object")

    def iriref(self):
        if self.kind != "iri":
            self.fail("an IRI")
        x = unescape(self.next()[1:-1])
        return urljoin(self.base, x) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", x) else x

    def iri(self):
        if self.kind == "iri":
            return self.iriref()
        if self.kind == "pname":
            prefix, local = self.next().split(":", 1)
            if prefix not in self.names:
                raise RdfSyntaxError(f"turtle parse error: unknown prefix {prefix!r}")
            return self.names[prefix] + re.sub(r"\\(.)", r"\1", local)
        self.fail("an IRI")


def parse_turtle(text: str, base: str = "", prefix: str = "") -> list[tuple]:
    return Turtle(text, base, False, prefix).statements()


def parse_trig(text: str, base: str = "", prefix: str = "") -> list[tuple]:
    return Turtle(text, base, True, prefix).statements()


def read_turtle_files(spark: SparkSession, path: str, prefix: str, base: str = "", graphs: bool = False) -> DataFrame:
    """Rows like those of parse_lines from Turtle or TriG files, each parsed whole by one task."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                own = prefix + hashlib.md5(name.encode()).hexdigest()[:8] + "."
                rows = Turtle(bytes(content).decode("utf-8"), base, graphs, own).statements()
                yield pd.DataFrame(
                    [(s.kind, s.lex, p.lex, o.kind, o.lex, o.dt, o.lang, g) for s, p, o, g in rows],
                    columns=["s__k", "s__x", "p__x", "o__k", "o__x", "o__d", "o__l", "graph"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "s__k int, s__x string, p__x string, o__k int, o__x string, o__d string, o__l string, graph string")


# writing


def nt_term(k: Column, x: Column, d: Column, lang: Column) -> Column:
    text = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return (
        F.when(k == T.IRI, F.concat(F.lit("<"), x, F.lit(">")))
        .when(k == T.BNODE, F.concat(F.lit("_:"), x))
        .when(lang != "", F.concat(quoted, F.lit("@"), lang))
        .when(d.isin(T.STRING, ""), quoted)
        .otherwise(F.concat(quoted, F.lit("^^<"), d, F.lit(">")))
    )


def nt_lines(quads: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """One N-Triples line for each quad; N-Quads lines with the IRIs of named graphs if ``graphs`` is given."""
    none = F.lit("")
    s = nt_term(F.col("s__k"), F.col("s__x"), none, none)
    o = nt_term(F.col("o__k"), F.col("o__x"), F.col("o__d"), F.col("o__l"))
    line = [s, F.concat(F.lit("<"), F.col("p__x"), F.lit(">")), o]
    if graphs is not None:
        quads = quads.join(graphs.select(F.col("graph_id").alias("g"), "iri"), "g", "left")
        line.append(F.when(F.col("g") != 0, F.concat(F.lit("<"), F.col("iri"), F.lit(">"))))
    return quads.select(F.concat_ws(" ", *line, F.lit(".")).alias("value"))


__all__ = ["ESCAPES", "RdfSyntaxError", "Turtle", "line_digest", "nt_lines", "parse_lines", "parse_trig", "parse_turtle", "read_turtle_files", "sniff", "source_digest"]
