"""A recursive-descent parser of SPARQL 1.1 query and update."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF, STRING, TYPE, Term, iri, literal
from .algebra import (
    Aggregate, Alternative, Bgp, Call, Exists, Extend, Filter, Graph, Inverse, Join, LeftJoin, Link, Minus, NotIn, Query, Repeat,
    Select, Sequence, SparqlError, Triple, Union, UpdateOp, Values, Var,
)

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<pname>(?:[A-Za-z][\w.\-]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<punct>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].;,*/|^!=<>+\-?])
""",
    re.X | re.S,
)

ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unquote(raw: str) -> str:
    """The value of a quoted string, or of a text with \\u escapes."""
    n = 3 if raw[:3] in ('"""', "'''") and len(raw) >= 6 else 1
    return unescape(raw[n:-n])


def unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m):
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 16))
        if m[3] not in ESCAPES:
            raise SparqlError(f"parse error: unknown escape \\{m[3]}")
        return ESCAPES[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


#: The aggregates of SPARQL 1.1, and one by a sketch of fixed size.
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT", "APPROX_COUNT_DISTINCT"}
#: The builtin calls of SPARQL 1.1, by their names.
BUILTINS = {
    "STR", "LANG", "LANGMATCHES", "DATATYPE", "BOUND", "IRI", "URI", "BNODE", "RAND", "ABS", "CEIL", "FLOOR", "ROUND", "CONCAT",
    "STRLEN", "UCASE", "LCASE", "ENCODE_FOR_URI", "CONTAINS", "STRSTARTS", "STRENDS", "STRBEFORE", "STRAFTER", "YEAR", "MONTH",
    "DAY", "HOURS", "MINUTES", "SECONDS", "TIMEZONE", "TZ", "NOW", "UUID", "STRUUID", "MD5", "SHA1", "SHA256", "SHA384", "SHA512",
    "COALESCE", "IF", "STRLANG", "STRDT", "SAMETERM", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC", "REGEX", "SUBSTR",
    "REPLACE",
}


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"parse error: unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i, self.prefixes, self.base, self.fresh = 0, {}, "", 0

    # tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def text(self) -> str:
        return self.tokens[self.i][1]

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def fail(self, what: str):
        raise SparqlError(f"parse error: expected {what}, found {self.text!r}")

    def at(self, *words: str) -> bool:
        return self.kind in ("word", "punct") and self.text.upper() in words

    def take(self, *words: str) -> str | None:
        return self.next().upper() if self.at(*words) else None

    def need(self, *words: str) -> str:
        return self.take(*words) or self.fail(" or ".join(words))

    def new_var(self) -> Var:
        self.fresh += 1
        return Var(f"_anon{self.fresh}")

    # prologue and terms

    def prologue(self):
        while w := self.take("PREFIX", "BASE"):
            if w == "PREFIX":
                name = self.next()
                self.prefixes[name[:-1]] = self.iriref()
            else:
                self.base = self.iriref()

    def iriref(self) -> str:
        if self.kind != "iri":
            self.fail("an IRI")
        text = unescape(self.next()[1:-1])
        return urljoin(self.base, text) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", text) else text

    def iri(self) -> str:
        if self.kind == "iri":
            return self.iriref()
        if self.kind == "pname":
            prefix, local = self.next().split(":", 1)
            if prefix not in self.prefixes:
                raise SparqlError(f"parse error: unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        self.fail("an IRI")

    def literal(self) -> Term:
        sign = self.next() if self.at("+", "-") else ""
        if self.kind == "number":
            text = self.next()
            return literal(sign.replace("+", "") + text, DOUBLE if re.search("[eE]", text) else DECIMAL if "." in text else INTEGER)
        if self.kind == "string":
            value = unquote(self.next())
            if self.kind == "lang":
                return literal(value, lang=self.next()[1:])
            if self.at("^^"):
                self.next()
                return literal(value, self.iri())
            return literal(value, STRING)
        if w := self.take("TRUE", "FALSE"):
            return literal(w.lower(), BOOLEAN)
        self.fail("a literal")

    def term(self):
        """A variable or an RDF term."""
        if self.kind == "var":
            return Var(self.next()[1:])
        if self.kind in ("iri", "pname"):
            return iri(self.iri())
        if self.kind == "bnode":
            return Var("_b_" + re.sub(r"\W", "_", self.next()[2:]))
        return self.literal()

    # triples

    def node(self, out: list):
        """A term, or a blank node or list whose triples go to out."""
        if self.at("["):
            self.next()
            me = self.new_var()
            if not self.at("]"):
                self.property_list(me, out)
            self.need("]")
            return me
        if self.at("("):
            self.next()
            items = []
            while not self.at(")"):
                items.append(self.node(out))
            self.next()
            head = iri(RDF + "nil")
            for x in reversed(items):
                cell = self.new_var()
                out += [Triple(cell, iri(RDF + "first"), x), Triple(cell, iri(RDF + "rest"), head)]
                head = cell
            return head
        return self.term()

    def property_list(self, s, out: list):
        while True:
            p = self.verb()
            while True:
                out.append(Triple(s, p, self.node(out)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.at(".", "]", "}", ")") or self.kind == "end":
                return

    def verb(self):
        if self.kind == "var":
            return Var(self.next()[1:])
        p = self.path()
        return iri(p.iri) if isinstance(p, Link) else p

    def path(self):
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Alternative(tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.take("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Sequence(tuple(parts))

    def path_step(self):
        if self.take("^"):
            return Inverse(self.path_step())
        if self.take("!"):
            forward, backward = [], []
            many = self.take("(")
            while not self.at(")"):
                (backward if self.take("^") else forward).append(self.path_iri())
                if not (many and self.take("|")):
                    break
            if many:
                self.need(")")
            p = NotIn(tuple(forward), tuple(backward))
        elif self.take("("):
            p = self.path()
            self.need(")")
        else:
            p = Link(self.path_iri())
        while w := self.take("*", "+", "?"):
            p = Repeat(p, 1 if w == "+" else 0, w != "?")
        return p

    def path_iri(self) -> str:
        if self.kind == "word" and self.text == "a":
            self.next()
            return TYPE
        return self.iri()

    def triples(self, out: list):
        """Triples up to the end of the block."""
        while self.kind in ("var", "iri", "pname", "bnode", "number", "string") or self.at("[", "(", "TRUE", "FALSE", "+", "-"):
            bracket = self.at("[")
            s = self.node(out)
            if not (bracket and self.at(".", "}")):
                self.property_list(s, out)
            if not self.take("."):
                return

    # patterns

    def group(self):
        self.need("{")
        if self.at("SELECT"):
            p = self.select()
            self.need("}")
            return p
        p, filters = Bgp(()), []
        while not self.at("}"):
            if self.take("."):
                continue
            if self.take("OPTIONAL"):
                right = self.group()
                if isinstance(right, Filter):
                    p = LeftJoin(p, right.pattern, right.condition)
                else:
                    p = LeftJoin(p, right)
            elif self.take("MINUS"):
                p = Minus(p, self.group())
            elif self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("BIND"):
                self.need("(")
                value = self.expression()
                self.need("AS")
                p = Extend(p, self.var(), value)
                self.need(")")
            elif self.at("VALUES"):
                p = join(p, self.values())
            elif self.take("GRAPH"):
                name = self.term()
                p = join(p, Graph(name, self.group()))
            elif self.at("SERVICE"):
                raise SparqlError("SERVICE is not supported")
            elif self.at("{"):
                q = self.group()
                while self.take("UNION"):
                    q = Union(q, self.group())
                p = join(p, q)
            else:
                out: list[Triple] = []
                before = self.i
                self.triples(out)
                if self.i == before:
                    self.fail("a pattern")
                p = Bgp(p.triples + tuple(out)) if isinstance(p, Bgp) else join(p, Bgp(tuple(out)))
        self.need("}")
        for f in filters:
            p = Filter(p, f if not isinstance(p, Filter) else f)
        return p

    def var(self) -> str:
        if self.kind != "var":
            self.fail("a variable")
        return self.next()[1:]

    def values(self) -> Values:
        self.need("VALUES")
        one = self.kind == "var"
        names = []
        if one:
            names.append(self.var())
        else:
            self.need("(")
            while not self.at(")"):
                names.append(self.var())
            self.next()
        self.need("{")
        rows = []
        while not self.at("}"):
            if one:
                rows.append((self.value(),))
            else:
                self.need("(")
                row = []
                while not self.at(")"):
                    row.append(self.value())
                self.next()
                if len(row) != len(names):
                    raise SparqlError("parse error: VALUES row of another length than its variables")
                rows.append(tuple(row))
        self.next()
        return Values(tuple(names), tuple(rows))

    def value(self):
        return None if self.take("UNDEF") else self.term()

    # expressions

    def constraint(self):
        if self.at("("):
            self.next()
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        e = self.conjunction()
        while self.take("||"):
            e = Call("||", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.relation()
        while self.take("&&"):
            e = Call("&&", (e, self.relation()))
        return e

    def relation(self):
        e = self.sum()
        if w := self.take("=", "!=", "<", ">", "<=", ">="):
            return Call(w, (e, self.sum()))
        negative = bool(self.take("NOT"))
        if self.take("IN"):
            found = Call("IN", (e, *self.arguments()))
            return Call("!", (found,)) if negative else found
        if negative:
            self.fail("IN")
        return e

    def sum(self):
        e = self.product()
        while w := self.take("+", "-"):
            e = Call(w, (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while w := self.take("*", "/"):
            e = Call(w, (e, self.unary()))
        return e

    def unary(self):
        if self.take("!"):
            return Call("!", (self.unary(),))
        if self.take("-"):
            return Call("neg", (self.unary(),))
        self.take("+")
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        while not self.at(")"):
            out.append(self.expression())
            if not self.take(","):
                break
        self.need(")")
        return tuple(out)

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind == "word":
            word = self.text.upper()
            if word == "NOT":
                self.next()
                self.need("EXISTS")
                return Exists(self.group(), False)
            if word == "EXISTS":
                self.next()
                return Exists(self.group(), True)
            if word in AGGREGATES:
                return self.aggregate()
            if word in BUILTINS:
                self.next()
                return Call(word, self.arguments())
        if self.kind == "var":
            return Var(self.next()[1:])
        if self.kind in ("iri", "pname"):
            name = self.iri()
            return Call(name, self.arguments()) if self.at("(") else iri(name)
        if self.kind == "word" and self.text.upper() not in ("TRUE", "FALSE"):
            raise SparqlError(f"parse error: unknown function {self.text!r}")
        return self.literal()

    def aggregate(self) -> Aggregate:
        name = self.next().upper()
        self.need("(")
        distinct = bool(self.take("DISTINCT"))
        arg = None if name == "COUNT" and self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = unquote(self.next())
        self.need(")")
        return Aggregate(name, arg, distinct, separator)

    # queries

    def select(self) -> Select:
        self.need("SELECT")
        distinct = bool(self.take("DISTINCT", "REDUCED"))
        items, star = [], bool(self.take("*"))
        while not star and (self.kind == "var" or self.at("(")):
            if self.take("("):
                e = self.expression()
                self.need("AS")
                items.append((self.var(), e))
                self.need(")")
            else:
                items.append((self.var(), None))
        if not star and not items:
            self.fail("a projection")
        self.dataset()
        self.take("WHERE")
        return self.modifiers(self.group(), tuple(items), star, distinct)

    def dataset(self):
        self.default, self.named = [], []
        while self.take("FROM"):
            (self.named if self.take("NAMED") else self.default).append(self.iri())

    def modifiers(self, pattern, items=(), star=False, distinct=False) -> Select:
        group, having, order, limit, offset = None, [], [], None, 0
        if self.take("GROUP"):
            self.need("BY")
            keys = []
            while self.kind == "var" or self.at("(") or (self.kind == "word" and self.text.upper() in BUILTINS) or self.kind in ("iri", "pname"):
                if self.kind == "var":
                    keys.append((self.var(), None))
                elif self.take("("):
                    e = self.expression()
                    name = self.var() if self.take("AS") else self.new_var().name
                    self.need(")")
                    keys.append((name, e))
                else:
                    keys.append((self.new_var().name, self.primary()))
            group = tuple(keys)
        if self.take("HAVING"):
            while self.at("(") or self.kind == "word" and (self.text.upper() in BUILTINS | AGGREGATES):
                having.append(self.constraint())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if w := self.take("ASC", "DESC"):
                    self.need("(")
                    e = self.expression()
                    self.need(")")
                    order.append((e, w == "ASC"))
                elif self.kind == "var":
                    order.append((Var(self.var()), True))
                elif self.at("(") or self.kind == "word" and self.text.upper() in BUILTINS | AGGREGATES or self.kind in ("iri", "pname"):
                    order.append((self.constraint(), True))
                else:
                    break
            if not order:
                self.fail("an order key")
        while w := self.take("LIMIT", "OFFSET"):
            if self.kind != "number":
                self.fail("a number")
            n = int(self.next())
            limit, offset = (n, offset) if w == "LIMIT" else (limit, n)
        if self.at("VALUES"):
            pattern = join(pattern, self.values())
        return Select(pattern, items, star, distinct, group, tuple(having), tuple(order), limit, offset)

    def query(self) -> Query:
        self.prologue()
        if self.at("SELECT"):
            s = self.select()
            q = Query("SELECT", s, dataset=tuple(self.default), named=tuple(self.named))
        elif self.take("ASK"):
            self.dataset()
            self.take("WHERE")
            q = Query("ASK", self.modifiers(self.group(), star=True), dataset=tuple(self.default), named=tuple(self.named))
        elif self.take("CONSTRUCT"):
            if self.at("{"):
                template = self.template()
                self.dataset()
                self.take("WHERE")
                q = Query("CONSTRUCT", self.modifiers(self.group(), star=True), template, dataset=tuple(self.default), named=tuple(self.named))
            else:
                self.dataset()
                self.need("WHERE")
                pattern = self.group()
                if not isinstance(pattern, Bgp):
                    raise SparqlError("CONSTRUCT WHERE takes a plain basic graph pattern")
                if any(isinstance(x, Var) and x.name.startswith("_") for t in pattern.triples for x in (t.s, t.o)):
                    raise SparqlError("CONSTRUCT WHERE takes no blank nodes")
                q = Query("CONSTRUCT", self.modifiers(pattern, star=True), pattern.triples, shorthand=True)
        elif self.take("DESCRIBE"):
            resources, star = [], bool(self.take("*"))
            while self.kind in ("var", "iri", "pname"):
                resources.append(self.term())
            self.dataset()
            pattern = Bgp(())
            if self.take("WHERE") or self.at("{"):
                pattern = self.group()
            s = self.modifiers(pattern, star=True)
            q = Query("DESCRIBE", s, resources=tuple(resources) if not star else ("*",))
        else:
            self.fail("SELECT, ASK, CONSTRUCT or DESCRIBE")
        if self.kind != "end":
            self.fail("the end of the query")
        return q

    def template(self) -> tuple:
        self.need("{")
        out: list[Triple] = []
        self.triples(out)
        self.need("}")
        return tuple(out)

    # updates

    def quads(self) -> tuple:
        """(triple, graph or None) of a quad template."""
        self.need("{")
        out = []
        while not self.at("}"):
            if self.take("GRAPH"):
                g = self.term()
                out += [(t, g) for t in self.template()]
                self.take(".")
            else:
                some: list[Triple] = []
                before = self.i
                self.triples(some)
                if self.i == before:
                    self.fail("a triple")
                out += [(t, None) for t in some]
        self.next()
        return tuple(out)

    def graph_ref(self, words=("DEFAULT", "NAMED", "ALL")) -> str:
        if w := self.take(*words):
            return w
        self.need("GRAPH") if self.at("GRAPH") else None
        return "<" + self.iri()

    def update(self) -> list[UpdateOp]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out.append(self.update_one())
            if not self.take(";") and self.kind != "end":
                self.fail("; or the end of the update")

    def update_one(self) -> UpdateOp:
        if self.take("LOAD"):
            raise SparqlError("LOAD is not supported")
        if w := self.take("CLEAR", "DROP", "CREATE"):
            silent = bool(self.take("SILENT"))
            return UpdateOp(w, target=self.graph_ref(), silent=silent)
        if w := self.take("ADD", "MOVE", "COPY"):
            silent = bool(self.take("SILENT"))
            source = self.graph_ref(("DEFAULT",))
            self.need("TO")
            return UpdateOp(w, source=source, target=self.graph_ref(("DEFAULT",)), silent=silent)
        graph = self.iri() if self.take("WITH") else None
        if self.take("INSERT"):
            if self.take("DATA"):
                return UpdateOp("INSERT DATA", insert=self.quads())
            insert, delete = self.quads(), ()
        else:
            self.need("DELETE")
            if self.take("DATA"):
                return UpdateOp("DELETE DATA", delete=self.quads())
            if self.take("WHERE"):
                found = self.quads()
                p = Bgp(())
                for t, g in found:
                    p = join(p, Bgp((t,)) if g is None else Graph(g, Bgp((t,))))
                return UpdateOp("DELETE WHERE", delete=found, pattern=p)
            delete = self.quads()
            insert = self.quads() if self.take("INSERT") else ()
        if self.at("USING"):
            raise SparqlError("USING is not supported")
        self.need("WHERE")
        kind = "DELETE/INSERT WHERE" if delete and insert else "DELETE WHERE" if delete else "INSERT WHERE"
        return UpdateOp(kind, delete, insert, self.group(), graph)


def join(a, b):
    if isinstance(a, Bgp) and not a.triples:
        return b
    if isinstance(a, Bgp) and isinstance(b, Bgp):
        return Bgp(a.triples + b.triples)
    return Join(a, b)


def parse_query(text: str) -> Query:
    return Parser(text).query()


def parse_update(text: str) -> list[UpdateOp]:
    return Parser(text).update()
