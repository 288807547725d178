"""SPARQL expressions as Spark columns.

A value is four columns (kind, lex, datatype, language) and, where it is known, a
number or a truth value.  An error is null, which is SPARQL's error -> unbound.
Nothing here leaves the JVM.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..plans.algebra import Aggregate, Call, Exists, SparqlError, Unsupported, Var

MATH = "http://www.w3.org/2005/xpath-functions/math#"
DATE_FIELDS = r"^\s*(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(?:Z|[+-]\d\d:\d\d)?\s*$"
DAY_TIME = T.XSD + "dayTimeDuration"


@dataclass
class Val:
    k: Column
    x: Column
    d: Column
    l: Column  # noqa: E741
    n: Column | None = None
    b: Column | None = None
    id: Column | None = None
    num: Column | None = None  # the numeric value of a stored term
    e: Column | None = None  # a computed number, exactly; null where only the double n is known
    exa: Column | None = None  # the exact value of a stored term

    def key(self) -> Column:
        return self.id if self.id is not None else F.when(self.x.isNotNull(), T.id_of(self.k, self.x, self.d, self.l))

    def number(self) -> Column:
        if self.n is not None:
            return self.n
        return self.num if self.num is not None else T.number(self.x, self.d)

    def exact(self) -> Column:
        if self.n is not None:
            return self.e if self.e is not None else T.no_exact()
        return self.exa if self.exa is not None else T.exact(self.x, self.d)

    def truth(self) -> Column:
        """Effective boolean value."""
        if self.b is not None:
            return self.b
        if self.n is not None:
            return (self.n != 0) & ~F.isnan(self.n)
        n = self.number()
        by_kind = F.when(self.d == T.BOOLEAN, T.truth(self.x, self.d)).when(self.d.isin(*T.NUMERIC), (n != 0) & ~F.isnan(n))
        return by_kind.when(self.d.isin(T.STRING, T.LANG_STRING), F.length(self.x) > 0)


def text_val(x: Column, lang: Column | None = None) -> Val:
    lang = F.lit("") if lang is None else lang
    return Val(F.when(x.isNotNull(), T.LITERAL), x, F.when(lang != "", T.LANG_STRING).otherwise(T.STRING), lang)


def bool_val(b: Column) -> Val:
    return Val(F.when(b.isNotNull(), T.LITERAL), F.when(b, "true").when(~b, "false"), F.lit(T.BOOLEAN), F.lit(""), b=b)


def num_val(n: Column, d: Column, e: Column | None = None) -> Val:
    """A computed number: as a double, and exactly where ``e`` is not null; then the double is that rounded, so both order alike."""
    if e is not None:
        n = F.coalesce(e.cast("double"), n)
    text = T.render(n) if e is None else F.coalesce(T.render_exact(e), T.render(n))
    return Val(F.when(n.isNotNull(), T.LITERAL), text, d, F.lit(""), n=n, e=e)


def compare(op: str, a: Val, b: Val) -> Column:
    """Two numbers by value.  Doubles that differ decide alone; equal ones may stand for different exact numbers."""
    x, y = a.number(), b.number()
    p, q = a.exact(), b.exact()
    if op in ("<", "<="):
        return (x <= y) & F.coalesce(p < q if op == "<" else p <= q, x < y if op == "<" else F.lit(True))
    if op in (">", ">="):
        return compare(op.replace(">", "<"), b, a)
    return (x == y) & F.coalesce(p == q, F.lit(True))


def arithmetic(op: str, a: Val, b: Val) -> tuple[Column, Column | None]:
    """(double, exact or null) of + - * /.  A product is exact if both factors have at most 12 and 6 digits."""
    x, y = a.number(), b.number()
    if op == "/":
        return F.try_divide(x, y), None
    p, q = a.exact(), b.exact()
    if op == "*":
        r, s = p.try_cast("decimal(18,6)"), q.try_cast("decimal(18,6)")
        return x * y, F.when((r == p) & (s == q), F.try_multiply(r, s).try_cast(T.EXACT))
    return (x + y, F.try_add(p, q).try_cast(T.EXACT)) if op == "+" else (x - y, F.try_subtract(p, q).try_cast(T.EXACT))


def iri_val(x: Column) -> Val:
    return Val(F.when(x.isNotNull(), T.IRI), x, F.lit(""), F.lit(""))


def const_val(t: T.Term) -> Val:
    n = e = None
    if t.dt in T.NUMERIC:
        try:
            n = F.lit(float(t.lex.replace("INF", "inf")))
        except ValueError:
            n = F.lit(None).cast("double")
        if t.dt not in T.INEXACT and re.fullmatch(r"[+-]?(?:[0-9]{1,25}(?:\.[0-9]{0,12})?|\.[0-9]{1,12})", t.lex):
            e = F.lit(Decimal(t.lex)).cast(T.EXACT)
    b = F.lit(t.lex in ("true", "1")) if t.dt == T.BOOLEAN and t.lex in ("true", "false", "0", "1") else None
    return Val(F.lit(t.kind), F.lit(t.lex), F.lit(t.dt), F.lit(t.lang), n=n, b=b, e=e, id=T.id_lit(t))


def null_val() -> Val:
    s = F.lit(None).cast("string")
    return Val(F.lit(None).cast("int"), s, s, s, id=F.lit(None).cast("long"))


def _step(d: Column) -> Column:
    """Place of a numeric datatype in the order integer, decimal, float, double."""
    return F.when(d == T.DOUBLE, 3).when(d == T.XSD + "float", 2).when(d == T.DECIMAL, 1).otherwise(0)


def _promoted(a: Val, b: Val | None = None, least: int = 0) -> Column:
    step = F.greatest(_step(a.d), _step((b or a).d), F.lit(least))
    return F.when(step == 3, T.DOUBLE).when(step == 2, T.XSD + "float").when(step == 1, T.DECIMAL).otherwise(T.INTEGER)


def java_regex(pattern: str) -> str:
    """POSIX classes become the Java ones."""
    names = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}
    return re.sub(r"\[:(\w+):\]", lambda m: names.get(m[1], m[0]), pattern)


class Expressions:
    """Compiles expressions over ``env``: variable -> Val.

    ``exists`` and ``aggregate`` give columns for those nodes; ``functions``: IRI -> (function of columns, datatype).
    """

    def __init__(self, env, exists=None, aggregate=None, functions=None):
        self.env, self.exists, self.aggregate, self.functions = env, exists, aggregate, functions or {}

    def truth(self, e) -> Column:
        return self.value(e).truth()

    def value(self, e) -> Val:
        if isinstance(e, Var):
            return self.env.get(e.name) or null_val()
        if isinstance(e, T.Term):
            return const_val(e)
        if isinstance(e, Exists):
            if not self.exists:
                raise Unsupported("EXISTS is not translatable here")
            return bool_val(self.exists(e))
        if isinstance(e, Aggregate):
            if not self.aggregate:
                raise SparqlError("aggregate outside of a grouped query")
            return self.aggregate(e)
        return self.call(e)

    def call(self, e: Call) -> Val:
        name, raw = e.name, e.args
        if name in ("BOUND", "COALESCE", "IF", "IN", "&&", "||", "!"):
            return getattr(self, {"&&": "_and", "||": "_or", "!": "_not"}.get(name, "_" + name.lower()))(raw)
        a = [self.value(x) for x in raw]
        if name in ("=", "!=", "SAMETERM"):
            return self._same(a[0], a[1], name)
        if name in ("<", ">", "<=", ">="):
            return self._order(name, a[0], a[1])
        if name in ("+", "-", "*", "/"):
            n, e = arithmetic(name, a[0], a[1])
            return num_val(n, _promoted(a[0], a[1], 1 if name == "/" else 0), e)
        if name == "neg":
            return num_val(-a[0].number(), _promoted(a[0]), -a[0].exact())
        if name in self.functions:
            f, d = self.functions[name]
            x = f(*(v.x for v in a)).cast("string")
            return Val(F.when(x.isNotNull(), T.LITERAL), x, F.lit(d), F.lit(""))
        if name.startswith(MATH):
            return self._math(name[len(MATH) :], a)
        if name.startswith(T.XSD):
            return self._cast(name, a[0])
        method = getattr(self, "f_" + name.lower(), None)
        if method is None or ":" in name:
            raise Unsupported(f"unknown function {name}")
        if name == "REGEX" or name == "REPLACE":
            return method(a, raw)
        return method(*a)

    # logic

    def _and(self, raw):
        return bool_val(self.truth(raw[0]) & self.truth(raw[1]))

    def _or(self, raw):
        return bool_val(self.truth(raw[0]) | self.truth(raw[1]))

    def _not(self, raw):
        return bool_val(~self.truth(raw[0]))

    def _bound(self, raw):
        v = self.env.get(raw[0].name) if isinstance(raw[0], Var) else None
        return bool_val(v.key().isNotNull() if v else F.lit(False))

    def _coalesce(self, raw):
        out = null_val()
        for v in reversed([self.value(x) for x in raw]):
            ok = v.key().isNotNull()
            out = Val(*(F.when(ok, getattr(v, p)).otherwise(getattr(out, p)) for p in "kxdl"))
        return out

    def _if(self, raw):
        c, yes, no = self.truth(raw[0]), self.value(raw[1]), self.value(raw[2])
        pick = lambda p, q: F.when(c, p).when(~c, q)
        n = pick(yes.n, no.n) if yes.n is not None and no.n is not None else None
        e = pick(yes.exact(), no.exact()) if n is not None else None
        b = pick(yes.b, no.b) if yes.b is not None and no.b is not None else None
        return Val(*(pick(getattr(yes, p), getattr(no, p)) for p in "kxdl"), n=n, b=b, e=e)

    def _in(self, raw):
        v = self.value(raw[0])
        found = F.lit(False)
        for x in raw[1:]:
            found = found | self._same(v, self.value(x), "=").b
        return bool_val(found)

    def _same(self, a: Val, b: Val, name: str) -> Val:
        """Term identity; two numbers or truth values of which one is computed compare by value."""
        fixed = a.id is not None and b.id is not None
        if name != "SAMETERM" and not fixed and a.n is not None and b.n is not None:
            same = compare("=", a, b)
        elif name != "SAMETERM" and not fixed and a.b is not None and b.b is not None:
            same = a.b == b.b
        else:
            same = a.key() == b.key()
        return bool_val(~same if name == "!=" else same)

    def _order(self, name: str, a: Val, b: Val) -> Val:
        """Numbers by value; dates by instant; strings by code point where neither side is numeric."""
        op = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[name]
        by_number = compare(name, a, b)
        if a.n is not None or b.n is not None:
            return bool_val(by_number)
        by_time = op(T.instant(a.x, a.d), T.instant(b.x, b.d))
        plain = a.d.isin(T.STRING) & b.d.isin(T.STRING)
        return bool_val(F.coalesce(by_number, by_time, F.when(plain, op(a.x, b.x))))

    # strings

    def f_str(self, a):
        return text_val(a.x)

    def f_lang(self, a):
        return text_val(F.when(a.k == T.LITERAL, F.coalesce(a.l, F.lit(""))))

    def f_langmatches(self, a, r):
        low = F.lower(r.x)
        return bool_val(F.when(r.x == "*", a.x != "").otherwise((F.lower(a.x) == low) | F.startswith(F.lower(a.x), F.concat(low, F.lit("-")))))

    def f_datatype(self, a):
        return iri_val(F.when(a.k == T.LITERAL, a.d))

    def f_iri(self, a):
        return iri_val(a.x)

    f_uri = f_iri

    def f_bnode(self, a=None):
        return Val(F.lit(T.BNODE), F.concat(F.lit("b"), a.x if a else F.uuid()), F.lit(""), F.lit(""))

    def f_strlen(self, a):
        return num_val(F.char_length(a.x).cast("double"), F.lit(T.INTEGER))

    def f_ucase(self, a):
        return text_val(F.upper(a.x), a.l)

    def f_lcase(self, a):
        return text_val(F.lower(a.x), a.l)

    def f_contains(self, a, b):
        return bool_val(F.contains(a.x, b.x))

    def f_strstarts(self, a, b):
        return bool_val(F.startswith(a.x, b.x))

    def f_strends(self, a, b):
        return bool_val(F.endswith(a.x, b.x))

    def f_strbefore(self, a, b):
        at = F.position(b.x, a.x)
        return text_val(F.when(at > 0, F.substring(a.x, F.lit(1), at - 1)).otherwise(""), F.when(at > 0, a.l).otherwise(""))

    def f_strafter(self, a, b):
        at = F.position(b.x, a.x)
        return text_val(F.when(at > 0, F.substring(a.x, at + F.char_length(b.x), F.char_length(a.x))).otherwise(""), F.when(at > 0, a.l).otherwise(""))

    def f_substr(self, a, start, size=None):
        at = start.number().cast("int")
        return text_val(F.substring(a.x, at, size.number().cast("int") if size else F.char_length(a.x)), a.l)

    def f_concat(self, *a):
        return text_val(F.concat(*(v.x for v in a)) if a else F.lit(""))

    def f_encode_for_uri(self, a):
        return text_val(F.replace(F.url_encode(a.x), F.lit("+"), F.lit("%20")))

    def _pattern(self, raw, i):
        if len(raw) <= i:
            return ""
        if not isinstance(raw[i], T.Term):
            raise Unsupported("FILTER expression not translatable: the pattern has to be a literal")
        return raw[i].lex

    def f_regex(self, a, raw):
        flags = self._pattern(raw, 2)
        if set(flags) - set("imsxq"):
            raise Unsupported(f"unknown regex flags {flags!r}")
        pattern = self._pattern(raw, 1)
        pattern = re.escape(pattern) if "q" in flags else java_regex(pattern)
        flags = flags.replace("q", "")
        return bool_val(F.rlike(a[0].x, F.lit((f"(?{flags})" if flags else "") + pattern)))

    def f_replace(self, a, raw):
        flags = self._pattern(raw, 3)
        return text_val(F.regexp_replace(a[0].x, F.lit((f"(?{flags})" if flags else "") + java_regex(self._pattern(raw, 1))), a[2].x), a[0].l)

    def f_strlang(self, a, tag):
        return text_val(a.x, F.lower(tag.x))

    def f_strdt(self, a, d):
        return Val(F.when(a.x.isNotNull(), T.LITERAL), a.x, d.x, F.lit(""))

    def f_md5(self, a):
        return text_val(F.md5(a.x))

    def f_sha1(self, a):
        return text_val(F.sha1(a.x))

    def f_sha256(self, a):
        return text_val(F.sha2(a.x, 256))

    def f_sha384(self, a):
        return text_val(F.sha2(a.x, 384))

    def f_sha512(self, a):
        return text_val(F.sha2(a.x, 512))

    # tests

    def f_isiri(self, a):
        return bool_val(a.k == T.IRI)

    f_isuri = f_isiri

    def f_isblank(self, a):
        return bool_val(a.k == T.BNODE)

    def f_isliteral(self, a):
        return bool_val(a.k == T.LITERAL)

    def f_isnumeric(self, a):
        return bool_val(F.when(a.k.isNotNull(), a.number().isNotNull()))

    # numbers

    def f_abs(self, a):
        return num_val(F.abs(a.number()), _promoted(a), F.abs(a.exact()))

    def f_ceil(self, a):
        return num_val(F.ceil(a.number()).cast("double"), _promoted(a), F.ceil(a.exact()).cast(T.EXACT))

    def f_floor(self, a):
        return num_val(F.floor(a.number()).cast("double"), _promoted(a), F.floor(a.exact()).cast(T.EXACT))

    def f_round(self, a):
        half = F.floor(F.try_add(a.exact(), F.lit(Decimal("0.5")))).try_cast(T.EXACT)
        return num_val(F.floor(a.number() + 0.5).cast("double"), _promoted(a), half)

    def f_rand(self):
        return num_val(F.rand(), F.lit(T.DOUBLE))

    def _math(self, name, a):
        n = [v.number() for v in a]
        if name not in ("exp", "log", "sqrt", "pow", "log10", "sin", "cos", "tan", "pi"):
            raise Unsupported(f"unknown function {MATH}{name}")
        made = F.lit(3.141592653589793) if name == "pi" else getattr(F, name)(*n)
        return num_val(F.when(~F.isnan(made) & (F.abs(made) != float("inf")), made), F.lit(T.DOUBLE))

    def _cast(self, name, a):
        n = F.coalesce(a.number(), a.x.try_cast("double"))
        e = F.coalesce(a.exact(), F.when(a.k == T.LITERAL, T.exact(a.x, F.lit(T.DECIMAL))))
        if name in (T.INTEGER, T.XSD + "int", T.XSD + "long"):
            whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
            return num_val(whole(n).cast("double"), F.lit(name), whole(e).try_cast(T.EXACT))
        if name in T.NUMERIC:
            return num_val(n, F.lit(name), None if name in T.INEXACT else e)
        if name == T.BOOLEAN:
            return bool_val(F.when(a.x.isin("true", "1"), True).when(a.x.isin("false", "0"), False))
        if name == T.STRING:
            return text_val(a.x)
        if name in (T.DATETIME, T.XSD + "date"):
            return Val(F.when(a.x.try_cast("timestamp").isNotNull(), T.LITERAL), F.when(a.x.try_cast("timestamp").isNotNull(), a.x), F.lit(name), F.lit(""))
        raise Unsupported(f"unknown cast {name}")

    # dates

    @staticmethod
    def _field(a, i, d=T.INTEGER):
        """A field of a date as it is written: it belongs to the date's own time zone."""
        x = F.when(T.instant(a.x, a.d).isNotNull(), F.regexp_extract(a.x, DATE_FIELDS, i))
        return num_val(x.try_cast("double"), F.lit(d), T.exact(x, F.lit(T.DECIMAL)))

    def f_year(self, a):
        return self._field(a, 1)

    def f_month(self, a):
        return self._field(a, 2)

    def f_day(self, a):
        return self._field(a, 3)

    def f_hours(self, a):
        return self._field(a, 4)

    def f_minutes(self, a):
        return self._field(a, 5)

    def f_seconds(self, a):
        return self._field(a, 6, T.DECIMAL)

    def f_tz(self, a):
        return text_val(F.when(T.instant(a.x, a.d).isNotNull(), F.regexp_extract(a.x, r"(Z|[+-]\d\d:\d\d)$", 1)))

    def f_timezone(self, a):
        z = F.regexp_extract(a.x, r"(Z|[+-]\d\d:\d\d)$", 1)
        hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        span = F.concat(F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.lit("PT"), hours, F.lit("H"), F.when(minutes > 0, F.concat(minutes, F.lit("M"))).otherwise(""))
        x = F.when(z == "Z", "PT0S").when(z != "", span)
        return Val(F.when(x.isNotNull(), T.LITERAL), x, F.lit(DAY_TIME), F.lit(""))

    def f_now(self):
        return const_val(T.literal(dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), T.DATETIME))

    def f_uuid(self):
        return iri_val(F.concat(F.lit("urn:uuid:"), F.uuid()))

    def f_struuid(self):
        return text_val(F.uuid())


def order_columns(v: Val, ascending: bool) -> list[Column]:
    """Type-aware sort keys: number < dateTime < boolean < other, nulls last either way, and the text to make it total."""
    keys = [T.rank(v.k, v.d), v.number(), v.exact(), T.instant(v.x, v.d), T.truth(v.x, v.d), v.x, v.d, v.l]
    keys[0] = F.when(v.x.isNotNull(), keys[0])
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last() for c in keys]
