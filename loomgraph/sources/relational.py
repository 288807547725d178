"""Relational tables as a virtual graph.

A fixed direct mapping: a row is the subject ``urn:t:<table>:<key>``, a column the
predicate ``urn:c:<column>``, a foreign key an IRI object, any other value a typed
literal; every foreign key also is an edge ``urn:c:within``, and every row has
the type ``urn:t:<table>``.  Nothing is stored: a pattern reads only the columns
it names, triples of one subject are one scan and no join, and a constant object
becomes a filter on the column that reaches the Parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import terms as T
from ..plans import algebra as A
from ..plans.compiler import GRAPH_KEY, Rel, Scope, col

COLUMN, TABLE, WITHIN = "urn:c:", "urn:t:", "urn:c:within"


@dataclass(frozen=True)
class Table:
    """key: the columns that name a row; without one, the hash of the whole row does.  links: column -> table."""

    key: tuple[str, ...] = ()
    links: dict = field(default_factory=dict, hash=False)


STAR_SCHEMA = {
    "region": Table(("r_regionkey",)),
    "nation": Table(("n_nationkey",), {"n_regionkey": "region"}),
    "customer": Table(("c_custkey",), {"c_nationkey": "nation"}),
    "supplier": Table(("s_suppkey",), {"s_nationkey": "nation"}),
    "part": Table(("p_partkey",)),
    "orders": Table(("o_orderkey",), {"o_custkey": "customer"}),
    "lineitem": Table((), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
}


def datatype(t: S.DataType) -> str:
    if isinstance(t, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return T.INTEGER
    if isinstance(t, S.DecimalType):
        return T.DECIMAL
    if isinstance(t, (S.DoubleType, S.FloatType)):
        return T.DOUBLE
    if isinstance(t, S.BooleanType):
        return T.BOOLEAN
    if isinstance(t, S.DateType):
        return T.XSD + "date"
    if isinstance(t, (S.TimestampType, S.TimestampNTZType)):
        return T.DATETIME
    return T.STRING


def lexical(c: Column, t: S.DataType) -> Column:
    if isinstance(t, (S.TimestampType, S.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


class RelationalGraph:
    """The compiler's view of a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table] | None = None):
        self.spark, self.tables = spark, tables or STAR_SCHEMA
        self.frames = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in self.tables}
        self.owner = {c: n for n, df in self.frames.items() for c in df.columns}

    def named_graphs(self) -> DataFrame:
        return self.spark.createDataFrame([], "graph_id long, iri string")

    def graph_id(self, iri: str) -> int | None:
        return None

    def closed_predicate(self, predicate: str, scope: Scope) -> bool:
        return False

    # one row as a subject, one cell as an object

    def subject(self, table: str) -> Column:
        key = self.tables[table].key
        tail = F.concat_ws("_", *(F.col(c).cast("string") for c in key)) if key else F.xxhash64(*self.frames[table].columns).cast("string")
        return F.concat(F.lit(f"{TABLE}{table}:"), tail)

    def cell(self, table: str, c: str) -> tuple[Column, Column, Column, Column, Column, Column]:
        """(kind, lex, datatype, language, number, exact number) of a column's values.

        Integers of at most 32 bits are exact as doubles, so their filters stay filters of the column.
        """
        to, none = self.tables[table].links.get(c), F.lit(None).cast("double")
        if to:
            return F.lit(T.IRI), F.concat(F.lit(f"{TABLE}{to}:"), F.col(c).cast("string")), F.lit(""), F.lit(""), none, T.no_exact()
        t = self.frames[table].schema[c].dataType
        number = F.col(c).cast("double") if isinstance(t, S.NumericType) else none
        exact = F.col(c).cast(T.EXACT) if isinstance(t, S.LongType) else T.exact(lexical(F.col(c), t), F.lit(T.DECIMAL)) if isinstance(t, S.DecimalType) else T.no_exact()
        return F.lit(T.LITERAL), lexical(F.col(c), t), F.lit(datatype(t)), F.lit(""), number, exact

    def matches(self, table: str, c: str, t: T.Term) -> Column:
        """A filter on the column itself that holds where its object is the term."""
        to, kind = self.tables[table].links.get(c), self.frames[table].schema[c].dataType
        if to:
            head = f"{TABLE}{to}:"
            return F.col(c).cast("string") == t.lex[len(head) :] if t.kind == T.IRI and t.lex.startswith(head) else F.lit(False)
        if t.kind != T.LITERAL or t.lang or t.dt != datatype(kind):
            return F.lit(False)
        if isinstance(kind, S.StringType):
            return F.col(c) == t.lex
        if isinstance(kind, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)) and (t.lex.lstrip("-").isdigit() and str(int(t.lex)) == t.lex):
            return F.col(c) == int(t.lex)
        return lexical(F.col(c), kind) == t.lex

    @staticmethod
    def _columns(v: str, k: Column, x: Column, d: Column, lang: Column, number: Column, exact: Column) -> list[Column]:
        parts = dict(zip((*T.PARTS, "n", "e"), (k, x, d, lang, number, exact)))
        return [T.id_of(k, x, d, lang).alias(col(v)), *(c.alias(T.part(col(v), p)) for p, c in parts.items())]

    def _row(self, table: str, x: str):
        return F.lit(T.IRI), self.subject(table), F.lit(""), F.lit(""), F.lit(None).cast("double"), T.no_exact()

    # scans

    def star_groups(self, triples) -> list:
        """Triples of one subject that a single table answers, together."""
        by: dict = {}
        rest = []
        for t in triples:
            name = self.owner.get(t.p.lex[len(COLUMN) :]) if t.p.lex.startswith(COLUMN) else None
            if name:
                by.setdefault(name, []).append(t)
            else:
                rest.append([t])
        return list(by.values()) + rest

    def star(self, triples, scope: Scope) -> Rel:
        table = self.owner[triples[0].p.lex[len(COLUMN) :]]
        return self._table_star(table, triples[0].s, [(t.p.lex[len(COLUMN) :], t.o) for t in triples], scope)

    def _table_star(self, table: str, s, cells, scope: Scope) -> Rel:
        df = self.frames[table]
        if scope.kind == "one" and scope.graph != 0:
            df = df.where(F.lit(False))
        out: dict[str, tuple] = {}
        if isinstance(s, A.Var):
            out[s.name] = self._row(table, s.name)
        else:
            df = self._at(df, table, s)
        for c, o in cells:
            df = df.where(F.col(c).isNotNull())
            if isinstance(o, T.Term):
                df = df.where(self.matches(table, c, o))
            elif o.name in out:
                a, b = out[o.name], self.cell(table, c)
                df = df.where((a[1] == b[1]) & (a[0] == b[0]) & (a[2] == b[2]))
            else:
                out[o.name] = self.cell(table, c)
        columns = [c for v, parts in out.items() for c in self._columns(v, *parts)]
        return Rel(df.select(*columns) if columns else df.select(F.lit(1).alias("__unit")), dict.fromkeys(out, False))

    def _at(self, df: DataFrame, table: str, s: T.Term) -> DataFrame:
        """The row that a subject names, by its key columns where they are numbers."""
        head, key = f"{TABLE}{table}:", self.tables[table].key
        if s.kind != T.IRI or not s.lex.startswith(head):
            return df.where(F.lit(False))
        tail = s.lex[len(head) :]
        if len(key) == 1 and tail.isdigit() and str(int(tail)) == tail and isinstance(df.schema[key[0]].dataType, (S.IntegerType, S.LongType)):
            return df.where(F.col(key[0]) == int(tail))
        return df.where(self.subject(table) == s.lex)

    def scan(self, t: A.Triple, scope: Scope) -> Rel:
        if scope.kind == "each":
            return self._empty(t, scope)
        if isinstance(t.p, T.Term):
            name = t.p.lex[len(COLUMN) :]
            if t.p.lex == T.TYPE:
                return self._union([self._type(n, t, scope) for n in self.tables], t, scope)
            if t.p.lex == WITHIN:
                return self._union([self._table_star(n, t.s, [(c, t.o)], scope) for n, x in self.tables.items() for c in x.links], t, scope)
            if t.p.lex.startswith(COLUMN) and name in self.owner:
                return self._table_star(self.owner[name], t.s, [(name, t.o)], scope)
            return self._empty(t, scope)
        found = []
        v = t.p.name
        for n, df in self.frames.items():
            for p, c in [(COLUMN + c, c) for c in df.columns] + [(WITHIN, c) for c in self.tables[n].links]:
                found.append(self._with(self._table_star(n, t.s, [(c, t.o)], scope), v, p))
            found.append(self._with(self._type(n, t, scope), v, T.TYPE))
        return self._union(found, t, scope)

    def outside(self, s, o, excluded: list[str], scope: Scope) -> Rel:
        """The edges from s to o of all predicates but the excluded ones, as solutions."""
        t = A.Triple(s, T.iri(T.TYPE), o)
        if scope.kind == "each":
            return self._empty(t, scope)
        found = [self._table_star(n, s, [(c, o)], scope) for n, c in self._pairs(None, excluded)]
        if T.TYPE not in excluded:
            found += [self._type(n, t, scope) for n in self.tables]
        return self._union(found, t, scope)

    def _with(self, rel: Rel, v: str, p: str) -> Rel:
        parts = F.lit(T.IRI), F.lit(p), F.lit(""), F.lit(""), F.lit(None).cast("double"), T.no_exact()
        if v in rel.vars:
            return Rel(rel.df.where(F.col(T.part(col(v), "x")) == p), rel.vars)
        return Rel(rel.df.select("*", *self._columns(v, *parts)), rel.vars | {v: False})

    def _type(self, table: str, t: A.Triple, scope: Scope) -> Rel:
        rel = self._table_star(table, t.s, [], scope)
        if isinstance(t.o, T.Term):
            return rel if t.o == T.iri(TABLE + table) else Rel(rel.df.where(F.lit(False)), rel.vars)
        return self._with(rel, t.o.name, TABLE + table)

    def _union(self, rels: list[Rel], t: A.Triple, scope: Scope) -> Rel:
        names = {x.name: False for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}
        if not rels:
            return self._empty(t, scope)
        df = None
        for r in rels:
            own = r.df.select(*[c for v in names for c in T.columns(col(v))]) if names else r.df.select(F.lit(1).alias("__unit"))
            df = own if df is None else df.unionByName(own)
        return Rel(df, names)

    def _empty(self, t: A.Triple, scope: Scope) -> Rel:
        names = {x.name: False for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}
        kinds = ", ".join(f"{col(v)} long, " + ", ".join(f"{T.part(col(v), p)} {'int' if p == 'k' else 'string'}" for p in T.PARTS) + f", {T.part(col(v), 'n')} double, {T.part(col(v), 'e')} {T.EXACT}" for v in names) or "__unit int"
        if scope.kind == "each":
            kinds += f", {GRAPH_KEY} long"
        return Rel(self.spark.createDataFrame([], kinds), names, scope.kind == "each")

    # paths

    def _pairs(self, predicates, excluded) -> list[tuple[str, str]]:
        out = []
        for n, x in self.tables.items():
            for c in self.frames[n].columns:
                if (predicates is None or COLUMN + c in predicates) and COLUMN + c not in excluded:
                    out.append((n, c))
            for c in x.links:
                if (predicates is None or WITHIN in predicates) and WITHIN not in excluded:
                    out.append((n, c))
        return out

    def edges(self, predicates, excluded, scope: Scope, start: T.Term | None = None, end: T.Term | None = None) -> DataFrame:
        df = self.spark.createDataFrame([], "a long, b long, g long")
        if scope.kind == "each" or scope.kind == "one" and scope.graph != 0:
            return df
        rows_of = lambda n: self.frames[n] if start is None else self._at(self.frames[n], n, start)
        ids = lambda n, b: (T.id_of(*self._row(n, "")[:4]).alias("a"), b.alias("b"), F.lit(0).cast("long").alias("g"))
        for n, c in self._pairs(predicates, excluded):
            rows = rows_of(n).where(F.col(c).isNotNull())
            if end is not None:
                rows = rows.where(self.matches(n, c, end))
            df = df.unionByName(rows.select(*ids(n, T.id_of(*self.cell(n, c)[:4]))))
        if (predicates is None or T.TYPE in predicates) and T.TYPE not in excluded:
            for n in self.tables:
                own = T.iri(TABLE + n)
                df = df.unionByName(rows_of(n).where(F.lit(end is None or end == own)).select(*ids(n, T.id_lit(own))))
        return df

    def nodes(self, scope: Scope, predicates: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], "id long, k int, x string, d string, l string, g long")
        if scope.kind == "each" or scope.kind == "one" and scope.graph != 0:
            return out
        own: dict[str, list[str]] = {n: df.columns for n, df in self.frames.items()}
        if predicates is not None:
            own = {}
            for n, c in self._pairs(predicates, []):
                own.setdefault(n, []).append(c)
        if predicates is None or T.TYPE in predicates:
            for n in self.tables:
                own.setdefault(n, [])
                kind = T.iri(TABLE + n)
                out = out.unionByName(self.frames[n].limit(1).select(T.id_lit(kind).alias("id"), *(c.alias(p) for p, c in T.constant(kind).items()), F.lit(0).cast("long").alias("g")))
        for n, cells in own.items():
            df = self.frames[n]
            for parts in (self._row(n, ""), *(self.cell(n, c) for c in cells)):
                k, x, d, lang = parts[:4]
                rows = df.select(T.id_of(k, x, d, lang).alias("id"), k.alias("k"), x.alias("x"), d.alias("d"), lang.alias("l"), F.lit(0).cast("long").alias("g"))
                out = out.unionByName(rows.where("x IS NOT NULL"))
        return (out if among is None else out.join(among, "id", "left_semi")).dropDuplicates(["id"])

    def quads(self, predicates: list[str] | None = None) -> DataFrame:
        """The mapping as stored quads, for operators that rewrite a graph."""
        from .quads import with_ids

        out = None
        for n, c in self._pairs(predicates, []):
            s, (k, x, d, lang, *_) = self.subject(n), self.cell(n, c)
            df = self.frames[n].where(F.col(c).isNotNull())
            df = df.select(F.lit(T.IRI).alias("s__k"), s.alias("s__x"), F.lit(COLUMN + c).alias("p__x"), k.alias("o__k"), x.alias("o__x"), d.alias("o__d"), lang.alias("o__l"), F.lit(0).cast("long").alias("g"))
            out = df if out is None else out.unionByName(df)
        return with_ids(out)
