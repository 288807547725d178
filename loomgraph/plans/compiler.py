"""Compiles SPARQL algebra to DataFrames.

Each variable is five columns: an id (the join key) and the parts of its term.
Parts that nothing uses are pruned by Catalyst, down to the scan.  Joins are
equi-joins on ids; a variable that may be unbound on either side is split into
its bound and unbound rows, so the bound ones still join by hash or merge.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..functions.expressions import Expressions, Val, bool_val, null_val, num_val, order_columns, text_val
from . import algebra as A


def col(name: str) -> str:
    """Column of a variable; the suffix keeps names apart that differ only in case."""
    mask = sum(1 << i for i, c in enumerate(name) if c.isupper())
    return f"v{re.sub(r'[^0-9A-Za-z_]', '_', name).lower()}_{mask:x}"


GRAPH_KEY = "__g"


@dataclass
class Rel:
    """A bag of solutions.  vars: variable -> whether it may be unbound.  graph: whether GRAPH_KEY is a column."""

    df: DataFrame
    vars: dict[str, bool] = field(default_factory=dict)
    graph: bool = False

    def env(self, df: DataFrame | None = None) -> dict[str, Val]:
        df = self.df if df is None else df
        return {v: Val(*(df[T.part(col(v), p)] for p in T.PARTS), id=df[col(v)], num=df[T.part(col(v), "n")], exa=df[T.part(col(v), "e")]) for v in self.vars}

    def columns(self, keep=None) -> list[str]:
        out = [c for v in self.vars if keep is None or v in keep for c in T.columns(col(v))]
        return out + ([GRAPH_KEY] if self.graph else [])


def bind(v: str, val: Val) -> dict[str, Column]:
    key = val.key()
    parts = {T.part(col(v), p): F.when(key.isNotNull(), getattr(val, p)) if val.id is None else getattr(val, p) for p in T.PARTS}
    return {col(v): key, **parts, T.part(col(v), "n"): val.number(), T.part(col(v), "e"): val.exact()}


@dataclass(frozen=True)
class Scope:
    """Where triples are matched: all graphs (kind ``all``), one graph (``one``), each named graph for itself (``each``).

    among: the only graphs that count, if not all do.  named: the graphs that GRAPH may see, if not all named ones.
    """

    kind: str = "all"
    graph: int | None = None
    among: tuple | None = None
    named: tuple | None = None


class Compiler:
    def __init__(self, dataset, paths, functions: dict | None = None):
        """dataset: a source of quads (see sources); paths: evaluates property paths (see operators.paths); functions: those bound to IRIs."""
        self.data, self.paths, self.spark, self.functions = dataset, paths, dataset.spark, functions or {}

    def _made(self, env, **more) -> Expressions:
        return Expressions(env, functions=self.functions, **more)

    # basics

    def unit(self, scope: Scope) -> Rel:
        if scope.kind == "each":
            return Rel(self._named(scope).select(F.col("graph_id").alias(GRAPH_KEY)), {}, True)
        return Rel(self.spark.range(1).select(F.lit(1).alias("__unit")), {})

    def _named(self, scope: Scope) -> DataFrame:
        df = self.data.named_graphs()
        return df if scope.named is None else df.where(F.col("graph_id").isin(*scope.named)) if scope.named else df.where(F.lit(False))

    def compile(self, p, scope: Scope = Scope()) -> Rel:
        return getattr(self, "_" + type(p).__name__.lower())(p, scope)

    def _bgp(self, p: A.Bgp, scope: Scope) -> Rel:
        if not p.triples:
            return self.unit(scope)
        rels = [(u, self._unit_vars(u)) for u in self._units(self.paths.steps(p.triples), scope)]
        # connected order: the most bound unit first, then what shares most with what is joined
        rels.sort(key=lambda x: -self._bound(x[0]))
        out, seen = None, set()
        while rels:
            best = 0 if out is None else max(range(len(rels)), key=lambda i: (bool(rels[i][1] & seen), len(rels[i][1] & seen), self._bound(rels[i][0]), -i))
            unit, names = rels.pop(best)
            rel = self._unit(unit, scope)
            out = rel if out is None else self.join(out, rel)
            seen |= names
        return out

    def _units(self, triples, scope) -> list:
        """Triples, with those that the source can answer in one scan taken together."""
        stars: dict = {}
        rest = []
        for t in triples:
            if isinstance(t.p, T.Term) and isinstance(t.s, A.Var):
                stars.setdefault(t.s, []).append(t)
            else:
                rest.append([t])
        for s, group in stars.items():
            if scope.kind != "each" and len(group) > 1:
                rest += self.data.star_groups(group)
            else:
                rest += [[t] for t in group]
        return rest

    @staticmethod
    def _unit_vars(unit) -> set:
        return {x.name for t in unit for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}

    @staticmethod
    def _bound(unit) -> int:
        weight = {0: 4, 1: 1, 2: 3}
        return sum(weight[i] for t in unit for i, x in enumerate((t.s, t.p, t.o)) if isinstance(x, T.Term))

    def _unit(self, unit, scope: Scope) -> Rel:
        if len(unit) > 1:
            return self.data.star(unit, scope)
        t = unit[0]
        if isinstance(t.p, (A.Var, T.Term)):
            return self.data.scan(t, scope)
        return self.paths.relation(self, t, scope)

    # joins

    def _split(self, rel: Rel, names: list[str]):
        """(bound flags, rows) for each combination of bound and unbound among names."""
        for flags in product((True, False), repeat=len(names)):
            df = rel.df
            for v, bound in zip(names, flags):
                df = df.where(F.col(col(v)).isNotNull() if bound else F.col(col(v)).isNull())
            yield dict(zip(names, flags)), df

    def join(self, a: Rel, b: Rel) -> Rel:
        shared = [v for v in a.vars if v in b.vars]
        loose_a = [v for v in shared if a.vars[v]]
        loose_b = [v for v in shared if b.vars[v]]
        graph = a.graph or b.graph
        names = a.vars | {v: (m and a.vars.get(v, True)) for v, m in b.vars.items()}
        names = {v: (a.vars[v] and b.vars[v]) if v in shared else m for v, m in names.items()}
        parts = []
        for fa, da in self._split(a, loose_a):
            for fb, db in self._split(b, loose_b):
                keys = [v for v in shared if fa.get(v, True) and fb.get(v, True)]
                parts.append(self._equi(Rel(da, a.vars, a.graph), Rel(db, b.vars, b.graph), keys, shared, fa, names, graph))
        df = parts[0]
        for x in parts[1:]:
            df = df.unionByName(x)
        return Rel(df, names, graph)

    def _equi(self, a: Rel, b: Rel, keys, shared, fa, names, graph) -> DataFrame:
        left, right = a.df.alias("l"), b.df.alias("r")
        on = [F.col(f"l.{col(v)}") == F.col(f"r.{col(v)}") for v in keys]
        if a.graph and b.graph:
            on.append(F.col(f"l.{GRAPH_KEY}") == F.col(f"r.{GRAPH_KEY}"))
        both = left.join(right, on) if on else left.crossJoin(right)
        out = []
        for v in names:
            side = "l" if v in a.vars and (v not in b.vars or fa.get(v, True)) else "r"
            out += [F.col(f"{side}.{c}").alias(c) for c in T.columns(col(v))]
        if graph:
            out.append(F.col(f"{'l' if a.graph else 'r'}.{GRAPH_KEY}").alias(GRAPH_KEY))
        return both.select(*out) if out else both.select(F.lit(1).alias("__unit"))

    def _join(self, p: A.Join, scope: Scope) -> Rel:
        return self.join(self.compile(p.left, scope), self.compile(p.right, scope))

    @staticmethod
    def _side_env(rel: Rel, side: str) -> dict[str, Val]:
        part = lambda v, p: F.col(f"{side}.{T.part(col(v), p)}")
        return {v: Val(*(part(v, p) for p in T.PARTS), id=F.col(f"{side}.{col(v)}"), num=part(v, "n"), exa=part(v, "e")) for v in rel.vars}

    def _parts(self, a: Rel, b: Rel):
        """Both sides by their bound and unbound shared variables: (flags, left rows, [(keys, right rows)]).

        The left parts are disjoint and hold all rows; within one, right rows are compatible where the keys are equal.
        """
        shared = [v for v in a.vars if v in b.vars]
        right = list(self._split(b, [v for v in shared if b.vars[v]]))
        for fa, da in self._split(a, [v for v in shared if a.vars[v]]):
            yield fa, da, [([v for v in shared if fa.get(v, True) and fb.get(v, True)], db) for fb, db in right]

    @staticmethod
    def _equal(keys, graph: bool) -> list[Column]:
        names = [col(v) for v in keys] + ([GRAPH_KEY] if graph else [])
        return [F.col(f"l.{c}") == F.col(f"r.{c}") for c in names]

    def _leftjoin(self, p: A.LeftJoin, scope: Scope) -> Rel:
        """Unbound shared variables take their value from the right.

        A left part meets the right side in one outer join if that is all of one kind; else it is joined with each
        kind, and its rows without any partner are added.
        """
        a, b = self.compile(p.left, scope), self.compile(p.right, scope)
        graph = a.graph and b.graph
        names = {v: a.vars.get(v, True) if v in a.vars else True for v in a.vars | b.vars}

        def condition(fa):
            if p.condition is None:
                return []
            env = self._side_env(b, "r") | {v: x for v, x in self._side_env(a, "l").items() if fa.get(v, True) or v not in b.vars}
            return [F.coalesce(self._made(env).truth(p.condition), F.lit(False))]

        def columns(fa, alone=False):
            out = []
            for v in names:
                left = v in a.vars and (alone or v not in b.vars or fa.get(v, True))
                missing = alone and v not in a.vars
                for c in T.columns(col(v)):
                    out.append(F.lit(None).cast(b.df.schema[c].dataType).alias(c) if missing else F.col(f"{'l' if left else 'r'}.{c}").alias(c))
            return out + ([F.col(f"l.{GRAPH_KEY}").alias(GRAPH_KEY)] if a.graph else [])

        parts = []
        for fa, da, right in self._parts(a, b):
            left = da.alias("l")
            if len(right) == 1:
                on = self._equal(right[0][0], graph) + condition(fa)
                both = left.join(right[0][1].alias("r"), on if on else F.lit(True), "left")
                parts.append(both.select(*columns(fa)) if columns(fa) else da)
                continue
            alone = left
            for keys, db in right:
                on = self._equal(keys, graph) + condition(fa)
                on = on if on else F.lit(True)
                parts.append(left.join(db.alias("r"), on).select(*columns(fa)))
                alone = alone.join(db.alias("r"), on, "left_anti").alias("l")
            parts.append(alone.select(*columns(fa, alone=True)))
        df = parts[0]
        for x in parts[1:]:
            df = df.unionByName(x)
        return Rel(df, names, a.graph)

    def _minus(self, p: A.Minus, scope: Scope) -> Rel:
        a, b = self.compile(p.left, scope), self.compile(p.right, scope)
        if not any(v in b.vars for v in a.vars):
            return a
        kept = None
        for _, da, right in self._parts(a, b):
            for keys, db in right:
                if keys:  # solutions that share no bound variable take nothing away
                    da = da.alias("l").join(db.alias("r"), self._equal(keys, a.graph and b.graph), "left_anti")
            kept = da if kept is None else kept.unionByName(da)
        return Rel(kept, a.vars, a.graph)

    def _union(self, p: A.Union, scope: Scope) -> Rel:
        a, b = self.compile(p.left, scope), self.compile(p.right, scope)
        names = {v: a.vars.get(v, True) or b.vars.get(v, True) for v in a.vars | b.vars}
        graph = a.graph or b.graph
        left, right = (x.df.select(*x.columns()) if x.columns() else x.df.select(F.lit(1).alias("__unit")) for x in (a, b))
        return Rel(left.unionByName(right, allowMissingColumns=True), names, graph)

    def _values(self, p: A.Values, scope: Scope) -> Rel:
        if not p.names:
            return self.unit(scope)
        kinds = ", ".join(f"{T.part(col(v), x)} {'int' if x == 'k' else 'string'}" for v in p.names for x in T.PARTS)
        rows = [tuple(y for t in r for y in ((t.kind, t.lex, t.dt, t.lang) if t else (None,) * 4)) for r in p.rows]
        df = self.spark.createDataFrame(rows, kinds)
        for v in p.names:
            parts = [F.col(T.part(col(v), x)) for x in T.PARTS]
            numbers = {T.part(col(v), "n"): T.number(parts[1], parts[2]), T.part(col(v), "e"): T.exact(parts[1], parts[2])}
            df = df.withColumns({col(v): F.when(parts[0].isNotNull(), T.id_of(*parts)), **numbers})
        return Rel(df, {v: any(r[i] is None for r in p.rows) for i, v in enumerate(p.names)})

    def _graph(self, p: A.Graph, scope: Scope) -> Rel:
        if isinstance(p.name, T.Term):
            g = self.data.graph_id(p.name.lex)
            if g is None or scope.named is not None and g not in scope.named:
                g = -1
            return self.compile(p.pattern, Scope("one", g, named=scope.named))
        inner = self.compile(p.pattern, Scope("each", among=scope.named, named=scope.named))
        names = self._named(scope).select(F.col("graph_id").alias("__id"), F.col("iri").alias("__iri"))
        if not inner.graph:  # a pattern without triples: once for each named graph
            df = inner.df.crossJoin(names)
        else:
            df = inner.df.join(names, F.col(GRAPH_KEY) == F.col("__id"))
        v = p.name.name
        key = Val(F.lit(T.IRI), F.col("__iri"), F.lit(""), F.lit(""))
        if v in inner.vars:
            df = df.where(F.col(col(v)).isNull() | (F.col(col(v)) == key.key()))
            keep = inner.columns(keep=set(inner.vars) - {v})
            return Rel(df.select(*[c for c in keep if c != GRAPH_KEY], *[x.alias(c) for c, x in bind(v, key).items()]), inner.vars | {v: False})
        keep = [c for c in inner.columns() if c != GRAPH_KEY]
        return Rel(df.select(*keep, *[x.alias(c) for c, x in bind(v, key).items()]), inner.vars | {v: False})

    # filters and bindings

    def _conjuncts(self, e) -> list:
        if isinstance(e, A.Call) and e.name == "&&":
            return [y for x in e.args for y in self._conjuncts(x)]
        return [e]

    def _filter(self, p: A.Filter, scope: Scope) -> Rel:
        rel = self.compile(p.pattern, scope)
        for e in self._conjuncts(p.condition):
            if isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
                e = A.Exists(e.args[0].pattern, not e.args[0].positive)
            if isinstance(e, A.Exists):
                rel = self._semi(rel, e, scope)
                continue
            rel, made = self._expressions(rel, [e], scope)
            rel = Rel(rel.df.where(made.truth(e)), rel.vars, rel.graph)
        return rel

    def _inner(self, rel: Rel, e: A.Exists, scope: Scope):
        """The pattern of an EXISTS and those of its filters that speak of outer variables."""
        inner, outer = e.pattern, []
        while isinstance(inner, A.Filter):
            names = variables(inner.condition)
            if names - set(pattern_variables(inner.pattern)):
                outer.append(inner.condition)
                inner = inner.pattern
            else:
                break
        return self.compile(inner, scope), outer

    def _semi(self, rel: Rel, e: A.Exists, scope: Scope) -> Rel:
        b, outer = self._inner(rel, e, scope)
        env = self._side_env(b, "r") | self._side_env(rel, "l")
        more = [F.coalesce(self._made(env).truth(x), F.lit(False)) for x in outer]
        kept = []
        for _, da, right in self._parts(rel, b):
            for keys, db in right:
                on = self._equal(keys, rel.graph and b.graph) + more
                left, right_side = da.alias("l"), (db if on else db.limit(1)).alias("r")
                if e.positive:
                    kept.append(left.join(right_side, on if on else F.lit(True), "left_semi"))
                da = left.join(right_side, on if on else F.lit(True), "left_anti")
            if not e.positive:
                kept.append(da)
        df = kept[0]
        for x in kept[1:]:
            df = df.unionByName(x)
        return Rel(df, rel.vars, rel.graph)

    def _expressions(self, rel: Rel, exprs, scope: Scope):
        """rel with a flag column for each EXISTS inside exprs, and the compiler for them."""
        flags = {}
        for e in exprs:
            for x in nested_exists(e):
                b, outer = self._inner(rel, x, scope)
                shared = [v for v in rel.vars if v in b.vars]
                if outer or any(rel.vars[v] or b.vars[v] for v in shared):
                    raise A.Unsupported("FILTER expression not translatable: EXISTS over variables that may be unbound, inside a larger expression")
                name = f"__e{len(flags)}"
                marks = b.df.select(*[F.col(col(v)).alias(f"{name}_{i}") for i, v in enumerate(shared)], F.lit(True).alias(name)).distinct()
                on = [F.col(col(v)) == F.col(f"{name}_{i}") for i, v in enumerate(shared)]
                rel = Rel(rel.df.join(marks, on if on else F.lit(True), "left"), rel.vars, rel.graph)
                flags[x] = F.coalesce(F.col(name), F.lit(False)) if x.positive else ~F.coalesce(F.col(name), F.lit(False))
        return rel, self._made(rel.env(), exists=lambda x: flags[x])

    def _extend(self, p: A.Extend, scope: Scope) -> Rel:
        rel = self.compile(p.pattern, scope)
        if p.var in rel.vars:
            raise A.SparqlError(f"BIND of a variable that is in scope: ?{p.var}")
        rel, made = self._expressions(rel, [p.value], scope)
        return Rel(rel.df.withColumns(bind(p.var, made.value(p.value))), rel.vars | {p.var: True}, rel.graph)

    # select

    def _select(self, p: A.Select, scope: Scope) -> Rel:
        rel = self.solutions(p, scope)
        return Rel(self.sliced(rel, p), rel.vars, rel.graph)

    def solutions(self, p: A.Select, scope: Scope = Scope(), ordered: bool = True) -> Rel:
        """Projected rows, ordered; not yet sliced."""
        rel = self.compile(p.pattern, scope)
        grouped = p.group is not None or any(has_aggregate(e) for _, e in p.items) or any(has_aggregate(e) for e in p.having) or any(has_aggregate(e) for e, _ in p.order)
        order, having = list(p.order), list(p.having)
        if grouped:
            rel, order = self.aggregate(rel, p, scope)
        else:
            for v, e in p.items:
                if e is not None:
                    rel, made = self._expressions(rel, [e], scope)
                    rel = Rel(rel.df.withColumns(bind(v, made.value(e))), rel.vars | {v: True}, rel.graph)
            for h in having:
                rel = Rel(rel.df.where(self._made(rel.env()).truth(h)), rel.vars, rel.graph)
        names = {v: m for v, m in rel.vars.items() if not v.startswith("_")} if p.star else {v: rel.vars.get(v, True) for v, _ in p.items}
        for v in names:
            if v not in rel.vars:
                rel = Rel(rel.df.withColumns(bind(v, null_val())), rel.vars | {v: True}, rel.graph)
        if p.distinct:
            for e, _ in order:
                if variables(e) - set(names):
                    raise A.SparqlError("for SELECT DISTINCT, ORDER BY expressions must appear in select list")
            keys = [col(v) for v in names] + ([GRAPH_KEY] if rel.graph else [])
            df = rel.df.select(*Rel(rel.df, names, rel.graph).columns())
            rel = Rel(df.dropDuplicates(keys) if keys else df.limit(1), names, rel.graph)
        if order and ordered:
            made = self._made(rel.env())
            rel = Rel(rel.df.orderBy(*[c for e, up in order for c in order_columns(made.value(e), up)]), rel.vars, rel.graph)
        keep = Rel(rel.df, names, rel.graph).columns()
        return Rel(rel.df.select(*keep) if keep else rel.df.select(F.lit(1).alias("__unit")), names, rel.graph)

    @staticmethod
    def sliced(rel: Rel, p: A.Select) -> DataFrame:
        df = rel.df
        if p.offset:
            df = df.offset(p.offset)
        return df if p.limit is None else df.limit(p.limit)

    def aggregate(self, rel: Rel, p: A.Select, scope: Scope):
        """Groups, aggregates, HAVING and projected expressions.  Gives the order keys over the result."""
        keys = list(p.group or ())
        for v, e in keys:
            if e is not None:
                rel, made = self._expressions(rel, [e], scope)
                rel = Rel(rel.df.withColumns(bind(v, made.value(e))), rel.vars | {v: True}, rel.graph)
        names = [v for v, _ in keys]
        for v in names:
            if v not in rel.vars:
                rel = Rel(rel.df.withColumns(bind(v, null_val())), rel.vars | {v: True}, rel.graph)
        found: dict[A.Aggregate, Val] = {}
        columns: list[Column] = []
        made = self._made(rel.env())

        def collect(e):
            for x in aggregates(e):
                if x not in found:
                    found[x] = self._aggregate(x, made, columns, f"__a{len(found)}", rel)

        for _, e in p.items:
            collect(e)
        for e in (*p.having, *(e for e, _ in p.order)):
            collect(e)
        grouping = [F.col(c) for v in names for c in T.columns(col(v))[:5]] + ([F.col(GRAPH_KEY)] if rel.graph else [])
        columns = columns or [F.count(F.lit(1)).alias("__n")]
        df = rel.df.groupBy(*grouping).agg(*columns) if grouping else rel.df.agg(*columns)
        for v in names:
            x, d = F.col(T.part(col(v), "x")), F.col(T.part(col(v), "d"))
            df = df.withColumns({T.part(col(v), "n"): T.number(x, d), T.part(col(v), "e"): T.exact(x, d)})
        out = Rel(df, {v: rel.vars[v] for v in names}, rel.graph)
        for v, e in p.items:
            if e is None:
                if v not in out.vars:
                    raise A.SparqlError(f"?{v} is neither grouped nor aggregated")
                continue
            made = self._made(out.env(), aggregate=found.__getitem__)
            out = Rel(out.df.withColumns(bind(v, made.value(e))), out.vars | {v: True}, out.graph)
        for h in p.having:
            out = Rel(out.df.where(self._made(out.env(), aggregate=found.__getitem__).truth(h)), out.vars, out.graph)
        order = []
        for i, (e, up) in enumerate(p.order):
            if has_aggregate(e):
                made = self._made(out.env(), aggregate=found.__getitem__)
                out = Rel(out.df.withColumns(bind(f"_order{i}", made.value(e))), out.vars | {f"_order{i}": True}, out.graph)
                e = A.Var(f"_order{i}")
            order.append((e, up))
        return out, order

    def _aggregate(self, x: A.Aggregate, made: Expressions, columns: list, name: str, rel: Rel) -> Val:
        def add(suffix: str, c: Column) -> Column:
            columns.append(c.alias(name + suffix))
            return F.col(name + suffix)

        if x.arg is None:
            ids = [F.col(col(v)) for v in rel.vars]
            # a struct, so that rows with unbound variables count too
            n = add("n", F.count_distinct(F.struct(*ids)) if x.distinct and ids else F.count(F.lit(1)))
            return num_val(n.cast("double"), F.lit(T.INTEGER))
        v = made.value(x.arg)
        key = v.key()
        if x.name == "APPROX_COUNT_DISTINCT":
            return num_val(add("n", F.approx_count_distinct(key)).cast("double"), F.lit(T.INTEGER))
        if x.name == "COUNT":
            n = add("n", F.count_distinct(key) if x.distinct else F.count(key))
            return num_val(n.cast("double"), F.lit(T.INTEGER))
        number = v.number()
        if x.name in ("SUM", "AVG"):
            step = F.when(v.d == T.DOUBLE, 3).when(v.d == T.XSD + "float", 2).when(v.d == T.DECIMAL, 1).otherwise(0)
            # the sum is exact if every number is; else it is the sum of the doubles
            exact = v.exact()
            pick, count = (F.sum_distinct, F.count_distinct) if x.distinct else (F.try_sum, F.count)
            total, size = add("n", pick(number)), add("c", count(number))
            whole, whole_size = add("e", pick(exact)), add("f", count(exact))
            e = F.when(size == whole_size, whole)
            n = total
            if x.name == "AVG":
                n, e = F.try_divide(total, size.cast("double")), F.try_divide(e, size.cast("decimal(20,0)"))
            step = add("d", F.max(F.when(number.isNotNull(), step)))
            d = F.when(step == 3, T.DOUBLE).when(step == 2, T.XSD + "float").when((step == 1) | F.lit(x.name == "AVG"), T.DECIMAL).otherwise(T.INTEGER)
            return num_val(n, d, e.try_cast(T.EXACT))
        if x.name in ("MIN", "MAX"):
            # numbers first, then dates, then text; null sort keys are replaced so that structs compare by the first that differs
            pick = F.min if x.name == "MIN" else F.max
            s = F.struct(number.alias("n"), v.exact().alias("e"), v.k.alias("k"), v.x.alias("x"), v.d.alias("d"), v.l.alias("l"))
            by_number = add("n", pick(F.when(number.isNotNull(), s)))
            t = F.struct(v.x.alias("x"), v.k.alias("k"), v.d.alias("d"), v.l.alias("l"))
            by_text = add("t", pick(F.when(v.x.isNotNull(), t)))
            either = lambda p: F.coalesce(by_number[p], by_text[p])
            return Val(either("k"), either("x"), either("d"), either("l"))
        if x.name == "SAMPLE":
            s = add("s", F.min(F.when(v.x.isNotNull(), F.struct(v.x.alias("x"), v.k.alias("k"), v.d.alias("d"), v.l.alias("l")))))
            return Val(s["k"], s["x"], s["d"], s["l"])
        got = add("g", (F.collect_set if x.distinct else F.collect_list)(v.x))
        return text_val(F.array_join(F.array_sort(got), x.separator))


# walks over expressions and patterns


def _children(e):
    if isinstance(e, A.Call):
        return e.args
    if isinstance(e, A.Aggregate):
        return (e.arg,) if e.arg is not None else ()
    return ()


def variables(e) -> set[str]:
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, A.Exists):
        return set()
    return set().union(*(variables(x) for x in _children(e))) if _children(e) else set()


def aggregates(e) -> list[A.Aggregate]:
    if isinstance(e, A.Aggregate):
        return [e]
    return [y for x in _children(e) for y in aggregates(x)]


def has_aggregate(e) -> bool:
    return e is not None and bool(aggregates(e))


def nested_exists(e) -> list[A.Exists]:
    if isinstance(e, A.Exists):
        return [e]
    return [y for x in _children(e) for y in nested_exists(x)]


def pattern_variables(p) -> list[str]:
    """Variables that a pattern can bind, in order."""
    out: dict[str, None] = {}

    def walk(p):
        if isinstance(p, A.Bgp):
            for t in p.triples:
                for x in (t.s, t.p, t.o):
                    if isinstance(x, A.Var):
                        out[x.name] = None
        elif isinstance(p, (A.Join, A.LeftJoin, A.Union)):
            walk(p.left)
            walk(p.right)
        elif isinstance(p, A.Minus):
            walk(p.left)
        elif isinstance(p, A.Filter):
            walk(p.pattern)
        elif isinstance(p, A.Extend):
            walk(p.pattern)
            out[p.var] = None
        elif isinstance(p, A.Values):
            out.update(dict.fromkeys(p.names))
        elif isinstance(p, A.Graph):
            if isinstance(p.name, A.Var):
                out[p.name.name] = None
            walk(p.pattern)
        elif isinstance(p, A.Select):
            if p.star:
                walk(p.pattern)
            out.update(dict.fromkeys(v for v, _ in p.items))

    walk(p)
    return list(out)


__all__ = ["Compiler", "Rel", "Scope", "bind", "bool_val", "col", "pattern_variables"]
