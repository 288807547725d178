"""SHACL Core and SHACL-SPARQL.

Shapes are read on the driver, behind a check of their size; the data graph never
is.  A shape becomes one DataFrame of results: focus nodes are rows, a property
path a relation, counts one aggregation, and boolean shapes joins of the nodes
that violate their parts.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..plans import algebra as A
from ..plans.compiler import Compiler, Rel, Scope, col
from ..plans.parser import Parser
from ..sources.quads import QuadDataset
from .closure import stage, transitive

SH = T.SH
MAX_SHAPE_TRIPLES = 200_000
MODES = ("core", "native", "sparql", "full")

#: The constraint parameters of SHACL Core that are evaluated, and the component each belongs to.
COMPONENTS = {
    "class": "Class", "datatype": "Datatype", "nodeKind": "NodeKind", "minCount": "MinCount", "maxCount": "MaxCount",
    "minExclusive": "MinExclusive", "minInclusive": "MinInclusive", "maxExclusive": "MaxExclusive", "maxInclusive": "MaxInclusive",
    "minLength": "MinLength", "maxLength": "MaxLength", "pattern": "Pattern", "languageIn": "LanguageIn", "uniqueLang": "UniqueLang",
    "equals": "Equals", "disjoint": "Disjoint", "lessThan": "LessThan", "lessThanOrEquals": "LessThanOrEquals", "not": "Not",
    "and": "And", "or": "Or", "xone": "Xone", "node": "Node", "qualifiedValueShape": "QualifiedMinCount", "closed": "Closed",
    "hasValue": "HasValue", "in": "In", "sparql": "SPARQL",
}
OTHER = {
    "path", "property", "targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "severity", "message", "deactivated", "name",
    "description", "order", "group", "defaultValue", "flags", "ignoredProperties", "qualifiedMinCount", "qualifiedMaxCount",
    "qualifiedValueShapesDisjoint", "prefixes", "declare", "prefix", "namespace", "select", "inversePath", "alternativePath",
    "zeroOrMorePath", "oneOrMorePath", "zeroOrOnePath", "entailment", "shapesGraph", "resultPath", "resultSeverity", "conforms", "result",
}


class ValidationError(ValueError):
    pass


class Shapes:
    """A shapes graph in memory: subject -> predicate -> objects."""

    def __init__(self, quads: DataFrame):
        rows = quads.select("s__k", "s__x", "p__x", "o__k", "o__x", "o__d", "o__l").distinct().limit(MAX_SHAPE_TRIPLES + 1).collect()
        if len(rows) > MAX_SHAPE_TRIPLES:
            raise ValidationError(f"validate: more than {MAX_SHAPE_TRIPLES} triples of shapes")
        self.n = len(rows)
        self.of: dict[T.Term, dict[str, list[T.Term]]] = {}
        for r in rows:
            self.of.setdefault(T.Term(r[0], r[1]), {}).setdefault(r[2], []).append(T.Term(r[3], r[4], r[5], r[6]))

    def get(self, s: T.Term, name: str) -> list[T.Term]:
        return sorted(self.of.get(s, {}).get(SH + name, []), key=lambda t: (t.kind, t.lex))

    def one(self, s: T.Term, name: str) -> T.Term | None:
        return next(iter(self.get(s, name)), None)

    def types(self, s: T.Term) -> set[str]:
        return {t.lex for t in self.of.get(s, {}).get(T.TYPE, [])}

    def list(self, x: T.Term) -> list[T.Term]:
        out, seen = [], set()
        while x in self.of and x not in seen and T.RDF + "first" in self.of[x]:
            seen.add(x)
            out.append(self.of[x][T.RDF + "first"][0])
            x = self.of[x].get(T.RDF + "rest", [T.iri(T.RDF + "nil")])[0]
        return out

    def path(self, x: T.Term):
        if x.kind == T.IRI:
            return A.Link(x.lex)
        for name, make in (
            ("inversePath", A.Inverse),
            ("zeroOrMorePath", lambda p: A.Repeat(p, 0, True)),
            ("oneOrMorePath", lambda p: A.Repeat(p, 1, True)),
            ("zeroOrOnePath", lambda p: A.Repeat(p, 0, False)),
        ):
            if self.one(x, name):
                return make(self.path(self.one(x, name)))
        if self.one(x, "alternativePath"):
            return A.Alternative(tuple(self.path(p) for p in self.list(self.one(x, "alternativePath"))))
        parts = self.list(x)
        if not parts:
            raise ValidationError("validate: unreadable path")
        return A.Sequence(tuple(self.path(p) for p in parts))

    def shapes(self) -> list[T.Term]:
        """Shapes with a target."""
        targets = {SH + t for t in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf")}
        implicit = lambda s: {SH + "NodeShape", SH + "PropertyShape"} & self.types(s) and T.RDFS + "Class" in self.types(s)
        return sorted((s for s, p in self.of.items() if targets & set(p) or implicit(s)), key=lambda t: (t.kind, t.lex))

    def unevaluated(self) -> list[str]:
        known = {SH + x for x in (*COMPONENTS, *OTHER)}
        return sorted({p for ps in self.of.values() for p in ps if p.startswith(SH) and p not in known})


FOCUS = ["f", "f__k", "f__x", "f__d", "f__l"]
VALUE = ["v", "v__k", "v__x", "v__d", "v__l"]


class Validator:
    def __init__(self, store, data: DataFrame, shapes: Shapes):
        self.store, self.shapes, self.spark = store, shapes, data.sparkSession
        self.data = QuadDataset(data, store.graphs)
        self.active: set[T.Term] = set()

    # nodes

    def _nodes(self, df: DataFrame, where: str, name: str = "f") -> DataFrame:
        if where == "s":
            parts = [F.col("s"), F.col("s__k"), F.col("s__x"), F.lit(""), F.lit("")]
        else:
            parts = [F.col("o"), F.col("o__k"), F.col("o__x"), F.col("o__d"), F.col("o__l")]
        return df.select(*[c.alias(n) for c, n in zip(parts, (name, *(f"{name}__{p}" for p in "kxdl")))])

    def _constant(self, terms: list[T.Term], name: str = "f") -> DataFrame:
        rows = [(t.kind, t.lex, t.dt, t.lang) for t in terms]
        df = self.spark.createDataFrame(rows, ", ".join(f"{name}__{p} {'int' if p == 'k' else 'string'}" for p in "kxdl"))
        return df.withColumn(name, T.id_of(*(F.col(f"{name}__{p}") for p in "kxdl"))).select(name, *(f"{name}__{p}" for p in "kxdl"))

    def focus(self, shape: T.Term) -> DataFrame:
        q, out = self.data.quads, []
        classes = list(self.shapes.get(shape, "targetClass"))
        if T.RDFS + "Class" in self.shapes.types(shape):
            classes.append(shape)
        for c in classes:
            out.append(self._nodes(q.where((F.col("p") == T.id_lit(T.iri(T.TYPE))) & (F.col("o") == T.id_lit(c))), "s"))
        if self.shapes.get(shape, "targetNode"):
            out.append(self._constant(self.shapes.get(shape, "targetNode")))
        for p in self.shapes.get(shape, "targetSubjectsOf"):
            out.append(self._nodes(q.where(F.col("p") == T.id_lit(p)), "s"))
        for p in self.shapes.get(shape, "targetObjectsOf"):
            out.append(self._nodes(q.where(F.col("p") == T.id_lit(p)), "o"))
        df = out[0]
        for x in out[1:]:
            df = df.unionByName(x)
        return df.dropDuplicates(["f"])

    def values(self, focus: DataFrame, path) -> DataFrame:
        """(focus, value) pairs of a path, as a set."""
        if isinstance(path, A.Link):
            q = self.data.quads.where(F.col("p") == T.id_lit(T.iri(path.iri)))
            pairs = q.select(F.col("s").alias("f"), *[F.col(c).alias(n) for c, n in zip(("o", "o__k", "o__x", "o__d", "o__l"), VALUE)])
        else:
            ids = self.store.paths.pairs(self.data, path, Scope()).select(F.col("a").alias("f"), F.col("b").alias("v"))
            nodes = self.data.nodes(Scope()).select(F.col("id").alias("v"), *(F.col(p).alias(f"v__{p}") for p in "kxdl"))
            pairs = ids.join(nodes, "v")
        return focus.join(pairs, "f").dropDuplicates(["f", "v"])

    def _classes(self, c: T.Term) -> DataFrame:
        """(id) of instances of a class or of its subclasses."""
        edges = self.data.edges([T.RDFS + "subClassOf"], [], Scope())
        seeds = self.spark.range(1).select(T.id_lit(c).alias("id"))
        below, _ = transitive(edges, 1024, seeds, backwards=True)
        kinds = below.select(F.col("a").alias("o")).unionByName(seeds.select(F.col("id").alias("o")))
        return self.data.quads.where(F.col("p") == T.id_lit(T.iri(T.TYPE))).join(kinds, "o", "left_semi").select(F.col("s").alias("id")).distinct()

    # one shape over given focus nodes

    def results(self, shape: T.Term, focus: DataFrame, sparql: bool, core: bool = True) -> list[DataFrame]:
        """DataFrames (focus, value, component, shape, path, message, severity) of violations of a shape."""
        sh = self.shapes
        if (sh.one(shape, "deactivated") or T.literal("")).lex == "true":
            return []
        if shape in self.active:
            raise ValidationError(f"validate: recursive shape {shape.nt()}")
        self.active.add(shape)
        try:
            out = []
            path = sh.one(shape, "path")
            if path is not None:
                pairs = stage(self.values(focus, sh.path(path)), "values")
            else:
                pairs = focus.select(*FOCUS, *[F.col(a).alias(b) for a, b in zip(FOCUS, VALUE)])
            if core:
                out += self._core(shape, focus, pairs, path)
            if sparql:
                out += self._sparql(shape, focus, path)
            for p in sh.get(shape, "property"):
                nodes = pairs.select(*[F.col(b).alias(a) for a, b in zip(FOCUS, VALUE)]).dropDuplicates(["f"])
                out += self.results(p, nodes, sparql, core)
            return out
        finally:
            self.active.discard(shape)

    def failing(self, shape: T.Term, nodes: DataFrame) -> DataFrame:
        """(id) of the nodes (column f) that don't conform to a shape."""
        found = [x.select(F.col("root").alias("id")) for x in self._rooted(shape, nodes)]
        df = self.spark.createDataFrame([], "id long")
        for x in found:
            df = df.unionByName(x)
        return df.distinct()

    def _rooted(self, shape: T.Term, nodes: DataFrame) -> list[DataFrame]:
        """Violations of a shape with the node they are about: nested property shapes report the outer node."""
        sh = self.shapes
        if (sh.one(shape, "deactivated") or T.literal("")).lex == "true":
            return []
        if shape in self.active:
            raise ValidationError(f"validate: recursive shape {shape.nt()}")
        self.active.add(shape)
        try:
            path = sh.one(shape, "path")
            pairs = self.values(nodes, sh.path(path)) if path is not None else nodes.select(*FOCUS, *[F.col(a).alias(b) for a, b in zip(FOCUS, VALUE)])
            pairs = stage(pairs, "values")
            out = [x.select(F.col("f").alias("root")) for x in [*self._core(shape, nodes, pairs, path), *self._sparql(shape, nodes, path)]]
            for p in sh.get(shape, "property"):
                inner = pairs.select(*[F.col(b).alias(a) for a, b in zip(FOCUS, VALUE)]).dropDuplicates(["f"])
                for bad in self._rooted(p, inner):
                    out.append(pairs.join(bad.select(F.col("root").alias("v")).distinct(), "v", "left_semi").select(F.col("f").alias("root")))
            return out
        finally:
            self.active.discard(shape)

    def _report(self, df: DataFrame, shape: T.Term, path, component: str, value: bool = True) -> DataFrame:
        sh = self.shapes
        severity = sh.one(shape, "severity")
        message = sh.one(shape, "message")
        shown = path.nt() if path is not None and path.kind == T.BNODE else path.lex if path is not None else None
        none = F.lit(None).cast("string")
        parts = [F.col(c) for c in VALUE] if value else [F.lit(None).cast("long"), F.lit(None).cast("int"), none, none, none]
        return df.select(
            *FOCUS, *[c.alias(n) for c, n in zip(parts, VALUE)],
            F.lit(SH + component + "ConstraintComponent").alias("component"), F.lit(shape.lex).alias("shape"),
            F.lit(shown).cast("string").alias("path"), F.lit(message.lex if message else f"{component} constraint violated").alias("message"),
            F.lit(severity.lex if severity else SH + "Violation").alias("severity"),
        )

    def _core(self, shape: T.Term, focus: DataFrame, pairs: DataFrame, path) -> list[DataFrame]:
        sh, out = self.shapes, []

        def add(df: DataFrame, component: str, value: bool = True):
            out.append(self._report(df, shape, path, component, value))

        v = lambda p="": F.col(f"v__{p}" if p else "v")
        for c in sh.get(shape, "class"):
            add(pairs.join(self._classes(c).withColumnRenamed("id", "v"), "v", "left_anti"), "Class")
        for d in sh.get(shape, "datatype"):
            ok = (v("k") == T.LITERAL) & (v("d") == d.lex)
            if d.lex in T.NUMERIC:
                ok = ok & T.number(v("x"), v("d")).isNotNull()
                if d.lex not in (T.DECIMAL, T.DOUBLE, T.XSD + "float"):
                    ok = ok & F.rlike(v("x"), F.lit(r"^[+-]?\d+$"))
            elif d.lex in (T.DATETIME, T.XSD + "date"):
                ok = ok & T.instant(v("x"), v("d")).isNotNull()
            elif d.lex == T.BOOLEAN:
                ok = ok & v("x").isin("true", "false", "0", "1")
            add(pairs.where(~ok), "Datatype")
        for n in sh.get(shape, "nodeKind"):
            kinds = [k for k, name in ((T.IRI, "IRI"), (T.BNODE, "BlankNode"), (T.LITERAL, "Literal")) if name in n.lex.removeprefix(SH).split("Or")]
            add(pairs.where(~v("k").isin(*kinds)), "NodeKind")
        counts = None
        for name, component, bad in (("minCount", "MinCount", lambda n, k: n < k), ("maxCount", "MaxCount", lambda n, k: n > k)):
            for k in sh.get(shape, name):
                if counts is None:
                    counts = focus.join(pairs.groupBy("f").agg(F.count(F.lit(1)).alias("n")), "f", "left").withColumn("n", F.coalesce("n", F.lit(0)))
                add(counts.where(bad(F.col("n"), int(k.lex))), component, False)
        for name, component, op in (
            ("minExclusive", "MinExclusive", lambda a, b: a > b), ("minInclusive", "MinInclusive", lambda a, b: a >= b),
            ("maxExclusive", "MaxExclusive", lambda a, b: a < b), ("maxInclusive", "MaxInclusive", lambda a, b: a <= b),
        ):
            for k in sh.get(shape, name):
                number = op(T.number(v("x"), v("d")), F.lit(float(k.lex)) if k.dt in T.NUMERIC else F.lit(None).cast("double"))
                instant = op(T.instant(v("x"), v("d")), T.instant(F.lit(k.lex), F.lit(k.dt)))
                add(pairs.where(~F.coalesce(number, instant, F.lit(False))), component)
        for k in sh.get(shape, "minLength"):
            add(pairs.where((v("k") == T.BNODE) | (F.char_length(v("x")) < int(k.lex))), "MinLength")
        for k in sh.get(shape, "maxLength"):
            add(pairs.where((v("k") == T.BNODE) | (F.char_length(v("x")) > int(k.lex))), "MaxLength")
        flags = sh.one(shape, "flags")
        for k in sh.get(shape, "pattern"):
            add(pairs.where((v("k") == T.BNODE) | ~F.rlike(v("x"), F.lit((f"(?{flags.lex})" if flags and flags.lex else "") + k.lex))), "Pattern")
        for k in sh.get(shape, "languageIn"):
            ok = F.lit(False)
            for tag in sh.list(k):
                ok = ok | (v("l") == tag.lex.lower()) | F.startswith(v("l"), F.lit(tag.lex.lower() + "-"))
            add(pairs.where(~ok), "LanguageIn")
        if (sh.one(shape, "uniqueLang") or T.literal("")).lex == "true":
            twice = pairs.where(v("l") != "").groupBy("f", "v__l").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f", "v__l")
            add(focus.join(twice, "f"), "UniqueLang", False)
        for k in sh.get(shape, "hasValue"):
            add(focus.join(pairs.where(v() == T.id_lit(k)).select("f"), "f", "left_anti"), "HasValue", False)
        for k in sh.get(shape, "in"):
            items = sh.list(k)
            add(pairs.where(~v().isin(*[T.id_lit(t) for t in items])) if items else pairs, "In")
        for k in sh.get(shape, "equals"):
            other = self.values(focus, A.Link(k.lex))
            add(pairs.join(other.select("f", "v"), ["f", "v"], "left_anti"), "Equals")
            add(other.join(pairs.select("f", "v"), ["f", "v"], "left_anti"), "Equals")
        for k in sh.get(shape, "disjoint"):
            add(pairs.join(self.values(focus, A.Link(k.lex)).select("f", "v"), ["f", "v"], "left_semi"), "Disjoint")
        for name, component, op in (("lessThan", "LessThan", lambda a, b: a < b), ("lessThanOrEquals", "LessThanOrEquals", lambda a, b: a <= b)):
            for k in sh.get(shape, name):
                other = self.values(focus, A.Link(k.lex)).select("f", F.col("v__x").alias("wx"), F.col("v__d").alias("wd"))
                both = pairs.join(other, "f")
                number = op(T.number(v("x"), v("d")), T.number(F.col("wx"), F.col("wd")))
                instant = op(T.instant(v("x"), v("d")), T.instant(F.col("wx"), F.col("wd")))
                text = F.when((v("d") == T.STRING) & (F.col("wd") == T.STRING), op(v("x"), F.col("wx")))
                add(both.where(~F.coalesce(number, instant, text, F.lit(False))), component)
        nodes = pairs.select(*[F.col(b).alias(a) for a, b in zip(FOCUS, VALUE)]).dropDuplicates(["f"])
        fails = lambda s: self.failing(s, nodes).withColumnRenamed("id", "v")
        for k in sh.get(shape, "not"):
            add(pairs.join(fails(k), "v", "left_anti"), "Not")
        for k in sh.get(shape, "node"):
            add(pairs.join(fails(k), "v", "left_semi"), "Node")
        for k in sh.get(shape, "and"):
            df = fails(sh.list(k)[0])
            for s in sh.list(k)[1:]:
                df = df.unionByName(fails(s))
            add(pairs.join(df.distinct(), "v", "left_semi"), "And")
        for k in sh.get(shape, "or"):
            df = None
            for s in sh.list(k):
                df = fails(s) if df is None else df.join(fails(s), "v", "left_semi")
            add(pairs.join(df, "v", "left_semi"), "Or")
        for k in sh.get(shape, "xone"):
            parts = sh.list(k)
            df = fails(parts[0])
            for s in parts[1:]:
                df = df.unionByName(fails(s))
            most = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
            add(pairs.join(most, "v", "left").where(F.coalesce("n", F.lit(0)) != len(parts) - 1).drop("n"), "Xone")
        for k in sh.get(shape, "qualifiedValueShape"):
            good = pairs.join(fails(k), "v", "left_anti")
            if (sh.one(shape, "qualifiedValueShapesDisjoint") or T.literal("")).lex == "true":
                for parent, ps in self.shapes.of.items():
                    siblings = [q for p in ps.get(SH + "property", []) for q in sh.get(p, "qualifiedValueShape") if q != k]
                    if shape in ps.get(SH + "property", []):
                        for q in siblings:
                            good = good.join(fails(q), "v", "left_semi")
            n = focus.join(good.groupBy("f").agg(F.count(F.lit(1)).alias("n")), "f", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            for lim in sh.get(shape, "qualifiedMinCount"):
                add(n.where(F.col("n") < int(lim.lex)), "QualifiedMinCount", False)
            for lim in sh.get(shape, "qualifiedMaxCount"):
                add(n.where(F.col("n") > int(lim.lex)), "QualifiedMaxCount", False)
        if (sh.one(shape, "closed") or T.literal("")).lex == "true":
            allowed = [p for s in sh.get(shape, "property") for p in sh.get(s, "path") if p.kind == T.IRI]
            for k in sh.get(shape, "ignoredProperties"):
                allowed += sh.list(k)
            q = self.data.quads
            q = q.where(~F.col("p").isin(*[T.id_lit(p) for p in allowed])) if allowed else q
            extra = q.select(F.col("s").alias("v"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(("o", "o__k", "o__x", "o__d", "o__l"))])
            bad = pairs.join(extra, "v").select(*FOCUS, *[F.col(f"e{i}").alias(n) for i, n in enumerate(VALUE)])
            add(bad, "Closed")
        return out

    def _sparql(self, shape: T.Term, focus: DataFrame, path) -> list[DataFrame]:
        """Each row of a constraint's SELECT, run once for all focus nodes as $this, is a violation."""
        out = []
        for c in self.shapes.get(shape, "sparql"):
            if (self.shapes.one(c, "deactivated") or T.literal("")).lex == "true":
                continue
            text = self.shapes.one(c, "select").lex
            if path is not None:
                text = text.replace("$PATH", f"<{path.lex}>").replace("?PATH", f"<{path.lex}>")
            parser = Parser(text)
            for ps in self.shapes.get(c, "prefixes"):
                for d in self.shapes.get(ps, "declare"):
                    parser.prefixes[self.shapes.one(d, "prefix").lex] = self.shapes.one(d, "namespace").lex
            q = parser.query()
            compiler = ThisCompiler(self.data, self.store.paths, focus, self.store.functions)
            rel = compiler._select(A.Select(A.Join(This(), q.select.pattern), tuple(dict.fromkeys([("this", None), *q.select.items])), distinct=q.select.distinct), Scope())
            named = [v for v, _ in q.select.items]
            pick = "value" if "value" in named else "this"
            rows = rel.df.select(*[F.col(c).alias(n) for c, n in zip(T.columns(col("this")), FOCUS)], *[F.col(c).alias(n) for c, n in zip(T.columns(col(pick)), VALUE)])
            df = self._report(rows, shape, path, "SPARQL")
            message = self.shapes.one(c, "message")
            out.append(df.withColumn("message", F.lit(message.lex)) if message else df)
        return out


class This:
    """The focus nodes, as a pattern that binds ?this."""


class ThisCompiler(Compiler):
    def __init__(self, dataset, paths, focus: DataFrame, functions: dict):
        super().__init__(dataset, paths, functions)
        self.focus = focus

    def _this(self, p, scope: Scope) -> Rel:
        x, d = F.col("f__x"), F.col("f__d")
        numbers = T.number(x, d).alias(T.part(col("this"), "n")), T.exact(x, d).alias(T.part(col("this"), "e"))
        return Rel(self.focus.select(*[F.col(a).alias(b) for a, b in zip(FOCUS, T.columns(col("this")))], *numbers), {"this": False})


REPORT = ["focusNode", "resultPath", "sourceShape", "resultMessage", "resultSeverity", "value", "sourceConstraintComponent"]


def validate(store, data: int, shapes: int, mode: str = "core", strict: bool = True, collect: bool = True) -> dict:
    """The envelope of a report, its results as a DataFrame (``report``) and, if ``collect``, as a list (``results``)."""
    if mode not in MODES:
        raise ValidationError(f"validate: unknown mode {mode!r}")
    began = time.time()
    own = store.quads.where(F.col("g") == data)
    sh = Shapes(store.quads.where(F.col("g") == shapes))
    warnings = []
    if data == shapes:
        warnings.append("the shapes graph is validated by itself")
    unevaluated = sh.unevaluated()
    targets = sh.shapes()
    if strict and not targets:
        raise ValidationError("validate: no shape declares a target")
    if strict and unevaluated:
        raise ValidationError(f"validate: components that are not evaluated: {', '.join(unevaluated)}")
    report: DataFrame | None = None
    v = Validator(store, own, sh)
    for s in targets:
        for df in v.results(s, stage(v.focus(s), "focus"), sparql=mode in ("sparql", "full"), core=mode != "sparql"):
            report = df if report is None else report.unionByName(df)
    if report is None:
        report = store.spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT))
    else:
        columns = ["f__x", "path", "shape", "message", F.replace("severity", F.lit(SH), F.lit("")), "v__x", "component"]
        report = stage(report.select(*columns).toDF(*REPORT), "report")
    told = report.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("resultSeverity").isin("Violation", "Warning", "Info")).alias("bad")).first()
    out = {
        "conforms": not told["bad"], "n_results": told["n"], "report": report, "data_graph_id": data, "shapes_graph_id": shapes,
        "data_triples": store.count_quads(data), "shapes_triples": sh.n, "mode": mode, "elapsed_ms": (time.time() - began) * 1000, "warnings": warnings,
    }
    if collect:
        out["results"] = [r.asDict() for r in report.collect()]
    if unevaluated:
        out["error"] = f"not evaluated: {', '.join(unevaluated)}"
    return out
