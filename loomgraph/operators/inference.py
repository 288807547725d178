"""Forward chaining: RDFS and the OWL 2 RL rules, as joins that run to a fixed point.

The schema (hierarchies, domains, ranges, inverses) is closed first, by itself: sub-properties are composed
with domains and ranges, those with sub-classes.  Then every rule with one fact as premise is one join of the
newest facts with a table of the schema, and under RDFS one pass over the asserted facts derives everything,
unless a property is declared to be a sub-property of a schema predicate.  OWL rules with two facts as
premises join the newest facts with all.  Facts are the asserted ones and what each round added, which is
written once and never rewritten; terms travel with their texts, so nothing is decoded by a join.

Nodes that owl:sameAs makes equal are replaced by one representative, the rules run on representatives, and
the result is expanded once at the end, but for the sameAs pairs themselves: they are given as groups of equal nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from .closure import connected, stage, transitive

PROFILES = ("rdfs", "owl-rl")
#: Lists and kinds of properties are read on the driver; more is an error.
MAX_LIST_CELLS = 100_000
ROUNDS = 200
#: Schema tables of at most so many rows travel with the plan, larger ones are staged.
FEW_ROWS = 10_000
FEW_IDS = 1000

SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (T.RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))
SAME, INVERSE, THING = (T.OWL + x for x in ("sameAs", "inverseOf", "Thing"))
EQUAL_CLASS, EQUAL_PROPERTY = T.OWL + "equivalentClass", T.OWL + "equivalentProperty"
HAS_VALUE, SOME, ALL, ON = (T.OWL + x for x in ("hasValue", "someValuesFrom", "allValuesFrom", "onProperty"))
SYMMETRIC, TRANSITIVE, FUNCTIONAL, INVERSE_FUNCTIONAL = (T.OWL + x + "Property" for x in ("Symmetric", "Transitive", "Functional", "InverseFunctional"))
#: The predicates of axioms, and the classes that are axioms as a type.
RDFS_AXIOMS = (SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)
OWL_AXIOMS = (EQUAL_CLASS, EQUAL_PROPERTY, INVERSE, HAS_VALUE, SOME, ALL, ON)
KINDS = (SYMMETRIC, TRANSITIVE, FUNCTIONAL, INVERSE_FUNCTIONAL)

FACT = ["s", "s__k", "s__x", "p", "p__x", "o", "o__k", "o__x", "o__d", "o__l"]
KEY = ["s", "p", "o"]


class InferenceError(RuntimeError):
    pass


def _c(iri: str):
    return T.id_lit(T.iri(iri))


def _node(df: DataFrame, frm: str, to: str) -> list:
    """The columns of a node under another name."""
    return [F.col(frm).alias(to), *(F.col(f"{frm}__{p}").alias(f"{to}__{p}") for p in T.PARTS if f"{frm}__{p}" in df.columns)]


def _at(f: DataFrame, p: str, a: str, b: str) -> DataFrame:
    """Subjects and objects of a predicate, as nodes a and b."""
    return f.where(F.col("p") == _c(p)).select(*_node(f, "s", a), *_node(f, "o", b))


def _triple(df: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Facts of nodes by name; p and o may be IRIs.  Literals are no subjects, and only IRIs are predicates."""

    def parts(x, names):
        if x.startswith("http"):
            given = {"": _c(x), "k": F.lit(T.IRI), "x": F.lit(x)}
        else:
            given = {"": F.col(x), **{n: F.col(f"{x}__{n}") for n in T.PARTS if f"{x}__{n}" in df.columns}}
        return [given.get(n, F.lit(T.IRI if n == "k" else "")) for n in names]

    if f"{s}__d" in df.columns:
        df = df.where(F.col(f"{s}__k") != T.LITERAL)
    if not p.startswith("http") and f"{p}__k" in df.columns:
        df = df.where(F.col(f"{p}__k") == T.IRI)
    columns = [*parts(s, ("", "k", "x")), *parts(p, ("", "x")), *parts(o, ("", "k", "x", "d", "l"))]
    return df.select(*(c.alias(n) for c, n in zip(columns, FACT)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _small(df: DataFrame) -> DataFrame:
    rows = df.limit(FEW_ROWS + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= FEW_ROWS else stage(df, "schema")


def _closed(edges: DataFrame) -> DataFrame:
    """Pairs of different nodes x, y with a way along the edges (x, y)."""
    ids, cut = transitive(edges.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).cast("long").alias("g")), 100_000)
    if cut:
        raise InferenceError("a hierarchy is deeper than 100000 steps")
    names = edges.select(*_node(edges, "x", "n")).unionByName(edges.select("y", "y__k", "y__x").toDF("n", "n__k", "n__x")).dropDuplicates(["n"])
    out = ids.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"))
    for c in ("x", "y"):
        out = out.join(names.select(*_node(names, "n", c)), c)
    return _small(out)


class Schema:
    """Axioms of a graph, closed."""

    def __init__(self, facts: DataFrame, owl: bool):
        self.owl, spark = owl, facts.sparkSession
        predicates = RDFS_AXIOMS + (OWL_AXIOMS if owl else ())
        axiom = F.col("p").isin(*[_c(x) for x in predicates])
        if owl:
            axiom = axiom | (F.col("p") == _c(T.TYPE)) & F.col("o").isin(*[_c(x) for x in KINDS])
        self.axioms = _small(facts.where(axiom).dropDuplicates(KEY))
        told = self.axioms.groupBy("p__x", F.when(F.col("p__x") == T.TYPE, F.col("o__x")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()
        #: what there is: the same axioms make the same schema
        self.state = sorted(((r["p__x"], r["kind"] or "", r["n"]) for r in told if r["p__x"] not in (SUBCLASS, SUBPROPERTY, EQUAL_CLASS, EQUAL_PROPERTY)))
        has = {r["kind"] or r["p__x"] for r in told}
        self.has = has
        iris = lambda df: df.where((F.col("x__k") != T.LITERAL) & (F.col("y__k") != T.LITERAL)).select("x", "x__k", "x__x", "y", "y__k", "y__x")
        none = spark.createDataFrame([], "x long, x__k int, x__x string, y long, y__k int, y__x string")
        pairs = lambda p: iris(_at(self.axioms, p, "x", "y")) if p in has else None

        def hierarchy(sub, equal):
            parts = [x for x in (pairs(sub),) if x is not None]
            if owl and equal in has:
                e = pairs(equal)
                back = e.select("y", "y__k", "y__x", "x", "x__k", "x__x").toDF(*e.columns)
                parts += [e, back]
            return _closed(_union(parts)) if parts else none

        self.classes, self.properties = hierarchy(SUBCLASS, EQUAL_CLASS), hierarchy(SUBPROPERTY, EQUAL_PROPERTY)
        self.state += [("classes", "", self.classes.count()), ("properties", "", self.properties.count())]
        self.domains, self.ranges = self._classes_of(pairs(DOMAIN)), self._classes_of(pairs(RANGE))
        self.inverses = None
        if owl and has & {INVERSE, SYMMETRIC}:
            parts = []
            if INVERSE in has:
                i = pairs(INVERSE)
                parts += [i, i.select("y", "y__k", "y__x", "x", "x__k", "x__x").toDF(*i.columns)]
            if SYMMETRIC in has:
                own = self.axioms.where((F.col("p") == _c(T.TYPE)) & (F.col("o") == _c(SYMMETRIC)))
                parts.append(own.select(*_node(own, "s", "x"), *_node(own, "s", "y")))
            self.inverses = _small(_union(parts).distinct())
        targets = {r[0] for r in self.properties.select("y__x").distinct().limit(FEW_ROWS).collect()}
        #: whether no rule can make another axiom or type out of what one pass makes
        self.plain = not targets & {T.TYPE, SAME, *RDFS_AXIOMS, *OWL_AXIOMS}

    def _classes_of(self, pairs: DataFrame | None) -> DataFrame | None:
        """Property x, and each class y that its domain (or range) implies, also through super-properties and super-classes."""
        if pairs is None:
            return None
        pairs = pairs.where(F.col("x") != _c(T.TYPE))
        over = self.properties.select(*_node(self.properties, "x", "x"), F.col("y").alias("m")).join(pairs.select(F.col("x").alias("m"), "y", "y__k", "y__x"), "m").drop("m")
        own = pairs.unionByName(over.where(F.col("x") != _c(T.TYPE)))
        above = own.select("x", "x__k", "x__x", F.col("y").alias("m")).join(self.classes.select(F.col("x").alias("m"), "y", "y__k", "y__x"), "m").drop("m")
        return _small(own.unionByName(above).dropDuplicates(["x", "y"]))

    def kind(self, kind: str) -> list[int]:
        """Ids of the properties of a kind."""
        if kind not in self.has:
            return []
        rows = self.axioms.where((F.col("p") == _c(T.TYPE)) & (F.col("o") == _c(kind))).select("s").limit(MAX_LIST_CELLS + 1).collect()
        if len(rows) > MAX_LIST_CELLS:
            raise InferenceError(f"more than {MAX_LIST_CELLS} properties are {kind}")
        return [r[0] for r in rows]

    def facts(self) -> list[DataFrame]:
        """What the hierarchies themselves imply."""
        out = []
        for pairs, sub, equal in ((self.classes, SUBCLASS, EQUAL_CLASS), (self.properties, SUBPROPERTY, EQUAL_PROPERTY)):
            out.append(_triple(pairs, "x", sub, "y"))
            if self.owl:
                mutual = pairs.join(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_semi")
                out.append(_triple(mutual, "x", equal, "y"))
        return out

    def one_premise(self, d: DataFrame) -> list[DataFrame]:
        """rdfs2, 3, 7 and 9, inverse and symmetric properties over facts d; domain and range leave rdf:type alone."""
        out, type_ = [], F.col("p") == _c(T.TYPE)
        if self.has & {SUBPROPERTY, EQUAL_PROPERTY}:
            up = self.properties.select(F.col("x").alias("p"), *_node(self.properties, "y", "q"))
            out.append(_triple(d.join(up, "p"), "s", "q", "o"))
        if self.has & {SUBCLASS, EQUAL_CLASS}:
            up = self.classes.select(F.col("x").alias("o"), *_node(self.classes, "y", "c"))
            out.append(_triple(d.where(type_).join(up, "o"), "s", T.TYPE, "c"))
        for table, end in ((self.domains, "s"), (self.ranges, "o")):
            if table is not None:
                kinds = table.select(F.col("x").alias("p"), *_node(table, "y", "c"))
                out.append(_triple(d.where(~type_ & (F.col(f"{end}__k") != T.LITERAL)).join(kinds, "p"), end, T.TYPE, "c"))
        if self.inverses is not None:
            turned = self.inverses.select(F.col("x").alias("p"), *_node(self.inverses, "y", "q"))
            out.append(_triple(d.join(turned, "p"), "o", "q", "s"))
        return out


def _with(f: DataFrame, ids: list[int]) -> DataFrame:
    """Facts of some predicates."""
    if len(ids) <= FEW_IDS:
        return f.where(F.col("p").isin(*ids))
    return f.join(f.sparkSession.createDataFrame([(i,) for i in ids], "p long"), "p", "left_semi")


def _two_premises(f: DataFrame, d: DataFrame, schema: Schema, lists: dict) -> list[DataFrame]:
    """OWL rules that put facts together; all facts f, of which d are the newest."""
    col, out = F.col, []
    if ids := schema.kind(TRANSITIVE):
        old, new = _with(f, ids), _with(d, ids)
        for left, right in ((new, old), (old, new)):
            a = left.select(*_node(left, "s", "s"), "p", "p__x", col("o").alias("m"))
            b = right.select(col("s").alias("m"), "p", *_node(right, "o", "o"))
            out.append(_triple(a.join(b, ["m", "p"]), "s", "p", "o"))
    # functional and inverse functional: each value is tied to the least one, not to all others
    for kind, key, end in ((FUNCTIONAL, "s", "o"), (INVERSE_FUNCTIONAL, "o", "s")):
        if ids := schema.kind(kind):
            own = _with(f, ids).where(col(f"{end}__k") != T.LITERAL)
            least = own.groupBy("p", key).agg(F.min(F.struct(*(col(c).alias(c.replace(end, "m", 1)) for c in (end, f"{end}__k", f"{end}__x")))).alias("low"), F.max(end).alias("top"))
            least = least.where("low.m <> top").select("p", key, "low.*")
            tied = own.join(least, ["p", key]).where(col(end) != col("m"))
            out.append(_triple(tied.select(*_node(tied, "m", "m"), *_node(own, end, "v")), "m", SAME, "v"))
    on = _at(schema.axioms, ON, "r", "p").select("r", "r__k", "r__x", "p", "p__k", "p__x")
    types = _at(f, T.TYPE, "x", "r").select("x", "x__k", "x__x", "r")
    if HAS_VALUE in schema.has:
        value = _at(schema.axioms, HAS_VALUE, "r", "v").drop("r__k", "r__x", "r__d", "r__l").join(on, "r")
        out.append(_triple(types.join(value, "r"), "x", "p", "v"))
        held = f.select(*_node(f, "s", "s"), "p", col("o").alias("v")).join(value.select("r", "r__k", "r__x", "p", "v"), ["p", "v"])
        out.append(_triple(held, "s", T.TYPE, "r"))
    if SOME in schema.has:
        some = _at(schema.axioms, SOME, "r", "c").select("r", "c").join(on, "r")
        used = f.select(*_node(f, "s", "s"), "p", "o").join(some.select("r", "r__k", "r__x", "c", "p"), "p")
        out.append(_triple(used.where(col("c") == _c(THING)), "s", T.TYPE, "r"))
        out.append(_triple(used.join(_at(f, T.TYPE, "o", "c").select("o", "c"), ["o", "c"], "left_semi"), "s", T.TYPE, "r"))
    if ALL in schema.has:
        every = _at(schema.axioms, ALL, "r", "c").select("r", "c", "c__k", "c__x").join(on.select("r", "p"), "r")
        held = types.select(col("x").alias("s"), "r").join(every, "r")
        out.append(_triple(f.where(col("o__k") != T.LITERAL).select("s", "p", *_node(f, "o", "o")).join(held, ["s", "p"]), "o", T.TYPE, "c"))
    for chain, p in lists["chains"]:
        step = None
        for q in chain:
            own = f.where(col("p") == F.lit(q))
            if step is None:
                step = own.select(*_node(own, "s", "s"), *_node(own, "o", "e"))
            else:
                step = step.select("s", "s__k", "s__x", col("e").alias("m")).join(own.select(col("s").alias("m"), *_node(own, "o", "e")), "m").drop("m")
        out.append(_triple(step.crossJoin(F.broadcast(_named(f, p, "q"))), "s", "q", "e"))  # one row
    typed = lambda df: df.where(col("p") == _c(T.TYPE))
    for parts, c in lists["intersections"]:
        have = typed(f).where(col("o").isin(*parts)).groupBy("s", "s__k", "s__x").agg(F.count_distinct("o").alias("n")).where(col("n") == len(set(parts)))
        out.append(_triple(have.crossJoin(F.broadcast(_named(f, c, "c"))), "s", T.TYPE, "c"))
        for x in set(parts):
            out.append(_triple(typed(d).where(col("o") == c).crossJoin(F.broadcast(_named(f, x, "c"))), "s", T.TYPE, "c"))
    for parts, c in lists["unions"]:
        out.append(_triple(typed(d).where(col("o").isin(*parts)).crossJoin(F.broadcast(_named(f, c, "c"))), "s", T.TYPE, "c"))
    return out


def _named(f: DataFrame, i: int, name: str) -> DataFrame:
    """One row: a node of the schema."""
    rows = f.where(F.col("s") == F.lit(i)).select("s", "s__k", "s__x").unionByName(f.where(F.col("o") == F.lit(i)).select("o", "o__k", "o__x").toDF("s", "s__k", "s__x"))
    row = rows.first()
    return f.sparkSession.createDataFrame([tuple(row)], f"{name} long, {name}__k int, {name}__x string")


def _lists(f: DataFrame) -> dict:
    """Chains, intersections and unions with their members, as ids."""
    cells = f.where(F.col("p").isin(_c(T.RDF + "first"), _c(T.RDF + "rest"))).select("s", "p__x", "o").limit(MAX_LIST_CELLS + 1).collect()
    if len(cells) > MAX_LIST_CELLS:
        raise InferenceError(f"more than {MAX_LIST_CELLS} list cells")
    first = {r["s"]: r["o"] for r in cells if r["p__x"] == T.RDF + "first"}
    rest = {r["s"]: r["o"] for r in cells if r["p__x"] != T.RDF + "first"}

    def members(x):
        out, seen = [], set()
        while x in first and x not in seen:
            seen.add(x)
            out.append(first[x])
            x = rest.get(x)
        return out

    kinds = {"propertyChainAxiom": "chains", "intersectionOf": "intersections", "unionOf": "unions"}
    out = {name: [] for name in kinds.values()}
    if cells:
        for r in f.where(F.col("p").isin(*[_c(T.OWL + x) for x in kinds])).select("s", "p__x", "o").collect():
            if members(r["o"]):
                out[kinds[r["p__x"].removeprefix(T.OWL)]].append((members(r["o"]), r["s"]))
    return out


def _fresh(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct facts found that are not known, as a table."""
    found = stage(found.dropDuplicates(KEY), "found")
    predicates = [r[0] for r in found.select("p").distinct().limit(FEW_IDS + 1).collect()]
    if len(predicates) <= FEW_IDS:
        facts = facts.where(F.col("p").isin(*predicates))
    known = facts.select(*KEY).join(found.select(*KEY), KEY, "left_semi")  # reads the found ones into a hash table if they are few
    return stage(found.join(known, KEY, "left_anti"), "derived")


class Equal:
    """Representatives of nodes that owl:sameAs makes equal: (id, r, r__k, r__x)."""

    def __init__(self):
        self.table: DataFrame | None = None

    def merge(self, facts: DataFrame) -> bool:
        """Takes in the sameAs facts; whether there are new ones."""
        same = facts.where((F.col("p") == _c(SAME)) & (F.col("s") != F.col("o")) & (F.col("o__k") != T.LITERAL))
        same = stage(same.select("s", "s__k", "s__x", "o", "o__k", "o__x"), "same")
        if same.isEmpty():
            return False
        nodes = same.select("s", "s__k", "s__x").unionByName(same.select("o", "o__k", "o__x").toDF("s", "s__k", "s__x")).toDF("id", "k", "x")
        links = same.select(F.col("s").alias("a"), F.col("o").alias("b"))
        if self.table is not None:
            links = links.unionByName(self.table.select(F.col("id").alias("a"), F.col("r").alias("b")))
            nodes = nodes.unionByName(self.table.select("id", "k", "x"))
        groups = connected(links).join(nodes.dropDuplicates(["id"]), "id")
        # an IRI stands for its group if there is one
        best = groups.groupBy("root").agg(F.min(F.struct("k", "id", "x")).alias("b"))
        self.table = stage(groups.join(best, "root").select("id", "k", "x", F.col("b.id").alias("r"), F.col("b.k").alias("r__k"), F.col("b.x").alias("r__x")), "equal")
        return True

    def fold(self, facts: DataFrame) -> DataFrame:
        """Facts of representatives; sameAs itself is left to the table."""
        changed = self.table.where("id <> r")
        out = facts.where(F.col("p") != _c(SAME))
        for c in ("s", "p", "o"):
            to = changed.select(F.col("id").alias(c), F.col("r").alias("__r"), F.col("r__k").alias("__k"), F.col("r__x").alias("__x"))
            if c == "p":
                to = _of_predicates(to.where(F.col("__k") == T.IRI), out)
            out = _renamed(out, to, c)
        return stage(out.select(*FACT).dropDuplicates(KEY), "folded")

    def expand(self, facts: DataFrame) -> DataFrame:
        """Facts of all nodes, without the sameAs pairs of different ones that the groups stand for."""
        same = (F.col("p") == _c(SAME)) & (F.col("s") == F.col("o"))
        each = self.table.select(F.col("r").alias("s"), F.col("id").alias("__r"), F.col("k").alias("__k"), F.col("x").alias("__x"))
        of = {c: each.withColumnRenamed("s", c) for c in ("s", "p", "o")}
        of["p"] = _of_predicates(of["p"].where(F.col("__k") == T.IRI), facts)
        out = facts.where(~same).withColumn("__one", F.col("s") == F.col("o"))
        for c in ("s", "p", "o"):
            out = _renamed(out, of[c], c)
        out = out.where(~((F.col("p") == _c(SAME)) & F.col("__one") & (F.col("s") != F.col("o"))))
        own = _renamed(facts.where(same), of["s"], "s").withColumns({"o": F.col("s"), "o__k": F.col("s__k"), "o__x": F.col("s__x")})
        return out.select(*FACT).unionByName(own.select(*FACT))

    def groups(self) -> DataFrame:
        """(r, id, k, x) of the nodes of all groups."""
        return self.table.select("r", "id", "k", "x")


def _of_predicates(table: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of a table by p whose p is a predicate of the facts: facts of one predicate are many, so few rows should meet them."""
    predicates = [r[0] for r in facts.select("p").distinct().limit(FEW_IDS + 1).collect()]
    if len(predicates) > FEW_IDS:
        return table
    rows = table.where(F.col("p").isin(*predicates)).limit(FEW_ROWS + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if len(rows) <= FEW_ROWS else table


def _renamed(facts: DataFrame, to: DataFrame, c: str) -> DataFrame:
    """Facts whose node at c is replaced by each of the nodes (__r, __k, __x) that a table has for it, if any."""
    out = facts.join(to, c, "left")
    new = {c: F.coalesce("__r", F.col(c)), f"{c}__x": F.coalesce("__x", F.col(f"{c}__x"))}
    if c != "p":
        new[f"{c}__k"] = F.coalesce("__k", F.col(f"{c}__k"))
    return out.withColumns(new).drop("__r", "__k", "__x")


def closure(base: DataFrame, graph: int, profile: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Inferred quads of a graph, what the rules add to its asserted ones; and, if nodes are equal, (groups of equal nodes, asserted pairs of them).

    The groups stand for the sameAs quads of all pairs of different members that are not asserted.
    """
    owl = profile == "owl-rl"
    facts = delta = base.select(*FACT)
    derived: list[DataFrame] = []
    equal, schema = Equal(), Schema(facts, owl)
    lists = _lists(facts) if owl else {}
    renewed = True
    for _ in range(ROUNDS):
        made = schema.one_premise(delta) + (schema.facts() if renewed else [])
        if owl:
            made += _two_premises(facts, delta, schema, lists)
        new = _fresh(_union(made), facts) if made else None
        if new is not None and not new.isEmpty():
            derived.append(new)
            facts = facts.unionByName(new)
            if not owl and schema.plain:
                break
            again = Schema(facts, owl)
            renewed, schema = again.state != schema.state, again
            delta = facts if renewed else new
            continue
        if not owl or not equal.merge(facts):
            break
        facts = delta = equal.fold(facts)
        derived = [facts]
        schema, lists, renewed = Schema(facts, owl), _lists(facts), True
    else:
        raise InferenceError(f"no fixed point after {ROUNDS} rounds")
    if not derived:
        out = base.sparkSession.createDataFrame([], base.schema).select(*FACT)
    else:
        out = _union(derived)
    groups = None
    if equal.table is not None:
        out = equal.expand(out).dropDuplicates(KEY).join(base.select(*KEY), KEY, "left_anti")
        groups = equal.groups(), base.where((F.col("p") == _c(SAME)) & (F.col("s") != F.col("o")) & (F.col("o__k") != T.LITERAL)).select("s", "o")
    return out.withColumns({"g": F.lit(graph).cast("long"), "inferred": F.lit(True)}).select(*T.QUAD), groups
