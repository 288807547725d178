"""A dataset of stored quads, as the compiler scans it.

Quads carry the ids and the parts of their terms side by side, so a query reads
only the columns it uses and decodes nothing by a join.  How they stand on disk
is told in ``segments``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..plans import algebra as A
from ..plans.compiler import GRAPH_KEY, Rel, Scope, col

SCHEMA = "s long, s__k int, s__x string, p long, p__x string, o long, o__k int, o__x string, o__d string, o__l string, g long, inferred boolean"
GRAPHS = "graph_id long, iri string, locked boolean, lock_reason string, locked_at timestamp, source_sha256 string, source_loads int"

PLACES = {"s": ("s", "s__k", "s__x", None, None), "p": ("p", None, "p__x", None, None), "o": ("o", "o__k", "o__x", "o__d", "o__l")}


def with_ids(df: DataFrame) -> DataFrame:
    """Quads from (s__k, s__x, p__x, o__k, o__x, o__d, o__l, g[, inferred])."""
    none = F.lit("")
    df = df.withColumns({
        "s": T.id_of(F.col("s__k"), F.col("s__x"), none, none),
        "p": T.id_of(F.lit(T.IRI), F.col("p__x"), none, none),
        "o": T.id_of(F.col("o__k"), F.col("o__x"), F.col("o__d"), F.col("o__l")),
    })
    if "inferred" not in df.columns:
        df = df.withColumn("inferred", F.lit(False))
    return df.select(*T.QUAD)


def from_triples(spark: SparkSession, rows, graph: int = 0, inferred: bool = False) -> DataFrame:
    """Quads of (subject, predicate, object) or (.., graph id) tuples of terms."""
    flat = [(t[0].kind, t[0].lex, t[1].lex, t[2].kind, t[2].lex, t[2].dt, t[2].lang, t[3] if len(t) > 3 else graph, inferred) for t in rows]
    return with_ids(spark.createDataFrame(flat, "s__k int, s__x string, p__x string, o__k int, o__x string, o__d string, o__l string, g long, inferred boolean"))


def place(df: DataFrame, where: str, v: str) -> list:
    """The columns of a variable taken from one place of a quad."""
    i, k, x, d, lang = PLACES[where]
    return [
        F.col(i).alias(col(v)),
        (F.col(k) if k else F.lit(T.IRI)).alias(T.part(col(v), "k")),
        F.col(x).alias(T.part(col(v), "x")),
        (F.col(d) if d else F.lit("")).alias(T.part(col(v), "d")),
        (F.col(lang) if lang else F.lit("")).alias(T.part(col(v), "l")),
        (T.number(F.col(x), F.col(d)) if d else F.lit(None).cast("double")).alias(T.part(col(v), "n")),
        (T.exact(F.col(x), F.col(d)) if d else T.no_exact()).alias(T.part(col(v), "e")),
    ]


class QuadDataset:
    """quads: DataFrame of terms.QUAD; graphs: DataFrame (graph_id, iri, ..)."""

    def __init__(self, quads: DataFrame, graphs: DataFrame, ids: tuple[int, ...] = (), closed: dict[int, str] | None = None):
        """ids: the graphs that hold quads; closed: graph -> the profile it was materialised with and not changed since."""
        self.quads, self.graphs, self.spark = quads, graphs, quads.sparkSession
        self.ids, self.closed = ids, dict(closed or {})

    def named_graphs(self) -> DataFrame:
        return self.graphs.where("graph_id <> 0").select("graph_id", "iri")

    def graph_id(self, iri: str) -> int | None:
        row = self.graphs.where(F.col("iri") == iri).select("graph_id").first()
        return row[0] if row else None

    def star_groups(self, triples) -> list:
        return [[t] for t in triples]

    def star(self, triples, scope):
        raise NotImplementedError

    def scoped(self, scope: Scope) -> DataFrame:
        df = self.quads
        if scope.kind == "one":
            return df.where(F.col("g") == scope.graph)
        if scope.kind == "each":
            df = df.where(F.col("g") != 0)
        if scope.among is not None:
            df = df.where(F.col("g").isin(*scope.among) if scope.among else F.lit(False))
        if scope.kind == "all" and len(scope.among or ()) > 1:
            df = df.dropDuplicates(["s", "p", "o"])  # graphs of FROM are merged as sets
        return df

    def scan(self, t: A.Triple, scope: Scope) -> Rel:
        return self._places(self.scoped(scope), (("s", t.s), ("p", t.p), ("o", t.o)), scope)

    def outside(self, s, o, excluded: list[str], scope: Scope) -> Rel:
        """The edges from s to o of all predicates but the excluded ones, as solutions."""
        df = self.scoped(scope)
        if excluded:
            df = df.where(~F.col("p").isin(*[T.id_lit(T.iri(p)) for p in excluded]))
        return self._places(df, (("s", s), ("o", o)), scope)

    def _places(self, df: DataFrame, at, scope: Scope) -> Rel:
        first: dict[str, str] = {}
        for where, x in at:
            if isinstance(x, T.Term):
                df = df.where(F.col(where) == T.id_lit(x))
            elif x.name in first:
                df = df.where(F.col(where) == F.col(first[x.name]))
            else:
                first[x.name] = where
        out = [c for v, where in first.items() for c in place(df, where, v)]
        if scope.kind == "each":
            out.append(F.col("g").alias(GRAPH_KEY))
        return Rel(df.select(*out) if out else df.select(F.lit(1).alias("__unit")), dict.fromkeys(first, False), scope.kind == "each")

    def edges(self, predicates: list[str] | None, excluded: list[str], scope: Scope, start: T.Term | None = None, end: T.Term | None = None) -> DataFrame:
        """(a, b, g) ids of the edges of some predicates, or of all but the excluded ones, between all nodes or from and to one."""
        df = self.scoped(scope)
        if predicates is not None:
            df = df.where(F.col("p").isin(*[T.id_lit(T.iri(p)) for p in predicates]))
        if excluded:
            df = df.where(~F.col("p").isin(*[T.id_lit(T.iri(p)) for p in excluded]))
        for c, t in (("s", start), ("o", end)):
            if t is not None:
                df = df.where(F.col(c) == T.id_lit(t))
        return df.select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("g") if scope.kind == "each" else F.lit(0).cast("long").alias("g"))

    def nodes(self, scope: Scope, predicates: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
        """(id, k, x, d, l, g) of all subjects and objects, or of those of some predicates or among some ids; g is 0 outside GRAPH ?g."""
        df = self.scoped(scope)
        if predicates is not None:
            df = df.where(F.col("p").isin(*[T.id_lit(T.iri(p)) for p in predicates]))
        g = F.col("g") if scope.kind == "each" else F.lit(0).cast("long").alias("g")
        subjects = df.select(F.col("s").alias("id"), F.col("s__k").alias("k"), F.col("s__x").alias("x"), F.lit("").alias("d"), F.lit("").alias("l"), g)
        objects = df.select(F.col("o").alias("id"), F.col("o__k").alias("k"), F.col("o__x").alias("x"), F.col("o__d").alias("d"), F.col("o__l").alias("l"), g)
        out = subjects.unionByName(objects)
        return (out if among is None else out.join(among, "id", "left_semi")).dropDuplicates(["id", "g"])

    def closed_predicate(self, predicate: str, scope: Scope) -> bool:
        """Whether the quads of a predicate hold its closure in every graph in scope.

        Several graphs seen as one have paths that cross from one to another, so they never count as closed.
        """
        if scope.kind == "one":
            graphs = [scope.graph]
        else:
            graphs = [g for g in self.ids if (scope.among is None or g in scope.among) and (g or scope.kind != "each")]
        if scope.kind == "all" and len(graphs) != 1:
            return False
        profiles = ("owl-rl",) if predicate == T.OWL + "sameAs" else ("rdfs", "owl-rl")
        return all(self.closed.get(g) in profiles for g in graphs)
