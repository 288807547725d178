"""Property paths as relations of node ids.

``+``, ``*`` and ``?`` are sets of pairs; alternatives and sequences keep their
duplicates as SPARQL says, unless ``distinct_alternatives`` asks for sets.  A zero-length path relates every
node in scope to itself, and a bound end to itself whether it is in the data or not.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..plans import algebra as A
from ..plans.compiler import GRAPH_KEY, Rel, Scope, col
from .closure import stage, transitive

#: Predicates of which a materialised closure answers ``+`` by a scan, if no graph in scope has changed since.
CLOSED = {T.RDFS + "subClassOf", T.RDFS + "subPropertyOf", T.OWL + "sameAs"}


class PathTruncated(RuntimeError):
    pass


class Paths:
    def __init__(self, max_depth: int = 64, on_truncation: str = "warn", distinct_alternatives: bool = False):
        self.configure(max_depth, on_truncation)
        self.distinct_alternatives, self.truncations, self.made = distinct_alternatives, 0, 0

    def configure(self, max_depth: int, on_truncation: str):
        if not 1 <= max_depth <= 1024:
            raise ValueError("path depth is 1 to 1024")
        if on_truncation not in ("count", "warn", "error"):
            raise ValueError("truncation policy is count, warn or error")
        self.max_depth, self.on_truncation = max_depth, on_truncation

    def steps(self, triples) -> list[A.Triple]:
        """Triples with sequence paths taken apart."""

        def fresh() -> str:
            self.made += 1
            return f"_step{self.made}"

        return [x for t in triples for x in expand(t, fresh)]

    def _note(self, cut: bool):
        if not cut:
            return
        self.truncations += 1
        if self.on_truncation == "error":
            raise PathTruncated(f"sparql: property path truncated at {self.max_depth} steps")
        if self.on_truncation == "warn":
            warnings.warn(f"property path truncated at {self.max_depth} steps", stacklevel=2)

    # ids

    def pairs(self, data, p, scope: Scope, start=None, end=None) -> DataFrame:
        """(a, b, g) of a path; start and end: a term that alone is asked for."""
        p = _plain(p)
        if isinstance(p, A.Link):
            return data.edges([p.iri], [], scope, start, end)
        if isinstance(p, A.Inverse):
            return self.pairs(data, p.path, scope, end, start).select(F.col("b").alias("a"), F.col("a").alias("b"), "g")
        if isinstance(p, A.Alternative):
            if all(isinstance(x, A.Link) for x in p.parts):
                found = data.edges([x.iri for x in p.parts], [], scope, start, end)
            else:
                found = self.pairs(data, p.parts[0], scope, start, end)
                for x in p.parts[1:]:
                    found = found.unionByName(self.pairs(data, x, scope, start, end))
            return found.distinct() if self.distinct_alternatives else found
        if isinstance(p, A.Sequence):
            found = self.pairs(data, p.parts[0], scope, start, None)
            for i, x in enumerate(p.parts[1:], 1):
                after = self.pairs(data, x, scope, None, end if i == len(p.parts) - 1 else None)
                found = found.join(after.select(F.col("a").alias("b"), F.col("b").alias("c"), "g"), ["b", "g"]).select("a", F.col("c").alias("b"), "g")
            return found
        if isinstance(p, A.NotIn):
            parts = []
            if p.forward or not p.backward:
                parts.append(data.edges(None, list(p.forward), scope, start, end))
            if p.backward:
                parts.append(data.edges(None, list(p.backward), scope, end, start).select(F.col("b").alias("a"), F.col("a").alias("b"), "g"))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if isinstance(p, A.Repeat):
            return self._repeat(data, p, scope, start, end)
        raise A.Unsupported(f"path {p}")

    @staticmethod
    def _ends(df: DataFrame, start, end) -> DataFrame:
        if start is not None:
            df = df.where(F.col("a") == T.id_lit(start))
        return df if end is None else df.where(F.col("b") == T.id_lit(end))

    def _repeat(self, data, p: A.Repeat, scope: Scope, start, end) -> DataFrame:
        spark = data.spark
        if not p.many:
            found = self.pairs(data, p.path, scope, start, end).distinct()
        elif isinstance(p.path, A.Link) and p.path.iri in CLOSED and data.closed_predicate(p.path.iri, scope):
            edges = data.edges([p.path.iri], [], scope)
            # the closure is stored without the pairs of a node with itself, which those on a cycle have
            back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "g")
            cycles = edges.join(back, ["a", "b", "g"], "left_semi").select("a", F.col("a").alias("b"), "g")
            found = self._ends(edges.unionByName(cycles), start, end).distinct()
        else:
            seed = start or end
            seeds = spark.range(1).select(T.id_lit(seed).alias("id")) if seed is not None else None
            found, cut = transitive(self.pairs(data, p.path, scope), self.max_depth, seeds, backwards=start is None and end is not None)
            self._note(cut)
            found = self._ends(found, start, end)
        if p.least:
            return found
        nodes = data.nodes(scope).select("id", "g")
        if start is not None or end is not None:
            one = spark.range(1).select(T.id_lit(start if start is not None else end).alias("id"), F.lit(0).cast("long").alias("g"))
            nodes = nodes.where(F.col("id") == T.id_lit(start if start is not None else end)) if scope.kind == "each" else one
        same = self._ends(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), "g"), start, end)
        return found.unionByName(same).distinct()

    # solutions

    def relation(self, compiler, t: A.Triple, scope: Scope) -> Rel:
        data, p = compiler.data, _plain(t.p)
        if isinstance(p, A.Link):
            return data.scan(A.Triple(t.s, T.iri(p.iri), t.o), scope)
        if isinstance(p, A.Inverse) and isinstance(_plain(p.path), A.Link):
            return data.scan(A.Triple(t.o, T.iri(_plain(p.path).iri), t.s), scope)
        if isinstance(p, A.NotIn):  # one edge bears both its ends, so no nodes are looked up
            rels = [data.outside(t.s, t.o, list(p.forward), scope)] if p.forward or not p.backward else []
            rels += [data.outside(t.o, t.s, list(p.backward), scope)] if p.backward else []
            return Rel(reduce(DataFrame.unionByName, [r.df for r in rels]), rels[0].vars, rels[0].graph)
        start = t.s if isinstance(t.s, T.Term) else None
        end = t.o if isinstance(t.o, T.Term) else None
        df = self.pairs(data, p, scope, start, end)
        names: dict[str, str] = {}
        if isinstance(t.s, A.Var):
            names[t.s.name] = "a"
        if isinstance(t.o, A.Var):
            if t.o.name in names:
                df = df.where("a = b")
            else:
                names[t.o.name] = "b"
        # parts of the terms, for each end that is a variable; a constant at the other end may be such a node itself
        # which are ends of the path's own edges, unless it may be empty between two variables
        known = _links(p)
        if start is None and end is None and _may_be_empty(p):
            known = None
        among = None
        if known is None and (start is not None or end is not None):
            # any node may be an end: those that are not are left out before the others are made unique
            df = stage(df, "path")
            among = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("id")) for c in names.values()]).distinct() if names else None
        nodes = data.nodes(scope, known, among).select("id", "k", "x", "d", "l").dropDuplicates(["id"])
        for c in (start, end):
            if c is not None:
                own = data.spark.range(1).select(T.id_lit(c).alias("id"), *(F.lit(getattr(c, f)).alias(n) for f, n in (("kind", "k"), ("lex", "x"), ("dt", "d"), ("lang", "l"))))
                nodes = nodes.unionByName(own).dropDuplicates(["id"])
        keep = []
        for v, end_col in names.items():
            numbers = T.number(F.col("x"), F.col("d")).alias(T.part(col(v), "n")), T.exact(F.col("x"), F.col("d")).alias(T.part(col(v), "e"))
            parts = nodes.select(F.col("id").alias(end_col), *(F.col(p).alias(T.part(col(v), p)) for p in T.PARTS), *numbers)
            df = df.join(parts, end_col)
            keep += [F.col(end_col).alias(col(v)), *(F.col(c) for c in T.columns(col(v))[1:])]
        if scope.kind == "each":
            keep.append(F.col("g").alias(GRAPH_KEY))
        return Rel(df.select(*keep) if keep else df.select(F.lit(1).alias("__unit")), dict.fromkeys(names, False), scope.kind == "each")


def _links(p) -> list[str] | None:
    """The predicates of a path; None if any other predicate may be among them."""
    if isinstance(p, A.Link):
        return [p.iri]
    if isinstance(p, A.NotIn):
        return None
    parts = [_links(x) for x in (p.parts if isinstance(p, (A.Sequence, A.Alternative)) else (p.path,))]
    return None if None in parts else sorted({x for own in parts for x in own})


def _may_be_empty(p) -> bool:
    if isinstance(p, A.Repeat):
        return not p.least or _may_be_empty(p.path)
    if isinstance(p, A.Inverse):
        return _may_be_empty(p.path)
    if isinstance(p, (A.Sequence, A.Alternative)):
        return any(_may_be_empty(x) for x in p.parts)
    return False


def expand(t: A.Triple, fresh) -> list[A.Triple]:
    """The steps of a sequence as triples of their own, so each is a scan."""
    p = _plain(t.p) if not isinstance(t.p, (A.Var, T.Term)) else t.p
    if not isinstance(p, A.Sequence):
        return [t]
    ends = [t.s, *(A.Var(fresh()) for _ in p.parts[1:]), t.o]
    out = []
    for a, x, b in zip(ends, p.parts, ends[1:]):
        x = _plain(x)
        if isinstance(x, A.Inverse) and isinstance(x.path, A.Link):
            a, x, b = b, x.path, a
        out += expand(A.Triple(a, T.iri(x.iri) if isinstance(x, A.Link) else x, b), fresh)
    return out


def _plain(p):
    """The path with double inverses removed and inverses moved inside."""
    if isinstance(p, T.Term):
        return A.Link(p.lex)
    if not isinstance(p, A.Inverse):
        return p
    q = _plain(p.path)
    if isinstance(q, A.Inverse):
        return _plain(q.path)
    if isinstance(q, A.Sequence):
        return A.Sequence(tuple(A.Inverse(x) for x in reversed(q.parts)))
    if isinstance(q, A.Alternative):
        return A.Alternative(tuple(A.Inverse(x) for x in q.parts))
    if isinstance(q, A.NotIn):
        return A.NotIn(q.backward, q.forward)
    if isinstance(q, A.Repeat):
        return A.Repeat(A.Inverse(q.path), q.least, q.many)
    return A.Inverse(q)
