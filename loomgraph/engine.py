"""The engine: a graph store with SPARQL, updates, graph lifecycle, reasoning and validation.

State is a list of immutable segments of quads and a small table of graphs.  Each change adds segments, or
replaces those it touches, and commits a new version.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .operators import canon, inference, integrity, neighbourhood, shacl
from .operators.closure import scratch, shared_dir, stage
from .operators.paths import Paths
from .plans import algebra as A
from .plans.compiler import GRAPH_KEY, Compiler, Rel, Scope, col, pattern_variables
from .plans.describe import describe_algebra
from .plans.parser import parse_query, parse_update
from .sources import rdf
from .sources.quads import GRAPHS, QuadDataset, from_triples, with_ids
from .sources.segments import SPREAD, SegmentStore

__version__ = "0.1.0"
SYNTHETIC = "urn:graph:"
#: Up to so many ids are put into the filter of a scan.
FEW = 1000
TERM = "type string, value string, datatype string, language string"


class GraphError(ValueError):
    pass


class Locked(GraphError):
    pass


class Queries:
    """SPARQL over any dataset that the compiler can scan."""

    def __init__(self, dataset, max_depth: int = 64, on_truncation: str = "warn", distinct_alternatives: bool = False, spark: SparkSession | None = None):
        self.dataset, self.spark = dataset, spark or dataset.spark
        self.paths = Paths(max_depth, on_truncation, distinct_alternatives)
        self._parsed: dict[str, A.Query] = {}
        self.functions: dict = {}
        self.__dict__.setdefault("counters", {"queries": 0})

    def register_function(self, iri: str, f, datatype: str = T.STRING):
        """Binds an IRI to a function of columns: it gets the lexical forms of its arguments (numbers for numeric ones are up to it)
        and returns a column, whose value is a literal of ``datatype``."""
        self.functions[iri] = (f, datatype)

    def _parse(self, text: str) -> A.Query:
        if text not in self._parsed:
            if len(self._parsed) >= 256:
                self._parsed.pop(next(iter(self._parsed)))
            self._parsed[text] = parse_query(text)
        return self._parsed[text]

    def plan_cache_clear(self) -> int:
        n = len(self._parsed)
        self._parsed.clear()
        return n

    def _compiler(self) -> Compiler:
        return Compiler(self.dataset, self.paths, self.functions)

    def _scope(self, q: A.Query) -> Scope:
        """FROM gives the graphs of plain patterns, FROM NAMED those that GRAPH sees; with either, what is not listed is not there."""
        if not q.dataset and not q.named:
            return Scope()
        ids = lambda names: tuple(g for g in map(self.dataset.graph_id, names) if g is not None)
        return Scope("all", among=ids(q.dataset), named=ids(q.named))

    def sparql(self, text: str, types: dict[str, str] | None = None) -> DataFrame:
        """SELECT: one string column for each variable, cast by ``types``.  ASK: one row with ``_ask``."""
        q = self._parse(text)
        self.counters["queries"] += 1
        if q.form == "ASK":
            rel = self._compiler().compile(q.select.pattern, self._scope(q))
            return rel.df.limit(1).agg(F.when(F.count(F.lit(1)) > 0, "true").otherwise("false").alias("_ask"))
        if q.form != "SELECT":
            raise A.SparqlError(f"sparql: query form {q.form} has its own method")
        return self._rows(q.select, self._scope(q), types or {})

    def _rows(self, select: A.Select, scope: Scope, types: dict) -> DataFrame:
        compiler = self._compiler()
        rel = compiler.solutions(select, scope)
        df = compiler.sliced(rel, select)
        names = [v for v in (pattern_variables(select.pattern) if select.star else [v for v, _ in select.items]) if v in rel.vars and not v.startswith("_")]
        out = []
        for v in names:
            c = F.col(T.part(col(v), "x"))
            out.append((c.try_cast(types[v]) if v in types else c).alias(v))
        return df.select(*out) if out else df.select(F.lit(None).cast("string").alias("_unit"))

    def terms(self, text: str) -> DataFrame:
        """SELECT with each variable as a struct (type, value, datatype, language)."""
        q = self._parse(text)
        rel = self._compiler()._select(q.select, self._scope(q))
        return rel.df.select(*(struct(v).alias(v) for v in rel.vars if not v.startswith("_")))

    def explain(self, text: str, mode: str = "formatted") -> str:
        df = self.sparql(text)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    @staticmethod
    def sparql_parse(text: str) -> dict:
        """What a query or update is made of, without running it."""
        return describe_algebra(text)

    # CONSTRUCT and DESCRIBE

    def construct_quads(self, template, rel: Rel, graph: int = 0) -> DataFrame:
        """The triples of a template over solutions, as a set: (s__k .. o__l, g).  Blank nodes are fresh for each solution."""
        if not template:
            raise A.SparqlError("construct: empty template")
        names = set(rel.vars)
        for t, _ in template:
            for x in (t.s, t.p, t.o):
                if isinstance(x, A.Var) and not x.name.startswith(("_b_", "_anon")) and x.name not in names:
                    raise A.SparqlError(f"construct: unbound template variable ?{x.name}")
        key = F.xxhash64(*[F.col(col(v)) for v in sorted(rel.vars)]) if rel.vars else F.lit(0)

        def parts(x, where):
            if isinstance(x, T.Term):
                return F.lit(x.kind), F.lit(x.lex), F.lit(x.dt), F.lit(x.lang)
            if x.name not in names:
                return F.lit(T.BNODE), F.concat(F.lit(f"c{x.name}"), F.hex(key)), F.lit(""), F.lit("")
            return tuple(F.col(T.part(col(x.name), p)) for p in T.PARTS)

        rows = []
        for t, g in template:
            s, p, o = parts(t.s, "s"), parts(t.p, "p"), parts(t.o, "o")
            if isinstance(g, A.Var):
                gid = F.col(T.part(col(g.name), "x"))
            else:
                gid = F.lit(g.lex if g is not None else None).cast("string")
            ok = s[0].isin(T.IRI, T.BNODE) & (p[0] == T.IRI) & o[0].isNotNull()
            rows.append(F.when(ok, F.struct(s[0].cast("int").alias("s__k"), s[1].alias("s__x"), p[1].alias("p__x"), o[0].cast("int").alias("o__k"), o[1].alias("o__x"), o[2].alias("o__d"), o[3].alias("o__l"), gid.alias("graph"))))
        df = rel.df.select(F.explode(F.array(*rows)).alias("t")).where("t IS NOT NULL").select("t.*")
        return df.distinct().withColumn("g", F.lit(graph).cast("long"))

    def construct(self, text: str) -> DataFrame:
        """Distinct triples: structs subject, predicate, object."""
        q = self._parse(text)
        if q.form != "CONSTRUCT":
            raise A.SparqlError("construct: not a CONSTRUCT query")
        s = q.select
        if s.group or s.having:
            raise A.SparqlError("construct: GROUP BY is not supported")
        rel = self._compiler()._select(s, self._scope(q))
        return triples_of(self.construct_quads([(t, None) for t in q.template], rel))

    def describe(self, text: str) -> DataFrame:
        """Outgoing triples of each resource, and of blank nodes that they reach."""
        q = self._parse(text)
        if q.form != "DESCRIBE":
            raise A.SparqlError("describe: not a DESCRIBE query")
        scope = self._scope(q)
        spark, seeds = self.spark, None
        constants = [r for r in q.resources if isinstance(r, T.Term)]
        if constants:
            seeds = spark.range(1).select(F.explode(F.array(*[T.id_lit(r) for r in constants])).alias("id"))
        pattern = q.select.pattern
        names = pattern_variables(pattern) if q.resources == ("*",) else [r.name for r in q.resources if isinstance(r, A.Var)]
        if names:
            rel = self._compiler()._select(q.select, scope)
            for v in names:
                own = rel.df.select(F.col(col(v)).alias("id")).where("id IS NOT NULL")
                seeds = own if seeds is None else seeds.unionByName(own)
        if seeds is None:
            raise A.SparqlError("describe: nothing to describe")
        graphs = [p for p in [pattern] if isinstance(p, A.Graph) and isinstance(p.name, T.Term)]
        if graphs:
            g = self.dataset.graph_id(graphs[0].name.lex)
            scope = Scope("one", -1 if g is None else g)
        quads = self.dataset.scoped(scope)
        found = front = stage(quads.join(seeds.distinct().withColumnRenamed("id", "s"), "s", "left_semi").select(*T.QUAD), "describe")
        seen = stage(seeds.distinct(), "seen")
        while True:
            new = front.where(F.col("o__k") == T.BNODE).select(F.col("o").alias("id")).distinct().join(seen, "id", "left_anti")
            new = stage(new, "front")
            if new.isEmpty():
                break
            seen = seen.unionByName(new)
            front = stage(quads.join(new.withColumnRenamed("id", "s"), "s", "left_semi").select(*T.QUAD), "describe")
            found = found.unionByName(front)
        return triples_of(found.dropDuplicates(["s", "p", "o"]))


def struct(v: str):
    k, x, d, lang = (F.col(T.part(col(v), p)) for p in T.PARTS)
    return term_struct(k, x, d, lang)


def term_struct(k, x, d, lang):
    kind = F.when(k == T.IRI, "iri").when(k == T.BNODE, "bnode").when(k == T.LITERAL, "literal")
    literal = F.lit(T.LITERAL) == k
    return F.when(k.isNotNull(), F.struct(kind.alias("type"), x.alias("value"), F.when(literal, d).alias("datatype"), F.when(literal & (lang != ""), lang).alias("language")))


def triples_of(df: DataFrame) -> DataFrame:
    none = F.lit("")
    return df.select(
        term_struct(F.col("s__k"), F.col("s__x"), none, none).alias("subject"),
        term_struct(F.lit(T.IRI), F.col("p__x"), none, none).alias("predicate"),
        term_struct(F.col("o__k"), F.col("o__x"), F.col("o__d"), F.col("o__l")).alias("object"),
    )


class GraphStore(Queries):
    """Named graphs of quads in immutable segments (sources.segments).

    Each change commits a new version; a query keeps the version that it began with until ``vacuum`` removes it.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, **settings):
        self.store = SegmentStore(spark, root or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
        told = self.store.refresh()
        self._graphs: dict[int, dict] = {g["graph_id"]: g | {"locked_at": g["locked_at"] and datetime.fromisoformat(g["locked_at"])} for g in told}
        self._graphs.setdefault(0, self._entry(0, SYNTHETIC + "0"))
        self.counters = {"queries": 0, "updates": 0, "loads": 0, "filter_clauses_dropped": 0}
        self._closed: dict[int, str] = {}
        super().__init__(None, **settings, spark=spark)
        self._refresh()

    @staticmethod
    def _entry(i: int, iri: str) -> dict:
        return {"graph_id": i, "iri": iri, "locked": False, "lock_reason": None, "locked_at": None, "source_sha256": None, "source_loads": 0}

    def _graph_frame(self, spark: SparkSession) -> DataFrame:
        order = [x.split()[0] for x in GRAPHS.split(", ")]
        return spark.createDataFrame([tuple(g[c] for c in order) for g in self._graphs.values()], GRAPHS)

    @property
    def quads(self) -> DataFrame:
        return self.dataset.quads

    @property
    def graphs(self) -> DataFrame:
        return self.dataset.graphs

    def _refresh(self):
        ids = tuple(sorted({s.g for s in self.store.segments}))
        self.dataset = QuadDataset(self.store.frame().drop("seg"), self._graph_frame(self.spark), ids, self._closed)

    def _commit(self, segments=None, changed=()):
        """Makes segments (if given) and the table of graphs the content of the next version; changed: graphs with other quads than before."""
        for g in changed:
            self._closed.pop(g, None)
        graphs = [g | {"locked_at": g["locked_at"] and g["locked_at"].isoformat()} for g in self._graphs.values()]
        self.store.commit(self.store.segments if segments is None else self.store.merged(segments), graphs)
        self._refresh()

    def save(self, path: str):
        """A copy of the newest version in a folder of its own, each graph in one segment."""
        other = SegmentStore(self.spark, path)
        graphs = [g | {"locked_at": g["locked_at"] and g["locked_at"].isoformat()} for g in self._graphs.values()]
        other.commit(other.write(self.quads, sum(s.rows for s in self.store.segments)), graphs)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **settings) -> GraphStore:
        return cls(spark, path, **settings)

    def vacuum(self, age_seconds: float = 3600) -> int:
        return self.store.vacuum(age_seconds)

    # graphs

    def _need_id(self, name: str, g) -> int:
        if isinstance(g, str):
            i = self.graph_id(g)
            if i is None:
                raise GraphError(f"{name}: unknown iri {g}")
            return i
        if g < 0:
            raise GraphError(f"{name}: graph_id must be >= 0")
        return g

    def _writable(self, g: int, verb: str):
        e = self._graphs.get(g)
        if e and e["locked"]:
            raise Locked(f"graph {g} is locked ({e['lock_reason']}): {verb} refused")

    def add_graph(self, graph, iri: str | None = None):
        """add_graph(id) -> whether it is new; add_graph(iri) -> its id; add_graph(id, iri) -> its id."""
        if isinstance(graph, str):
            found = self.graph_id(graph)
            if found is not None:
                return found
            graph, iri = max(self._graphs) + 1, graph
        elif iri is None:
            self._need_id("add_graph", graph)
            new = graph not in self._graphs
            if new:
                self._graphs[graph] = self._entry(graph, f"{SYNTHETIC}{graph}")
                self._commit()
            return new
        self._need_id("add_graph", graph)
        owner, e = self.graph_id(iri), self._graphs.get(graph)
        if owner is not None and owner != graph:
            raise GraphError(f"add_graph: {iri} is graph {owner}")
        if e and e["iri"] not in (iri, f"{SYNTHETIC}{graph}"):
            raise GraphError(f"add_graph: graph {graph} is {e['iri']}")
        self._graphs[graph] = (e or self._entry(graph, iri)) | {"iri": iri}
        self._commit()
        return graph

    def graph_id(self, iri: str) -> int | None:
        return next((i for i, g in self._graphs.items() if g["iri"] == iri), None)

    def graph_iri(self, graph: int) -> str | None:
        return self._graphs[graph]["iri"] if graph in self._graphs else None

    def count_quads(self, graph: int = 0) -> int:
        return self.store.rows(graph)

    def _of(self, graph: int) -> DataFrame:
        return self.quads.where(F.col("g") == graph)

    def drop_graph(self, graph, cascade: bool = True) -> int:
        g = self._need_id("drop_graph", graph)
        if g == 0:
            raise GraphError("drop_graph: cannot drop the default graph")
        self._writable(g, "drop")
        if not cascade and any(s.inferred for s in self.store.of(g)):
            raise GraphError(f"drop_graph: graph {g} has inferred quads")
        n = self.count_quads(g)
        self._graphs.pop(g, None)
        self._commit([s for s in self.store.segments if s.g != g], [g])
        return n

    def clear_graph(self, graph) -> int:
        g = self._need_id("clear_graph", graph)
        self._writable(g, "clear")
        n = self.count_quads(g)
        if n:
            self._commit([s for s in self.store.segments if s.g != g], [g])
        return n

    def copy_graph(self, src, dst) -> int:
        """Adds the quads of src to dst, inferred ones as such; an unknown source gives 0."""
        a, b = self._need_id("copy_graph", src), self._graph_for("copy_graph", dst)
        if a == b:
            raise GraphError("copy_graph: src and dst must differ")
        self._writable(b, "copy")
        return self._add(self._of(a).withColumn("g", F.lit(b).cast("long")), b)

    def move_graph(self, src, dst) -> int:
        a, b = self._need_id("move_graph", src), self._graph_for("move_graph", dst)
        if a == b:
            raise GraphError("move_graph: src and dst must differ")
        self._writable(a, "move")
        self._writable(b, "move")
        if self.count_quads(b):
            raise GraphError(f"move_graph: graph {b} is not empty")
        n = self.count_quads(a)
        self.add_graph(b)
        moved = self.store.write(self._of(a).withColumn("g", F.lit(b).cast("long")), n) if n else []
        if a != 0:
            self._graphs.pop(a, None)
        self._commit([s for s in self.store.segments if s.g != a] + moved, [a, b])
        return n

    def _graph_for(self, name: str, g) -> int:
        return self.add_graph(g) if isinstance(g, str) else self._need_id(name, g)

    def carve_graph(self, src, dst, predicate: str | None = None, seeds: list[str] | None = None, max_hops: int = 1) -> dict:
        """Copies the quads of one predicate, or the undirected ball of max_hops around seeds; gives counts and the rim."""
        a, b = self._need_id("carve_graph", src), self._need_id("carve_graph", dst) if not isinstance(dst, str) else None
        own, rim = self._of(a), None
        with scratch(self.spark):
            if predicate is not None:
                found = own.where(F.col("p") == T.id_lit(T.iri(predicate)))
            else:
                found, rim = neighbourhood.ball(own, [T.iri(s) for s in seeds or []], max_hops)
            found = stage(found.dropDuplicates(["s", "p", "o", "g"]), "carved")
            n = found.count()
            out = {"quads": n, "boundary": rim.count() if rim is not None else 0}
            if n:
                b = self.add_graph(dst) if b is None else b
                self._writable(b, "carve")
                self.add_graph(b)
                self._add(found.withColumn("g", F.lit(b).cast("long")), b)
        return out

    def lock_graph(self, graph, reason: str = "") -> bool:
        g = self._need_id("lock_graph", graph)
        self.add_graph(g)
        was = self._graphs[g]["locked"]
        self._graphs[g] |= {"locked": True, "lock_reason": reason, "locked_at": datetime.now(timezone.utc).replace(tzinfo=None)}
        self._commit()
        return not was

    def unlock_graph(self, graph, reason: str = "") -> bool:
        g = self._need_id("unlock_graph", graph)
        was = bool(self._graphs.get(g, {}).get("locked"))
        if was:
            self._graphs[g] |= {"locked": False, "lock_reason": None, "locked_at": None}
            self._commit()
        return was

    def graph_integrity(self, graph: int = 0) -> dict:
        return integrity.audit(self._of(graph))

    def graph_digest(self, graph: int = 0) -> str:
        """sha256 of the canonical N-Triples (RDFC-1.0) of the asserted quads.

        The standard hashes sorted lines one after another, so all lines pass the driver, one partition at a time.
        """
        return canon.digest(self._of(graph).where(~F.col("inferred")))

    def partitioned_digest(self, graph: int = 0) -> str:
        """A digest of the same lines that does not depend on their order: one aggregation, nothing sorted or gathered."""
        return canon.partitioned_digest(self._of(graph).where(~F.col("inferred")))

    # loading

    def put_quads(self, quads: DataFrame, graph: int | None = None, dedup: bool = True) -> int:
        """Adds a DataFrame of quads (terms.QUAD); gives how many are new."""
        return self._add(quads, graph, dedup)

    def _near(self, rows: DataFrame, n: int) -> DataFrame | None:
        """Stored quads (with ``seg``) among which all of ``rows`` (s, p, o, g) must be: filters that reach the files."""
        live = {s.g for s in self.store.segments}
        graphs = [r[0] for r in rows.select("g").distinct().collect() if r[0] in live]
        if not graphs:
            return None
        df = self.store.frame(self.store.of(*graphs))
        for c in ("p", "s") if n <= FEW else ("p",):
            ids = [r[0] for r in rows.select(c).distinct().limit(FEW + 1).collect()]
            if len(ids) <= FEW:
                df = df.where(F.col(c).isin(*ids))
        return df

    def _add(self, new: DataFrame, graph: int | None = None, dedup: bool = True) -> int:
        """Adds quads as new segments; gives how many are new.  A graph is a set of triples, unless ``dedup`` is off."""
        keys, n = ["s", "p", "o", "g"], None
        new = new.select(*T.QUAD)
        empty = not self.store.segments or graph is not None and not self.store.of(graph)
        with scratch(self.spark):
            if dedup:
                new = new.dropDuplicates(keys)
            if dedup and not empty:
                new = stage(new, "new")
                n = new.count()
                near = self._near(new, n)
                if near is not None:
                    if n <= SPREAD:
                        near = near.join(new.select(*keys), keys, "left_semi")
                    new = stage(new.join(near.select(*keys), keys, "left_anti"), "new")
                    n = new.count()
            segments = self.store.write(new, n) if n != 0 else []
        if graph is not None and graph not in self._graphs:
            self.add_graph(graph)
        if segments:
            self._commit([*self.store.segments, *segments], [x.g for x in segments])
        return sum(x.rows for x in segments)

    def _resolve(self, rows: DataFrame, default: int, strict: bool, name: str) -> DataFrame:
        """Rows with graph IRIs as rows with graph ids; new graphs are allocated, or refused if ``strict``."""
        rows = stage(rows, "parsed")  # the caller's scratch removes it
        names = sorted(r[0] for r in rows.select("graph").where("graph IS NOT NULL").distinct().collect())
        unknown = [x for x in names if self.graph_id(x) is None]
        if strict and unknown:
            raise GraphError(f"{name}: unknown graph iri {unknown[0]}")
        for x in names:
            self._writable(self.add_graph(x), "load")
        ids = self.spark.createDataFrame([(x, self.graph_id(x)) for x in names], "graph string, gid long")
        return rows.join(ids, "graph", "left").withColumn("g", F.coalesce("gid", F.lit(default)).cast("long")).drop("graph", "gid")

    def _source(self, graph: int, sha: str):
        e = self._graphs[graph]
        self._graphs[graph] = e | {"source_sha256": sha, "source_loads": e["source_loads"] + 1}
        self.counters["loads"] += 1
        self._commit()

    def parse_turtle(self, content: str, graph: int = 0, base: str = "", dedup: bool = True) -> int:
        self._writable(graph, "load")
        self.add_graph(graph)
        rows = rdf.parse_turtle(content, base, f"l{uuid.uuid4().hex[:8]}.")
        n = self._add(from_triples(self.spark, [r[:3] for r in rows], graph), graph, dedup)
        self._source(graph, hashlib.sha256(content.encode()).hexdigest())
        return n

    def parse_turtle_verbose(self, content: str, graph: int = 0, base: str = "") -> dict:
        began = time.time()
        n = self.parse_turtle(content, graph, base)
        return {"triples": n, "graph_id": graph, "elapsed_ms": (time.time() - began) * 1000, "source_sha256": self._graphs[graph]["source_sha256"]}

    def parse_trig(self, content: str, default_graph: int = 0, strict: bool = False) -> dict:
        rows = rdf.parse_trig(content, "", f"l{uuid.uuid4().hex[:8]}.")
        flat = [(s.kind, s.lex, p.lex, o.kind, o.lex, o.dt, o.lang, g) for s, p, o, g in rows]
        df = self.spark.createDataFrame(flat, "s__k int, s__x string, p__x string, o__k int, o__x string, o__d string, o__l string, graph string")
        return self._quads_in(df, default_graph, strict, "parse_trig")

    def parse_nquads(self, content: str, default_graph: int = 0, strict: bool = False) -> dict:
        lines = self.spark.createDataFrame([(x,) for x in content.split("\n")], "value string")
        return self._quads_in(rdf.parse_lines(lines, f"l{uuid.uuid4().hex[:8]}.", lenient=False), default_graph, strict, "parse_nquads")

    def _quads_in(self, df: DataFrame, default: int, strict: bool, name: str) -> dict:
        self._writable(default, "load")
        with scratch(self.spark):
            n = self._add(with_ids(self._resolve(df, default, strict, name)))
        self.counters["loads"] += 1
        return {"quads": n, "graphs": sorted(self._graphs)}

    def load(self, path: str, graph: int = 0, format: str = "auto", base: str = "", dedup: bool = True, lenient: bool = True, digest: str = "auto") -> int:
        """Reads ntriples, nquads, turtle or trig files; ``auto`` looks at the name and the first 64 KiB.

        digest: ``bytes`` is the sha256 of the file, read as a stream of any length by the driver; ``lines`` is a digest of
        the lines of all files, in any order, by one distributed aggregation; ``auto`` is bytes for one file, else lines.
        """
        self._writable(graph, "load")
        self.add_graph(graph)
        if format == "auto":
            ends = {".nq": "nquads", ".trig": "trig", ".nt": "ntriples"}
            format = next((f for e, f in ends.items() if path.rstrip("/").endswith(e)), "") or self._sniff(path)
        prefix = f"l{uuid.uuid4().hex[:8]}."
        if format in ("ntriples", "nquads"):
            rows = rdf.parse_lines(self.spark.read.text(path), prefix, lenient)
        else:
            rows = rdf.read_turtle_files(self.spark, path, prefix, base, format == "trig")
        with scratch(self.spark):
            if format in ("nquads", "trig"):
                quads = with_ids(self._resolve(rows, graph, False, "load"))
                n = self._add(quads, None, dedup)
            else:
                n = self._add(with_ids(rows.drop("graph").withColumn("g", F.lit(graph).cast("long"))), graph, dedup)
        self._source(graph, rdf.source_digest(self.spark, path, digest))
        return n

    def load_turtle_verbose(self, path: str, graph: int = 0, base: str = "") -> dict:
        """Loads Turtle files, without a look at what they are, and tells what that took."""
        began, before = time.time(), self.count_quads(graph)
        n = self.load(path, graph, "turtle", base)
        e = self._graphs[graph]
        return {"triples": n, "graph_id": graph, "quads_before": before, "quads_after": self.count_quads(graph),
                "elapsed_ms": (time.time() - began) * 1000, "source_sha256": e["source_sha256"], "source_loads": e["source_loads"]}

    def _sniff(self, path: str) -> str:
        head = self.spark.read.text(path).limit(200).collect()
        return rdf.sniff("\n".join(r[0] for r in head))

    def put_quad(self, s: T.Term, p: T.Term, o: T.Term, graph: int = 0) -> int:
        self._writable(graph, "put")
        return self._add(from_triples(self.spark, [(s, p, o)], graph), graph)

    def put_term(self, term: T.Term) -> int:
        """The id of a term; ids are hashes, so nothing is stored."""
        return self.spark.range(1).select(T.id_lit(term)).first()[0]

    def get_term(self, i: int) -> str | None:
        row = self.dataset.nodes(Scope()).where(F.col("id") == i).select("x").first()
        row = row or self.quads.where(F.col("p") == i).select("p__x").first()
        return row[0] if row else None

    def put_construct_rows(self, rows: list[dict], graph: int = 0) -> int:
        """Adds structured triples; blank node labels are shared inside one call only."""
        self._writable(graph, "ingest")
        if not rows:
            return 0
        salt = f"i{uuid.uuid4().hex[:8]}."

        def term(x, where):
            kind = x["type"]
            if kind in ("iri", "uri"):
                return T.iri(x["value"])
            if kind == "bnode" and where != "predicate":
                return T.Term(T.BNODE, salt + x["value"])
            if kind == "literal" and where == "object":
                return T.literal(x["value"], x.get("datatype") or T.STRING, x.get("language") or "")
            raise GraphError(f"a {kind} can't stand as {where}")

        triples = [tuple(term(r[w], w) for w in ("subject", "predicate", "object")) for r in rows]
        return self._add(from_triples(self.spark, triples, graph), graph)

    def put_construct_row(self, row: dict, graph: int = 0) -> int:
        return self.put_construct_rows([row], graph)

    def write_ntriples(self, path: str, graph: int = 0):
        rdf.nt_lines(self._of(graph)).write.text(path)

    # updates

    def update(self, text: str) -> dict:
        """Runs an update request; each operation sees the snapshot that the one before it left."""
        began, touched, added, removed = time.time(), set(), 0, 0
        ops = parse_update(text)
        for op in ops:
            names = {x: self.graph_iri(x) for x in self._graphs}
            with scratch(self.spark):
                i, d, g = self._update_one(op)
            added, removed = added + i, removed + d
            touched |= {"DEFAULT" if x == 0 else names.get(x) or self.graph_iri(x) or f"{SYNTHETIC}{x}" for x in g}
        self.counters["updates"] += 1
        kinds = {op.kind for op in ops}
        form = "EMPTY" if not ops else kinds.pop().replace(" ", "_").replace("/", "_") if len(kinds) == 1 else "MIXED"
        return {"form": form, "triples_inserted": added, "triples_deleted": removed, "graphs_touched": sorted(touched, key=lambda x: (x != "DEFAULT", x)), "elapsed_ms": (time.time() - began) * 1000}

    def _targets(self, ref: str, verb: str, silent: bool) -> list[int]:
        if ref == "DEFAULT":
            return [0]
        if ref in ("NAMED", "ALL"):
            return [g for g in self._graphs if ref == "ALL" or g]
        g = self.graph_id(ref[1:])
        if g is None:
            if silent:
                return []
            raise GraphError(f"{verb}: unknown graph {ref[1:]}")
        return [g]

    def _update_one(self, op: A.UpdateOp) -> tuple[int, int, set]:
        if op.kind in ("CLEAR", "DROP"):
            n, gs = 0, self._targets(op.target, op.kind.lower(), op.silent)
            for g in gs:
                n += self.clear_graph(g) if op.kind == "CLEAR" or g == 0 else self.drop_graph(g)
            return 0, n, set(gs)
        if op.kind == "CREATE":
            if self.graph_id(op.target[1:]) is not None and not op.silent:
                raise GraphError(f"create: graph {op.target[1:]} exists")
            return 0, 0, {self.add_graph(op.target[1:])}
        if op.kind in ("ADD", "COPY", "MOVE"):
            src = self._targets(op.source, op.kind.lower(), op.silent)
            dst = 0 if op.target == "DEFAULT" else self.add_graph(op.target[1:])
            if not src or src[0] == dst:
                return 0, 0, set()
            removed = self.clear_graph(dst) if op.kind != "ADD" else 0
            added = self.copy_graph(src[0], dst)
            if op.kind == "MOVE":
                removed += self.clear_graph(0) if src[0] == 0 else self.drop_graph(src[0])
            return added, removed, {src[0], dst}
        scope, home = Scope(), None
        if op.with_graph:
            home = self.add_graph(op.with_graph) if op.insert else self.graph_id(op.with_graph)
            scope = Scope("one", -1 if home is None else home)
        for t, _ in (*op.delete, *(op.insert if op.kind == "INSERT DATA" else ())):
            if op.kind.endswith("DATA") and any(isinstance(x, A.Var) and not x.name.startswith("_") for x in (t.s, t.p, t.o)):
                raise A.SparqlError(f"{op.kind} takes no variables")
        rel = self._compiler().compile(op.pattern, scope) if op.pattern is not None else Rel(self.spark.range(1).select(F.lit(1).alias("__unit")), {})
        if op.pattern is not None:
            rel = Rel(stage(rel.df, "solutions"), rel.vars)
        gone = self._resolved(op.delete, rel, home, False)
        new = self._resolved(op.insert, rel, home, True)
        touched, removed, added = set(), 0, 0
        if gone is not None:
            touched |= {r[0] for r in gone.select("g").distinct().collect()}
        if new is not None:
            touched |= {r[0] for r in new.select("g").distinct().collect()}
        for g in touched:
            self._writable(g, "update")
        if gone is not None and (near := self._near(gone, gone.count())) is not None:
            segments, removed = self.store.without(gone, near)
            if removed:
                self._commit(segments, touched)
        if new is not None:
            n = new.count()
            self._add(new)
            added = n
        return added, removed, touched

    def _resolved(self, template, rel: Rel, home: int | None, create: bool) -> DataFrame | None:
        if not template:
            return None
        rows = stage(self.construct_quads(list(template), rel).drop("g"), "template")
        names = [r[0] for r in rows.select("graph").where("graph IS NOT NULL").distinct().collect()]
        for x in names if create else []:
            self.add_graph(x)
        ids = self.spark.createDataFrame([(x, self.graph_id(x)) for x in names if self.graph_id(x) is not None], "graph string, gid long")
        rows = rows.join(ids, "graph", "left")
        default = F.lit(0 if home is None else home)
        g = F.when(F.col("graph").isNull(), default).otherwise(F.col("gid"))
        return stage(with_ids(rows.withColumn("g", g.cast("long")).where("g IS NOT NULL").drop("graph", "gid")), "resolved")

    # reasoning, validation, figures

    def materialize(self, graph: int = 0, profile: str = "owl-rl") -> dict:
        if profile not in inference.PROFILES:
            raise GraphError(f"materialize: unknown profile {profile!r}")
        self._writable(graph, "materialize")
        began = time.time()
        own = self.store.of(graph)
        base = self._of(graph).where(~F.col("inferred"))
        dropped = sum(x.inferred for x in own)
        with scratch(self.spark):
            new, groups = inference.closure(base, graph, profile)
            segments = [x for x in self.store.segments if x.g != graph or not x.inferred]
            mixed = [x for x in own if 0 < x.inferred < x.rows]
            if mixed:
                segments += self.store.write(self.store.frame(mixed).where(~F.col("inferred")), sum(x.rows - x.inferred for x in mixed), mixed[0].level)
            made = self.store.write(new)
            if groups:
                made += self.store.write_groups(*groups, graph)
        self._commit([*segments, *made], [graph])
        self._closed[graph] = profile
        self._refresh()
        return {
            "base_triples": sum(x.rows - x.inferred for x in own), "inferred_triples_written": sum(x.rows for x in made), "previous_inferred_dropped": dropped,
            "profile": profile, "reasoner_errors": 0, "elapsed_ms": (time.time() - began) * 1000,
        }

    def validate(self, data: int, shapes: int, mode: str = "core", strict: bool = True, collect: bool = True) -> dict:
        """The report's envelope.  ``report`` is a DataFrame of the results; ``collect`` also lists them under ``results``."""
        return shacl.validate(self, data, shapes, mode, strict, collect)

    def stats(self) -> dict:
        return self.counters | {"path_depth_truncations": self.paths.truncations, "graphs": len(self._graphs), "quads": sum(s.rows for s in self.store.segments), "plan_cache": len(self._parsed)}

    @staticmethod
    def version() -> str:
        return __version__

    @staticmethod
    def build_id() -> str:
        """The version and a hash of the package's own source."""
        here = pathlib.Path(__file__).parent
        text = b"".join(x.read_bytes() for x in sorted(here.rglob("*.py")) if "llm" not in x.relative_to(here).parts)
        return f"{__version__}+{hashlib.sha256(text).hexdigest()[:12]}"

    def to_json(self, df: DataFrame) -> list[str]:
        return [json.dumps(r.asDict(True)) for r in df.collect()]


__all__ = ["GRAPH_KEY", "GraphError", "GraphStore", "Locked", "Queries"]
