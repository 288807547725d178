"""Quads on shared storage: immutable segments of Parquet, named by a manifest.

A segment holds quads of one graph in ``seg=<name>/g=<graph>/``, sorted by predicate, subject and object, so a
constant graph prunes folders and constant ids prune row groups.  A change writes new segments beside the old
ones and then commits a manifest, whose name holds its version and which is created only if it does not exist:
a reader sees one version whole, and a second writer fails instead of overwriting.  Segments of like age are
merged as they add up, so a quad is rewritten a logarithmic number of times.  ``vacuum`` removes what the newest
manifest does not name.

The owl:sameAs quads that reasoning infers are as many as the square of a group of equal nodes.  A segment of groups
stores the members in their place, and a scan makes the quads out of them, in blocks of pairs that are dealt over tasks.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T

FILES = "s long, s__k int, s__x string, p long, p__x string, o long, o__k int, o__x string, o__d string, o__l string, inferred boolean, seg string, g long"
#: So many segments of one level make one of the next.
FAN = 8
#: Rows from which a segment is spread over tasks by ranges of (graph, predicate, subject).
SPREAD = 1 << 20
#: Members of a group that are paired with so many others at once, about how many pairs a task makes, and how many asserted ones travel with the plan.
BLOCK, PAIRS, FEW_TOLD = 1000, 1 << 20, 1_000_000


class LostRace(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Segment:
    name: str
    g: int
    rows: int
    inferred: int  # how many of them are inferred
    level: int = 0
    groups: bool = False  # holds groups of equal nodes; rows are the quads that they stand for
    told: int = 0  # how many pairs of its groups are asserted, so not among its rows


class SegmentStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.version, self.segments = 0, ()

    # manifests

    def refresh(self) -> list[dict]:
        """Reads the newest manifest; gives its table of graphs."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        self.version = max([int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json")], default=0)
        if not self.version:
            self.segments = ()
            return []
        text = self.spark.read.text(self._manifest(self.version), wholetext=True).first()[0]
        told = json.loads(text)
        self.segments = tuple(Segment(**x) for x in told["segments"])
        return told["graphs"]

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:010d}.json"

    def commit(self, segments, graphs: list[dict]):
        text = json.dumps({"segments": [asdict(s) for s in segments], "graphs": graphs})
        try:
            out = self._fs.create(self._path(self._manifest(self.version + 1)), False)
        except Exception as e:
            if "exist" not in str(e):
                raise
            raise LostRace(f"version {self.version + 1} exists") from e
        out.write(bytearray(text.encode()))
        out.close()
        self.version, self.segments = self.version + 1, tuple(segments)

    # quads

    def of(self, *graphs: int) -> list[Segment]:
        return [s for s in self.segments if s.g in graphs]

    def rows(self, graph: int) -> int:
        return sum(s.rows for s in self.of(graph))

    def frame(self, segments=None) -> DataFrame:
        """The quads of segments, and the segment of each as ``seg``."""
        some = self.segments if segments is None else segments
        if not some:
            return self.spark.createDataFrame([], FILES).select(*T.QUAD, "seg")
        frames, plain = [self._pairs(s) for s in some if s.groups], [s for s in some if not s.groups]
        if plain:
            read = self.spark.read.schema(FILES).option("basePath", self.root)
            frames.insert(0, read.parquet(*(f"{self.root}/seg={s.name}/g={s.g}" for s in plain)).select(*T.QUAD, "seg"))
        return reduce(DataFrame.unionByName, frames)

    def _pairs(self, s: Segment) -> DataFrame:
        """The quads of a segment of groups: each member with all others of its group, but for asserted pairs.

        Both sides are dealt by pairs of blocks, so no task holds more of a group than a block, whatever its size.
        """
        read, folder = self.spark.read, f"{self.root}/seg={s.name}"
        members, tasks = read.schema("r long, id long, k int, x string, n int").parquet(f"{folder}/members"), -(-s.rows // PAIRS)
        own, each = F.expr("int(pmod(id, n))"), F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        sides = [
            members.select("r", i.alias("i"), j.alias("j"), F.col("id").alias(e), F.col("k").alias(f"{e}__k"), F.col("x").alias(f"{e}__x")).repartition(tasks, "r", "i", "j")
            for e, i, j in (("s", own, each), ("o", each, own))
        ]
        pairs = sides[0].hint("merge").join(sides[1], ["r", "i", "j"]).where("s <> o")
        if s.told:
            told = read.schema("s long, o long").parquet(f"{folder}/told")
            pairs = pairs.join(F.broadcast(told) if s.told <= FEW_TOLD else told, ["s", "o"], "left_anti")
        same, none = T.iri(T.OWL + "sameAs"), F.lit("")
        rest = {"p": T.id_lit(same), "p__x": F.lit(same.lex), "o__d": none, "o__l": none, "g": F.lit(s.g).cast("long"), "inferred": F.lit(True), "seg": F.lit(s.name)}
        return pairs.withColumns(rest).select(*T.QUAD, "seg")

    def write_groups(self, members: DataFrame, told: DataFrame, graph: int) -> list[Segment]:
        """A segment of groups of equal nodes.  members: (r, id, k, x), r being the same for all of a group; told: (s, o) of asserted pairs of different ones."""
        name = f"s{uuid.uuid4().hex}"
        size = members.groupBy("r").agg(F.count(F.lit(1)).alias("size"))
        members.join(size, "r").select("r", "id", "k", "x", F.ceil(F.col("size") / BLOCK).cast("int").alias("n")).write.parquet(f"{self.root}/seg={name}/members")
        told.distinct().write.parquet(f"{self.root}/seg={name}/told")
        known = self.spark.read.schema("s long, o long").parquet(f"{self.root}/seg={name}/told").count()
        rows = (size.agg(F.sum(F.col("size") * (F.col("size") - 1))).first()[0] or 0) - known
        return [Segment(name, graph, rows, rows, groups=True, told=known)] if rows else []

    def write(self, quads: DataFrame, rows: int | None = None, level: int = 0) -> list[Segment]:
        """Writes quads as new segments, one for each graph.  rows: how many there are, if it is known."""
        name = f"s{uuid.uuid4().hex}"
        quads = quads.select(*T.QUAD)
        if rows is None or rows > SPREAD:
            quads = quads.repartitionByRange("g", "p", "s")
        elif rows <= SPREAD // 8:
            quads = quads.repartition(1)  # not coalesce: what makes the quads, such as a join with all that go, keeps its own tasks
        quads.sortWithinPartitions("g", "p", "s", "o").write.partitionBy("g").parquet(f"{self.root}/seg={name}")
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/seg={name}")) if s.isDirectory()]
        new = [Segment(name, int(x[2:]), 0, 0, level) for x in folders if x.startswith("g=")]
        if not new:
            return []
        told = self.frame(new).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if("inferred").alias("i")).collect()
        return [Segment(name, r["g"], r["n"], r["i"], level) for r in told]

    def merged(self, segments) -> list[Segment]:
        """Segments with those of a graph and level put together where there are FAN of them."""
        segments = list(segments)
        while True:
            by: dict = {}
            for s in segments:
                if s.groups:
                    continue
                by.setdefault((s.g, s.level, bool(s.inferred)), []).append(s)
            many = next((x for x in by.values() if len(x) >= FAN), None)
            if many is None:
                return segments
            new = self.write(self.frame(many), sum(s.rows for s in many), many[0].level + 1)
            segments = [s for s in segments if s not in many] + new

    def without(self, gone: DataFrame, among) -> tuple[list[Segment], int]:
        """(all segments after the quads of ``gone`` (s, p, o, g) are taken out of those among, how many went).

        Only segments that hold such a quad are rewritten.
        """
        keys = ["s", "p", "o", "g"]
        gone = gone.select(*keys).distinct()
        hits = {(r["seg"], r["g"]): r["n"] for r in among.join(gone, keys, "left_semi").groupBy("seg", "g").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = [s for s in self.segments if (s.name, s.g) in hits]
        kept = [s for s in self.segments if s not in touched]
        rest = [s for s in touched if hits[s.name, s.g] < s.rows]
        if rest:
            left = sum(s.rows - hits[s.name, s.g] for s in rest)
            kept += self.write(self.frame(rest).join(gone, keys, "left_anti"), left, max(s.level for s in rest))
        return kept, sum(hits.values())

    def vacuum(self, age_seconds: float = 3600) -> int:
        """Removes segments that the newest manifest does not name and that are older than a write may take, and older manifests."""
        self.refresh()
        named, gone, before = {f"seg={s.name}" for s in self.segments}, 0, (time.time() - age_seconds) * 1000
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            old = s.getModificationTime() < before
            if old and (name.startswith("seg=") and name not in named or name.startswith("manifest-") and name < f"manifest-{self.version:010d}.json"):
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone
