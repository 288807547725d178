"""Sharding by size-tiered compaction, with atomically committed versions; DataFrame functions only.

A store is a folder in shared storage.  Arrivals are appended as small immutable
runs of Parquet files.  Compaction merges runs of similar size (of one tier: sizes
within a factor) into one run, whose files have the target size; a run that has
reached the target is left alone if its files are of that size too, so each row
is written about log(target / arrival) times.  A run over the target made of
small files, as a large arrival written by many tasks is, is rewritten once,
without waiting for others.  Merging reads files next to each other and coalesces them: no
shuffle.  Every change writes its files first and then commits a manifest,
``manifest-<version>.json``, which is created only if it does not exist (no
rename, so object stores do as well).  A manifest that can't be read whole, since
its writer still writes or was lost, is not a version yet: readers use the one
before it, and after ``grace_seconds`` the next writer goes past it.  A writer
that lost the race, or its machine, leaves only files that no manifest names;
``vacuum`` removes those that are older than a write may take.

Defined cases: an empty arrival is recorded as a run without rows and vanishes in
the next merge; nulls, repeated rows and any columns are stored as they are;
arrivals must agree in their columns; an empty store reads as an error until the
first commit.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names


class LostRace(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int
    tier: int
    merged: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20, factor: int = 4, fan: int = 4, grace_seconds: float = 600):
        self.spark, self.root, self.grace = spark, root.rstrip("/"), grace_seconds
        self.target, self.base, self.factor, self.fan = target_bytes, base_bytes, factor, fan
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    # manifests

    def _named(self) -> list[int]:
        """Numbers of all manifests, the newest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted((int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json")), reverse=True)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:010d}.json"

    def _read(self, version: int) -> list[Run] | None:
        """The runs of a version; None if its manifest is not whole."""
        rows = self.spark.read.text(self._manifest(version), wholetext=True).collect()
        try:
            return [Run(**x) for x in json.loads(rows[0][0])["runs"]]
        except (IndexError, ValueError):
            return None

    def version(self) -> int:
        return next((v for v in self._named() if self._read(v) is not None), 0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        found = self._read(version) if version else []
        if found is None:
            raise FileNotFoundError(f"version {version} was never committed")
        return found

    def commit(self, version: int, runs: list[Run]) -> int:
        """Makes runs the content of the version after ``version``."""
        new = version + 1
        for v in self._named():
            if v > version:
                age = time.time() - self._fs.getFileStatus(self._path(self._manifest(v))).getModificationTime() / 1000
                if self._read(v) is not None or age < self.grace:
                    raise LostRace(f"version {v} exists")
                new = max(new, v + 1)
        try:
            out = self._fs.create(self._path(self._manifest(new)), False)
        except Exception as e:
            if "exist" not in str(e):
                raise
            raise LostRace(f"version {new} exists") from e
        out.write(bytearray(json.dumps({"version": new, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        return new

    # runs

    def _measure(self, path: str, merged: int) -> Run:
        sizes = [s.getLen() for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        return Run(path, sum(sizes), len(sizes), self._tier(sum(sizes)), merged)

    def _tier(self, size: int) -> int:
        return 0 if size <= self.base else math.ceil(math.log(size / self.base, self.factor))

    def _write(self, df: DataFrame, merged: int) -> Run:
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._measure(path, merged)

    def append(self, df: DataFrame) -> int:
        version = self.version()
        return self.commit(version, [*self.runs(version), self._write(df, 0)])

    def append_by(self, df: DataFrame, key: str) -> int:
        """Appends one run for each value of ``key`` in a single pass over df, without a shuffle; the key column is not stored."""
        version, path = self.version(), f"{self.root}/run-{uuid.uuid4().hex}"
        df.write.partitionBy(key).parquet(path)
        found = [s.getPath().toString() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        return self.commit(version, [*self.runs(version), *(self._measure(x, 0) for x in sorted(found))])

    def _scattered(self, r: Run) -> bool:
        """Whether a run that has reached the target has more than twice the files it needs."""
        return r.bytes >= self.target and r.files > 2 * math.ceil(r.bytes / self.target)

    def _plan(self, runs: list[Run]) -> list[Run]:
        """Runs of the lowest tier that has at least ``fan`` of them and is not at the target; else of the lowest tier with scattered ones, those."""
        for tier in sorted({r.tier for r in runs}):
            same = sorted((r for r in runs if r.tier == tier and r.bytes < self.target), key=lambda r: r.bytes)
            if len(same) >= self.fan:
                return same
        loose = [r for r in runs if self._scattered(r)]
        return [r for r in loose if r.tier == min(x.tier for x in loose)]

    @contextmanager
    def _fine_reads(self):
        """Reads are cut finely, so that coalescing them comes near the target size from either side."""
        conf = self.spark.conf
        now = self.spark._jsparkSession.sessionState().conf()
        least = {"spark.sql.files.maxPartitionBytes": min(now.filesMaxPartitionBytes(), max(1, self.target // 8)), "spark.sql.files.openCostInBytes": min(now.filesOpenCostInBytes(), max(1, self.target // 512))}
        old = {k: conf.get(k, None) for k in least}
        for k, v in least.items():
            conf.set(k, str(v))
        try:
            yield
        finally:
            for k, v in old.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def compact(self, schema) -> int:
        """Merges until no tier has ``fan`` runs below the target and none is scattered; one commit for each merge."""
        while True:
            version = self.version()
            runs = self.runs(version)
            some = self._plan(runs)
            if not some:
                return version
            parts = max(1, math.ceil(sum(r.bytes for r in some) / self.target))
            with self._fine_reads():
                df = self.spark.read.schema(schema).parquet(*(r.path for r in some)).coalesce(parts)
                new = self._write(df, 1 + max(r.merged for r in some))
            self.commit(version, [r for r in runs if r not in some] + [new])

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, with the shard (file) that holds each as ``shard`` (``_shard`` if the rows have such a column)."""
        runs = self.runs(version)
        if not runs:
            raise FileNotFoundError("the store has no version")
        (name,) = free_names(schema.fieldNames(), "shard")
        return self.spark.read.schema(schema).parquet(*(r.path for r in runs)).withColumn(name, F.input_file_name())

    def vacuum(self, age_seconds: float = 86_400) -> int:
        """Removes runs that the newest version does not name and older manifests, if they are older than ``age_seconds``.

        Another writer's run that is not committed yet must not be that old.  Returns how many folders went.
        """
        version, before = self.version(), (time.time() - age_seconds) * 1000
        named = {self._path(r.path).toUri().getPath() for r in self.runs(version)}
        gone = 0
        for s in self._fs.listStatus(self._path(self.root)):
            name, own = s.getPath().getName(), s.getPath().toUri().getPath()
            if s.getModificationTime() > before:
                continue
            if name.startswith("run-") and own not in named:
                inner = [x for x in self._fs.listStatus(s.getPath()) if x.isDirectory()]
                kept = [x for x in inner if x.getPath().toUri().getPath() in named]
                for x in inner if kept else [s]:
                    if x not in kept:
                        self._fs.delete(x.getPath(), True)
                        gone += 1
            elif name.startswith("manifest-") and name < f"manifest-{version:010d}.json":
                self._fs.delete(s.getPath(), False)
        return gone
