"""Operator 9: sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and a chain of manifests, one
JSON file for each version.  `append` writes an arrival as a run of small shards
and commits a manifest that names it too.  A run's list of shards is a file of
its own, written once, so a manifest holds a line for each run (their number
grows with the logarithm of the data).  `compact` looks for runs of similar
size: a run's tier is the power of `fanout` that its size reaches; `fanout` runs
of one tier are merged into one run of target-sized files, which reaches a
higher tier, and so on until no tier is full.  So every row is rewritten once
for each tier at most.  Merges of different runs go side by side.

A commit is a rename without overwriting: of two writers of one version one
fails and takes the next version; a reader sees whole versions only.  Files of a
failed or repeated task are in no manifest.  Old shards go when `vacuum` is
called, not before, and with them the manifests that name them and, some time
after they were written, files that no manifest names.

Merging reads a run's files and coalesces their partitions to the wanted number
of files, so no row is shuffled.  Only names and sizes of shards come to the
driver, a few hundred bytes for each target-sized file.

Defined cases: an empty arrival commits a version without new shards; null
values, repeated rows and texts of any length are stored as they are; a table of
any columns can be stored whatever their names, arrivals of one store must have
the same columns; a version that was never committed or has been vacuumed away
cannot be read (ValueError).
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.frames import free_name

TARGET_BYTES = 128 << 20
FANOUT = 4
#: A run below this size is in tier 0.
BASE_BYTES = 1 << 20
#: Merges that go side by side.
MERGES = 4
#: Files that no manifest names are left alone for so long: a writer may be about to commit them.
ORPHAN_SECONDS = 24 * 3600


@dataclass
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass
class Run:
    name: str
    shards: list[Shard]
    merged_from: list[str] = field(default_factory=list)

    @property
    def bytes(self) -> int:
        return sum(s.bytes for s in self.shards)


@dataclass
class Manifest:
    version: int
    schema: str
    runs: list[Run]

    @property
    def shards(self) -> list[Shard]:
        return [s for r in self.runs for s in r.shards]


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """A store of shards at `root`, a path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, base_bytes: int = BASE_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.base_bytes = target_bytes, fanout, base_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._known: dict[str, list[Shard]] = {}  # shard lists of runs, which never change
        for folder in ("manifests", "runs", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # --- manifests ---

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the last one by default; version 0 is empty."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, "", [])
        if not self._fs.exists(self._path(self._name(version))):
            raise ValueError(f"there is no version {version}")
        raw = json.loads(self._text(self._name(version)))
        return Manifest(raw["version"], raw["schema"], [Run(r["name"], self._shards(r["name"]), r["merged_from"]) for r in raw["runs"]])

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _shards(self, run: str) -> list[Shard]:
        if run not in self._known:
            self._known[run] = [Shard(**x) for x in json.loads(self._text(f"{self.root}/runs/{run}.json"))]
        return self._known[run]

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:012d}.json"

    def _write(self, path: str, value: object) -> None:
        """A JSON file at a path where none may be."""
        draft = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(value), "utf-8"))
        out.close()
        try:
            self._files.rename(draft, self._path(path), self._no_options)
        except Exception:
            self._fs.delete(draft, False)
            raise

    def commit(self, manifest: Manifest) -> Manifest:
        """Make it the manifest of its version, or raise Conflict."""
        for run in manifest.runs:
            if run.name not in self._known:
                self._write(f"{self.root}/runs/{run.name}.json", [asdict(x) for x in run.shards])
                self._known[run.name] = run.shards
        runs = [{"name": r.name, "bytes": r.bytes, "merged_from": r.merged_from} for r in manifest.runs]
        try:
            self._write(self._name(manifest.version), {"version": manifest.version, "schema": manifest.schema, "runs": runs})
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {manifest.version} exists") from error
            raise
        return manifest

    def _replace(self, add: list[Run], remove: set[str], schema: str = "", retries: int = 20) -> Manifest:
        """Commit the last version with runs added and removed; try again after a conflict."""
        for _ in range(retries):
            last = self.manifest()
            if missing := remove - {r.name for r in last.runs}:
                raise Conflict(f"runs are gone: {sorted(missing)}")
            runs = [r for r in last.runs if r.name not in remove] + add
            try:
                return self.commit(Manifest(last.version + 1, schema or last.schema, runs))
            except Conflict:
                continue
        raise Conflict("too many writers")

    # --- data ---

    def _listed(self, folder: str) -> list[Shard]:
        """Shards below a folder just written, from file metadata and row counts."""
        files, it = {}, self._fs.listFiles(self._path(folder), True)
        while it.hasNext():
            status = it.next()
            if (path := status.getPath()).getName().endswith(".parquet"):
                files[f"{path.getParent().getName()}/{path.getName()}"] = (path.toString(), status.getLen())
        if not files:
            return []
        counted = self.spark.read.parquet(*[p for p, _ in files.values()]).groupBy(F.substring_index("_metadata.file_path", "/", -2).alias("f")).count().collect()
        rows = {r["f"]: r["count"] for r in counted}
        return [Shard(path, rows[name], size) for name, (path, size) in sorted(files.items()) if rows.get(name)]

    def append(self, df: DataFrame) -> Manifest:
        """Commit a table as one arrival."""
        name = free_name(df, "_arrival")
        return self.append_all(df.withColumn(name, F.lit(0).cast("long")), name)

    def append_all(self, df: DataFrame, arrival_col: str) -> Manifest:
        """Commit arrivals told apart by a column (not stored): they are written
        in one pass, each becomes a run and a version in the column's order."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival_col).parquet(folder)
        schema = T.StructType([f for f in df.schema if f.name != arrival_col]).json()
        by_arrival: dict[str, list[Shard]] = {}
        for shard in self._listed(folder):
            by_arrival.setdefault(shard.path.rsplit("/", 2)[1], []).append(shard)
        out = None
        for name in sorted(by_arrival, key=lambda x: (len(x), x)):
            out = self._replace([Run(uuid.uuid4().hex, by_arrival[name])], set(), schema)
            self.compact()
        return self.manifest() if out else self._replace([], set(), schema)

    def tier(self, run: Run) -> int:
        return 0 if run.bytes < self.base_bytes else 1 + int(math.log(run.bytes / self.base_bytes, self.fanout))

    def compact(self) -> int:
        """Merge full tiers until none is left; returns the number of merges."""
        merges = 0
        while True:
            tiers: dict[int, list[Run]] = {}
            for run in self.manifest().runs:
                tiers.setdefault(self.tier(run), []).append(run)
            n = self.fanout
            full = [runs[a : a + n] for _, runs in sorted(tiers.items()) for a in range(0, len(runs) - n + 1, n)]
            if not full:
                return merges
            with ThreadPoolExecutor(MERGES) as pool:
                list(pool.map(self.merge, full))
            merges += len(full)

    def merge(self, runs: list[Run]) -> Manifest:
        """Rewrite runs as one run of target-sized files."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        total = sum(r.bytes for r in runs)
        if shards := [s.path for r in runs for s in r.shards]:
            rows = self.spark.read.schema(self._schema()).parquet(*shards)
            rows.coalesce(max(1, math.ceil(total / self.target_bytes))).write.parquet(folder)
        merged = Run(uuid.uuid4().hex, self._listed(folder) if shards else [], [r.name for r in runs])
        return self._replace([merged], {r.name for r in runs})

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest().schema))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        manifest = self.manifest(version)
        if not manifest.schema:
            raise ValueError("nothing has been stored")
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        paths = [s.path for s in manifest.shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep_versions: int = 1, orphan_seconds: int = ORPHAN_SECONDS) -> int:
        """Keep the last versions only: delete older manifests, the shards and lists
        that none of the last names, and files that no manifest ever named once
        they are `orphan_seconds` old; returns how many shards went."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep_versions:]]
        old = [self.manifest(v) for v in versions[:-keep_versions]]
        shards = {s.path for m in kept for s in m.shards}
        runs = {r.name for m in kept for r in m.runs}
        gone = {s.path for m in old for s in m.shards} - shards
        for manifest in old:  # first, so that no manifest is left without its files
            self._fs.delete(self._path(self._name(manifest.version)), False)
        for run in {r.name for m in old for r in m.runs} - runs:
            self._fs.delete(self._path(f"{self.root}/runs/{run}.json"), False)
            self._known.pop(run, None)
        limit = self.spark.sparkContext._jvm.System.currentTimeMillis() - 1000 * orphan_seconds
        it = self._fs.listFiles(self._path(f"{self.root}/data"), True)
        while it.hasNext():
            status = it.next()
            path = status.getPath().toString()
            if path not in shards and status.getModificationTime() < limit:
                gone.add(path)
        for path in gone:
            self._fs.delete(self._path(path), False)
        return len(gone)
