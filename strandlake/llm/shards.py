"""Sharding by size-tiered compaction under a versioned manifest; DataFrame operations only.

An arrival is written once as a *run*: a folder of Parquet files that never change. A run's tier is the power of
``FANOUT`` that its bytes reach over ``BASE_BYTES``. Whenever a tier has ``FANOUT`` runs, they are merged into one run of
files of about ``TARGET_BYTES``, however large they are, so a row is written once for each tier that it climbs. Readers
follow the newest manifest, a JSON file that lists all live runs. A commit writes the next version beside it and renames it into place, which fails
if that version exists; so writers can't overwrite one another, and a reader sees all of a compaction or none of it.
Files that no manifest needs go after the commit. Tasks that die are run again by Spark under its own output commit.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT, BASE_BYTES, TARGET_BYTES = 4, 1 << 20, 64 << 20
#: From how many targets on a run is left alone: no run is.
LARGEST = math.inf
#: How often a commit is tried on top of others'.
RETRIES = 20


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Runs and manifests below one folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, base_bytes: int = BASE_BYTES, target_bytes: int = TARGET_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.fanout, self.base, self.target = fanout, base_bytes, target_bytes
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}".rstrip("/"))

    # -- manifests ---------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, schema: str | None, runs: list[dict]) -> dict:
        after = {"version": before["version"] + 1, "schema": schema, "runs": runs}
        new, draft = self._path(f"manifests/v{after['version']:010d}.json"), self._path(f"manifests/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, new, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(new):
                raise CommitConflict(f"version {after['version']} exists") from e
            raise
        return after

    # -- runs --------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame) -> dict:
        name = f"runs/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        size = sum(s.getLen() for s in self._fs.listStatus(self._path(name)) if s.getPath().getName().endswith(".parquet"))
        return {"run": name, "bytes": size, "tier": max(0, int(math.log(max(size, 1) / self.base, self.fanout))) if size > self.base else 0}

    def append(self, df: DataFrame) -> dict:
        """Commit an arrival as one more run; an arrival without rows commits its schema only.

        The run is written once; where other writers commit first, the commit is tried again on what they left.
        """
        run = None
        for _ in range(RETRIES):
            before = self.manifest()
            schema = before["schema"] or df.schema.json()
            if T.StructType.fromJson(json.loads(schema)).simpleString() != df.schema.simpleString():
                raise ValueError("the arrival's columns differ from the store's")
            if run is None:
                run = [] if df.isEmpty() else [self._write(df)]
            try:
                return self._commit(before, schema, [*before["runs"], *run])
            except CommitConflict:
                continue
        raise CommitConflict(f"{RETRIES} other commits came first")

    def _rows(self, manifest: dict, runs: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{r['run']}" for r in runs])

    def compact(self) -> dict:
        """Merge tiers until none has ``fanout`` runs; each merge is a commit of its own.

        Merged runs stay on disk for readers of older versions, until ``vacuum``. A merge whose runs another writer took
        first is dropped.
        """
        now = self.manifest()
        while True:
            tiers: dict[int, list[dict]] = {}
            for r in now["runs"]:
                tiers.setdefault(r["tier"], []).append(r)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return now
            files = max(1, round(sum(r["bytes"] for r in full) / self.target))
            merged = self._write(self._rows(now, full).coalesce(files))
            merged["tier"] = max(merged["tier"], full[0]["tier"] + 1)  # columns pack better together; a merge still is a step up
            names = {r["run"] for r in full}
            for _ in range(RETRIES):
                if not names <= {r["run"] for r in now["runs"]}:
                    self._fs.delete(self._path(merged["run"]), True)
                    break
                try:
                    now = self._commit(now, now["schema"], [*(r for r in now["runs"] if r["run"] not in names), merged])
                    break
                except CommitConflict:
                    now = self.manifest()
            else:
                raise CommitConflict(f"{RETRIES} other commits came first")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the runs that none of the newest ``keep`` versions names, and the older manifests; returns how many runs.

        Readers of older versions fail afterwards. Runs of writers that haven't committed yet are deleted as well, so
        nothing else may write meanwhile.
        """
        newest = self.version()
        held = {r["run"].split("/")[1] for v in range(max(1, newest - keep + 1), newest + 1) for r in self.manifest(v)["runs"]}
        runs = self._path("runs")
        gone = [s.getPath() for s in (self._fs.listStatus(runs) if self._fs.exists(runs) else []) if s.getPath().getName() not in held]
        for path in gone:
            self._fs.delete(path, True)
        for v in range(newest - keep, 0, -1):
            if not self._fs.delete(self._path(f"manifests/v{v:010d}.json"), False):
                break
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with ``shard_run``, ``shard_file``, ``shard_tier`` and ``shard_version``; where the rows have
        columns of such names, these four get underscores in front."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("nothing was ever appended")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        first, names = "", ("shard_run", "shard_file", "shard_tier", "shard_version")
        while {f"{first}{n}".lower() for n in names} & {f.lower() for f in schema.names}:
            first += "_"
        in_run, in_file, in_tier, in_version = (first + n for n in names)
        if not now["runs"]:
            rows = self.spark.createDataFrame([], schema)
            return rows.select("*", *(F.lit(None).cast(t).alias(n) for n, t in ((in_run, "string"), (in_file, "string"), (in_tier, "int"), (in_version, "long"))))
        file = F.input_file_name()
        tiers = F.create_map(*[F.lit(x) for r in now["runs"] for x in (r["run"].split("/")[1], r["tier"])])
        run = F.element_at(F.split(file, "/"), -2)
        return self._rows(now, now["runs"]).select("*", run.alias(in_run), F.element_at(F.split(file, "/"), -1).alias(in_file), tiers[run].alias(in_tier), F.lit(now["version"]).cast("long").alias(in_version))


def ingest(docs: DataFrame, root: str, arrivals: int = 12, id_col: str = "doc_id", **sizes) -> ShardStore:
    """A table as a series of arrivals, ranges of its ids, each appended and followed by compaction.

    Every row is kept as it is, repeated ones and nulls in any column included; rows without an id are the last arrival.
    """
    store = ShardStore(docs.sparkSession, root, **sizes)
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        store.append(docs)
        return store
    step = max(1, -(-(high - low + 1) // arrivals))
    for k in range(-(-(high - low + 1) // step)):
        a = low + k * step
        store.append(docs.where((F.col(id_col) >= a) & (F.col(id_col) < a + step)))
        store.compact()
    if not docs.where(F.col(id_col).isNull()).isEmpty():
        store.append(docs.where(F.col(id_col).isNull()))
        store.compact()
    return store
