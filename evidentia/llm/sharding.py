"""Size-tiered compaction of immutable shards under a versioned manifest.

DataFrame functions on the executors; the driver only moves pointers.  A store is a folder:
``data/<run>/`` holds Parquet shards that never change, ``manifest/<id>/`` a table of live shards,
and ``current/<N>`` is a small file that names the manifest of version N and the schema of the
rows.  A writer writes shards and manifest under names of its own and commits by one rename of
that file which fails if N is taken: then it builds on the version that came first and tries the
next number.  Readers take the newest version, so a writer that dies leaves the one before it in
force.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.llm.common import cut, near, shared_dir

#: Bytes that a merged shard should have, ratio of the sizes of two tiers, runs that make a merge.
TARGET_BYTES = 128 << 20
FANOUT = 4
MIN_RUNS = 4
#: Rows of an arriving shard; paths that the driver holds at a time.
ARRIVAL_ROWS = 4_000
PATHS = 10_000
#: Age in seconds from which shards that no version in force names are deleted.
VACUUM_AGE = 7 * 24 * 3600

_MANIFEST = "path string, bytes long, rows long, run string"


class Conflict(RuntimeError):
    """Another writer has replaced what this one was about to replace."""


class ShardStore:
    """``append`` arrivals, ``compact`` them, ``read`` the committed version."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, min_runs: int = MIN_RUNS):
        self.spark, self.root, self.target, self.fanout, self.min_runs = spark, root.rstrip("/"), target_bytes, fanout, min_runs
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Newest committed version; 0 for an empty store."""
        marks = self._path(f"{self.root}/current")
        if not self._fs.exists(marks):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(marks) if s.getPath().getName().isdigit()), default=0)

    def _pointer(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/current/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def schema(self, version: int | None = None) -> StructType | None:
        version = self.version() if version is None else version
        return StructType.fromJson(self._pointer(version)["schema"]) if version else None

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/{self._pointer(version)['manifest']}")

    def _claim(self, version: int, pointer: dict) -> bool:
        """Whether ``version`` was free and now is this pointer's: one rename that never overwrites."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.root}/current/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(pointer).encode())
        out.close()
        where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            where.rename(draft, self._path(f"{self.root}/current/{version}"), options)
            return True
        except Exception as e:  # py4j wraps what Java throws
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False

    def _commit(self, change: Callable[[DataFrame], DataFrame], schema: StructType) -> int:
        """Commit ``change`` of the newest manifest; built anew on each version that another writer commits first."""
        self._fs.mkdirs(self._path(f"{self.root}/current"))
        while True:
            base, name = self.version(), uuid.uuid4().hex
            change(self.manifest(base)).write.parquet(f"{self.root}/manifest/{name}")
            if self._claim(base + 1, {"manifest": name, "schema": schema.jsonValue()}):
                return base + 1

    def _written(self, run: str) -> DataFrame:
        """The shards of a run, from Parquet's own metadata columns."""
        rows = self.spark.read.parquet(f"{self.root}/data/{run}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return rows.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows")).withColumn("run", F.lit(run))

    def append(self, arrivals: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Add arrivals as shards of at most ``rows`` rows, without a shuffle.

        Arrivals need the columns that the store has.  Without rows only a version is added.
        """
        known = self.schema()
        if known is not None and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in arrivals.schema]:
            raise ValueError(f"the store has {known.simpleString()}, not {arrivals.schema.simpleString()}")
        run = uuid.uuid4().hex
        arrivals.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/data/{run}")
        written = cut(self._written(run))
        return self._commit(lambda base: base.unionByName(written), arrivals.schema)

    def plan(self, shards: DataFrame) -> DataFrame:
        """``shards`` with ``tier`` and ``merge``.

        A tier holds sizes within a factor ``fanout``.  Shards of up to half the target are merged
        where their tier has ``min_runs`` of them, or enough bytes for a target.
        """
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)).cast("double")) / F.log(F.lit(float(self.fanout))))
        df = shards.withColumn("tier", tier).withColumn("small", F.col("bytes") * 2 <= self.target)
        sums = df.where("small").groupBy("tier").agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_bytes"))
        ready = sums.where((F.col("_n") >= self.min_runs) | ((F.col("_bytes") >= self.target) & (F.col("_n") > 1))).select("tier", F.lit(True).alias("_ready"))
        # A row per tier: at most as many as a size has digits.
        return df.join(F.broadcast(ready), "tier", "left").withColumn("merge", F.col("small") & F.coalesce("_ready", F.lit(False))).drop("small", "_ready")

    def _packed(self, paths: list[str], run: str) -> None:
        """Rewrite shards as target-sized ones without a shuffle.

        A scan packs small files into partitions of up to the target, and each is written as one
        file: a row goes from its old shard to its new one in one task.  The scan's settings are
        those of a session of its own.
        """
        session = self.spark.newSession()
        for k, v in {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
            session.conf.set(k, v)
        session.read.parquet(*paths).write.mode("append").parquet(f"{self.root}/data/{run}")

    def compact(self) -> int:
        """Merge all that the plan says, tier by tier; the version in force, the same if nothing is due.

        Raises ``Conflict`` if another writer has replaced some of the shards meanwhile.
        """
        base = self.version()
        due = cut(self.plan(self.manifest(base)).where("merge").select("tier", "bytes", "path"))
        n = due.count()
        if not n:
            return base
        run = uuid.uuid4().hex
        for tier in sorted(r.tier for r in due.select("tier").distinct().collect()):  # as many as a size has digits
            for paths in _chunks(r.path for r in due.where(F.col("tier") == tier).orderBy("bytes", "path").select("path").toLocalIterator()):
                self._packed(paths, run)
        gone, written = near(due.select("path")), cut(self._written(run))

        def change(now: DataFrame) -> DataFrame:
            if now.join(gone, "path", "left_semi").count() != n:
                raise Conflict("shards that were merged are no longer live")
            return now.join(gone, "path", "left_anti").unionByName(written)

        return self._commit(change, self.schema(base))

    def _dead(self, runs: list[str], live: DataFrame) -> DataFrame:
        """(name, path) of the shards in the folders of ``runs`` that aren't live; only names are listed."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{self.root}/data/{r}" for r in runs]).select("path", _name("path"))
        return listed.join(near(cut(live.select(_name("path")))), "name", "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the live shards.  An empty store that has had arrivals has their columns.

        Dead shards in folders that are still in use are pruned by name before the scan; only of
        more than ``PATHS`` of them the rows are read and dropped.
        """
        schema = self.schema(version)
        if schema is None:
            raise ValueError("nothing was ever appended to the store")
        live = self.manifest(version)
        runs = [r.run for r in live.select("run").distinct().toLocalIterator()]
        if not runs:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{r}" for r in runs))
        dead = [r.name for r in self._dead(runs, live).limit(PATHS + 1).collect()]
        if len(dead) <= PATHS:
            return rows.where(~F.col("_metadata.file_name").isin(dead)) if dead else rows
        at = F.struct(*(F.col(f"`{f.name}`") for f in schema)).alias("row")
        held = rows.select(at, F.col("_metadata.file_name").alias("name")).join(near(cut(live.select(_name("path")))), "name", "left_semi")
        return held.select(*(F.col("row").getField(f.name).alias(f.name) for f in schema))

    def vacuum(self, age: float = VACUUM_AGE) -> int:
        """Delete shards that the newest version doesn't use, if they are ``age`` seconds old; returns how many.

        Shards of writers at work aren't in any version yet: ``age`` has to exceed what a write takes.
        """
        import time

        live = self.manifest()
        before = int((time.time() - age) * 1000)
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data"))]
        gone = 0
        for r in self._dead(folders, live).toLocalIterator():
            path = self._path(r.path)
            if self._fs.getFileStatus(path).getModificationTime() <= before:
                gone += self._fs.delete(path, False)
        return gone


def _name(path: str) -> Column:
    """File name of a path: a write's own id is in it, so it is unique in a store."""
    return F.substring_index(path, "/", -1).alias("name")


def _chunks(paths: Iterator[str]) -> Iterator[list[str]]:
    while part := list(islice(paths, PATHS)):
        yield part


def store(spark: SparkSession, name: str, **options) -> ShardStore:
    """A store in the folder that the cluster shares."""
    return ShardStore(spark, f"{shared_dir(spark)}/shards/{name}-{uuid.uuid4().hex}", **options)
