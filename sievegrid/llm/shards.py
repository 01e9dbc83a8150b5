"""Sharding by size-tiered compaction, with versions committed atomically.

A table is a folder of immutable Parquet shards. Arrivals are appended as they come, as small
shards. Compaction sorts shards into tiers by size; where a tier has a full run of similar shards,
they are merged into files of about the target size, and shards of the target size are never
written again, so each row is rewritten about once per tier. The live shards of a version are a
manifest, a small Parquet table that Spark writes. A version becomes real when one pointer file is
renamed into place, which fails if that version exists: readers see all of a version or nothing,
and writers that lose the race, appends and compactions alike, try again on top of the version that
won; what they have written stays good unless another compaction took the same shards. A job lost
half-way leaves only files no version names. The rename is atomic on HDFS and local disks; object
stores without an atomic rename need a committer of their own for the one small pointer file.

What grows with the rows stays in Spark; the driver holds file names alone, as Spark's own file
listing does. A merge gets one task per output file, so no task reads more than about two targets,
whatever the table's size.

Defined results: rows come back as they were, nulls, repeated rows and any column names included;
an empty arrival makes a version with no new shard; a table without shards reads as no rows of its
first schema; an arrival whose columns differ from the table's raises ValueError.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
#: Shards up to this size are of the lowest tier.
LEAST_BYTES = 1 << 20
#: Similar shards that make a run, and the step between tiers.
FAN_IN = 4
#: Seconds for which folders that no version names are left alone: a writer may still commit them.
GRACE_S = 7 * 86_400
#: Times that a writer tries again after others have committed first.
TRIES = 20
_MANIFEST = "file string, rows long, bytes long, added long"


class VersionTaken(RuntimeError):
    """Another writer has committed that version first."""


class ShardTable:
    """A versioned table of Parquet shards below root, a path that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.least, self.fan_in = target_bytes, least_bytes, fan_in

    # Pointers

    def _java(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.root}/versions")
        conf = self.spark._jsc.hadoopConfiguration()
        return jvm, path.getFileSystem(conf), jvm.FileContext.getFileContext(path.toUri(), conf)

    def versions(self) -> list[int]:
        jvm, fs, _ = self._java()
        folder = jvm.Path(f"{self.root}/versions")
        if not fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit())

    def _pointer(self, version: int | None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:012d}", wholetext=True).first()[0]) | {"version": version}

    def _commit(self, live: DataFrame, schema: T.StructType, after: int) -> int:
        """Make live the manifest of version after + 1, or raise VersionTaken."""
        place = f"manifests/{uuid.uuid4().hex}"
        live.write.parquet(f"{self.root}/{place}")
        jvm, fs, files = self._java()
        draft = jvm.Path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"manifest": place, "schema": schema.jsonValue()}).encode()))
        out.close()
        final = jvm.Path(f"{self.root}/versions/{after + 1:012d}")
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        no_overwrite[0] = jvm.Options.Rename.NONE
        try:
            files.rename(draft, final, no_overwrite)
        except Exception as e:
            if fs.exists(final):
                fs.delete(draft, False)
                raise VersionTaken(after + 1) from e
            raise
        return after + 1

    # Reading

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version: file, rows, bytes, and the version that added each."""
        pointer = self._pointer(version)
        if pointer is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/{pointer['manifest']}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        pointer = self._pointer(version)
        if pointer is None:
            raise ValueError("the table has no version yet")
        return self._rows([r.file for r in self.manifest(pointer["version"]).select("file").collect()], T.StructType.fromJson(pointer["schema"]))

    def _rows(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def _written(self, df: DataFrame, by: str | None = None) -> tuple[str, DataFrame]:
        """Write df as new shards; their folder, and (file, bytes, rows) from what the files themselves say.

        by: a column whose values get folders of their own, and which is not kept in the files.
        """
        place = f"{self.root}/data/{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(place)
        got = self.spark.read.schema(df.schema).parquet(place)
        about = got.metadataColumn("_metadata")
        return place, got.groupBy(about["file_path"].alias("file"), about["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))

    def _added(self, shards: DataFrame, schema: T.StructType, tries: int = TRIES) -> int:
        """Commit written shards on top of the last version, whichever that is by then."""
        for _ in range(tries):
            pointer = self._pointer(None)
            if pointer and T.StructType.fromJson(pointer["schema"]) != schema:
                raise ValueError("the arrival's columns differ from the table's")
            before = pointer["version"] if pointer else 0
            try:
                return self._commit(self.manifest(before or None).unionByName(self._entries(shards, before + 1)), schema, before)
            except VersionTaken:
                continue
        raise VersionTaken(f"no version could be taken in {tries} tries")

    @staticmethod
    def _entries(shards: DataFrame, version: int) -> DataFrame:
        return shards.select("file", "rows", "bytes", F.lit(version).cast("long").alias("added"))

    # Writing

    def append(self, df: DataFrame, tries: int = TRIES) -> int:
        """Add an arrival as new shards, one per partition of df; the new version."""
        pointer, schema = self._pointer(None), _nullable(df.schema)
        if pointer and T.StructType.fromJson(pointer["schema"]) != schema:
            raise ValueError("the arrival's columns differ from the table's")
        return self._added(self._written(df)[1], schema, tries)

    def append_each(self, df: DataFrame, arrival: Column, tries: int = TRIES) -> int | None:
        """Add the rows of each value of arrival as an arrival of its own, in the values' order: one scan of df
        and one version each; the last version. The values must be few."""
        pointer, schema, name = self._pointer(None), _nullable(df.schema), "arrival"
        while name in {c.lower() for c in df.columns}:
            name = f"_{name}"
        if pointer and T.StructType.fromJson(pointer["schema"]) != schema:
            raise ValueError("the arrival's columns differ from the table's")
        place, shards = self._written(df.withColumn(name, F.coalesce(arrival.cast("int"), F.lit(0))), name)
        value = F.regexp_extract("file", f"/{name}=(-?[0-9]+)/", 1).cast("int")
        shards = shards.withColumn("value", value).persist()
        try:
            last = None
            for row in shards.select("value").distinct().orderBy("value").collect():
                last = self._added(shards.where(F.col("value") == row.value), schema, tries)
            return last if last is not None else self._added(shards, schema, tries)
        finally:
            shards.unpersist()

    def plan(self, version: int | None = None) -> DataFrame:
        """Shards to merge, with the number of the file that each goes to (from 0)."""
        live = self.manifest(version).where(F.col("bytes") < self.target)
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / self.least) / F.log(F.lit(float(self.fan_in)))) + 1)
        in_tier = Window.partitionBy("tier")
        sums = in_tier.orderBy("added", "file").rowsBetween(Window.unboundedPreceding, -1)
        tiered = live.withColumn("tier", tier).withColumn("n", F.count("*").over(in_tier)).where(F.col("n") >= self.fan_in)
        run = F.floor(F.coalesce(F.sum("bytes").over(sums), F.lit(0)) / self.target)
        runs = tiered.withColumn("run", run)
        shared = runs.withColumn("together", F.count("*").over(Window.partitionBy("tier", "run"))).where("together > 1")
        number = shared.select("tier", "run").distinct().withColumn("target", (F.row_number().over(Window.orderBy("tier", "run")) - 1).cast("int"))
        return shared.join(number, ["tier", "run"]).select("file", "rows", "bytes", "tier", "target")

    def compact(self, tries: int = TRIES) -> int | None:
        """One round: merge every full run of every tier and commit; None if there is nothing to merge.

        If others commit first, the merged files still stand for the shards they were made of, as long
        as all of those are live; if another compaction took some, the round starts again.
        """
        for _ in range(tries):
            pointer = self._pointer(None)
            if pointer is None:
                return None
            version, schema = pointer["version"], T.StructType.fromJson(pointer["schema"])
            plan = self.plan(version).select("file", "target").collect()  # file names only
            if not plan:
                return None
            goes = self.spark.createDataFrame([(r.file, r.target) for r in plan], "file string, target int")
            rows = self._rows([r.file for r in plan], schema)
            n = 1 + max(r.target for r in plan)
            # The plan names files, never rows; each task looks up the few that it reads.
            columns = [F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), rows.metadataColumn("_metadata")["file_path"].alias("file")]
            dealt = rows.select(*columns).join(F.broadcast(goes) if len(plan) <= 100_000 else goes, "file")
            place, merged = self._written(dealt.repartitionById(n, "target").select("row.*"))
            for _ in range(tries):
                live = self.manifest(version)
                if live.join(goes.select("file"), "file", "left_semi").count() < len(plan):
                    break
                kept = live.join(goes.select("file"), "file", "left_anti").select("file", "rows", "bytes", "added")
                try:
                    return self._commit(kept.unionByName(self._entries(merged, version + 1)), schema, version)
                except VersionTaken:
                    version = self._pointer(None)["version"]
            jvm, fs, _ = self._java()
            fs.delete(jvm.Path(place), True)
        raise VersionTaken(f"no version could be taken in {tries} tries")

    def compact_all(self) -> int | None:
        """Rounds until no tier has a full run; the last version made."""
        last = None
        while (version := self.compact()) is not None:
            last = version
        return last

    def _folders(self, version: int) -> set[str]:
        """Folders of data that a version names."""
        folder = F.regexp_extract("file", r"/data/([0-9a-f]+)/", 1)
        return {r[0] for r in self.manifest(version).select(folder.alias("f")).distinct().collect()}

    def expire(self, keep: int = 1, grace_s: float = GRACE_S) -> list[int]:
        """Forget all but the last versions; delete the folders of shards that only those name, and
        folders that no version names once they are older than grace_s: a younger one may belong to
        a writer that has yet to commit."""
        known = self.versions()
        old = known[:-keep] if keep else known
        jvm, fs, _ = self._java()
        needed = set().union(*[self._folders(v) for v in known[len(old) :]])
        gone = set().union(*[self._folders(v) for v in old]) - needed
        places = {v: self._pointer(v)["manifest"] for v in old}
        for v in old:
            fs.delete(jvm.Path(f"{self.root}/versions/{v:012d}"), False)
            fs.delete(jvm.Path(f"{self.root}/{places[v]}"), True)
        data = jvm.Path(f"{self.root}/data")
        for x in fs.listStatus(data) if fs.exists(data) else []:
            name = x.getPath().getName()
            if name in gone or (name not in needed and x.getModificationTime() / 1000 < time.time() - grace_s):
                fs.delete(x.getPath(), True)
        return old


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
