"""Tables of keyed rows that are really written: immutable folders, and versions by one conditional rename.

A commit writes its rows to a folder of its own, then names all live folders in a small manifest and renames
that into place as the next version. The rename fails if that version exists, so of two writers one is
first and the other commits on top of it: no update is lost, readers see a version whole or not at all, and
a commit that dies leaves only a folder that no version names. Folders are read together and the last
row of each key counts; ``fold`` writes that down as one folder.

The rename is atomic on HDFS; on a local disk the check and the rename are two steps, which is enough for the
threads of one process here because they take a lock as well. An object store needs a committer of its own
for the one small file.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL = threading.Lock()


class Conflict(RuntimeError):
    """Another writer was first, or other rows are published under the same name."""


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small text file at path unless there is one; False if there is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".draft-{uuid.uuid4().hex}")
    files = final.getFileSystem(conf)
    files.mkdirs(final.getParent())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    with _LOCAL:
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            files.delete(draft, False)
            return False
    return True


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None."""
    final = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(final):
        return None
    stream = files.open(final)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class KeyedTable:
    """Rows by key, with upsert, delete, replacement of a range of keys, and named snapshots."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType | str):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema

    def _manifest(self, version: int) -> dict | None:
        text = read_small(self.spark, f"{self.root}/versions/{version:012}.json")
        return None if text is None else json.loads(text)

    def version(self) -> int:
        """The last version; 0: none was committed."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version."""
        manifest = self._manifest(self.version() if version is None else version)
        if manifest is None:
            if version:
                raise ValueError(f"no version {version}")
            return self.spark.createDataFrame([], self.schema)
        return self._live(manifest["parts"])

    def _live(self, parts: list[str]) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_part", T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(stored).parquet(*[f"{self.root}/data/{p}" for p in parts])
        # Folders are few between folds, so their order is a short map.
        order = F.create_map(*[x for i, p in enumerate(parts) for x in (F.lit(p), F.lit(i))])
        rest = [c for c in self.schema.names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(F.col("_gone"), *rest), F.try_element_at(order, F.col("_part"))).alias("_r"))
        return last.where(~F.col("_r._gone")).select(*[c if c in self.keys else F.col("_r")[c].alias(c) for c in self.schema.names])

    def _write(self, puts: DataFrame | None, gone: DataFrame | None) -> str:
        """Both in one folder; its name."""
        part = uuid.uuid4().hex
        sides = []
        if puts is not None:
            fault = puts.groupBy(*self.keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
            if fault:
                raise ValueError(f"two rows of one key: {fault[0]}")
            sides.append(puts.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], F.lit(False).alias("_gone")))
        if gone is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in self.keys else F.col(f.name) for f in self.schema]
            sides.append(gone.select(*empty, F.lit(True).alias("_gone")).distinct())
        rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        rows.withColumn("_part", F.lit(part)).write.parquet(f"{self.root}/data/{part}")
        return part

    def _commit(self, change: Callable[[dict], dict | None], after: int | None, tries: int) -> int:
        """change(manifest): the next one, or None for nothing to do."""
        for _ in range(tries):
            at = self.version()
            if after is not None and at != after:
                raise Conflict(f"version {after} was expected, {at} is there")
            made = change(self._manifest(at) or {"parts": [], "published": {}})
            if made is None:
                return at
            if write_once(self.spark, f"{self.root}/versions/{at + 1:012}.json", json.dumps(made)):
                return at + 1
        raise Conflict(f"{tries} times another writer was first")

    def upsert(self, rows: DataFrame, after: int | None = None, tries: int = 20) -> int:
        """Put rows by key. after: only if that is still the last version."""
        part = self._write(rows, None)
        return self._commit(lambda m: m | {"parts": [*m["parts"], part]}, after, tries)

    def delete(self, keys: DataFrame, after: int | None = None, tries: int = 20) -> int:
        """Remove rows by key; keys that are not there are no fault."""
        part = self._write(None, keys.select(*self.keys))
        return self._commit(lambda m: m | {"parts": [*m["parts"], part]}, after, tries)

    def replace(self, where: Column, rows: DataFrame, tries: int = 20) -> int:
        """Put rows in place of all that fulfil a condition on the keys, as one version.

        What is replaced depends on what is there, so a version that came between makes it again.
        """
        for _ in range(tries):
            at = self.version()
            old = self.read(at).where(where).select(*self.keys).join(rows.select(*self.keys), self.keys, "left_anti")
            part = self._write(rows, old)
            try:
                return self._commit(lambda m, part=part: m | {"parts": [*m["parts"], part]}, at, 1)
            except Conflict:
                continue
        raise Conflict(f"{tries} times another writer was first")

    def fold(self, tries: int = 20) -> int:
        """Write the present rows as one folder; what others add meanwhile stays after it."""
        at = self.version()
        old = (self._manifest(at) or {"parts": []})["parts"]
        part = self._write(self.read(at), None)

        def folded(m: dict) -> dict | None:
            return m | {"parts": [part, *m["parts"][len(old) :]]} if m["parts"][: len(old)] == old else None

        return self._commit(folded, None, tries)

    def publish(self, rows: DataFrame, as_of: str, tries: int = 20) -> int:
        """Rows under a name, once: the same rows again change nothing, others are a conflict, whoever comes first."""
        mark = rows.select(F.xxhash64(*[F.col(c) for c in self.schema.names]).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x")).first()
        digest = f"{mark.n}-{mark.x}"
        part = self._write(rows, None)

        def named(m: dict) -> dict | None:
            had = m["published"].get(as_of)
            if had == digest:
                return None
            if had is not None:
                raise Conflict(f"other rows are published as {as_of}")
            return m | {"parts": [*m["parts"], part], "published": m["published"] | {as_of: digest}}

        return self._commit(named, None, tries)
