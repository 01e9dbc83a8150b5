"""What several operators of this subpackage share: reading tables, scratch tables, word rules."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a session that runs in one process may go without that setting; it gets a
    temporary folder, removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return f"file://{_local_dirs[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts the lineage and survives lost executors.

    free: let Spark remove the shuffle files of what is finished now. It does so for plans that the
    driver has collected as garbage, which may else take as long as the job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def null_safe(column: Column, placeholder: str = "") -> Column:
    return F.coalesce(column, F.lit(placeholder))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base = f"_{base}"
    return base


def named(name: str) -> Column:
    """The column of that name, dots and all."""
    return F.col(name if name.startswith("`") else f"`{name}`")


def all_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [named(c) for c in df.columns]


def row_marks(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell a row of this id and text; rows that repeat whole share them."""
    i, t = named(id_col), named(text_col)
    return F.xxhash64(i, t), F.xxhash64(F.lit("/"), t, F.lit("/"), i)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about so many bytes of that column, one row at least."""
    for batch in batches:
        at, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, size in enumerate(sizes):
            held += size
            if held >= most or i == len(sizes) - 1:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0


def word_parts(text: bytes, overlap: int = 0, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of words of a text, each of about so many bytes, with the place of its first word.

    A run begins with the last ``overlap`` words of the run before it, and has more words than
    those unless the text ends. bytes.split() parts at exactly the six ASCII white-space characters.
    """
    if len(text) <= most:
        yield 0, text.split()
        return
    at, first, carry = 0, 0, []
    while at < len(text):
        end = min(at + most, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = carry + text[at:end].split()
        at = end
        if len(words) <= overlap and at < len(text):
            carry = words
            continue
        yield first, words
        carry = words[-overlap:] if overlap else []
        first += len(words) - len(carry)
