"""JSON-array files, fallbacks, task grids, and snapshots that readers see whole or not at all."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_arrays(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of files that each hold one JSON array, with their file's name, its place among paths, and their own place in it."""
    rows = spark.read.schema(schema).option("multiLine", True).json(paths)
    path = F.col("_metadata.file_path")
    at = F.lit(len(paths))
    for i, p in reversed(list(enumerate(paths))):
        at = F.when(F.endswith(F.url_decode(path), F.lit("/" + p.rstrip("/").split("://")[-1].lstrip("/"))), i).otherwise(at)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"), at.alias("file_order"), F.monotonically_increasing_id().alias("place"))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, NULLs kept."""
    df.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def _guessed(df: DataFrame, prefixes: dict[str, str], market: str, name: str) -> Column:
    guess: Column = F.lit(None).cast("string")
    for prefix, code in prefixes.items():
        guess = F.when(F.startswith(F.col(name), F.lit(prefix)), F.lit(code)).otherwise(guess)
    return F.coalesce(F.nullif(F.trim(F.col(market)), F.lit("")), guess)


def with_market(df: DataFrame, prefixes: dict[str, str], market: str = "market_code", name: str = "file_name") -> DataFrame:
    """Missing markets from the file's name; a row that is still without one fails the job."""
    found = _guessed(df, prefixes, market, name)
    return df.withColumn(market, F.when(found.isNull(), F.raise_error(F.concat(F.lit("MARKET_METADATA_MISSING: "), F.col(name)))).otherwise(found))


def market_quarantine(df: DataFrame, prefixes: dict[str, str], market: str = "market_code", name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Rows with their market, and those that are still without one."""
    marked = df.withColumn(market, _guessed(df, prefixes, market, name))
    return marked.where(F.col(market).isNotNull()), marked.where(F.col(market).isNull())


def or_seed(live: DataFrame, seed: DataFrame) -> DataFrame:
    """live, or seed where live has no row."""
    return seed if live.isEmpty() else live


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class QueryPlan:
    """Bounds of a search over markets."""

    markets: tuple[str, ...]
    keywords: tuple[str, ...]
    kinds: tuple[str, ...]
    lookback_days: int = 3
    most_per_market: int = 100
    pages: int = 1
    bounds: tuple[tuple[str, int], ...] = ()  # markets with a bound of their own

    def __post_init__(self):
        if not (self.markets and self.keywords and self.kinds):
            raise ValueError("markets, keywords and kinds must not be empty")
        if not 1 <= self.lookback_days <= 90 or not 1 <= self.most_per_market <= 1000:
            raise ValueError("lookback_days or most_per_market out of range")
        if not 1 <= self.pages <= 50 or any(m not in self.markets or not 1 <= n <= 1000 for m, n in self.bounds):
            raise ValueError("pages or a market's bound out of range")

    @classmethod
    def load(cls, text: str) -> QueryPlan:
        """From a JSON object with markets (names, or objects with market_code and perhaps max_candidates), keywords, notice_types and bounds."""
        raw = json.loads(text)
        markets = [m if isinstance(m, dict) else {"market_code": m} for m in raw.get("markets", [])]
        given = {k: raw[v] for k, v in (("lookback_days", "lookback_days"), ("most_per_market", "max_candidates_per_market"), ("pages", "pages")) if v in raw}
        own = tuple((m["market_code"], m["max_candidates"]) for m in markets if "max_candidates" in m)
        return cls(tuple(m["market_code"] for m in markets), tuple(raw.get("keywords", ())), tuple(raw.get("notice_types", ())), bounds=own, **given)

    def tasks(self, spark: SparkSession) -> DataFrame:
        """One row per market, keyword, kind and page, from the plan's own short lists, with the market's bound."""
        explode = lambda xs, name: F.explode(F.array(*[F.lit(x) for x in xs])).alias(name)
        one = spark.range(1).select(explode(self.markets, "market"))
        one = one.select("market", explode(self.keywords, "keyword")).select("market", "keyword", explode(self.kinds, "kind")).select("*", explode(range(1, self.pages + 1), "page"))
        bound = F.lit(self.most_per_market)
        for market, n in self.bounds:
            bound = F.when(F.col("market") == market, n).otherwise(bound)
        return one.withColumn("most", bound)


def fallback_candidates(found: DataFrame, national: DataFrame, markets: DataFrame, market: str, guessed: Column, order: list[Column], most: int) -> DataFrame:
    """Candidates of a national scan for the markets in which none was found, dealt by the market that their label names, so many a market."""
    empty = markets.select(market).join(found.select(market).distinct(), market, "left_anti")
    dealt = national.withColumn(market, guessed).join(empty, market)
    place = F.row_number().over(Window.partitionBy(market).orderBy(*order))
    return dealt.withColumn("place", place).where(F.col("place") <= most).drop("place")


def division_faults(divisions: DataFrame, level: str, expected: dict[str, int]) -> DataFrame:
    """Levels of which a table of divisions has another number of rows than it must have."""
    want = divisions.sparkSession.createDataFrame(list(expected.items()), f"{level} string, expected long")
    have = divisions.groupBy(level).agg(F.count("*").alias("n_rows"))
    return want.join(have, level, "full_outer").where(~F.col("expected").eqNullSafe(F.coalesce("n_rows", F.lit(0))))


def search_url(base: str, **params: Column) -> Column:
    """An address with URL-encoded parameters in the order given."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def publish_snapshot(df: DataFrame, root: str, as_of: str = "") -> str:
    """Write df beside the others, check what was written, then name it in one small pointer file.

    A second snapshot of one as_of is the first one if it has the same rows, and a conflict otherwise.
    """
    spark = df.sparkSession
    place = f"snapshots/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{place}")
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64(*d.columns))).first())
    written = mark(spark.read.schema(df.schema).parquet(f"{root}/{place}"))
    if written != mark(df):
        raise RuntimeError("the snapshot read back differs from what was written")
    pointer = _POINTER.format(place=place, as_of=as_of, rows=written[0], hash=written[1])
    for old in _pointers(spark, root).where(F.col("as_of") == as_of).collect() if as_of else []:
        if (old.rows, old.hash) == written:
            return old.place
        raise ValueError(f"another snapshot of {as_of} is published already")
    spark.range(1).select(F.lit(pointer).alias("value")).coalesce(1).write.mode("append").text(f"{root}/pointers")
    return place


_POINTER = "{place}\t{as_of}\t{rows}\t{hash}"


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """(place, as_of, rows, hash, at) of what is published; at orders them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "place string, as_of string, rows long, hash long, at timestamp")
    parts = F.split("value", "\t")
    pointers = spark.read.text(f"{root}/pointers").select("value", F.col("_metadata.file_modification_time").alias("at"))
    return pointers.select(parts[0].alias("place"), parts[1].alias("as_of"), parts[2].cast("long").alias("rows"), parts[3].cast("long").alias("hash"), "at")


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The published snapshot of the latest as_of; without those, the one published last."""
    newest = _pointers(spark, root).agg(F.max_by("place", F.struct("as_of", "at"))).first()[0]
    return spark.read.parquet(f"{root}/{newest}")


def newest_source(snapshots: DataFrame, now: Column, tolerance_minutes: int = 15) -> DataFrame:
    """Of snapshots (source, priority, as_of) the newest that is not from the future; of equals the highest priority."""
    valid = snapshots.where(F.col("as_of") <= now + F.expr(f"INTERVAL {tolerance_minutes} MINUTES"))
    return valid.orderBy(F.col("as_of").desc(), F.col("priority").desc()).limit(1)
