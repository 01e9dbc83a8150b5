"""The shard table: rows come back whole, tiers fill up, versions are atomic."""

import pytest
from pyspark.sql import functions as F

from sievegrid.llm.common import scratch_path
from sievegrid.llm.shards import ShardTable, VersionTaken


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tiers_fill_and_rows_stay(spark):
    shelf = ShardTable(spark, scratch_path(spark, "t"), target_bytes=20_000, least_bytes=1_500, fan_in=3)
    want = []
    for k in range(7):
        part = [(k * 50 + i if i else None, f"text {k} {i} " * 3, None) for i in range(50)] + [(1, "same", "x")] * 2
        want += part
        shelf.append(spark.createDataFrame(part, "doc_id long, text string, _metadata string").repartition(2))
        assert rows_of(shelf.read()) == sorted(want, key=str)
    before = shelf.manifest().count()
    planned = {r.file: r for r in shelf.plan().collect()}
    assert planned and all(r.bytes < 20_000 for r in planned.values())
    version = shelf.compact_all()
    after = shelf.manifest().collect()
    assert len(after) < before and sum(r.rows for r in after) == len(want) and version == shelf.versions()[-1]
    assert rows_of(shelf.read()) == sorted(want, key=str)
    assert len(rows_of(shelf.read(3))) == 3 * 52  # old versions stay as they were
    assert shelf.compact() is None
    shelf.expire()
    assert shelf.versions() == [version] and rows_of(shelf.read()) == sorted(want, key=str)


def test_a_version_is_taken_once(spark):
    shelf = ShardTable(spark, scratch_path(spark, "t"))
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert shelf.append(df) == 1
    with pytest.raises(VersionTaken):
        shelf._commit(shelf.manifest(), df.schema, 0)
    assert shelf.versions() == [1] and shelf.append(df) == 2 and shelf.read().count() == 2


def test_empty_arrivals_and_other_columns(spark):
    shelf = ShardTable(spark, scratch_path(spark, "t"))
    df = spark.createDataFrame([], "doc_id long, text string")
    shelf.append(df)
    assert shelf.read().count() == 0 and shelf.read().columns == ["doc_id", "text"] and shelf.compact_all() is None
    with pytest.raises(ValueError):
        shelf.append(spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(ValueError):
        ShardTable(spark, scratch_path(spark, "t")).read()


def small(spark, k, n=40):
    return spark.createDataFrame([(k * n + i, f"text {k} {i} " * 5) for i in range(n)], "doc_id long, text string").coalesce(1)


def interleave(shelf, act):
    """Run act once, just before the table's next commit."""
    commit = shelf._commit

    def late(*args):
        shelf._commit = commit
        act()
        return commit(*args)

    shelf._commit = late


def test_a_compaction_survives_an_append(spark):
    root = scratch_path(spark, "t")
    shelf, other = ShardTable(spark, root, fan_in=3), ShardTable(spark, root, fan_in=3)
    want = [small(spark, k) for k in range(3)]
    for df in want:
        shelf.append(df)
    interleave(shelf, lambda: other.append(small(spark, 3)))
    assert shelf.compact() == 5  # on top of the append, which took version 4
    assert shelf.manifest().count() == 2
    assert rows_of(shelf.read()) == sorted((tuple(r) for df in [*want, small(spark, 3)] for r in df.collect()), key=str)


def test_two_compactions_merge_once(spark):
    root = scratch_path(spark, "t")
    shelf, other = ShardTable(spark, root, fan_in=3), ShardTable(spark, root, fan_in=3)
    for k in range(3):
        shelf.append(small(spark, k))
    interleave(shelf, other.compact)
    assert shelf.compact() is None  # the other one merged all there was
    assert shelf.manifest().count() == 1 and shelf.read().count() == 120


def test_an_append_survives_expire(spark):
    root = scratch_path(spark, "t")
    shelf, other = ShardTable(spark, root, fan_in=2), ShardTable(spark, root, fan_in=2)
    shelf.append(small(spark, 0))
    shelf.append(small(spark, 1))
    other.compact_all()
    interleave(shelf, other.expire)
    shelf.append(small(spark, 2))
    assert shelf.read().count() == 120
    other.expire(grace_s=-60)
    assert shelf.read().count() == 120


def test_arrivals_of_one_scan(spark):
    shelf = ShardTable(spark, scratch_path(spark, "t"))
    df = spark.createDataFrame([(i if i else None, "é" * 400_000 if i == 3 else f"t{i}", 5) for i in range(9)], "doc_id long, text string, arrival int")
    assert shelf.append_each(df, F.pmod("doc_id", F.lit(3))) == 3
    assert [shelf.read(v).count() for v in (1, 2, 3)] == [3, 6, 9]
    assert rows_of(shelf.read()) == rows_of(df) and shelf.read().columns == df.columns
    assert shelf.append_each(df.where("false"), F.col("doc_id")) == 4 and shelf.read().count() == 9
