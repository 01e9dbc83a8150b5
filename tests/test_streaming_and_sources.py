"""Streams give what their batch forms give; sources and snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import ledger, merge
from sievegrid.sources import files
from sievegrid.streaming import ledgers

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def stream(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"))
    for i in range(2):
        rows.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def drained(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_once_per_bucket(spark, stream):
    rows, live = stream
    got = drained(ledgers.once_per_bucket(live, "event_type", "ts", 180, "60 days"), "once")
    assert got.count() == rows.select("event_type", F.floor(F.col("at_s") / 10_800)).distinct().count()


def test_window_hits(spark, stream):
    rows, live = stream
    got = drained(ledgers.window_hits(live, "event_type", "ts", "1 hour", 3, "60 days"), "hits", "complete")
    want = ledger.rate_limited(rows, "event_type", F.col("at_s"), ["at_s", "event_id"], 3600, 3)
    assert got.agg(F.sum("over")).first()[0] == want.where("limited").count()


def test_change_reasons(spark, stream, tmp_path):
    rows, _ = stream
    rows.coalesce(1).write.parquet(str(tmp_path / "whole"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "whole"))
    got = drained(ledgers.change_reasons(live, "user_id", "at_s", "event_type", 43_200), "reasons")
    want = ledger.observed_changes(rows, ["user_id"], ["at_s", "event_type"], F.col("event_type"), F.col("at_s"), 43_200)
    columns = ["user_id", "at_s", "event_type", "reason"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_keep_last(spark, stream, tmp_path):
    rows, live = stream
    live = live.select("user_id", "event_id", "event_type")
    ledgers.keep_last(live, ["user_id"], ["event_id"], str(tmp_path / "state"), str(tmp_path / "cp")).start().awaitTermination()
    want = merge.last_wins(rows.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])
    got = ledgers.last_rows(spark, str(tmp_path / "state"), ["user_id"], ["event_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = ledgers.compacted(spark, str(tmp_path / "state"), str(tmp_path / "next"), ["user_id"], ["event_id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_sources(spark, tmp_path):
    for name, rows in (("tj_a.json", [{"id": "1", "market_code": None}, {"id": "2", "market_code": "SH"}]), ("x.json", [{"id": "3"}])):
        (tmp_path / name).write_text(json.dumps(rows))
    df = files.read_json_arrays(spark, [str(tmp_path / "tj_a.json"), str(tmp_path / "x.json")], "id string, market_code string")
    good, bad = files.market_quarantine(df, {"tj_": "TJ"})
    assert {r.id: r.market_code for r in good.collect()} == {"1": "TJ", "2": "SH"} and [r.id for r in bad.collect()] == ["3"]
    assert {r.id: r.file_order for r in df.collect()} == {"1": 0, "2": 0, "3": 1}
    assert files.with_market(df.where("id < 3"), {"tj_": "TJ"}).count() == 2
    with pytest.raises(Exception, match="MARKET_METADATA_MISSING"):
        files.with_market(df, {"tj_": "TJ"}).collect()
    assert files.optional(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert files.or_seed(df.where("false"), df).count() == 3
    plan = files.QueryPlan(("TJ", "SH"), ("ct", "x y"), ("BID",))
    assert plan.tasks(spark).count() == 4
    assert plan.tasks(spark).select(files.search_url("https://e.example/s", q=F.col("keyword"))).distinct().count() == 2
    with pytest.raises(ValueError):
        files.QueryPlan((), ("a",), ("b",))
    plan = files.QueryPlan.load('{"markets": [{"market_code": "TJ", "max_candidates": 5}, "SH"], "keywords": ["ct"], "notice_types": ["BID"], "pages": 2}')
    assert {(r.market, r.page, r.most) for r in plan.tasks(spark).collect()} == {("TJ", 1, 5), ("TJ", 2, 5), ("SH", 1, 100), ("SH", 2, 100)}
    root = str(tmp_path / "snap")
    place = files.publish_snapshot(df.select("id"), root, "2024-01-02")
    assert files.publish_snapshot(df.select("id"), root, "2024-01-02") == place
    with pytest.raises(ValueError):
        files.publish_snapshot(df.select("id").limit(1), root, "2024-01-02")
    files.publish_snapshot(df.select("id").limit(1), root, "2024-01-01")
    assert files.latest_snapshot(spark, root).count() == 3
    levels = spark.createDataFrame([("city", 1), ("city", 2), ("town", 3)], "level string, i int")
    assert [r.level for r in files.division_faults(levels, "level", {"city": 2, "town": 2, "village": 0}).collect()] == ["town"]
