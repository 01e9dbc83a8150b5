"""Scans of sources: one step at a time, batch against a plain walk, stream against batch, and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from sievegrid.plans import tables
from sievegrid.streaming import scans
from sievegrid.streaming.scans import Rules, Source, step

RULES = Rules()


def run(events, rules=RULES):
    s, out = Source(), []
    for kind, at, url, mark, bucket in events:
        out += [x for x in step(s, kind, at, url, mark, bucket, rules)]
    return s, out


def test_barrier_holds_siblings_until_its_own_success():
    head = [("SEEN", 1, "a", "m", ""), ("SEEN", 1, "b", "m", ""), ("VERIFIED", 2, "a", "", ""), ("FAILED", 2, "b", "", ""), ("SCAN_END", 3, "", "", "t1")]
    s, out = run(head)
    assert out == [("VERIFY", "a", 0), ("VERIFY", "b", 0), ("HELD", "", 1), ("INTERVAL", "", 900)]
    other = [("SEEN", 4, "c", "m", ""), ("VERIFIED", 5, "c", "", ""), ("SCAN_END", 6, "", "", "t2")]
    assert run(head + other)[1][-2:] == [("HELD", "", 2), ("INTERVAL", "", 900)]  # another's success does not lift it
    own = [("VERIFIED", 5, "b", "", ""), ("SCAN_END", 6, "", "", "t2"), ("SCAN_END", 7, "", "", "t2")]
    assert run(head + own)[1][4:] == [("RELEASED", "a", 2), ("RELEASED", "b", 5), ("INTERVAL", "", 900), ("REPEATED", "", None)]


def test_carry_over_ends_and_full_cycles_clear():
    head = [("SEEN", 1, "b", "m", ""), ("FAILED", 2, "b", "", ""), ("SEEN", 2, "a", "m", ""), ("VERIFIED", 100_000, "a", "", "")]
    assert run([*head, ("SCAN_END", 2 + RULES.carry_s, "", "", "t")])[1][-2] == ("HELD", "", 1)
    assert run([*head, ("SCAN_END", 3 + RULES.carry_s, "", "", "t")])[1][-2] == ("RELEASED", "a", 100_000)
    s, out = run([*head, ("FULL_CYCLE", 100_001, "", "", ""), ("SCAN_END", 100_002, "", "", "t")])
    assert out[-2:] == [("CLEARED", "", None), ("INTERVAL", "", 900)] and not s.stage and not s.barrier and len(s.ledger) == 2


def test_reasons_attempts_and_intervals():
    fails = [("SEEN", 1, "a", "m", ""), ("FAILED", 2, "a", "", ""), ("SEEN", 3, "a", "m", ""), ("FAILED", 4, "a", "", ""), ("SEEN", 5, "a", "m", ""), ("SEEN", 6, "a", "n", "")]
    assert run(fails)[1] == [("VERIFY", "a", 0), ("VERIFY", "a", 2), ("EXHAUSTED", "a", 2), ("VERIFY", "a", 1)]
    due = [("SEEN", 1, "a", "m", ""), ("VERIFIED", 2, "a", "", ""), ("SEEN", 3, "a", "m", ""), ("SEEN", 2 + RULES.due_s, "a", "m", "")]
    assert run(due)[1] == [("VERIFY", "a", 0), ("VERIFY", "a", 3)]
    quiet = [("SCAN_END", i, "", "", f"t{i}") for i in range(6)]
    assert [d for _, _, d in run(quiet)[1]] == [1800, 3600, 7200, 14_400, 14_400, 14_400]
    assert run([("SEEN", 1, "a", "m", ""), ("SEEN", 2 + RULES.forget_s, "a", "m", "")])[1] == [("VERIFY", "a", 0)] * 2
    assert run([("?", 1, "u", "", "")])[1] == [("IGNORED", "u", None)]


def made(seed, n=900):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        kind = rng.choices(["SEEN", "VERIFIED", "FAILED", "SCAN_END", "FULL_CYCLE"], [8, 3, 1, 3, 0.2])[0]
        hot = rng.random() < 0.4
        rows.append(("hot" if hot else f"s{rng.randrange(6)}", seq, 1_700_000_000 + seq * 700, kind, f"u{rng.randrange(9)}", f"m{rng.randrange(2)}", str(seq // 3)))
    return rows


def plain(rows):
    states, out = {}, []
    for source, seq, at, kind, url, mark, bucket in rows:
        out += [(source, seq, at, *x) for x in step(states.setdefault(source, Source()), kind, at, url, mark, bucket, RULES)]
    return sorted(out, key=str)


def test_batch_form(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, scans.EVENT).repartition(5)
    assert sorted(map(tuple, scans.outcomes(df).collect()), key=str) == plain(rows)
    assert scans.outcomes(df.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1, "SEEN", None, None, None), ("a", 2, 2, None, None, None, None)], scans.EVENT)
    assert sorted((r.outcome, r.url) for r in scans.outcomes(nulls).collect()) == [("IGNORED", ""), ("VERIFY", "")]


@pytest.fixture()
def store(spark):
    was = {k: spark.conf.get(k, None) for k in scans.STATE_STORE}
    for k, v in scans.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_stream_equals_batch_through_a_restart(spark, store, tmp_path):
    """Events come in three files, the query ends after each and goes on from its checkpoint."""
    rows = made(2, 300)
    (tmp_path / "in").mkdir()
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], scans.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(scans.EVENT).parquet(str(tmp_path / "in"))
        query = scans.outcome_stream(live).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("source", "seq", "at_s", "outcome", "url", "detail").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_query_over_events(spark):
    sf = "/root/testdata/sf0.001"
    got = tables.QUERIES["source_scans"](spark, sf).collect()
    events = tables.scan_events(spark, sf).orderBy("at_s", "seq").collect()
    assert sorted(map(tuple, got), key=str) == plain([tuple(r) for r in events]) and {"RELEASED", "HELD", "VERIFY", "CLEARED"} <= {r.outcome for r in got}
