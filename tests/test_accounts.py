"""Accounts, choices of markets, shown percentages and snapshots: odd rows, empty tables, ties."""

from pyspark.sql import functions as F

from sievegrid.functions import text
from sievegrid.operators import accounts, ledger, merge, scoring


def test_export_and_profiles(spark):
    users = spark.createDataFrame([(1, "a"), (2, None)], "u int, n string")
    rows = spark.createDataFrame([(1, 5, "x", None), (1, 5, "x", None), (1, 7, None, 2), (3, 1, "z", 1), (None, 1, "z", 1)], "o int, at int, v string, w int")
    part = accounts.Part(rows, "o", [F.col("at").desc(), F.col("w")], ["v", "w"])
    lines = accounts.export_lines(users, "u", ["u", "n"], {"p": part}, {"p": "at"})
    got = sorted((r.u, r.part, r.at or "", r.line) for r in lines.collect())
    assert got == [(1, "account", "", '{"u":1,"n":"a"}'), (1, "p", "5", '{"v":"x","w":null}'), (1, "p", "5", '{"v":"x","w":null}'), (1, "p", "7", '{"v":null,"w":2}'), (2, "account", "", '{"u":2,"n":null}')]
    made = accounts.profiles(users, "u", {"p": (part, 2)}).orderBy("u").collect()
    assert [[tuple(i) for i in r.p] for r in made] == [[(None, 2), ("x", None)], []]
    assert accounts.profiles(users.limit(0), "u", {"p": (part, 2)}).count() == 0
    said = spark.createDataFrame([(1, 1, 5), (1, 2, 99), (2, 1, None)], "u int, at int, n int")
    assert sorted(map(tuple, accounts.preference(users, "u", said, ["at"], "n", [3, 5], 3).collect())) == [(1, 5), (2, 3)]


def test_states_and_indexes(spark):
    cards = spark.createDataFrame([(1, "x"), (1, "y")], "u int, k string")
    followups = spark.createDataFrame([(1, "x", 10, "WON")], "u int, k string, followup int, status string")
    events = spark.createDataFrame([(10, 1, "a"), (10, 2, "b"), (10, 3, "c")], "f int, at int, note string")
    got = accounts.states(cards, ["u", "k"], followups, accounts.Part(events, "f", [F.col("at").desc()], ["note"]), 2).orderBy("k").collect()
    assert [(r.status, [h.note for h in r.history]) for r in got] == [("WON", ["c", "b"]), ("NEW", [])]
    rows = spark.createDataFrame([(1, i, "A" if i else "?") for i in range(4)] + [(2, 0, "A")], "u int, at int, status string")
    index = accounts.status_index(rows, "u", [F.col("at")], ["A"], 3)
    assert sorted((r.u, r["at"], r.truncated) for r in index.collect()) == [(1, 1, True), (1, 2, True), (2, 0, False)]
    members = spark.createDataFrame([("g", True), ("g", True), ("h", True), ("h", None)], "g string, out boolean")
    assert [tuple(r) for r in accounts.left_empty(members, "g", F.col("out")).collect()] == [("g", 2)]


def test_points_markets_and_snapshots(spark):
    p = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-5.0,), (45.0,), (500.0,)], "p double")
    assert [r[0] for r in p.select(scoring.percent_points(F.col("p"), 10)).collect()] == [0, 0, 0, 0, 5, 10]
    ids = spark.createDataFrame([("CCGP_he_1",), ("x",), (None,)], "i string")
    assert [r[0] for r in ids.select(text.market_of_id(F.col("i"))).collect()] == ["HE", "TJ", "TJ"]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    one = merge.snapshot_checks(a, a.limit(0), "k", "rank").collect()[0]
    assert (one.local_count, one.remote_count, one.pool_ids, one.card_ids, one.first_difference, one.pool_count) == (2, 0, False, False, 1, False)


def test_bootstrap(spark):
    day = 86_400
    d = spark.createDataFrame([(k, "m", "t", "p") for k in "abcdefghi"], "key string, fingerprint string, title string, published_at string")
    e = spark.createDataFrame(
        [("c", "other", "FAILED", None, None, 1), ("d", "m", "VERIFIED", "m", 900, 1), ("e", "m", "FAILED", None, None, 1), ("g", "m", "VERIFIED", "m", 100, 600), ("h", "m", "VERIFIED", "m", 100, 400)],
        "key string, fingerprint string, status string, verified_fingerprint string, last_verified long, last_seen long",
    )
    c = spark.createDataFrame([("a", "t", "p", 2000), ("b", "t", "p", 1000 - 2 * day), ("c", "t", "p", 500), ("d", "t", "p", 500), ("e", "t", "p", 500), ("f", "T", "p", 500), ("g", "T", "p", 500), ("h", "T", "p", 500), ("i", " t ", None, 500)], "key string, title string, published_at string, observed long")
    got = {r.key: r.disposition for r in ledger.bootstrapped(d, e, c, "key", F.lit(1000), F.lit(700), day, F.lit(True)).collect()}
    assert got == {"a": None, "b": "STALE", "c": "METADATA_CHANGED", "d": "NEWER_VERIFIED", "e": "NEWER_STATE", "f": "METADATA_MISMATCH", "g": "BRIDGE_TOO_OLD", "h": "BRIDGED", "i": "SEEDED"}
