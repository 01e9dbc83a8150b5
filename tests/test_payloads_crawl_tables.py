"""Payloads against plain Python, crawls against a plain walk, and tables with two writers."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import payload
from sievegrid.operators import crawl
from sievegrid.sources.tables import Conflict, KeyedTable


def made(rng, depth=0):
    kind = rng.randrange(8 if depth < 5 else 5)
    if kind == 0:
        return None
    if kind == 1:
        return rng.choice([True, False])
    if kind == 2:
        return rng.randrange(-(10**6), 10**12)
    if kind == 3:
        return rng.choice(['q"\\u\n', "é日本", "", '{"k":1}', ',"k":', "x" * 30])
    if kind == 4:
        return rng.randrange(100) + 0.5
    if kind == 5:
        return [made(rng, depth + 1) for _ in range(rng.randrange(6))]
    return {rng.choice(["b", "a", "Z", "é", "token", 'q"', "a.b", "user_id"]) + str(rng.randrange(3)): made(rng, depth + 1) for _ in range(rng.randrange(7))}


def plain_bounded(x, depth, most, text):
    if isinstance(x, str):
        return x[:text]
    if isinstance(x, (list, dict)) and not depth:
        return None
    if isinstance(x, list):
        return [plain_bounded(y, depth - 1, most, text) for y in x[:most]]
    if isinstance(x, dict):
        return {k: plain_bounded(x[k], depth - 1, most, text) for k in sorted(x)[:most]}
    return x


def keys_of(x):
    if isinstance(x, dict):
        return set(x) | {k for y in x.values() for k in keys_of(y)}
    return {k for y in x for k in keys_of(y)} if isinstance(x, list) else set()


def written(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_payloads(spark):
    rng = random.Random(4)
    values = [made(rng) for _ in range(250)] + [{f"k{i:02}": {"deep": {"deeper": {"no": 1}}} for i in range(40)}, list(range(40)), {"facts": {"x": [1]}}]
    rows = [(i, json.dumps(x, indent=2), json.dumps(y)) for i, (x, y) in enumerate(zip(values, values[1:] + values[:1], strict=True))]
    df = spark.createDataFrame(rows, "i int, x string, y string")
    got = df.select(
        "i", payload.canonical(F.col("x")).alias("c"), F.to_json(payload.bounded(F.try_parse_json("x"), 3, 5, 7)).alias("b"), payload.changed_keys(F.col("x"), F.col("y")).alias("d"),
        payload.all_keys(F.col("x")).alias("k"), payload.forbidden_keys(F.col("x"), ["A1"], ["user_"]).alias("f"), F.to_json(payload.value_at(F.col("x"), "facts", "x")).alias("v"),
    ).collect()
    for r in got:
        x, y = values[r.i], values[(r.i + 1) % len(values)]
        assert r.c == written(x)
        assert json.loads(r.b or "null") == plain_bounded(x, 3, 5, 7), x
        a, b = (z if isinstance(z, dict) else {} for z in (x, y))
        assert r.d == sorted((k for k in {*a, *b} if written(a.get(k)) != written(b.get(k))), key=lambda k: k.encode())
        assert {json.loads(f'"{k}"') for k in r.k} == keys_of(x)
        assert set(r.f) == {k for k in keys_of(x) if k.lower() == "a1" or k.lower().startswith("user_")}
        assert r.v == ("[1]" if isinstance(x, dict) and "facts" in x else None)
    odd = spark.createDataFrame([("{",), (None,), ('{"a":1,"a":2}',), ("1e999",)], "x string")
    assert [r.c for r in odd.select(payload.canonical(F.col("x")).alias("c")).collect()][:3] == [None, None, None]
    assert odd.select(F.to_json(payload.bounded(F.try_parse_json("x"))).alias("b")).collect()[3].b in (None, "null")
    assert odd.select(payload.changed_keys(F.col("x"), F.col("x")).alias("d")).distinct().collect()[0].d == []


def plain_coverage(start, pages, most_pages, most_anchors):
    at, seen, anchors, found, limited, partial, resume = start, [], {}, False, False, False, None
    for i in range(most_pages):
        if at in seen:
            break
        if at not in pages:
            partial, resume = True, at
            break
        seen.append(at)
        following, links = pages[at]
        for url, title in links:
            anchors.setdefault(url, title)
        if len(anchors) >= most_anchors or following is None or following in seen:
            break
        found = True
        if i + 1 >= most_pages:
            limited, resume = True, following
        at = following
    return seen, found, limited, partial, resume, list(anchors.items())


@pytest.mark.parametrize("most_pages, most_anchors", [(5, 400), (3, 6), (1, 1)])
def test_coverage(spark, most_pages, most_anchors):
    rng = random.Random(7)
    pages = {f"p{i}": (rng.choice([f"p{rng.randrange(70)}", f"p{i + 1}", None]), [(f"a{rng.randrange(9)}", f"t{rng.randrange(3)}") for _ in range(rng.randrange(5))]) for i in range(60)}
    starts = [(f"s{i}", f"p{rng.randrange(65)}") for i in range(50)]
    stored = spark.createDataFrame([(u, n, a) for u, (n, a) in pages.items()], "url string, next_url string, anchors array<struct<url:string,title:string>>")
    got = crawl.coverage(spark.createDataFrame(starts, "source string, url string"), stored, "source", "url", most_pages, most_anchors).collect()
    assert len(got) == len(starts)
    for r in got:
        want = plain_coverage(dict(starts)[r.source], pages, most_pages, most_anchors)
        assert (r.pages, r.next_found, r.limited, r.partial, r.resume, [tuple(a) for a in r.anchors]) == want
        assert r.n_anchors == len(r.anchors)


def test_tables(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k string, n int")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n int")
    got = lambda v=None: sorted(map(tuple, t.read(v).collect()))
    assert (t.version(), got()) == (0, [])
    assert t.upsert(rows(("a", 1), ("b", 2))) == 1 and t.upsert(rows(("b", 3), ("c", None))) == 2
    assert got() == [("a", 1), ("b", 3), ("c", None)] and got(1) == [("a", 1), ("b", 2)]
    assert t.delete(rows(("a", 0), ("zz", 0)).select("k")) == 3 and got() == [("b", 3), ("c", None)]
    assert t.replace(F.col("k") >= "c", rows(("d", 4))) == 4 and got() == [("b", 3), ("d", 4)]
    assert t.upsert(rows(("a", 9))) == 5 and t.fold() == 6 and got() == [("a", 9), ("b", 3), ("d", 4)] and len(t._manifest(6)["parts"]) == 1
    with pytest.raises(Conflict):
        t.upsert(rows(("a", 0)), after=5)
    with pytest.raises(ValueError):
        t.upsert(rows(("a", 0), ("a", 1)))
    assert t.publish(rows(("p", 1)), "2024") == 7 and t.publish(rows(("p", 1)), "2024") == 7
    with pytest.raises(Conflict):
        t.publish(rows(("p", 2)), "2024")
    assert got()[-1] == ("p", 1)
    with pytest.raises(ValueError):
        t.read(99)


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    faults, done = [], []

    def write(who):
        t = KeyedTable(spark, root, ["k"], "k string, n int")
        for i in range(4):
            t.upsert(spark.createDataFrame([(f"{who}{i}", i), ("both", who)], "k string, n int"))
        try:
            done.append(t.publish(spark.createDataFrame([("as_of", who)], "k string, n int"), "2024-01-01"))
        except Conflict as e:
            faults.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = KeyedTable(spark, root, ["k"], "k string, n int")
    assert t.version() == 9 and len(faults) == 1 and len(done) == 1
    assert {r.k for r in t.read().collect()} == {f"{w}{i}" for w in (1, 2) for i in range(4)} | {"both", "as_of"}


def test_payloads_are_parsed_once(spark):
    """Hash, value, changed and forbidden keys and the public form of an event share one parse; parts agree with the functions of whole texts."""
    from sievegrid.plans import records

    plan = records.QUERIES["payload_projection"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1
    df = spark.createDataFrame([('{"b": 1, "a": {"A1": null}}', '{"a": {"A1": 0}, "c": null}'), (None, '{"z": "1"}'), ("[1]", "x")], "x string, y string")
    x, y = F.col("x"), F.col("y")
    v, w = F.try_parse_json(x), F.try_parse_json(y)
    rows = df.select(payload.changed_keys(x, y).alias("a"), payload.changed_fields(payload.fields_of(v), payload.fields_of(w)).alias("b"), payload.changed_fields(F.lit(None).cast("map<string,string>"), payload.fields_of(w)).alias("c"), payload.forbidden_of(payload.canonical(x), ["a1"]).alias("f"))
    got = [tuple(r) for r in rows.collect()]
    assert got == [(["a", "b"], ["a", "b"], ["a"], ["A1"]), (["z"], ["z"], ["z"], None), ([], [], [], [])]
