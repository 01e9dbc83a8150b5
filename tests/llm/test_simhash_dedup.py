"""SimHash near-dedup against all pairs of small tables."""

import random

import pytest
import xxhash

from sievegrid.llm import simhash_dedup as op
from sievegrid.llm.components import connected_components
from sievegrid.llm.queries import op5_simhash_dedup


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, distance=2):
    """(id, hex, smallest id reachable) by comparing all pairs of fingerprints."""
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= distance:
                parent[find(p)] = find(q)
    least = {}
    for (id_, _), p in zip(rows, prints, strict=True):
        r = find(p)
        least[r] = min((x for x in (least.get(r), id_) if x is not None), default=None)
    return sorted(((id_, f"{p:016x}", least[find(p)]) for (id_, _), p in zip(rows, prints, strict=True)), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op5_simhash_dedup(spark, sf).collect()), key=str) == plain_components(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "É a b"), (8, "é a b"), (None, "one"), (9, long), (10, long + " tail"), (6, "one two"), (11, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = op.near_duplicates(df)
    assert sorted((tuple(r[:3]) for r in found.collect()), key=str) == plain_components(rows)
    kept = op.drop_near_copies(df.selectExpr("*", "1 AS m1", "2 AS root")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted({c for _, _, c in plain_components(rows)}, key=str)
    assert all((r.m1, r.root) == (1, 2) for r in kept)
    assert op.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["x" * (1 << 20) + " a b", " " * (1 << 20) + "a b c d", "a " + "y" * (1 << 20) + " b", "x" * (1 << 20) + " " * (1 << 20) + "a", "a b " + " " * (3 << 20), "q " + "z" * (2 << 20)])
def test_very_long_words_and_blanks(text):
    assert int(op.fingerprints_of([b"a b", text.encode(), b""])[1]) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_links_lose_no_pair(spark, distance):
    rng = random.Random(distance)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randrange(distance + 2)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {tuple(r) for r in op.near_links(nodes, distance).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert found == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 400)] + [(7, 7), (500, 501), (501, 500)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, **dict.fromkeys(range(200, 400), 100), 500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
