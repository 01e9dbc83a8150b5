"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline as p
from sievegrid.llm import mixing
from tests.llm.test_shingle_dedup import plain_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, quality = docs.columns, dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]

    good = p.quality(spark, docs, SF).cache()
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    judged = [d for d in quality if (d in kept) == bool(quality[d])]
    assert len(judged) / len(quality) > 0.9

    once = p.exact(spark, good, SF).cache()
    assert once.columns == columns
    groups = {}
    for r in good.collect():
        groups.setdefault("".join(r.text.translate(dict.fromkeys(b" \t\n\x0b\x0c\r"))), []).append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in once.collect()} == {min(g)[1] for g in groups.values()}

    single = p.near(spark, once, SF).cache()
    assert single.columns == columns
    rows = [(r.doc_id, r.text) for r in once.collect()]
    assert {r.doc_id for r in single.collect()} == set(plain_kept(rows))  # five words, Jaccard 0.8

    mixed = p.mix(spark, single, SF).cache()
    assert mixed.columns == columns
    want = {r.doc_id for r in mixing.mix(single).collect() if r.sampled}
    assert {r.doc_id for r in mixed.collect()} == want and 0 < len(want) < single.count()

    packed = p.pack(spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == want
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_run(spark):
    assert p.run(spark, SF).count() > 0


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing and dotted names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    schema = docs.schema
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    odd = [(None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", None, "s", 0), (900_003, long, "en", None, len(long)), (900_004, long, "en", "s", len(long)), (900_005, "a b", "en", "s", 3), (900_005, "a b", "en", "s", 3), (None, "c d", "en", "s", 3)]
    rows = [tuple({"doc_id": r[0], "text": r[1], "lang": r[2], "source": r[3], "n_chars": r[4]}[c] for c in schema.names) for r in odd]
    df = docs.unionByName(spark.createDataFrame(rows, schema)).selectExpr("*", "1 AS m1", "2 AS `a.b`", "3 AS topic", "4 AS piece", "5 AS whole", "6 AS sketch", "7 AS root").cache()
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns, name
        kept = got.collect()
        assert {tuple(r)[-7:] for r in kept} <= {(1, 2, 3, 4, 5, 6, 7)}
        if name in ("exact dedup", "SimHash near-dedup"):
            mine = sorted(str(r.doc_id) for r in kept if r.doc_id is None or r.doc_id > 900_000)
            # empty texts are one class, led by the smallest id; so are the two long ones; of the whole repeats one stays
            assert mine == ["900001", "900003", "900005", "None"], name
    packed = p.pack(spark, df, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 900_003) == sum(r.length for r in packed if r.doc_id == 900_004) > 300_000
    assert sum(r.doc_id == 900_005 for r in packed) == 2 and sum(r.doc_id is None for r in packed) == 2
