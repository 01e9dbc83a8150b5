"""Raking against a plain loop, and the sample's defined results."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import mixing as op
from sievegrid.llm.queries import ORACLE_SQL, op4_mixing


def plain_fit(cells, targets, rounds=op.ROUNDS):
    """Factors of cells {(values): tokens} by scaling one marginal after another."""
    factors = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(rounds):
        for i, target in enumerate(targets):
            there = {v for c in cells for v in [c[i]]}
            whole = sum(s for v, s in target.items() if v in there)
            have = dict.fromkeys(target, 0.0)
            for c, w in cells.items():
                have[c[i]] += w * factors[c]
            for c in cells:
                factors[c] *= target[c[i]] / whole * total / have[c[i]]
    top = max(factors.values())
    return {c: min(1.0, 1 / top) * f for c, f in factors.items()}


TARGETS = {"source": {"a": 0.2, "b": 0.5, "gone": 0.3}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.5, "y": 0.5}}


def test_factors_and_marginals(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice("aab"), rng.choice(["en", "en", "de"]), rng.choice("xy")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    got = op.mix(df, TARGETS, topic=F.col("kind")).collect()
    cells = {}
    for _, text, *values in rows:
        cells[tuple(values)] = cells.get(tuple(values), 0) + len(text.split())
    want = plain_fit(cells, list(TARGETS.values()))
    for r in got:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.kind], rel=1e-9)
        assert r.topic == r.kind and 0 < r.probability <= 1
    whole = sum(r.n_tokens * r.probability for r in got)
    for value, share in (("de", 0.4), ("en", 0.6)):
        assert sum(r.n_tokens * r.probability for r in got if r.lang == value) / whole == pytest.approx(share, rel=1e-6)
    assert sum(r.n_tokens * r.probability for r in got if r.source == "a") / whole == pytest.approx(0.2 / 0.7, rel=1e-6)


def test_budget_nulls_unlisted_values_and_clashes(spark):
    rows = [(1, "a b", "s", "en", 5), (2, None, "s", "en", 5), (3, "", None, None, 5), (4, "c d e", None, "xx", 5), (None, "q", "s", "en", 5), (1, "a b", "s", "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    got = op.mix(df, {"source": {"s": 0.5}, "lang": {"en": 0.5}, "topic": {}}, budget=0.5).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert sum(r.n_tokens * r.probability for r in got) <= 0.5 * 8 + 1e-9
    assert len({r.sampled for r in got if r.doc_id == 1}) == 1
    assert op.sample(df).columns == df.columns and {r.topic for r in op.sample(df).collect()} <= {5}
    assert op.mix(df.where("false")).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, "s", "en")], "doc_id long, text string, source string, lang string")
    row = op.mix(df).first()
    assert (row.n_tokens, row.probability, row.sampled) == (400_000, 1.0, True)


def test_more_values_than_are_broadcast(spark):
    rng = random.Random(4)
    rows = [(i, "w " * (1 + s % 7 + rng.randrange(9)), f"s{s:02}" if s else None, rng.choice(["en", "de"]), "x") for i in range(1600) for s in [i % 80]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    got = op.mix(df, topic=F.col("kind"), broadcast_rows=10).collect()
    natural = {}
    for _, text, source, *_ in rows:
        natural[source] = natural.get(source, 0) + len(text.split())
    whole = sum(t**op.TEMPER for t in natural.values())
    assert len(natural) == 80 and all(0 < r.probability <= 1 for r in got)
    expected = {}
    for r in got:
        expected[r.source] = expected.get(r.source, 0) + r.n_tokens * r.probability
    tokens = sum(expected.values())
    for s in natural:
        assert expected[s] / tokens == pytest.approx(natural[s] ** op.TEMPER / whole, rel=1e-6)


def test_two_thousand_sources_as_in_sql(spark, tmp_path):
    rng = random.Random(6)
    words = ["harbour", "Lantern", "orchard", "meadows", "granite", "velvet", "thunder", "compass", "whisper", "is", "of"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40))), f"s{i if i < 2000 else min(rng.randrange(2000), rng.randrange(2000)):04}", rng.choice(["en", "en", "de"]), 1) for i in range(12_000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_mixing(spark, str(tmp_path)).collect()
    assert len({r.source for r in got}) == 2000 and min(r.probability for r in got) > 0
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(ORACLE_SQL["op4_mixing"])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got)


def test_genres(spark):
    rows = [(1, "in 1999 12345"), (2, "see http://a.b for more"), (3, "a\nb\nc"), (4, "word " * 500), (5, None), (6, "plain words"), (7, "me@there"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", op.genre(F.col("text")).alias("t")).collect()}
    assert got == {1: "figures", 2: "web", 3: "lines", 4: "long", 5: "prose", 6: "prose", 7: "web", 8: "prose"}


def test_seed_words_of_each_language(spark):
    """Words of all texts tell seeds, each language its own; lower case is of A-Z."""
    rows = [(1, "Harbour harbour lantern is", "en"), (2, "the LANTERN, harbour!", "en"), (3, "Straße Hafenstadt", "de"), (4, "hafenstadt im Nebel", "de"), (5, "short ones", "en"), (6, None, None), (7, "orchards", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.seed for r in op.seeded(df).collect()}
    assert got == {1: "harbour", 2: "harbour", 3: "hafenstadt", 4: "hafenstadt", 5: "none", 6: "none", 7: "orchards"}
    assert op.seeded(df.where("false")).count() == 0


def test_query_tells_seeds_as_in_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = op4_mixing(spark, sf).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(ORACLE_SQL["op4_mixing"])
    columns = [d[0] for d in want.description]
    assert "seed" in columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got)
    assert {lang for lang in {r.lang for r in got} if any(r.seed != "none" for r in got if r.lang == lang)} == {r.lang for r in got}


def test_few_cells_are_fitted_on_the_driver_as_by_jobs(spark, monkeypatch):
    """Both forms give the same multipliers; while there are few cells no round writes a table, and texts are measured once."""
    rng = random.Random(11)
    rows = [(f"s{rng.randrange(4)}", rng.choice(["en", "fr"]), rng.choice("abc"), float(rng.randrange(1, 99))) for _ in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, w double").groupBy("source", "lang", "topic").agg(F.sum("w").alias("w"))
    written = []
    monkeypatch.setattr(op, "materialise", lambda df, label, free=False, real=op.materialise: (written.append(label), real(df, label, free))[1])
    for targets in (None, {"source": {"s0": 0.5, "s1": 0.2}, "lang": {"en": 1.0}, "topic": {"a": 0.4, "b": 0.6, "other": 0.0}}):
        shown = cells if targets is None else cells.select(*[op._value(F.col(d), d, targets).alias(d) for d in targets], "w")
        tables = [{d: dict(t.select("value", "f").collect()) for d, t in op.fit(shown, ["source", "lang", "topic"], targets, broadcast_rows=n).items()} for n in (op.BROADCAST_ROWS, 10)]
        for d in tables[0]:
            assert tables[0][d].keys() == tables[1][d].keys()
            assert all(abs(f - tables[1][d][v]) <= 1e-9 * max(f, 1.0) for v, f in tables[0][d].items())
    assert "multipliers" in written  # ten rows at most: by jobs
    written.clear()
    op.mix(spark.createDataFrame([(1, "a b", "s", "en"), (2, "c", "t", "fr")], "doc_id long, text string, source string, lang string")).collect()
    assert written == ["measured", "cells"]
