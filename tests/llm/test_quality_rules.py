"""The rule ensemble: held-out accuracy, and its defined results on odd tables."""

import math
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from sievegrid.llm import quality_rules as op
from sievegrid.llm.queries import op3_quality_rules


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op3_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in judged) / len(judged) > 0.95


def test_odd_texts_and_columns(spark):
    texts = [None, "", " \n\t", "a", "!!! ***", "word " * 300_000, "Ein Satz.", "Ein Satz."]
    df = spark.createDataFrame([(i, t, 9.0, "s") for i, t in enumerate(texts)], "doc_id long, text string, score double, stats string")
    model = op.RuleModel(0.5, (((("upper", ">", 0.0), ("log_words", "<=", 3.0)), 2.0), ((("bars", "<=", 1.0),), -1.0)))
    found = {r.doc_id: r for r in op.score(df, model).collect()}
    assert len(found) == len(texts) and all(0 < r.score < 1 and r.stats == "s" for r in found.values())
    assert found[0].score == found[1].score and found[6].score == found[7].score > found[3].score


def test_no_labels_and_one_class(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (None, "d")], "doc_id long, text string")
    none = op.fit(df, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert none.rules == () and op.score(df, none).select("score").distinct().collect() == [(0.5,)]
    one = op.fit(df, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert {r.predicted for r in op.score(df, one).collect()} == {1}
    assert op.score(df.where("false"), none).count() == 0


def test_paths_keep_one_bound_for_each_side():
    text = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.0)\n     If (feature 0 <= 1.0)\n      Predict: 0.0\n     Else (feature 0 > 1.0)\n      Predict: 1.0\n    Else (feature 0 > 2.0)\n     Predict: 1.0\n"
    assert op._paths(text, ["x"]) == {(("x", "<=", 2.0),), (("x", "<=", 1.0),), (("x", "<=", 2.0), ("x", ">", 1.0)), (("x", ">", 2.0),)}


def test_id_never_feeds_a_score(spark):
    df = spark.createDataFrame([(i, "Same text here.") for i in range(5)], "doc_id long, text string")
    model = op.RuleModel(0.0, (((("upper", ">", 0.0),), 1.0),))
    assert op.score(df, model).agg(F.count_distinct("score")).first()[0] == 1


def plain_statistics(text):
    """The statistics in plain Python."""
    t = text or ""
    words = [w for w in regex.split("[\x20\x09-\x0d]+", t) if w]
    lines, size, some = t.split("\n"), max(len(t), 1), max(len(words), 1)
    share = lambda pattern: len("".join(regex.findall(pattern, t))) / size
    return {
        "log_words": math.log1p(len(words)),
        "log_lines": math.log1p(len(lines)),
        "word_length": len("".join(words)) / some,
        "distinct_words": len(set(words)) / some,
        "distinct_lines": len(set(lines)) / len(lines),
        "repeated_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / some,
        "upper": share(r"\p{Lu}"),
        "digits": share("[0-9]"),
        "full_stops": t.count(".") / some,
        "exclamations": t.count("!") / some,
        "bars": t.count("|") / some,
        "other_marks": share(r"[^\p{L}\p{N}\x20\x09-\x0d.,!|]"),
    }


def plain_score(model, text):
    stats = plain_statistics(text)
    margin = model.intercept
    for conditions, weight in model.rules:
        if all(stats[name] <= at if side == "<=" else stats[name] > at for name, side, at in conditions):
            margin += weight
    return 1 / (1 + math.exp(-margin))


def test_scores_as_in_plain_python(spark):
    """Every document's score under the learned rules, worked out row by row."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = op.fit(docs, labels.where(~op.held_out(F.col("doc_id"))))
    texts = dict(docs.select("doc_id", "text").collect())
    odd = [(-1, None), (-2, ""), (-3, "Ünï Çode!| 12\n12 12 a a."), (-4, "\n\n"), (-5, "\U0001f600 x" * 9)]
    got = op.score(docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")), model).collect()
    texts |= dict(odd)
    assert len(model.rules) > 3 and len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-9)
