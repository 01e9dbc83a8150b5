"""Quality classifier as a sparse rule ensemble.

Statistics of whole texts are Spark column expressions. A random forest over the statistics of a
bounded sample of labelled rows gives tree paths; every path is a conjunctive rule. Lasso logistic
regression weighs the rules and sets most weights to zero; the rest becomes one column expression,
so scoring is a projection inside the scan: no shuffle, no Python.

Only the text feeds a score; labels, language, source and id never do.

Defined results: a null text counts as empty, and empty texts get a score like any other; rows
that repeat are scored alike; without labelled rows of both classes every score is the share of
label 1 among those there are, or 0.5; an empty table gives no rows; an output replaces a column
that has its name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import SPACE, all_of, fresh, materialise, named

#: The bound of the training sample: about so many labelled rows, chosen by a hash of their ids.
SAMPLE_ROWS = 12_000
TREES, DEPTH = 12, 4
#: Steps of the lasso fit at most.
STEPS = 30
LASSO = 0.002
SEED = 7

#: One condition of a rule: (statistic, "<=" or ">", threshold).
Condition = tuple[str, str, float]


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights; a score is the logistic of intercept plus the weights of rules that hold."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        margin = F.lit(self.intercept)
        for conditions, weight in self.rules:
            margin = margin + F.when(_holds(conditions, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _holds(conditions: tuple[Condition, ...], stats: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, side, at in conditions:
        out = out & ((stats[name] <= F.lit(at)) if side == "<=" else (stats[name] > F.lit(at)))
    return out


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all are defined, and finite, for every text."""
    t = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    n_words = F.size(words)
    some_words = F.greatest(n_words, F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    count = lambda mark: F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
    again = F.zip_with(F.slice(words, 2, F.greatest(n_words - 1, F.lit(0))), F.slice(words, 1, F.greatest(n_words - 1, F.lit(0))), lambda a, b: a == b)
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "log_lines": F.log1p(F.size(lines).cast("double")),
        "word_length": F.length(F.regexp_replace(t, f"{SPACE}+", "")) / some_words,
        "distinct_words": F.size(F.array_distinct(words)) / some_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "repeated_next": F.size(F.filter(again, lambda x: x)) / some_words,
        "upper": gone(r"\p{Lu}+") / size,
        "digits": gone(r"[0-9]+") / size,
        "full_stops": count(".") / some_words,
        "exclamations": count("!") / some_words,
        "bars": count("|") / some_words,
        "other_marks": gone(r"[^\p{L}\p{N}\s.,!|]+") / size,
    }


def with_statistics(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """df with one struct column of statistics, and that column's name."""
    name = fresh(df, "stats")
    return df.withColumn(name, F.struct(*[c.cast("double").alias(k) for k, c in statistics(named(text_col)).items()])), name


def _paths(description: str, names: list[str]) -> set[tuple[Condition, ...]]:
    """Every root-to-node path of the trees in a forest's printed form."""
    found: set[tuple[Condition, ...]] = set()
    path: list[Condition] = []
    margin = 0
    for line in description.splitlines():
        if m := re.match(r"(\s*)Tree \d+", line):
            path, margin = [], len(m[1])
        elif m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            del path[len(m[1]) - margin - 2 :]
            path.append((names[int(m[2])], m[3], float(m[4])))
            found.add(_shortest(path))
    return found


def _shortest(path: list[Condition]) -> tuple[Condition, ...]:
    """The same rule with one bound for each statistic and side."""
    bounds: dict[tuple[str, str], float] = {}
    for name, side, at in path:
        pick = min if side == "<=" else max
        bounds[name, side] = pick(at, bounds.get((name, side), at))
    return tuple(sorted((name, side, at) for (name, side), at in bounds.items()))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED, steps: int = STEPS) -> RuleModel:
    """Learn from the labelled rows of df. labels: id and label (0 or 1); rows with nulls are left out."""
    given = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    n = given.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = given.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample is bounded by sample_rows whatever the tables' size, so it may be broadcast.
    texts = df.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(chosen), "id")
    measured, stats = with_statistics(texts)
    # The sample is small: a few partitions keep the many short jobs of the fits short.
    rows = materialise(measured.select("id", "label", f"{stats}.*"), "training").coalesce(2).cache()
    try:
        ones, all_ = rows.agg(F.sum("label"), F.count("*")).first()
        if not all_ or ones in (0, all_):
            p = min(max(ones / all_, 1e-6), 1 - 1e-6) if all_ else 0.5
            return RuleModel(math.log(p / (1 - p)), ())
        names = [c for c in rows.columns if c not in ("id", "label")]
        forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="0.5", maxBins=64, seed=seed)
        grown = forest.fit(rows.select("label", array_to_vector(F.array(*names)).alias("features")))
        rules = sorted(_paths(grown.toDebugString, names))
        stats_of = {c: F.col(c) for c in names}
        flags = F.array(*[_holds(r, stats_of).cast("double") for r in rules])
        table = rows.select("label", array_to_vector(flags).alias("features"))
        weighed = LogisticRegression(labelCol="label", regParam=lasso, elasticNetParam=1.0, maxIter=steps, tol=1e-5, standardization=True).fit(table)
        kept = tuple((r, float(w)) for r, w in zip(rules, weighed.coefficients, strict=True) if w)
        return RuleModel(float(weighed.intercept), kept)
    finally:
        rows.unpersist()


def score(df: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """df with the score and the class predicted from it."""
    measured, stats = with_statistics(df, text_col)
    columns = {name: F.col(stats)[name] for name in measured.schema[stats].dataType.names}
    return measured.withColumn(score_col, model.score(columns)).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int")).drop(stats)


def keep(df: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of df that the model does not reject, with the columns of df."""
    whole = fresh(df, "whole")
    scored = score(df.withColumn(whole, F.struct(*all_of(df))), model, text_col)
    return scored.where(F.col("predicted") == 1).select(f"{whole}.*")


def held_out(id_: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows that no model learns from: crc32 of the id's digits, modulo folds."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
