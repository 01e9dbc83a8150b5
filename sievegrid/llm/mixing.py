"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token weights of the cells (source, language, topic) are raked: each marginal in turn is scaled to
its target shares until all three hold. A cell's factor is the product of its three multipliers,
and a document is sampled with probability c * factor, where c makes the largest factor certain to
be taken (or meets a smaller token budget). So no probability is ever cut at one, and expected
token shares equal the fitted ones. The draw is a hash of the document's id: the same every time.

A text is measured once, and what it measures is written beside its row. Every step of the fit is a
grouped sum over the table of cells. While that has few rows (``FEW_CELLS``, whatever the number of
documents) the steps are sums on the driver, as thousands of small jobs would cost its memory; else
each is folded in tasks before it is shuffled, and leaves a written table of one multiplier a value, at
any number of values. Rounds end when no multiplier moves any more, or after ``rounds``. Documents meet the multipliers by broadcast joins
while those tables are few rows (``broadcast_rows``), else by joins whose skewed sides Spark splits.

A topic is any column expression. Tables without one can be told apart by ``genre``: surface marks
that mean the same in every language. ``seeded`` adds the word topic of a text: seeds are the long
words that most documents of a language have, counted over all texts. Raking over seeds by default
has no solution (a language's tempered seeds may want more tokens than the language), so they are a
column that a caller may rake over with targets of its own.

Defined results: a null text has no tokens; null values, and values that given targets do not list,
count as the value "other", whose target is what the listed targets leave; targets of values without
tokens are shared out among the rest; rows with the same id are taken or left together; an empty
table gives no rows; seeds that as many rows have come in alphabetical order, a text that has two as
often is of the first, and one that has none of "none"; other columns pass through, and an output replaces a column that has its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import let
from sievegrid.llm.common import WORD, all_of, fresh, materialise, named

ROUNDS = 40
OTHER = "other"
#: Seed words of a language, and the letters that they have at least.
SEEDS, SEED_LETTERS = 8, 6
#: Share of the natural token shares' logarithms that default targets keep: below one, it evens out.
TEMPER = 0.7
#: Multipliers that move by less than this share in a round have settled.
SETTLED = 1e-10
#: Rows of a table of multipliers that may be broadcast.
BROADCAST_ROWS = 100_000
#: Cells that are fitted on the driver; more are fitted by jobs.
FEW_CELLS = 10_000

Targets = dict[str, dict[str, float]]


def n_tokens(text: Column) -> Column:
    """White-space words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def genre(text: Column) -> Column:
    """figures (over a fortieth of digits), web (addresses), lines (short ones), long (2000 characters), else prose; the first that holds."""
    t = F.coalesce(text, F.lit(""))
    digits = F.regexp_count(t, F.lit("[0-9]"))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (
        F.when(digits * 40 > F.length(t), "figures")
        .when(F.contains(t, F.lit("://")) | F.contains(t, F.lit("@")), "web")
        .when((lines > 0) & (lines * 60 >= F.length(t)), "lines")
        .when(F.length(t) >= 2000, "long")
        .otherwise("prose")
    )


def long_words(text: Column, letters: int = SEED_LETTERS) -> Column:
    """Runs of so many letters of a text, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(\p{{L}}{{{letters},}})"), F.lit(1))


def _low(word: Column) -> Column:
    """A-Z in lower case; lower() does just that to a word of ASCII, and much faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def seed_words(df: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = SEEDS, letters: int = SEED_LETTERS) -> DataFrame:
    """(language, seeds): of each language the long words that most of its rows have, those of most rows first."""
    said = df.select(F.coalesce(named(lang_col).cast("string"), F.lit(OTHER)).alias("language"), F.explode(F.array_distinct(F.transform(F.array_distinct(long_words(named(text_col), letters)), _low))).alias("word"))
    counted = said.groupBy("language", "word").agg(F.count("*").alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))).where(F.col("place") <= most)
    return placed.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("s")).select("language", F.col("s.word").alias("seeds"))


def seed_of(text: Column, seeds: Column, letters: int = SEED_LETTERS) -> Column:
    """The seed (of an array in order) that the text has most often, of equals the first; none if it has none."""
    counted = lambda had: F.transform(seeds, lambda s, i: F.struct(F.size(F.filter(had, lambda w: w == s)).alias("n"), (-i).alias("i"), s.alias("s")))
    best = let(F.filter(F.transform(long_words(text, letters), _low), lambda w: F.array_contains(seeds, w)), lambda had: F.when(F.size(had) > 0, F.array_max(counted(had))["s"]))
    return F.coalesce(best, F.lit("none"))


def seeded(df: DataFrame, text_col: str = "text", lang_col: str = "lang", name: str = "seed", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with the seed word of each text, of the seeds of its language."""
    found = materialise(seed_words(df, text_col, lang_col), "seeds")
    language, seeds = fresh(df, "seed_language"), fresh(df, "seeds")
    listed = found.select(F.col("language").alias(language), F.col("seeds").alias(seeds))
    met = df.join(F.broadcast(listed) if found.count() <= broadcast_rows else listed, F.coalesce(named(lang_col).cast("string"), F.lit(OTHER)) == F.col(language), "left")
    kept = [named(c) for c in df.columns if c.lower() != name.lower()]
    return met.select(*kept, seed_of(named(text_col), F.col(seeds)).alias(name))


def uniform(id_: Column) -> Column:
    """A number in [0, 1) from the id's digits."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def cell_weights(docs: DataFrame, dims: list[str], targets: Targets | None = None) -> DataFrame:
    """Tokens of each combination of the dimensions' values (columns of docs, with n_tokens)."""
    values = [_value(F.col(d), d, targets).alias(d) for d in dims]
    return docs.groupBy(*values).agg(F.sum("n_tokens").cast("double").alias("w")).where("w > 0")


def _value(value: Column, d: str, targets: Targets | None) -> Column:
    """The value, or OTHER of a null one and of one that given targets do not list."""
    shown = F.coalesce(value.cast("string"), F.lit(OTHER))
    return shown if targets is None else F.when(shown.isin(list(targets[d])), shown).otherwise(OTHER)


def target_tokens(cells: DataFrame, d: str, targets: Targets | None, temper: float = TEMPER) -> DataFrame:
    """(value, target): target tokens of each value that has tokens, by given shares or by tempered natural ones."""
    own = cells.groupBy(F.col(d).alias("value")).agg(F.sum("w").alias("w"))
    if targets is None:
        shared = own.withColumn("share", F.pow("w", F.lit(temper)))
    else:
        listed = targets[d] if OTHER in targets[d] else targets[d] | {OTHER: max(0.0, 1.0 - sum(targets[d].values()))}
        given = cells.sparkSession.createDataFrame([(v, float(s)) for v, s in listed.items()], "value string, share double")
        shared = own.join(given, "value")
    whole = shared.agg(F.sum("share").alias("shares"), F.sum("w").alias("total"))
    return shared.crossJoin(whole).select("value", (F.when(F.col("shares") > 0, F.col("share") / F.col("shares")).otherwise(0.0) * F.col("total")).alias("target"))  # one row beside


def _fit_few(rows: list[tuple], dims: list[str], targets: Targets | None, rounds: int) -> dict[str, dict[str, float]]:
    """The steps of fit over rows (a value of each dimension, then w): multipliers by dimension and value."""
    at = range(len(dims))
    aims: list[dict[str, float]] = []
    for k, d in enumerate(dims):
        own: dict[str, float] = {}
        for row in rows:
            own[row[k]] = own.get(row[k], 0.0) + row[-1]
        if targets is None:
            share = {v: w**TEMPER for v, w in own.items()}
        else:
            listed = targets[d] if OTHER in targets[d] else targets[d] | {OTHER: max(0.0, 1.0 - sum(targets[d].values()))}
            share = {v: float(listed[v]) for v in own}
        shares, total = sum(share.values()), sum(own.values())
        aims.append({v: s / shares * total if shares > 0 else 0.0 for v, s in share.items()})
    found = [dict.fromkeys(a, 1.0) for a in aims]
    for _ in range(rounds):
        moved = 0.0
        for k in at:
            have = dict.fromkeys(aims[k], 0.0)
            others = [o for o in at if o != k]
            for row in rows:
                weight = row[-1]
                for o in others:
                    weight *= found[o][row[o]]
                have[row[k]] += weight
            for v, n in have.items():
                f = aims[k][v] / n if n > 0 else 0.0
                moved = max(moved, abs(f - found[k][v]) / max(f, 1e-300))
                found[k][v] = f
        if moved <= SETTLED:
            break
    return dict(zip(dims, found, strict=True))


def fit(cells: DataFrame, dims: list[str], targets: Targets | None = None, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> dict[str, DataFrame]:
    """For each dimension a table (value, f) of multipliers, to be broadcast where it has few rows."""
    most = min(FEW_CELLS, broadcast_rows)
    few = cells.select(*dims, "w").limit(most + 1).collect()  # grouped sums, so many rows at most
    if len(few) <= most:
        # In order, so that sums are the same each time.
        fitted = _fit_few(sorted(map(tuple, few)), dims, targets, rounds)
        return {d: F.broadcast(cells.sparkSession.createDataFrame(sorted(f.items()), "value string, f double")) for d, f in fitted.items()}
    aims = {d: materialise(target_tokens(cells, d, targets), "targets") for d in dims}
    # A dimension's table has the same values in every round, so its size is checked once.
    sized = {d: F.broadcast if aims[d].count() <= broadcast_rows else (lambda df: df) for d in dims}
    found = {d: aims[d].withColumn("f", F.lit(1.0)) for d in dims}
    for _ in range(rounds):
        moves = []
        for d in dims:
            rows = cells
            for other in dims:
                if other != d:
                    rows = rows.join(sized[other](found[other].select(F.col("value").alias(other), F.col("f").alias(f"f_{other}"))), other)
            weight = F.col("w")
            for other in dims:
                if other != d:
                    weight = weight * F.col(f"f_{other}")
            have = rows.groupBy(F.col(d).alias("value")).agg(F.sum(weight).alias("have"))
            f = F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0)
            made = sized[d](found[d]).join(have, "value", "left").select("value", "target", f.alias("f"), (F.abs(f - F.col("f")) / F.greatest(f, F.lit(1e-300))).alias("move"))
            stepped = materialise(made.coalesce(1) if sized[d] is F.broadcast else made, "multipliers")
            moves.append(stepped.select("move"))
            found[d] = stepped.select("value", "target", "f")
        moved = moves[0]
        for m in moves[1:]:
            moved = moved.unionByName(m)
        if (moved.agg(F.max("move")).first()[0] or 0.0) <= SETTLED:
            break
    return {d: sized[d](t) for d, t in found.items()}


def scale(cells: DataFrame, found: dict[str, DataFrame], budget: float | None = None) -> float:
    """c: a budget (share of all tokens to expect at most), or as much as exact shares allow."""
    rows, factor = cells, F.lit(1.0)
    for d, table in found.items():
        rows = rows.join(table.select(F.col("value").alias(d), F.col("f").alias(f"f_{d}")), d)
        factor = factor * F.col(f"f_{d}")
    largest = rows.agg(F.max(factor)).first()[0] or 0.0
    return min(1.0 if budget is None else float(budget), 1.0 / largest) if largest > 0 else 0.0


def _drawn(df: DataFrame, targets: Targets | None, id_col: str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, budget: float | None = None, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(whole, topic, n_tokens, probability, sampled) of every row of df, whole is the row."""
    values = {"source": named(source_col), "lang": named(lang_col), "topic": genre(named(text_col)) if topic is None else topic}
    rows = df.select(F.struct(*all_of(df)).alias("whole"), values["topic"].alias("topic"), n_tokens(named(text_col)).alias("n_tokens"), *[_value(v, d, targets).alias(f"v_{d}") for d, v in values.items()])
    rows = materialise(rows, "measured")
    cells = materialise(cell_weights(rows.select(*[F.col(f"v_{d}").alias(d) for d in values], "n_tokens"), list(values), targets), "cells")
    found = fit(cells, list(values), targets, rounds, broadcast_rows)
    p = F.lit(scale(cells, found, budget))
    for d, table in found.items():
        rows = rows.join(table.select(F.col("value").alias(f"v_{d}"), F.col("f").alias(f"f_{d}")), f"v_{d}", "left")
        p = p * F.coalesce(f"f_{d}", F.lit(0.0))
    p = F.least(F.lit(1.0), p)
    return rows.select("whole", "topic", "n_tokens", p.alias("probability"), (uniform(F.col("whole")[id_col]) < p).alias("sampled"))


def mix(df: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, budget: float | None = None, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with n_tokens, topic, probability and sampled.

    targets: for "source", "lang" and "topic" the target share of each value; by default tempered
    natural shares of all values. topic: a column expression; by default genre of the text.
    """
    drawn = _drawn(df, targets, id_col, text_col, source_col, lang_col, topic, budget, rounds, broadcast_rows)
    made = ("topic", "n_tokens", "probability", "sampled")
    return drawn.select(*[F.col("whole")[c].alias(c) for c in df.columns if c.lower() not in made], *made)


def sample(df: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """The sampled rows of df, with the columns of df."""
    return _drawn(df, targets, id_col, **options).where("sampled").select(*[F.col("whole")[c].alias(c) for c in df.columns])
