"""Reports: outcomes, feedback, risks, discovery metrics, ledgers of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.scoring import percent


def outcome_summary(df: DataFrame, group: list[str], status: Column, won: str = "WON", lost: str = "LOST", unfit: str = "NOT_FIT") -> DataFrame:
    """Counts by outcome and the win rate in whole percent, NULL without decided rows."""
    n = lambda v: F.count_if(status == v)
    counted = df.groupBy(*group).agg(n(won).alias("won"), n(lost).alias("lost"), n(unfit).alias("unfit"), F.count("*").alias("n_rows"))
    return counted.withColumn("win_rate", percent(F.col("won"), F.col("won") + F.col("lost")))


def recognised_reason(status: Column, reason: Column, note: Column, codes: dict[str, list[str]], prefixes: dict[str, str], labels: dict[str, dict[str, str]]) -> Column:
    """The code of a closed row's reason: a known code of its status as given, else the code of the label that a note names after the status's prefix; else NULL."""
    given, said = F.nullif(F.trim(reason), F.lit("")), F.trim(note)
    out = F.lit(None).cast("string")
    for state, known in codes.items():
        own = F.when(given.isin(known), given)
        if state in prefixes:
            label = F.when(F.startswith(said, F.lit(prefixes[state])), F.trim(F.substring(said, len(prefixes[state]) + 1, 1 << 30)))
            pairs = [x for text, code in labels[state].items() for x in (F.lit(text), F.lit(code))]
            own = F.coalesce(own, F.try_element_at(F.create_map(*pairs), label))
        out = F.when(status == state, own).otherwise(out)
    return out


def reason_counts(df: DataFrame, group: list[str], status: str, code: Column, most: int = 5000) -> DataFrame:
    """Rows by status and recognised code (NULL: unclassified), place orders the codes of a group by count, then code.

    A group of more than most rows raises, as a report over a cut list would be wrong.
    """
    from pyspark.sql import Window

    sized = df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > most) if group else df.agg(F.count("*").alias("n")).where(F.col("n") > most)
    if not sized.isEmpty():
        raise ValueError("OUTCOME_SUMMARY_TRUNCATED")
    counted = df.groupBy(*group, status, code.alias("code")).agg(F.count("*").alias("n_rows"))
    by = Window.partitionBy(*group, status, F.col("code").isNull()).orderBy(F.desc("n_rows"), "code")
    return counted.withColumn("place", F.when(F.col("code").isNotNull(), F.row_number().over(by)))


def first_recognised(events: DataFrame, keys: list[str], order: list[str], code: Column) -> DataFrame:
    """Per key the code of its latest row with a recognised one."""
    known = events.withColumn("_code", code).where(F.col("_code").isNotNull())
    return known.groupBy(*keys).agg(F.max(F.struct(*order, F.col("_code").alias("c"))).alias("_l")).select(*keys, F.col("_l.c").alias("code"))


def reason_histogram(df: DataFrame, reason: Column, known: list[str]) -> DataFrame:
    """Rows by recognised reason, the others as UNCLASSIFIED."""
    said = F.when(reason.isin(known), reason).otherwise("UNCLASSIFIED")
    return df.groupBy(said.alias("reason")).agg(F.count("*").alias("n_rows"))


def feedback_rate(df: DataFrame, effective: Column) -> DataFrame:
    whole = df.agg(F.count(effective).alias("responded"), F.count_if(effective).alias("effective"))
    return whole.withColumn("rate", percent(F.col("effective"), F.col("responded")))


def risks(df: DataFrame, key: list[Column], rules: dict[str, Column]) -> DataFrame:
    """One row for each risk of each row."""
    found = F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda c: c.isNotNull())
    return df.select(*key, F.explode(found).alias("risk"))


def risk_summary(found: DataFrame, source: str, high: list[str], continuation: list[str]) -> DataFrame:
    """Risks in all, and distinct sources that have any, a high one, or one that a further scan may settle."""
    of = lambda codes: F.count_distinct(F.when(F.col("risk").isin(codes), F.col(source)))
    return found.agg(F.count("*").alias("n_risks"), F.count_distinct(source).alias("affected"), of(high).alias("high"), of(continuation).alias("continuation"))


def discovery_metrics(outputs: DataFrame, gold: DataFrame, key: str, rejected: str) -> DataFrame:
    """How well model outputs find a gold set: recall, grounding, valid format, and 75, 20 and 5 hundredths of them as a score.

    rejected: NULL for an accepted output, UNGROUNDED for an address that was not given, anything
    else for a wrong format. Recall and score are NULL without a gold set; the rates of no outputs are 1.
    """
    bad = F.col(rejected)
    counts = outputs.agg(F.count("*").alias("raw"), F.count_if(bad == "UNGROUNDED").alias("rejected_ungrounded"), F.count_if(bad.isNotNull() & (bad != "UNGROUNDED")).alias("rejected_invalid"))
    found = outputs.where(bad.isNull()).select(key).distinct().withColumn("_f", F.lit(1))
    both = found.join(gold.select(key).distinct().withColumn("_g", F.lit(1)), key, "full_outer")
    sets = both.agg(F.count("_g").alias("gold"), F.count("_f").alias("candidates"), F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("hits"))
    recall = F.when(F.col("gold") > 0, F.col("hits") / F.col("gold"))
    rate = lambda kept: F.when(F.col("raw") > 0, kept / F.col("raw")).otherwise(1.0)
    grounded = rate(F.col("raw") - F.col("rejected_ungrounded"))
    valid = rate(F.col("raw") - F.col("rejected_ungrounded") - F.col("rejected_invalid"))
    whole = counts.crossJoin(sets).withColumns({"novel": F.col("candidates") - F.col("hits"), "recall": recall, "grounding": grounded, "format_valid": valid})  # two tables of one row
    score = F.round(100 * (0.75 * F.col("recall") + 0.20 * F.col("grounding") + 0.05 * F.col("format_valid")), 1)
    return whole.withColumn("score", score).withColumns({c: F.round(c, 4) for c in ("recall", "grounding", "format_valid")})


def dashboard(df: DataFrame, flags: dict[str, Column], sums: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """One row of counters: rows with each flag, sums and averages of values, distinct values."""
    parts = [F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in flags.items()]]
    parts += [x for k, c in sums.items() for x in (F.sum(c).alias(k), F.avg(c).alias(f"{k}_avg"))]
    return df.agg(*parts, *[F.count_distinct(c).alias(k) for k, c in distinct.items()])


def sync_report(df: DataFrame, market: str, outcomes: dict[str, Column]) -> DataFrame:
    """Rows of each market by outcome, and all of them."""
    return df.groupBy(market).agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in outcomes.items()])


def continuation_summary(segments: DataFrame, root: str, index: str, anchors: Column, exhausted: str) -> DataFrame:
    """Segments and anchors of each root, and whether its last segment ends it."""
    return segments.groupBy(root).agg(F.count("*").alias("segments"), F.sum(F.size(anchors)).alias("anchors"), F.max_by(exhausted, index).alias("exhausted"))


def finding_ledger(df: DataFrame, keys: list[str], source: str, at: Column) -> DataFrame:
    """First and last sighting and their number; active if the source's last scan still has it."""
    seen = df.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_seen"))
    scans = seen.groupBy(source).agg(F.max("last_seen").alias("_last"))
    return seen.join(scans, source).withColumn("active", F.col("last_seen") == F.col("_last")).drop("_last")


def ordered_json(df: DataFrame, key: str, order: list[str], fields: list[str], most: int) -> DataFrame:
    """Per key its last rows as a JSON array, newest first, so many at most."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    newest = df.withColumn("_p", place).where(F.col("_p") <= most)
    rows = F.array_sort(F.collect_list(F.struct("_p", *fields)))
    return newest.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))).alias("items"))


def health(zero_runs: Column, failed_runs: Column, limit: int = 3) -> Column:
    return F.when(failed_runs >= limit, "FAILING").when(zero_runs >= limit, "SILENT").otherwise("HEALTHY")
