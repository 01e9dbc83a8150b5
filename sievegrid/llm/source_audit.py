"""Source divergence audit: how far the vocabulary of each source lies from the others of its language.

Plain relational: terms are exploded and counted per language, source and term; each language keeps
the terms that enough of its documents have; every (language, source) group meets every kept term of
its language, with zero where it lacks it; groups meet each other on language and term; distances are
summed and ranked. Joins are dealt by (language, term), never by the language alone, so a hot language
or source spreads over all tasks; terms are counted in each task before anything is shuffled.

Defined results: null texts, languages and sources are ''. Rows that repeat are documents each. A
group without kept terms is compared like any other; a language with one source has no pairs; a
language without kept terms has pairs of value 0 and no terms. An empty table gives no rows. Only the
three columns are read, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import materialise, named

#: A term is a run of ASCII letters and of any characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 10
#: Shares are whole numbers of this many parts.
PARTS = 1_000_000_000
TOP_TERMS = 10
#: Parts of a language's vocabulary that a group meets in tasks of their own.
SPREAD = 64


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, occurrences, documents); a group without terms has one row with a null term."""
    text = F.coalesce(named(text_col), F.lit(""))
    # Texts of ASCII alone have a faster way to the same.
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    groups = [F.coalesce(named(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    found = df.select(*groups, F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms")).withColumn("own", F.array_distinct("terms"))
    # A text's distinct terms come first and count it as their document; then all its terms count.
    rows = found.select("lang", "source", F.size("own").alias("d"), F.posexplode_outer(F.concat("own", "terms")).alias("at", "term"))
    return rows.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") >= F.col("d")).alias("occurrences"), F.count_if(F.col("at") < F.col("d")).alias("documents"))


def _share(count: str, total: str, kept: str) -> Column:
    """One and the whole part of PARTS * (count + 2) / (total + 2 * kept); exact, by decimals."""
    up = F.lit(PARTS).cast("decimal(10,0)") * (F.col(count) + 2).cast("decimal(20,0)")
    down = (F.col(total) + 2 * F.col(kept)).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", up, down)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_shares(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Dense shares (lang, source, term, occurrences, p, q) of groups over kept terms, and the groups of languages without any.

    q is the share in the whole language.
    """
    some = counts.where("term is not null").select("lang", "source", "term", "occurrences", "documents")
    vocabulary = some.groupBy("lang", "term").agg(F.sum("occurrences").alias("in_lang"), F.sum("documents").alias("n")).where(F.col("n") >= least).drop("n")
    kept = materialise(vocabulary, "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    totals = some.join(kept, ["lang", "term"]).groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    groups = counts.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    sized = groups.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))).join(sizes, "lang", "left")
    sized = materialise(sized, "groups")
    # Each group goes to every part of its language's vocabulary once.
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    spread = sized.where("kept is not null").withColumn("part", parts)
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("int"))
    dense = spread.join(dealt, ["lang", "part"]).join(some, ["lang", "source", "term"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    shares = dense.select("lang", "source", "term", "occurrences", _share("occurrences", "total", "kept").alias("p"), _share("in_lang", "lang_total", "kept").alias("q"))
    return shares, sized.where("kept is null").select("lang", "source")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank.

    pair: the other sources of the language by summed distance, all of them. term: the terms that the
    group has more of than its language, by distance, the first ``top``.
    """
    counts = materialise(term_counts(df, text_col, lang_col, source_col), "term-counts")
    shares, bare = group_shares(counts, least)
    shares = materialise(shares, "shares")
    own, other = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"))
    summed = own.join(other, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("r"))).alias("value"))
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = summed.unionByName(none).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = shares.where("occurrences > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(place)).unionByName(best)
