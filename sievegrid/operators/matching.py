"""Scope classification, and joins by containment and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import acronym_pattern, any_term, official_url
from sievegrid.operators.profile import containing


def primary(title: Column, kind: Column, path: Column, words: list[str]) -> Column:
    """True unless a title, a kind of notice or a path says that it is a result or a correction."""
    pattern = any_term(words)
    hit = lambda c: F.coalesce(c.rlike(pattern), F.lit(False))
    return ~(hit(title) | hit(kind) | hit(path))


def scope(text: Column, context: Column, terms: dict[str, list[str]]) -> Column:
    """IN or the code of the rule that excludes, by ordered rules over term lists.

    terms: hard, strong, generic, adjacent, contextual and context, and acronyms of the strong, the adjacent
    and the contextual ones as acronyms, adjacent_acronyms and contextual_acronyms. Adjacent terms need a
    context term in the text itself, contextual ones in the text or in the context (who buys).
    """

    def has(x: Column, name: str, acronyms: str = "") -> Column:
        hit = F.lower(x).rlike(any_term([t.lower() for t in terms[name]])) if terms.get(name) else F.lit(False)
        if terms.get(acronyms):
            hit = hit | x.rlike(acronym_pattern(terms[acronyms]))
        return F.coalesce(hit, F.lit(False))

    near = has(text, "context")
    return (
        F.when(has(text, "hard"), "HARD_EXCLUSION")
        .when(has(text, "strong", "acronyms"), "IN")
        .when(has(text, "generic"), "GENERIC_EXCLUSION")
        .when(has(text, "adjacent", "adjacent_acronyms"), F.when(near, "IN").otherwise("ADJACENT_WITHOUT_CONTEXT"))
        .when(has(text, "contextual", "contextual_acronyms"), F.when(near | has(context, "context"), "IN").otherwise("CONTEXT_MISSING"))
        .otherwise("NO_TERM")
    )


def contains_either(a: Column, b: Column, least: int = 1) -> Column:
    """Either text contains the other; the shorter has at least so many characters."""
    return (F.least(F.length(a), F.length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def keyword_matches(rows: DataFrame, text: str, keywords: DataFrame, word: str) -> DataFrame:
    """rows joined with each keyword that their text contains, in any case; up to three ASCII letters or digits must stand alone.

    Texts and keywords meet on a run of bytes, so the rule is the same for lists of any length.
    """
    listed = keywords.withColumn("_word", F.lower(F.col(word))).where(~F.coalesce(F.trim("_word") == "", F.lit(True)))
    met = containing(rows.withColumn("_text", F.lower(F.col(text))), "_text", listed, "_word")
    alone = F.concat(F.lit("(?<![a-z0-9])\\Q"), F.col("_word"), F.lit("\\E(?![a-z0-9])"))
    return met.where(~F.col("_word").rlike("^[a-z0-9]{1,3}$") | F.regexp_like("_text", alone)).drop("_word", "_text")


def best_scope(rows: DataFrame, row_key: str, name: str, scopes: DataFrame, scope_name: str, value: str) -> DataFrame:
    """For each row the best value of the scopes whose name contains its name or is contained in it, and how many those are."""
    a = rows.select(row_key, F.col(name).alias("_name"))
    b = scopes.select(F.col(scope_name).alias("_scope"), value)
    columns = [row_key, "_scope", value]
    hits = containing(a, "_name", b, "_scope").select(*columns).unionByName(containing(b, "_scope", a, "_name").where("_name != _scope").select(*columns))
    best = hits.groupBy(row_key).agg(F.max(value).alias("best"), F.count("_scope").alias("n_matches"))
    return rows.select(row_key).distinct().join(best, row_key, "left").select(row_key, "best", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def successors(intents: DataFrame, formals: DataFrame, institution: str, published: str, subject: str, key: str, most: int = 3) -> DataFrame:
    """For each intent the earliest formal rows of its institution, not before it and on its subject (4 characters at least)."""
    i = intents.select(F.col(institution).alias("_who"), F.col(key).alias("intent_key"), F.col(published).alias("_since"), F.col(subject).alias("_subject"))
    f = formals.select(F.col(institution).alias("_who"), F.col(key).alias("formal_key"), F.col(published).alias("formal_published"), F.col(subject).alias("_formal"))
    alike = (F.col("_subject") == F.col("_formal")) | contains_either(F.col("_subject"), F.col("_formal"), 4)
    pairs = i.join(f, "_who").where((F.col("formal_published") >= F.col("_since")) & alike & (F.col("intent_key") != F.col("formal_key")))
    place = F.row_number().over(Window.partitionBy("intent_key").orderBy("formal_published", "formal_key"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).select("intent_key", "formal_key", "place")


def scoped(pool: DataFrame, keep: Column, order: list[Column], most: int, cards: int) -> DataFrame:
    """The pool's rows in scope, ranked anew from 1, so many at most; the first of them are cards."""
    first = pool.where(F.coalesce(keep, F.lit(False))).orderBy(*order).limit(most)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # most rows
    return first.withColumn("rank", rank).withColumn("is_card", F.col("rank") <= cards)


def known_status(candidates: DataFrame, url: str, known: DataFrame, key: str, urls: str) -> DataFrame:
    """candidates with the least known row (key) that has their address among its urls, in canonical form, and status KNOWN or NEW."""
    owners = known.select(F.col(key), F.explode(urls).alias("_u")).select(key, official_url(F.col("_u")).alias("_at")).where("_at is not null")
    least = owners.groupBy("_at").agg(F.min(key).alias(key))
    met = candidates.withColumn("_at", official_url(F.col(url))).join(least, "_at", "left").drop("_at")
    return met.withColumn("status", F.when(F.col(key).isNull(), "NEW").otherwise("KNOWN"))
