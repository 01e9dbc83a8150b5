"""Coverage of sources over stored pages: from each start along next links, within bounds.

A source's chain moves by one join on the address a step, and there are ``most_pages`` steps at most, so the
plan has that many joins and a chain's row holds that many addresses. Cycles end a chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(starts: DataFrame, pages: DataFrame, source: str, url: str, most_pages: int = 5, most_anchors: int = 400) -> DataFrame:
    """(source, pages, next_found, limited, partial, resume, n_anchors, anchors).

    starts: source, url. pages: url, next_url (NULL: none) and anchors (array of struct(url, title)); of an
    address stored twice any row. A start that is not stored is partial with no pages. After a page with
    which ``most_anchors`` distinct anchors are reached the rest of the chain does not count. partial: a
    later page is not stored. limited: the page bound ended the chain though a next page is known; resume
    is that page's address, or the missing one's. anchors: distinct addresses in order, each with its
    first title.
    """
    known = pages.groupBy(F.col(url).alias("_url")).agg(F.any_value(F.struct(F.col("next_url").alias("next"), "anchors")).alias("_page"))
    links = known.select("_url", F.col("_page.next").alias("_next"))
    chain = starts.select(source, F.col(url).alias("_at"), F.array().cast("array<string>").alias("_seen"), F.lit(False).alias("_missing"))
    for _ in range(most_pages):
        step = chain.join(links.withColumn("_there", F.lit(True)), F.col("_at") == F.col("_url"), "left")
        there = F.coalesce("_there", F.lit(False))
        seen = F.when(there, F.concat("_seen", F.array("_at"))).otherwise(F.col("_seen"))
        missing = F.col("_missing") | (F.col("_at").isNotNull() & ~there)
        chain = step.select(source, seen.alias("_seen"), missing.alias("_missing"), F.when(there, F.col("_next")).alias("_to"), F.when(missing, F.coalesce("_at", "_resume") if "_resume" in chain.columns else F.col("_at")).alias("_resume"))
        # A page that was seen before ends the chain; it is no next page.
        fresh = F.when(~F.coalesce(F.array_contains("_seen", F.col("_to")), F.lit(False)), F.col("_to"))
        chain = chain.select(source, "_seen", "_missing", "_resume", fresh.alias("_at"))
    walked = chain.select(source, F.posexplode_outer("_seen").alias("_n", "_url"), F.size("_seen").alias("_size"), F.col("_at").alias("_left"), "_missing", "_resume")
    found = walked.join(known.select("_url", F.col("_page.anchors").alias("anchors")), "_url", "left")
    each = found.where("_n is not null").select(source, "_n", F.posexplode("anchors").alias("_place", "a")).groupBy(source, F.col("a.url").alias("u")).agg(F.min(F.struct("_n", "_place", F.col("a.title").alias("title"))).alias("f"))
    # Distinct anchors up to each page tell where the anchor bound is reached.
    fresh = each.groupBy(source, F.col("f._n").alias("_n")).agg(F.count("*").alias("new"), F.array_sort(F.collect_list(F.struct(F.col("f._place").alias("place"), "u", F.col("f.title").alias("title")))).alias("list"))
    rows = walked.join(fresh, [source, "_n"], "left")
    before = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(source).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_n").isNull() | (F.col("_before") < most_anchors))
    told = kept.groupBy(source).agg(
        F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_n", "_url")))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("list").isNotNull(), F.struct("_n", "list")))).alias("l"),
        F.any_value("_size").alias("size"), F.any_value("_left").alias("left"), F.any_value("_missing").alias("missing"), F.any_value("_resume").alias("resume"),
    )
    n = F.aggregate("l", F.lit(0), lambda total, x: total + F.size(x["list"]))
    whole = (F.size("p") == F.col("size")) & (n < most_anchors)  # the anchor bound did not end it
    limited = whole & (F.size("p") == most_pages) & F.col("left").isNotNull()
    partial = whole & F.col("missing")
    anchors = F.transform(F.flatten(F.transform("l", lambda x: x["list"])), lambda a: F.struct(a["u"].alias("url"), a["title"].alias("title")))
    out = told.select(
        source, F.transform("p", lambda x: x["_url"]).alias("pages"), ((F.size("p") > 1) | limited | (partial & (F.size("p") > 0))).alias("next_found"), limited.alias("limited"), partial.alias("partial"),
        F.when(limited, F.col("left")).when(partial, F.col("resume")).alias("resume"), anchors.alias("anchors"),
    )
    return out.withColumn("n_anchors", F.size("anchors"))
