"""Freshness probe: published counts against what the portals show now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of interstitial pages, gap that counts as drift, shortest page that counts as an answer.
BLOCK_MARKERS = (
    "cf-error-details", "sorry, you have been blocked", "just a moment", "cdn-cgi/challenge", "attention required", "cf-browser-verification", "enable javascript and cookies",
)
LEAST_GAP, GAP_PERCENT, SHORTEST_PAGE = 50, 5.0, 80


def looks_blocked(html: Column) -> Column:
    """Whether the first 8000 characters hold a marker of an interstitial page."""
    start = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 8000))
    found = F.lit(False)
    for marker in BLOCK_MARKERS:
        found = found | F.contains(start, F.lit(marker))
    return found


def live_count(total: Column, result_count: Column, pages: Column, cards: Column, page_size: Column) -> tuple[Column, Column]:
    """(count, kind): the stated total, else the cards of a single page, else an estimate from the pager."""
    stated = F.coalesce(F.when(total >= 0, total), F.when(result_count >= 0, result_count))
    n_pages = F.greatest(F.lit(1), F.coalesce(pages, F.lit(1)))
    estimate = F.when(n_pages <= 1, cards).otherwise((n_pages - 1) * page_size + cards)
    return F.coalesce(stated, estimate), F.when(stated.isNotNull() | (n_pages <= 1), "exact").otherwise("estimate")


def is_drift(ours: Column, live: Column, percent: float = GAP_PERCENT, least: int = LEAST_GAP) -> Column:
    gap = F.abs(live - ours)
    return F.coalesce((gap >= least) | ((ours > 0) & (gap * 100 >= ours * percent)), F.lit(False))


def fetch_blocked(error: Column) -> Column:
    """Whether the text of a failed request says that the portal turned it away."""
    return F.coalesce(F.lower(error).rlike("403|forbidden|cloudflare|blocked"), F.lit(False))


def probe(seeds: DataFrame, percent: float = GAP_PERCENT, least: int = LEAST_GAP) -> DataFrame:
    """seeds (search, source, ours, html, total, result_count, pages, cards, page_size, has_skip, catalogue_currency) as report rows.

    One row a seed: search, source, ours, live, delta, note, drift, detail. A blocked or empty answer has no
    live count. seeds may have error (the text of a request or a parser that failed) and page_blocked
    (what the parser says of the page); both end in the note blocked or error, the text in detail.
    """
    error = F.col("error") if "error" in seeds.columns else F.lit(None).cast("string")
    turned_away = F.coalesce(F.col("page_blocked"), F.lit(False)) if "page_blocked" in seeds.columns else F.lit(False)
    answer = F.trim(F.coalesce("html", F.lit("")))
    blocked = F.when(error.isNotNull(), fetch_blocked(error)).otherwise(looks_blocked(F.col("html")) | turned_away)
    empty = F.length(answer) < SHORTEST_PAGE
    failed = error.isNotNull() | empty
    count, kind = live_count(F.col("total"), F.col("result_count"), F.col("pages"), F.col("cards"), F.col("page_size"))
    found = seeds.withColumn("live", F.when(~blocked & ~failed, count)).withColumn("drift", is_drift(F.col("ours"), F.col("live"), percent, least))
    wide = (kind == "exact") & F.col("has_skip") & (F.col("ours") > 0) & (F.col("live") > F.col("ours") * 2)
    note = F.concat_ws(
        "; ",
        F.when(F.coalesce(wide, F.lit(False)), "exact; list wider than skip").otherwise(kind),
        F.when(F.col("catalogue_currency") == "USD", "USD catalogue"),
        F.when(F.col("ours").isNull(), "no published count"),
    )
    full = F.when(blocked, "blocked").when(failed, "error").otherwise(F.concat(note, F.when(F.col("drift"), " drift").otherwise("")))
    return found.select("search", "source", "ours", "live", (F.col("live") - F.col("ours")).alias("delta"), full.alias("note"), "drift", F.coalesce(error, F.when(~blocked & empty, "empty response"), F.lit("")).alias("detail"))


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: seeds, drifting, blocked, errors, failed (whether any drifts)."""
    return report.agg(
        F.count("*").alias("seeds"), F.count_if("drift").alias("drifting"), F.count_if(F.col("note") == "blocked").alias("blocked"), F.count_if(F.startswith("note", F.lit("error"))).alias("errors"),
        F.coalesce(F.bool_or("drift"), F.lit(False)).alias("failed"),
    )


def report_lines(report: DataFrame) -> DataFrame:
    """search, line: the report as aligned text, a dash for what is not known."""
    number = lambda c: F.coalesce(F.format_number(F.col(c), 0), F.lit("-"))
    delta = F.when(F.col("delta").isNull(), "-").when(F.col("delta") >= 0, F.concat(F.lit("+"), number("delta"))).otherwise(number("delta"))
    return report.select("search", F.concat(F.rpad("search", 26, " "), F.lpad(number("ours"), 9, " "), F.lpad(number("live"), 9, " "), F.lpad(delta, 9, " "), F.lit("  "), F.col("note")).alias("line"))
