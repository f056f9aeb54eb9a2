"""What to crawl next, planned as tables. Fetching itself is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide import dims

PAIR = ["role", "location_group"]


def search_url(role: Column, location: Column, page: Column, base: str) -> Column:
    """``base/role-jobs-in-location-page`` with lower-case, dashed names."""
    slug = lambda c: F.regexp_replace(F.lower(c), " ", "-")
    return F.concat(F.lit(base + "/"), slug(role), F.lit("-jobs-in-"), slug(location), F.lit("-"), page.cast("string"))


def frontier(roles: DataFrame, groups: list[str], completed: DataFrame) -> DataFrame:
    """(role, location_group) pairs not completed yet; the group list is short."""
    pairs = roles.select("role").distinct().select("role", F.explode(F.array(*[F.lit(g) for g in groups])).alias("location_group"))
    return pairs.join(completed, PAIR, "left_anti")


def quota_per_pair(pages: DataFrame, quota: int = dims.PAIR_QUOTA, max_pages: int = dims.MAX_PAGES, pair: list[str] = PAIR) -> DataFrame:
    """Pages taken per pair: whole pages, in order, while fewer than ``quota`` new rows came before.

    ``pages`` has one row per page (``page``, ``n_new``), so a pair holds at most
    ``max_pages`` rows in its window.
    """
    before = Window.partitionBy(*pair).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    taken = pages.where(F.col("page") <= max_pages).withColumn("new_before", F.coalesce(F.sum("n_new").over(before), F.lit(0)))
    return taken.where(F.col("new_before") < quota)


def low_yield(pages: DataFrame, num_pages: int, threshold: int = dims.LOW_YIELD, pair: list[str] = PAIR) -> DataFrame:
    """Per pair: its first block of ``num_pages`` pages, and the start of a second block if cards came but few were new.

    Only the first block decides, so a pair is extended once, however often and with whatever later pages this is asked.
    """
    first = Window.partitionBy(*pair)
    block = pages.withColumn("_start", F.min("page").over(first)).where(F.col("page") < F.col("_start") + num_pages)
    seen = block.groupBy(*pair).agg(F.min("page").alias("start_page"), F.sum("n_cards").alias("n_cards"), F.sum("n_new").alias("n_new"))
    extend = (F.col("n_cards") > 0) & (F.col("n_new") < threshold)
    return seen.withColumn("next_start", F.when(extend, F.col("start_page") + num_pages))


#: What is known of a pair between runs.
STATE = "role string, location_group string, page int, n_new long, status string"
OPEN, QUOTA, DRY, LIMIT = "open", "quota", "dry", "page limit"


def fold_pages(
    state: DataFrame, pages: DataFrame, quota: int = dims.PAIR_QUOTA, max_pages: int = dims.MAX_PAGES, pair: list[str] = PAIR,
) -> DataFrame:
    """The state of every pair after the pages fetched since: (pair, page, n_new, status).

    Pages count in order, whole, as long as the pair is open: it closes with the page that meets the ``quota`` (which may
    exceed it), with one that held no card, and at ``max_pages``. Pages after that, repeated ones and ones before the pair's
    last page change nothing, so a run that is repeated ends in the same state. ``pages`` has ``page, n_cards, n_new``; a pair
    has at most ``max_pages`` of them that count.
    """
    once = pages.where(F.col("page") <= max_pages).groupBy(*pair, "page").agg(F.max("n_cards").alias("n_cards"), F.max("n_new").alias("n_new"))
    known = state.select(*pair, F.col("page").alias("_page"), F.col("n_new").alias("_new"), F.col("status").alias("_status"))
    rows = once.join(known, pair, "full").withColumns(
        {"_page": F.coalesce("_page", F.lit(0)), "_new": F.coalesce("_new", F.lit(0).cast("long")), "_status": F.coalesce("_status", F.lit(OPEN))})
    fresh = (F.col("_status") == OPEN) & (F.col("page") > F.col("_page"))
    before = Window.partitionBy(*pair).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_counts", F.coalesce(fresh, F.lit(False)))
    rows = rows.withColumns({
        "_ahead": F.col("_new") + F.coalesce(F.sum(F.when(F.col("_counts"), F.col("n_new"))).over(before), F.lit(0)),
        "_dried": F.coalesce(F.max(F.col("_counts") & (F.col("n_cards") == 0)).over(before), F.lit(False))})
    taken = F.col("_counts") & (F.col("_ahead") < quota) & ~F.col("_dried")
    out = rows.groupBy(*pair).agg(
        F.greatest(F.max("_page"), F.coalesce(F.max(F.when(taken, F.col("page"))), F.lit(0))).cast("int").alias("page"),
        (F.max("_new") + F.coalesce(F.sum(F.when(taken, F.col("n_new"))), F.lit(0))).cast("long").alias("n_new"),
        F.max("_status").alias("_status"), F.coalesce(F.max(taken & (F.col("n_cards") == 0)), F.lit(False)).alias("_dry"))
    status = F.when(F.col("_status") != OPEN, F.col("_status")).when(F.col("n_new") >= quota, QUOTA).when(F.col("_dry"), DRY).when(
        F.col("page") >= max_pages, LIMIT).otherwise(OPEN)
    return out.select(*pair, "page", "n_new", status.alias("status"))


def crawl_frontier(
    roles: DataFrame, completed: DataFrame, state: DataFrame, groups: dict[str, list[str]] = dims.LOCATION_GROUPS,
    blocks: DataFrame | None = None, max_pages: int = dims.MAX_PAGES, base: str = "https://example.org",
) -> DataFrame:
    """(role, location_group, location, page, url): the next page of every open pair, for each of its locations.

    ``state`` is what :func:`fold_pages` keeps; a pair without state starts with page 1. Completed and closed pairs give
    nothing. ``blocks`` is :func:`low_yield` of a pair's first block: where that says so, the pages of a second block, as
    long as the first, are planned at once when the pair stands at the end of the first, and never again.
    """
    pairs = frontier(roles, list(groups), completed).join(state, PAIR, "left")
    going = pairs.where(F.coalesce("status", F.lit(OPEN)) == OPEN).select(*PAIR, F.coalesce("page", F.lit(0)).alias("_page"))
    upto = F.col("_page") + 1
    if blocks is not None:
        going = going.join(blocks.select(*PAIR, "start_page", "next_start"), PAIR, "left")
        again = F.col("_page") == F.col("next_start") - 1
        upto = F.when(again, 2 * F.col("next_start") - F.col("start_page") - 1).otherwise(upto)
    places = F.create_map(*[x for g, names in groups.items() for x in (F.lit(g), F.array(*[F.lit(n) for n in names]))])
    planned = going.withColumn("_upto", F.least(upto, F.lit(max_pages))).where(F.col("_upto") > F.col("_page"))
    return (
        planned.select(*PAIR, F.explode(F.sequence(F.col("_page") + 1, F.col("_upto"))).alias("page"))
        .withColumn("location", F.explode(places[F.col("location_group")]))
        .withColumn("url", search_url(F.col("role"), F.col("location"), F.col("page"), base))
    )
