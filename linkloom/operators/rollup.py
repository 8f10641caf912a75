"""Counts, coverage and samples per site, and their roll-up over all sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.classify import transport_error
from ..functions.urls import proxy_label, site_family, site_folder
from . import order

SAMPLE = 20


def site_counts(nodes: DataFrame, edges: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """Per site: discovered, queueable, same-site, other URLs, edges, visits and how they went. One aggregate a table."""
    out = nodes.groupBy("site_key").agg(
        F.count("*").alias("discovered_urls"), F.count_if("queueable").alias("queueable_urls"), F.count_if("same_site").alias("same_site_urls"), F.count_if(~F.col("queueable")).alias("external_or_non_queueable_urls"),
    )
    out = out.join(edges.groupBy("site_key").agg(F.count("*").alias("edges")), "site_key", "left").na.fill(0, ["edges"])
    if visits is None:
        return out
    went = visits.groupBy("site_key").agg(F.count("*").alias("visited_pages"), F.count_if("ok").alias("visit_ok"), F.count_if(~F.col("ok")).alias("visit_failed"))
    return out.join(went, "site_key", "left").na.fill(0, ["visited_pages", "visit_ok", "visit_failed"])


def page_kinds(nodes: DataFrame) -> DataFrame:
    """Rows (site_key, page_kind, n) of queueable nodes."""
    return nodes.filter("queueable").groupBy("site_key", "page_kind").agg(F.count("*").alias("n"))


def page_kind_map(nodes: DataFrame) -> DataFrame:
    return page_kinds(nodes).groupBy("site_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_kind", "n")))).alias("page_kinds"))


def sampled(rows: DataFrame, keys: list[str], value: str, n: int = SAMPLE) -> DataFrame:
    """Rows (keys…, total, sample): how many distinct values a key has, and the first n of them, sorted.

    A window keeps n rows of a key in each task before anything is shuffled, so no key's values are gathered.
    """
    once = rows.select(*keys, value).distinct()
    total = once.groupBy(*keys).agg(F.count("*").alias("total"))
    first = once.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("__n") <= n)
    sample = first.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("sample"))
    return total.join(sample, keys)


def missing(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected rows (site_key, category, url) that no queueable node has."""
    return expected.join(nodes.filter("queueable").select("site_key", "url"), ["site_key", "url"], "left_anti").select("site_key", "category", "url")


def unvisited(nodes: DataFrame, visited: DataFrame) -> DataFrame:
    return nodes.filter("should_visit").join(visited.select("site_key", "url"), ["site_key", "url"], "left_anti").select("site_key", "url")


def skipped(nodes: DataFrame) -> DataFrame:
    """Queueable nodes that are left out on purpose."""
    return nodes.filter("queueable and not should_visit").select("site_key", "url")


def verification(expected: DataFrame, nodes: DataFrame, visited: DataFrame, frontier: DataFrame) -> DataFrame:
    """Rows (site_key, item, expected, total, sample) of what each site's coverage lacks, and what waits."""
    asked = expected.groupBy("site_key", F.col("category").alias("item")).agg(F.countDistinct("url").alias("expected"))
    lacks = sampled(missing(expected, nodes).withColumnRenamed("category", "item"), ["site_key", "item"], "url")
    out = asked.join(lacks, ["site_key", "item"], "full")
    for item, rows in (("unvisited_queueable", unvisited(nodes, visited)), ("skipped_leaf", skipped(nodes)), ("frontier", frontier)):
        found = sampled(rows.select("site_key", F.lit(item).alias("item"), "url"), ["site_key", "item"], "url")
        out = out.unionByName(found.select("site_key", "item", F.lit(None).cast("long").alias("expected"), "total", "sample"))
    return out.select("site_key", "item", "expected", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def sites_summary(counts: DataFrame, completed: DataFrame) -> DataFrame:
    """The summary table of all sites; completed has (site_key, site_host, completed), and a site without counts has zeros."""
    numbers = ["discovered_urls", "queueable_urls", "same_site_urls", "external_or_non_queueable_urls", "edges", "visited_pages", "visit_ok", "visit_failed"]
    out = completed.join(counts, "site_key", "left").na.fill(0, numbers)
    family = F.when(F.coalesce("site_host", F.lit("")) == "", F.lit("")).otherwise(site_family(F.col("site_host")))
    return out.select(site_folder(F.col("site_key")).alias("site_folder"), "site_host", family.alias("site_family"), "completed", *numbers)


def batch_summary(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("sites_total"), F.count_if("completed").alias("sites_completed"))


def completion(sites: DataFrame, frontier: DataFrame, page_limited: bool = False) -> DataFrame:
    """Rows (site_key, site_host, completed): a site is done when nothing waits and the run was not cut short."""
    waiting = frontier.select("site_key").distinct().withColumn("waits", F.lit(True))
    return sites.join(waiting, "site_key", "left").select("site_key", "site_host", (F.col("waits").isNull() & F.lit(not page_limited)).alias("completed"))


def global_urls(nodes: DataFrame) -> DataFrame:
    return nodes.select("url").filter("url <> ''").distinct()


def global_links(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of all sites with their site; a site without nodes has none here, as in the link list."""
    joined = sites.select("site_key", "site_host").join(nodes, "site_key")
    return joined.select(site_folder(F.col("site_key")).alias("site_folder"), "site_host", site_family(F.col("site_host")).alias("site_family"), "url", "same_site", "queueable", "page_kind", "first_depth")


def saved_report(summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of summaries with what was read of each site's nodes: links, distinct URLs and broken lines, 0 without nodes.

    Nodes of folders without a summary do not count. summaries has site_folder, nodes site_folder, url and broken.
    """
    read = nodes.groupBy("site_folder").agg(F.count_if(F.col("broken").isNull()).alias("links"), F.count_distinct("url").alias("urls"), F.count_if(F.col("broken").isNotNull()).alias("broken_lines"))
    return summaries.join(read, "site_folder", "left").na.fill(0, ["links", "urls", "broken_lines"])


def visits_by_proxy(visits: DataFrame) -> DataFrame:
    label = proxy_label(F.col("proxy"), F.lit(None).cast("string")).alias("proxy")
    return visits.groupBy(label).agg(F.count("*").alias("visits"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(transport_error(F.col("error"))).alias("transport_errors"), F.sum("duration_ms").alias("duration_ms"))


def visit_attempts(visits: DataFrame) -> DataFrame:
    """visits with the number of the attempt at their URL, in order of start; a null URL or site is one of its own.

    Attempts are numbered by slices, so a URL that a third of all visits went to is not one task's.
    """
    keyed = visits.withColumn("__tried", F.to_json(F.struct("site_key", "requested_url")))
    return order.numbered(keyed, ["__tried"], ["started_at", "finished_at", "visit_id"], "attempt").drop("__tried")


def ticks(visits: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (site_key, segment, new_visits, new_ok, new_failed, visits, ok): what each report of a run adds, and its totals so far.

    A report is due with each save: segments has (site_key, visit_id, segment), numbered from 0 as order.segments does,
    visits has site_key, visit_id and ok. Only counts are summed up over reports, in blocks.
    """
    new = visits.select("site_key", "visit_id", "ok").join(segments.select("site_key", "visit_id", "segment"), ["site_key", "visit_id"])
    counts = new.groupBy("site_key", "segment").agg(F.count("*").alias("new_visits"), F.count_if("ok").alias("new_ok"), F.count_if(~F.col("ok")).alias("new_failed"))
    out = order.running(counts, ["site_key"], F.col("new_visits"), "visits", place="segment").drop("visits_before")
    return order.running(out, ["site_key"], F.col("new_ok"), "ok", place="segment").drop("ok_before")


def worker_totals(workers: DataFrame) -> DataFrame:
    """One row (workers, failed_workers, sites, sites_of_failed) of rows (worker, return_code, sites).

    A worker failed if its code is not 0 or missing. Without workers all are 0.
    """
    failed = F.coalesce(F.col("return_code") != 0, F.lit(True))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in ((F.col("sites"), "sites"), (F.when(failed, F.col("sites")), "sites_of_failed"))]
    return workers.agg(F.count("*").alias("workers"), F.count_if(failed).alias("failed_workers"), *sums)
