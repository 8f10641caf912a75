"""Sinks: lists, link tables and summaries, in the formats that readers of a site's folder expect.

Each sink is a folder that Spark's commit protocol fills; nothing passes through the driver. Lists are range-sorted, so
reading the parts in order gives the sorted list. What goes into more than one file is written as a table first, so that
it is not worked out again for each; the sorts read that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import EDGE, NODE, written

VISIT = ["requested_url", "final_url", "depth", "page_kind", "proxy", "title", "ok", "error", "discoveries", "started_at", "finished_at", "duration_ms"]
FEED = ["url", "same_site", "queueable", "first_depth", "first_source", "first_method", "page_kind"]
LINKS = ["site_folder", "site_host", "site_family", "url", "same_site", "queueable", "page_kind", "first_depth"]


def yes_no(value: Column) -> Column:
    """True or False with a capital, as the tables of text have them."""
    return F.initcap(value.cast("string"))


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    flags = [c for c, kind in df.dtypes if kind == "boolean"]
    return df.select(*[yes_no(F.col(c)).alias(c) if c in flags else F.col(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], sep: str = ",") -> None:
    as_text(df, columns).write.mode("overwrite").option("header", True).option("sep", sep).option("lineSep", "\r\n" if sep == "," else "\n").option("emptyValue", "").option("escape", '"').csv(path)


def write_nodes(nodes: DataFrame, folder: str) -> None:
    ordered = written(nodes.select(*NODE)).orderBy("url")
    ordered.select(*NODE).write.mode("overwrite").json(f"{folder}/nodes_jsonl")
    write_csv(ordered, f"{folder}/nodes_csv", NODE)


def write_edges(edges: DataFrame, folder: str) -> None:
    """Edges in order of their discovery: depth, source, method, place on the page."""
    ordered = written(edges.select(*EDGE, "pos")).orderBy("depth", "source_url", "method", "pos", "target_url")
    ordered.select(*EDGE).write.mode("overwrite").json(f"{folder}/edges_jsonl")
    write_csv(ordered, f"{folder}/edges_csv", EDGE)


def write_visits(visits: DataFrame, folder: str) -> None:
    rows = visits.withColumn("duration_ms", F.coalesce("duration_ms", ((F.col("finished_at") - F.col("started_at")) * 1000).cast("long"))) if "duration_ms" in visits.columns else visits.withColumn("duration_ms", ((F.col("finished_at") - F.col("started_at")) * 1000).cast("long"))
    rows = written(rows.select(*VISIT))
    rows.write.mode("overwrite").json(f"{folder}/visits_jsonl")
    write_csv(rows, f"{folder}/visits_csv", VISIT)


def write_url_lists(nodes: DataFrame, folder: str) -> None:
    """All URLs, those of the site, and those not followed, which may be of the site as well."""
    nodes = written(nodes.select("url", "same_site", "queueable"))
    for name, kept in (("all_discovered_urls", F.lit(True)), ("same_site_urls", F.col("same_site")), ("external_or_non_queueable_urls", ~F.col("queueable"))):
        nodes.filter(kept).select("url").orderBy("url").write.mode("overwrite").text(f"{folder}/{name}")


def write_seeds(seeds: DataFrame, folder: str) -> None:
    seeds.select("url").write.mode("overwrite").text(f"{folder}/seed_urls")


def write_summary(summary: DataFrame, folder: str) -> None:
    summary.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(f"{folder}/summary")


def write_global(links: DataFrame, summary: DataFrame, batch: DataFrame, folder: str) -> None:
    """The roll-up of all sites: URLs, links as TSV (without the family) and CSV, the table of sites, and the totals."""
    links = written(links.select(*LINKS))
    links.select("url").filter("url <> ''").distinct().orderBy("url").write.mode("overwrite").text(f"{folder}/all_urls")
    ordered = links.orderBy("site_folder", "url")
    write_csv(ordered, f"{folder}/all_links_tsv", [c for c in LINKS if c != "site_family"], sep="\t")
    write_csv(ordered, f"{folder}/all_links_csv", LINKS)
    write_csv(summary.orderBy("site_folder"), f"{folder}/sites_summary", summary.columns)
    write_summary(batch, f"{folder}/batch")


def write_sites(nodes: DataFrame, summaries: DataFrame, root: str) -> None:
    """Nodes and summaries of all sites, two jobs in all: a folder a site in each of two tables, as saved_nodes and saved_summaries read them.

    nodes has site_folder and NODE, summaries the columns of rollup.sites_summary. A site's nodes come from as many
    tasks as they fill, each in order of URL.
    """
    nodes.select("site_folder", *NODE).sortWithinPartitions("site_folder", "url").write.mode("overwrite").partitionBy("site_folder").json(f"{root}/nodes.jsonl")
    rest = [c for c in summaries.columns if c not in ("site_folder", "site_host", "site_family", "completed")]
    rows = summaries.select("site_folder", "site_host", "site_family", "completed", F.struct(*rest).alias("counts"))
    rows.write.mode("overwrite").partitionBy("site_folder").json(f"{root}/summary.json")


def write_error(site_folder: str, message: DataFrame, folder: str) -> None:
    """What ended a site's run: rows (error) beside a summary that has nothing but them."""
    message.select("error").write.mode("overwrite").text(f"{folder}/{site_folder}/run_error")
    write_summary(message.select("error"), f"{folder}/{site_folder}")
