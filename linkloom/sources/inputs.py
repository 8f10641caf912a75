"""Sources: seed files, run configuration, captured pages, and saved summaries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import normalize_seed, site_family, site_folder


def seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line) of a seed file or folder of them: no blanks, no comments, no byte-order mark."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\\uFEFF", "")).alias("line"))
    return lines.filter("line <> '' and not startswith(line, '#')")


def seeds(lines: DataFrame) -> DataFrame:
    """Rows (url, site_key, host, origin) of rows (line, …): repeats stay, invalid lines go. Other columns stay."""
    made = normalize_seed(lines, "line", "url").filter("url is not null")
    return made.withColumnsRenamed({"url_site_key": "site_key", "url_host": "host", "url_origin": "origin"})


def sites(rows: DataFrame, position: str, include_homepage: bool = True) -> DataFrame:
    """One row per site of seeds: its origin is that of its first seed, its seed URLs are distinct and sorted."""
    first = F.min_by(F.struct("host", "origin"), position).alias("first")
    urls = rows.select("site_key", "host", "origin", "url", position)
    grouped = urls.groupBy("site_key").agg(first, F.collect_set("url").alias("urls"))
    home = F.array(F.concat("first.origin", F.lit("/"))) if include_homepage else F.array().cast("array<string>")
    return grouped.select(
        "site_key", F.col("first.host").alias("site_host"), F.col("first.origin").alias("site_origin"), site_family(F.col("first.host")).alias("site_family"),
        site_folder(F.col("site_key")).alias("site_folder"), F.array_sort(F.array_union("urls", home)).alias("seed_urls"),
    )


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages with their site: page_id, site…, source_url, html. Pages without a usable address are left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    named = seeds(pages.withColumnRenamed("url", "line")).withColumnRenamed("url", "source_url")
    first = named.groupBy("site_key").agg(F.min_by("origin", "page_id").alias("site_origin"))
    return named.join(first, "site_key").select("page_id", "site_key", F.col("host").alias("site_host"), "site_origin", site_family(F.col("host")).alias("site_family"), "source_url", "html")


@dataclass
class RunConfig:
    """Settings that change results. Unknown keys of a file are ignored; numbers are held at their least value."""

    input_urls_file: str = "input_urls.txt"
    output_dir: str = "output"
    include_homepage_seed: bool = True
    aggressive_same_site_crawl: bool = True
    visit_leaf_pages: bool = False
    max_pages_per_site: int = 0
    max_api_pages_per_series: int = 0
    max_cbpt_portal_ajax_requests_per_page: int = 24
    enable_cbpt_portal_ajax_expansion: bool = True
    transient_page_retry_limit: int = 1
    session_rebuild_retries: int = 2
    checkpoint_every_pages: int = 10
    checkpoint_every_seconds: float = 30.0
    skip_completed_sites: bool = True
    blocked_resource_types: list[str] = field(default_factory=list)

    @classmethod
    def from_text(cls, text: str) -> RunConfig:
        given = json.loads(text.lstrip("﻿"))
        known = {f.name: f for f in fields(cls) if f.name in given}
        out = cls(**{name: given[name] for name in known})
        for f in fields(cls):
            value = getattr(out, f.name)
            if isinstance(value, int | float) and not isinstance(value, bool):
                setattr(out, f.name, max(0, value))
        return out

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> RunConfig:
        return cls.from_text("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


COUNTS = ["discovered_urls", "queueable_urls", "same_site_urls", "external_or_non_queueable_urls", "edges", "visited_pages", "visit_ok", "visit_failed"]
SUMMARY_ROW = f"site_key string, site_host string, site_family string, completed boolean, counts struct<{', '.join(f'{c}: long' for c in COUNTS)}>"
NODE_ROW = "url string, same_site boolean, queueable boolean, first_depth int, first_source string, first_method string, seen_count long, page_kind string"
BROKEN = "broken"


def _saved(spark: SparkSession, root: str, name: str, schema: str, whole: bool) -> DataFrame:
    """Rows of one table of all sites under root, in one scan, with site_folder and, where a record is no JSON of that schema, broken.

    Sites are folders with a file (site/name) each, or, as write_sites has them, parts of one table (name/site_folder=site).
    """
    jvm = spark.sparkContext._jvm
    bulk = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    one_table = bulk.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(bulk)
    paths = f"{root}/{name}/*/" if one_table else f"{root}/*/{name}"
    reader = spark.read.schema(f"{schema}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN).option("multiLine", whole and not one_table)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return reader.json(paths).withColumn("site_folder", F.url_decode(F.regexp_replace(folder, "^site_folder=", "")))


def saved_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of all sites under root, numbers flat and 0 where a summary lacks them; a site without one is not there."""
    rows = _saved(spark, root, "summary.json", SUMMARY_ROW, True)
    host = F.coalesce("site_host", F.lit(""))
    family = F.when(F.coalesce("site_family", F.lit("")) != "", F.col("site_family")).when(host != "", site_family(host)).otherwise("")
    numbers = [F.coalesce(F.col(f"counts.{c}"), F.lit(0)).alias(c) for c in COUNTS]
    return rows.select("site_folder", host.alias("site_host"), family.alias("site_family"), F.coalesce("completed", F.lit(False)).alias("completed"), *numbers)


def saved_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of all sites under root; blank lines are none, and a line that is no JSON has nothing but broken."""
    return _saved(spark, root, "nodes.jsonl", NODE_ROW, False)
