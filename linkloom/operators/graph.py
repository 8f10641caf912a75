"""The link graph: edges and nodes from raw discoveries, the frontier, and breadth-first levels.

Raw discoveries are rows (site…, source_url, depth, method, raw_url, pos). First arrivals follow one total order: depth,
rank of the method, source, method, position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.classify import classified, method_rank, page_kind
from ..functions.urls import normalize
from .extract import SITE

NODE = ["url", "same_site", "queueable", "first_depth", "first_source", "first_method", "seen_count", "page_kind"]
EDGE = ["source_url", "target_url", "depth", "method", "same_site", "queueable", "note"]


def scratch(spark: SparkSession) -> str:
    """The folder all executors share; set a checkpoint folder in the session's configuration on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing."""
    path = f"{scratch(df.sparkSession)}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrival() -> Column:
    """Sort key of a discovery."""
    return F.struct(F.col("depth"), method_rank(F.col("method")).alias("rank"), F.col("source_url"), F.col("method"), F.col("pos"))


def resolved(discoveries: DataFrame, aggressive: bool = True, visit_leaf_pages: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct discoveries with url (the target) and its classes; what has no URL is gone.

    Of one source and method a raw URL counts once, for each value of the columns in keep. Rows of the same raw URL from
    the same page are merged before it is normalised, which is the dear part.
    """
    keys = [*SITE, "source_url", *keep, "method", "raw_url"]
    once = discoveries.groupBy(keys).agg(F.min("depth").alias("depth"), F.min("pos").alias("pos"))
    return classified(normalize(once, "raw_url", "source_url").filter("url is not null"), aggressive=aggressive, visit_leaf_pages=visit_leaf_pages)


def edges(found: DataFrame) -> DataFrame:
    """One row per (site_key, source_url, target, method) of resolved discoveries; pos is where the page has the first of them."""
    best = F.min_by(F.struct("depth", "same_site", "queueable", "pos"), arrival()).alias("first")
    grouped = found.groupBy("site_key", "source_url", F.col("url").alias("target_url"), "method").agg(best)
    return grouped.select("site_key", "source_url", "target_url", "first.depth", "method", "first.same_site", "first.queueable", F.lit("").alias("note"), "first.pos")


def nodes(found: DataFrame) -> DataFrame:
    """One row per (site_key, url); seen_count counts distinct (source, method, raw URL), which found's rows are."""
    grouped = found.groupBy("site_key", "url").agg(
        F.min(arrival()).alias("first"),
        F.count("*").alias("seen_count"),
        F.bool_or("same_site").alias("same_site"),
        F.bool_or("queueable").alias("queueable"),
        F.min("page_kind").alias("page_kind"),
        F.bool_or("should_visit").alias("should_visit"),
    )
    return grouped.select(
        "site_key", "url", "same_site", "queueable", F.col("first.depth").alias("first_depth"), F.col("first.source_url").alias("first_source"),
        F.col("first.method").alias("first_method"), "seen_count", "page_kind", "should_visit",
    )


def merged_nodes(known: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of known state and new nodes as one table: counts add up, the earlier first arrival stays, known before new."""
    order = lambda df, n: df.withColumn("__known", F.lit(n))
    both = order(known, 0).unionByName(order(new, 1))
    first = F.min(F.struct("__known", "first_depth", "first_source", "first_method")).alias("first")
    latest = lambda c: F.max_by(c, "__known").alias(c)
    out = both.groupBy("site_key", "url").agg(first, F.min("first_depth").alias("first_depth"), F.sum("seen_count").alias("seen_count"), *[latest(c) for c in ("same_site", "queueable", "page_kind", "should_visit")])
    return out.select("site_key", "url", "same_site", "queueable", "first_depth", "first.first_source", "first.first_method", "seen_count", "page_kind", "should_visit")


def expected(found: DataFrame) -> DataFrame:
    """Rows (site_key, category, url) of pages that should be covered, by what found them or by their kind.

    Searches that answers name for an issue, articles, pages of details, and English articles that answers or the
    English start page name. A URL may be in more than one category; a null method names none.
    """
    method, kind = F.coalesce("method", F.lit("")), F.coalesce("page_kind", F.lit(""))
    by_answer = F.when(method.endswith(":search") | method.endswith(":currentIssue"), "issue_search").when(method.endswith(":enIssue"), "en_issue")
    by_kind = F.when(kind == "issue_detail", "issue_detail").when(kind == "detail", "static_detail")
    named = found.select("site_key", F.explode(F.array_compact(F.array(by_answer, by_kind))).alias("category"), "url")
    source = normalize(found.filter("page_kind = 'english_issue'").withColumn("__source", F.col("source_url")), "__source", None, "from")
    english = source.filter(page_kind("from") == "english_index").select("site_key", F.lit("en_issue").alias("category"), "url")
    return named.unionByName(english).distinct()


def frontier_next(found: DataFrame, visited: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Rows (site_key, url, depth, discovered_from, discovery_method, attempts) to visit that are not visited or queued yet."""
    seen = visited.select("site_key", "url")
    seen = seen.unionByName(queued.select("site_key", "url")) if queued is not None else seen
    first = found.filter("should_visit").groupBy("site_key", "url").agg(F.min(arrival()).alias("first"))
    new = first.join(seen, ["site_key", "url"], "left_anti")
    return new.select("site_key", "url", F.col("first.depth").alias("depth"), F.col("first.source_url").alias("discovered_from"), F.col("first.method").alias("discovery_method"), F.lit(0).alias("attempts"))


def limited(frontier: DataFrame, limit_this_run: int) -> DataFrame:
    """The first rows of a frontier, for a run that may dispatch only so many."""
    return frontier.orderBy("depth", "site_key", "url").limit(limit_this_run)


def in_flight(active: DataFrame, frontier: DataFrame) -> DataFrame:
    """Frontier and rows being worked on, one per URL; a frontier row wins over an active one."""
    both = active.withColumn("__ord", F.lit(0)).unionByName(frontier.withColumn("__ord", F.lit(1)))
    columns = [c for c in frontier.columns if c not in ("site_key", "url")]
    return both.groupBy("site_key", "url").agg(F.max_by(F.struct(*columns), "__ord").alias("r")).select("site_key", "url", "r.*")


def retryable(items: DataFrame, transient_retries: int = 1, rebuild_retries: int = 2) -> DataFrame:
    """Items whose attempts stay under the limit of a queue item."""
    return items.filter(F.col("attempts") < max(2, 1 + transient_retries + rebuild_retries))


def bfs(links: DataFrame, seeds: DataFrame, max_levels: int | None = None) -> DataFrame:
    """Rows (node, depth) of what rows (node) of seeds reach over rows (src, dst) of links, with the least depth.

    One job a level: new nodes are the distinct targets of the last level without those seen. Each level is written to
    the shared folder, so plans do not grow with depth; it ends with an empty level, or after max_levels.
    """
    links = links.select("src", "dst")
    level = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while max_levels is None or depth < max_levels:
        depth += 1
        targets = level.join(links, level["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        level = written(targets.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def crawl(pages: DataFrame, seeds: DataFrame, max_levels: int | None = None, aggressive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(visited, found): a crawl of captured pages from seeds, level by level.

    pages has SITE, source_url (normalised) and html; seeds SITE and url. A level is the frontier joined with the
    captured pages; its links are resolved and what is new becomes the next level. URLs without a captured page stay in
    the frontier of their level and are not expanded. It ends with an empty frontier, or after max_levels.
    """
    from .extract import links_of_pages

    keys = ["site_key", "url"]
    level = written(seeds.select(*SITE, "url").distinct().withColumn("depth", F.lit(0)))
    visited, found, depth = level, None, 0
    while max_levels is None or depth < max_levels:
        depth += 1
        captured = level.join(pages.select("site_key", F.col("source_url").alias("url"), "html"), keys).withColumnRenamed("url", "source_url")
        raw = links_of_pages(captured.select(*SITE, "source_url", "html")).select("*", F.lit(depth).alias("depth"), F.lit("dom").alias("method"))
        new = written(resolved(raw, aggressive))
        found = new if found is None else found.unionByName(new)
        follow = new.filter("should_visit").groupBy(*SITE, "url").agg(F.min("depth").alias("depth"))
        level = written(follow.join(visited.select(*keys), keys, "left_anti"))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited, found


def classic_expansion(start: DataFrame, pages: DataFrame, limit: int = 256) -> DataFrame:
    """Rows (root, url, depth) reached from rows (SITE, root, url) over captured list pages of the portal family.

    A breadth-first search of its own for each root, over list pages only; pages that ask for a code are passed over,
    and no root takes more than `limit` pages, in order of depth and URL. Only captured pages count.
    """
    from pyspark.sql import Window

    from ..functions import rules
    from ..functions.classify import portal_page
    from .extract import links_of_html

    def lists_only(df: DataFrame) -> DataFrame:
        kept = (F.col("site_family") == rules.FAMILY_PORTAL) & ~portal_page("url") & (page_kind("url") == "cbpt_list")
        return df.filter(kept).select(*SITE, "root", "url").distinct()

    def fetched(df: DataFrame) -> DataFrame:
        return df.join(texts.select("site_key", "url"), ["site_key", "url"], "left_semi")

    texts = pages.filter(~F.col("html").contains("showValidateCode.aspx")).select("site_key", F.col("source_url").alias("url"), "html")
    level = written(lists_only(normalize(start.withColumnRenamed("url", "__raw"), "__raw")).filter("root <> url").withColumn("depth", F.lit(0)))
    seen = level
    while not level.isEmpty():
        read = level.join(texts, ["site_key", "url"])
        links = links_of_html(read.withColumn("source_url", F.col("url")).select(*SITE, "source_url", "html")).select("site_key", F.col("source_url").alias("url"), "raw_url").distinct()
        targets = read.select(*SITE, "root", "url", "depth").join(links, ["site_key", "url"]).withColumnRenamed("url", "__from")
        new = normalize(targets, "raw_url", "__from").withColumn("__next", F.col("depth") + 1)
        new = lists_only(new).join(seen.select("root", "url"), ["root", "url"], "left_anti").filter("root <> url")
        depth = level.agg(F.max("depth")).first()[0] + 1
        level = written(new.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(level)
        full = fetched(seen).groupBy("root").count().filter(F.col("count") >= limit)
        if seen.select("root").distinct().join(full, "root", "left_anti").isEmpty():
            break
    ranked = fetched(seen).withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("depth", "url")))
    return ranked.filter(F.col("n") <= limit).select("root", "url", "depth")
