"""Saved state: a keyed log of Parquet deltas under one manifest, and what a resumed run makes of it.

A version holds what is new since the last one: rows to put in, and keys of rows that left (tombstones). A table's rows
are merged by key when it is read, so a key that many versions have comes back once. The manifest of a version
names the versions that each table is made of; it is written last, and only if no other run has written that number, so
a version counts whole or not at all. Compacting writes merged tables as a version that needs none before it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rules
from ..functions.classify import classified
from ..functions.urls import normalize
from . import graph
from .extract import SITE

PAGE = ["site_key", "url"]
#: What a table's rows are told apart by; rows of tables without a key all stay.
KEYS = {
    "nodes": PAGE,
    "edges": ["site_key", "source_url", "target_url", "method"],
    "visits": [],
    "visited": PAGE,
    "frontier": PAGE,
    "in_flight": PAGE,
    "expected": ["site_key", "category", "url"],
    "seeds": PAGE,
}
#: Tables of one moment: a version that has one makes those of earlier versions void.
MOMENTS = {"in_flight"}
REMOVED, VERSION = "__removed", "v"


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under path, in order."""
    files, folder = _path(spark, f"{path}/_log")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def meta(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, or of the newest; empty if nothing is saved. No job runs for it."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else 0
    if version not in known:
        return {}
    files, target = _path(spark, f"{path}/_log/{version:010d}.json")
    stream = files.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, manifest: dict) -> int:
    """Write a manifest in one step; an error if its version exists."""
    files, target = _path(spark, f"{path}/_log/{manifest['version']:010d}.json")
    _, draft = _path(spark, f"{path}/_log/.{manifest['version']:010d}.{spark.sparkContext.applicationId}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        raise FileExistsError(f"version {manifest['version']} of {path} was saved by another run")
    return manifest["version"]


def save(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None, completed: bool = False, visit_leaf_pages: bool = False
) -> int:
    """Write what is new in tables (names of KEYS), and the keys that left them, as the next version; return its number.

    Nodes are what was found since the last save: counts add up, and the earliest version's first arrival stays. Of
    other tables the latest version of a key stays, of edges the first. A key that is put in and removed by one version is removed.
    """
    removed = removed or {}
    before = meta(spark, path)
    version = before.get("version", 0) + 1
    parts = {name: list(held) for name, held in before.get("tables", {}).items()}
    for name in {**tables, **removed}:
        rows = tables.get(name)
        rows = rows.withColumn(REMOVED, F.lit(False)) if rows is not None else None
        if name in removed:
            gone = removed[name].select(*KEYS[name]).distinct().withColumn(REMOVED, F.lit(True))
            rows = gone if rows is None else rows.unionByName(gone, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{path}/{VERSION}={version}/{name}")
        parts[name] = [version] if name in MOMENTS else [*parts.get(name, []), version]
    return _commit(spark, path, {"version": version, "policy_version": rules.POLICY_VERSION, "visit_leaf_pages": visit_leaf_pages, "completed": completed, "tables": parts})


def load(spark: SparkSession, path: str, name: str, upto: int | None = None) -> DataFrame | None:
    """A table as of a version (the newest), one row a key; None if no version has it."""
    parts = meta(spark, path, upto).get("tables", {}).get(name)
    if not parts:
        return None
    rows = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*[f"{path}/{VERSION}={v}/{name}" for v in parts])
    keys = KEYS[name]
    rest = [c for c in rows.columns if c not in (*keys, REMOVED, VERSION)]
    if not keys:
        return rows.filter(~F.col(REMOVED)).select(*rest)
    if name == "nodes":
        return _summed(rows, rest)
    newest: Column = F.max(F.struct(VERSION, REMOVED, *rest)) if name != "edges" else F.min(F.struct(REMOVED, VERSION, *rest))
    return rows.groupBy(*keys).agg(newest.alias("r")).filter(f"not r.{REMOVED}").select(*keys, *[F.col(f"r.{c}") for c in rest])


def _summed(rows: DataFrame, rest: list[str]) -> DataFrame:
    """One row a node: counts of all versions, the earliest one's first arrival, the latest one's classes."""
    gone = rows.groupBy(*PAGE).agg(F.max(F.when(F.col(REMOVED), F.col(VERSION))).alias("gone"))
    live = rows.join(gone.filter("gone is not null"), PAGE, "left").filter(f"gone is null or {VERSION} > gone").drop("gone")
    arrival = [c for c in ("first_depth", "first_source", "first_method") if c in rest]
    classes = [c for c in rest if c not in (*arrival, "seen_count")]
    made = live.groupBy(*PAGE).agg(F.min(F.struct(VERSION, *arrival)).alias("first"), F.min("first_depth").alias("depth"), F.sum("seen_count").alias("seen_count"), F.max(F.struct(VERSION, *classes)).alias("last"))
    column = lambda c: F.col("depth").alias(c) if c == "first_depth" else F.col(f"first.{c}") if c in arrival else F.col(c) if c == "seen_count" else F.col(f"last.{c}")
    return made.select(*PAGE, *[column(c) for c in rest])


def compact(spark: SparkSession, path: str) -> int:
    """Write all tables merged as the next version, which stands alone, and return its number. Tombstones are gone then."""
    before = meta(spark, path)
    version = before["version"] + 1
    for name in before["tables"]:
        load(spark, path, name).withColumn(REMOVED, F.lit(False)).write.mode("overwrite").parquet(f"{path}/{VERSION}={version}/{name}")
    return _commit(spark, path, before | {"version": version, "tables": {name: [version] for name in before["tables"]}})


def clear_out(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Remove manifests but the last keep, and the folders that none of these names; return the versions of the folders."""
    known = versions(spark, path)
    named = {v for n in known[-keep:] for held in meta(spark, path, n)["tables"].values() for v in held}
    gone = [v for v in known[:-keep] if v not in named]
    for n in known[:-keep]:
        files, target = _path(spark, f"{path}/_log/{n:010d}.json")
        files.delete(target, False)
    for v in gone:
        files, target = _path(spark, f"{path}/{VERSION}={v}")
        files.delete(target, True)
    return gone


def matches_policy(saved: dict, visit_leaf_pages: bool) -> bool:
    return int(saved.get("policy_version", 0) or 0) >= rules.POLICY_VERSION and bool(saved.get("visit_leaf_pages", False)) == visit_leaf_pages


def run_plan(seeds: DataFrame, saved: DataFrame, saved_seeds: DataFrame, visit_leaf_pages: bool = False, skip_completed: bool = True) -> DataFrame:
    """Rows (site_key, decision, new_seeds): what is to be done for each site of seeds, all sites at once.

    seeds and saved_seeds have site_key and url, saved has site_key, completed, policy_version and visit_leaf_pages of
    sites with a state; nulls there count as not completed, version 0 and false. decision is start without a state,
    skip if the site is done under today's policy and has no new seeds, and else why it is resumed: unfinished, policy
    or seeds. new_seeds counts distinct seeds that the state does not have.
    """
    once = seeds.select(*PAGE).distinct()
    fresh = once.join(saved_seeds.select(*PAGE), PAGE, "left_anti").groupBy("site_key").agg(F.count("*").alias("new_seeds"))
    policy = (F.coalesce("policy_version", F.lit(0)) >= rules.POLICY_VERSION) & (F.coalesce("visit_leaf_pages", F.lit(False)) == F.lit(visit_leaf_pages))
    states = saved.select("site_key", F.coalesce("completed", F.lit(False)).alias("completed"), policy.alias("policy"))
    out = once.select("site_key").distinct().join(states, "site_key", "left").join(fresh, "site_key", "left").na.fill(0, ["new_seeds"])
    decision = (
        F.when(F.col("completed").isNull(), "start")
        .when(~F.col("completed") | F.lit(not skip_completed), "unfinished")
        .when(~F.col("policy"), "policy")
        .when(F.col("new_seeds") > 0, "seeds")
        .otherwise("skip")
    )
    return out.select("site_key", decision.alias("decision"), "new_seeds")


def saved_sites(spark: SparkSession, root: str) -> DataFrame:
    """The newest manifest of every state under root, in one scan: rows (site_folder, version, completed, policy_version, visit_leaf_pages)."""
    schema = "version long, policy_version int, visit_leaf_pages boolean, completed boolean"
    rows = spark.read.schema(schema).json(f"{root}/*/_log/*.json").withColumn("site_folder", F.element_at(F.split("_metadata.file_path", "/"), -3))
    newest = F.max(F.struct("version", "completed", "policy_version", "visit_leaf_pages")).alias("m")
    return rows.filter("version is not null").groupBy("site_folder").agg(newest).select("site_folder", "m.*")


def new_seeds(seeds: DataFrame, saved_seeds: DataFrame) -> DataFrame:
    return seeds.select("url").distinct().join(saved_seeds.select("url"), "url", "left_anti")


def reclassified(nodes: DataFrame, sites: DataFrame, aggressive: bool = True, visit_leaf_pages: bool = False) -> DataFrame:
    """Saved nodes with same_site, queueable, page_kind and should_visit derived anew: stored values are never trusted."""
    base = nodes.drop("same_site", "queueable", "page_kind", "should_visit").join(sites.select(*SITE), "site_key")
    parts = normalize(base.withColumnRenamed("url", "__saved"), "__saved")
    out = classified(parts.filter("url is not null"), aggressive=aggressive, visit_leaf_pages=visit_leaf_pages)
    return out.select("site_key", F.col("__saved").alias("url"), "same_site", "queueable", "first_depth", "first_source", "first_method", "seen_count", "page_kind", "should_visit")


def resumed_frontier(frontier: DataFrame, nodes: DataFrame, visited: DataFrame) -> DataFrame:
    """Saved frontier rows that still wait: not visited, and of a node that is still to be visited."""
    keys = ["site_key", "url"]
    return frontier.join(visited.select(*keys), keys, "left_anti").join(nodes.filter("should_visit").select(*keys), keys, "left_semi")


def requeued(nodes: DataFrame, visited: DataFrame, queued: DataFrame) -> DataFrame:
    """Frontier rows of nodes that are neither visited nor queued, with what is known of their discovery."""
    keys = ["site_key", "url"]
    gone = visited.select(*keys).unionByName(queued.select(*keys))
    lost = nodes.filter("queueable and should_visit").join(gone, keys, "left_anti")
    return lost.select(*keys, F.coalesce("first_depth", F.lit(0)).alias("depth"), F.coalesce("first_source", "url").alias("discovered_from"), F.coalesce("first_method", F.lit("resume")).alias("discovery_method"), F.lit(0).alias("attempts"))


def seed_rows(seeds: DataFrame) -> DataFrame:
    """Discoveries of seeds, at depth 0."""
    return seeds.select(*SITE, F.col("url").alias("source_url"), F.lit(0).alias("depth"), F.lit("seed").alias("method"), F.col("url").alias("raw_url"), F.lit(0).alias("pos"))


def resume(spark: SparkSession, path: str, sites: DataFrame, seeds: DataFrame | None = None, aggressive: bool = True, visit_leaf_pages: bool = False) -> dict[str, DataFrame]:
    """nodes, visited and frontier of the saved state, as a run would start from them.

    Rows that were being worked on wait again, behind a frontier row of the same page. Nodes are classified anew, what
    waits but is done or is no longer to be visited goes, and nodes that were lost come back. Seeds (site_key, url)
    are found once more, at depth 0, and those that are to be visited and are neither done nor waiting wait too. Tables that
    no version has are empty.
    """
    item = "site_key string, url string, depth int, discovered_from string, discovery_method string, attempts int"
    held = {name: load(spark, path, name) for name in ("nodes", "visited", "frontier", "in_flight")}
    empty = spark.createDataFrame([], item)
    visited = held["visited"] if held["visited"] is not None else empty.select(*PAGE)
    frontier, active = (held[n] if held[n] is not None else empty for n in ("frontier", "in_flight"))
    known = held["nodes"]
    if known is None:
        known = empty.select(*PAGE, F.lit(0).alias("first_depth"), F.lit("").alias("first_source"), F.lit("").alias("first_method"), F.lit(0).cast("long").alias("seen_count"))
    nodes = reclassified(known, sites, aggressive, visit_leaf_pages)
    waiting = resumed_frontier(graph.in_flight(active, frontier), nodes, visited)
    waiting = waiting.unionByName(requeued(nodes, visited, waiting))
    if seeds is not None:
        found = graph.written(graph.resolved(seed_rows(seeds.join(sites.select(*SITE), "site_key")), aggressive, visit_leaf_pages))
        waiting = graph.written(waiting)
        waiting = waiting.unionByName(graph.frontier_next(found, visited, waiting))
        nodes = graph.merged_nodes(nodes, graph.nodes(found))
    return {"nodes": nodes, "visited": visited, "frontier": waiting}
