"""The link-graph queries against DuckDB, and invariants that hold on any pages."""

import os
import random

import duckdb
import pytest
from linkloom import catalogue
from linkloom.operators import expand, extract, graph, state
from linkloom.plans import queries as plans
from linkloom.sources import inputs, outputs
from linkloom.streaming import feed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    return float(value) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    if name not in catalogue.oracle_sql():
        assert rows
        return
    result = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall()) == rows


@pytest.fixture(scope="module")
def found(spark):
    return plans.found(spark, SF).cache()


def test_invariants(spark, found):
    nodes, edges = graph.nodes(found), graph.edges(found)
    assert edges.count() == edges.select("site_key", "source_url", "target_url", "method").distinct().count()
    assert edges.join(nodes, (edges.target_url == nodes.url) & (edges.site_key == nodes.site_key), "left_anti").count() == 0
    assert nodes.filter("queueable and not same_site").count() == 0
    assert nodes.filter("first_depth > 1").count() == 0
    visited = plans.visited(spark, SF)
    frontier = graph.frontier_next(found, visited)
    assert frontier.join(visited, ["site_key", "url"]).count() == 0
    from linkloom.functions.urls import normalize

    again = normalize(found.filter("same_site").select(*extract.SITE, "url"), "url", None, "twice")
    assert again.filter("url <> twice or twice is null").count() == 0


def test_links_of_long_pages(spark):
    rows = [("h", "h", "http://h", "generic", "http://h/", f'<p>{"x " * 1_000_100}</p><a href="/far">far</a> see http://h/further now')]
    pages = spark.createDataFrame(rows, "site_key string, site_host string, site_origin string, site_family string, source_url string, html string")
    assert {r["url"] for r in graph.resolved(plans.raw_links(pages)).collect()} == {"http://h/", "http://h/far", "http://h/further"}


def test_bfs_levels_on_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d"), ("b", "d"), ("x", "y")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in graph.bfs(links, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}
    assert graph.bfs(links, spark.createDataFrame([("a",)], "node string"), max_levels=1).count() == 2


def test_bfs_from_all_customers(spark, duck):
    links = {}
    for kind, a, other, b, table in (("c", "o_custkey", "o", "o_orderkey", "orders"), ("o", "l_orderkey", "s", "l_suppkey", "lineitem"), ("s", "s_suppkey", "n", "s_nationkey", "supplier"), ("n", "n_nationkey", "r", "n_regionkey", "nation"), ("r", "n_regionkey", "n", "n_nationkey", "nation")):
        for src, dst in duck.execute(f"SELECT {a}, {b} FROM {table}").fetchall():
            links.setdefault(f"{kind}{src}", set()).add(f"{other}{dst}")
    want = {f"c{k}": 0 for (k,) in duck.execute("SELECT c_custkey FROM customer").fetchall()}
    level = list(want)
    while level:
        level = [want.setdefault(dst, want[src] + 1) and dst for src in level for dst in links.get(src, ()) if dst not in want]
    assert {r["node"]: r["depth"] for r in plans.bfs_reachability(spark, SF).collect()} == want


def test_crawl_ends_on_an_empty_frontier(spark, monkeypatch):
    cheap = lambda pages: pages.select(*extract.SITE, F.col("html").alias("url"), F.lit(True).alias("should_visit"))
    monkeypatch.setattr(extract, "links_of_pages", cheap)
    monkeypatch.setattr(graph, "resolved", lambda raw, aggressive: raw.drop("method"))
    monkeypatch.setattr(graph, "written", lambda df: spark.createDataFrame(df.coalesce(1).collect(), df.schema))
    rows = [(str(n), str(n + 1), "h") for n in range(22)]
    pages = plans.with_site(spark.createDataFrame(rows, "source_url string, html string, host string").coalesce(1))
    starts = pages.filter("source_url = '0'").withColumnRenamed("source_url", "url")
    got = {(r["url"], r["depth"]) for r in graph.crawl(pages, starts)[0].collect()}
    assert got == {(str(n), n) for n in range(23)}


def test_portal_requests_of_a_long_page(spark, monkeypatch):
    rows = [(n, f"tabPage('2020','1','{n}','client/paper_list','y','i')", "gggl.cbpt.cnki.net") for n in range(2, 6)]
    monkeypatch.setitem(plans.fixtures.TABLES, "onclicks", ("id int, value string, host string", rows))
    methods = {r["method"] for r in plans.portal_requests(spark, SF).collect()}
    assert {m for m in methods if not m.endswith(":html")} == {f"portal:ajax:tabPage:{n}" for n in range(2, 6)}


def test_pagination_plan_all(spark):
    got = {(r["source_url"], r["page"]) for r in plans.pagination_plan_all(spark, SF).collect()}
    assert {p for _, p in got} == {2, 3, 4}


def _series(spark, *claims):
    rows = [("h.example", f"http://h.example/{n}", f"https://uniapp.boyuancb.com/api/SiteWebApi/GetBackIssueBrowsing?s={n}", post, body) for n, (post, body) in enumerate(claims)]
    return plans.with_site(spark.createDataFrame(rows, "host string, source_url string, url string, post_body string, body string"))


def test_pagination_of_long_and_odd_claims(spark):
    """J18: no claim is too long, and what is no claim plans nothing."""
    rows = _series(spark, ('{"s":1}', '{"totalpage":1500000}'), ('{"s":2,"curr":9999}', '{"totalpage":10001}'), ('{"s":3}', '{"totalpage":"x"}'), ("no json", "{}"), (None, None), ('{"s":4,"curr":7}', '{"totalpage":7}'))
    got = expand.pagination_plan(rows).groupBy("source_url").agg(F.count("*").alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.count_distinct("page").alias("d")).collect()
    assert {tuple(r) for r in got} == {("http://h.example/0", 1_499_999, 2, 1_500_000, 1_499_999), ("http://h.example/1", 2, 10_000, 10_001, 2)}
    assert expand.pagination_plan(_series(spark, ("{}", '{"totalpage":2147483647}')), 3).count() == 3


def test_expected_categories(spark):
    """G1, JN4: by the method that found a page, by its kind, and English articles that the English start page names."""
    at = "http://j.ajcass.com"
    rows = [
        (f"{at}/#/search?year=1", "api:GetYearVolumeTree:search", f"{at}/", "j.ajcass.com"),
        (f"{at}/#/search?year=2", "dom", f"{at}/", "j.ajcass.com"),
        (f"{at}/#/issueDetail?contentId=1", None, f"{at}/", "j.ajcass.com"),
        (f"{at}/#/detail?id=1", "dom", f"{at}/", "j.ajcass.com"),
        (f"{at}/#/enIssue?contentId=1", "dom", f"{at}/#/enIndex", "j.ajcass.com"),
        (f"{at}/#/enIssue?contentId=2", "dom", f"{at}/", "j.ajcass.com"),
        (f"{at}/#/enIssue?contentId=3", "api:GetIssueSimpleSearch:enIssue", f"{at}/", "j.ajcass.com"),
    ]
    raw = plans.with_site(spark.createDataFrame(rows, "raw_url string, method string, source_url string, host string")).withColumns({"depth": F.lit(1), "pos": F.lit(0)})
    got = {(r["category"], r["url"].removeprefix(f"{at}/#/")) for r in graph.expected(graph.resolved(raw)).collect()}
    assert got == {("issue_search", "search?year=1"), ("issue_detail", "issueDetail?contentId=1"), ("static_detail", "detail?id=1"), ("en_issue", "enIssue?contentId=1"), ("en_issue", "enIssue?contentId=3")}


def test_classic_expansion_counts_captured_pages(spark):
    at = lambda p: f"http://gggl.cbpt.cnki.net/WKB/WKList.aspx?p={p}"
    host = "gggl.cbpt.cnki.net"
    start = plans.with_site(spark.createDataFrame([(at("root"), at(0), host)], "root string, url string, host string"))
    listed = "".join(f"<a href='WKList.aspx?p={p}'>" for p in range(1, 301))
    rows = [(at(0), listed, host), (at(300), "<a href='WKList.aspx?p=301'>", host), (at(301), "", host)]
    captured = plans.with_site(spark.createDataFrame(rows, "source_url string, html string, host string"))
    got = {(r["url"], r["depth"]) for r in graph.classic_expansion(start, captured).collect()}
    assert got == {(at(0), 0), (at(300), 1), (at(301), 2)}
    assert graph.classic_expansion(start, captured, 2).count() == 2


def test_merged_nodes_and_in_flight(spark):
    schema = "site_key string, url string, same_site boolean, queueable boolean, first_depth int, first_source string, first_method string, seen_count long, page_kind string, should_visit boolean"
    known = spark.createDataFrame([("s", "u", True, True, 3, "a", "dom", 2, "page", True)], schema)
    new = spark.createDataFrame([("s", "u", True, False, 1, "b", "seed", 5, "resource", False), ("s", "v", True, True, 2, "c", "dom", 1, "page", True)], schema)
    got = {r["url"]: (r["first_depth"], r["first_source"], r["seen_count"], r["queueable"]) for r in graph.merged_nodes(known, new).collect()}
    assert got == {"u": (1, "a", 7, False), "v": (2, "c", 1, True)}
    items = "site_key string, url string, depth int, attempts int"
    both = graph.in_flight(spark.createDataFrame([("s", "u", 1, 0), ("s", "w", 1, 0)], items), spark.createDataFrame([("s", "u", 2, 1)], items))
    assert {(r["url"], r["depth"]) for r in both.collect()} == {("u", 2), ("w", 1)}


def test_seed_file_and_configuration(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("﻿https://b.example/x\n# note\n\nb.example\nb.example\nftp://no/\n", encoding="utf-8")
    rows = inputs.seeds(inputs.seed_lines(spark, str(tmp_path / "seeds.txt")).withColumn("n", F.monotonically_increasing_id()))
    assert [r["url"] for r in rows.orderBy("n").collect()] == ["https://b.example/x", "https://b.example/", "https://b.example/"]
    site = inputs.sites(rows, "n").first()
    assert (site["site_key"], site["site_origin"], site["site_folder"], site["seed_urls"]) == ("b.example", "https://b.example", "b_example", ["https://b.example/", "https://b.example/x"])
    config = inputs.RunConfig.from_text('﻿{"max_pages_per_site": -4, "visit_leaf_pages": true, "unknown": 1}')
    assert config.max_pages_per_site == 0 and config.visit_leaf_pages and config.transient_page_retry_limit == 1


def test_sinks(spark, found, tmp_path):
    nodes, edges = graph.nodes(found), graph.edges(found)
    folder = str(tmp_path)
    outputs.write_nodes(nodes, folder)
    outputs.write_edges(edges, folder)
    outputs.write_url_lists(nodes, folder)
    read = spark.read.option("header", True).csv(f"{folder}/nodes_csv")
    assert read.columns == graph.NODE and {r[0] for r in read.select("same_site").distinct().collect()} <= {"True", "False"}
    assert [r["url"] for r in spark.read.json(f"{folder}/nodes_jsonl").collect()] == sorted(r["url"] for r in nodes.collect())
    assert spark.read.json(f"{folder}/edges_jsonl").count() == edges.count()
    lists = {n: spark.read.text(f"{folder}/{n}").count() for n in ("all_discovered_urls", "same_site_urls", "external_or_non_queueable_urls")}
    assert lists["all_discovered_urls"] == nodes.count() and lists["external_or_non_queueable_urls"] == nodes.filter("not queueable").count()
    links, summary = plans.global_links(spark, SF), plans.sites_summary(spark, SF)
    outputs.write_global(links, summary, plans.batch_summary(spark, SF), folder)
    assert len(spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/all_links_tsv").columns) == 7
    assert len(spark.read.option("header", True).csv(f"{folder}/all_links_csv").columns) == 8
    outputs.write_visits(plans.visit_log(spark, SF).selectExpr("requested_url", "requested_url as final_url", "1 as depth", "'page' as page_kind", "proxy", "'' as title", "ok", "error", "0 as discoveries", "started_at", "finished_at", "duration_ms"), folder)
    assert spark.read.json(f"{folder}/visits_jsonl").columns == sorted(outputs.VISIT)
    outputs.write_seeds(spark.createDataFrame([("a",)], "url string"), folder)
    outputs.write_error("s", spark.createDataFrame([("boom",)], "error string"), folder)
    assert spark.read.text(f"{folder}/s/run_error").first()[0] == "boom"


def test_feed_reports_each_url_once(spark, tmp_path):
    pages = plans.pages(spark, SF).select(*extract.SITE, "source_url", "html")
    pages.union(pages.limit(5)).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = feed.start_feed(feed.page_stream(spark, str(tmp_path / "in"), pages.schema), str(tmp_path / "checkpoint"), feed.tsv_sink(str(tmp_path / "out")))
    stream.awaitTermination()
    rows = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out"))
    assert rows.columns[:7] == outputs.FEED
    assert rows.count() == feed.new_nodes(pages).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain_leaves(value, at=()):
    """(path, kind, value) of what holds nothing else, keys in order."""
    import json

    if value and isinstance(value, dict | list):
        members = sorted(value.items()) if isinstance(value, dict) else enumerate(value)
        return [leaf for k, v in members for leaf in plain_leaves(v, (*at, str(k)))]
    kind = {dict: "object", list: "array", bool: "boolean", type(None): "null", str: "string"}.get(type(value), "number")
    return [(at, kind, value if kind == "string" else json.dumps(value))]


def test_json_walk(spark):
    """X4, G6: every value of texts of any shape and depth, in order."""
    import json

    from linkloom.operators import json_tree

    rng = random.Random(1)

    def made(depth):
        kind = rng.choice(["object", "array", "leaf"]) if depth else "leaf"
        if kind == "leaf":
            return rng.choice([None, True, False, 7, -3, "", "x", '{"a": "no object"}', "漢", "a/b", {}, []])
        members = [made(depth - 1) for _ in range(rng.randrange(4))]
        return members if kind == "array" else {rng.choice("abcdé") + str(n): m for n, m in enumerate(members)}

    values = [made(6) for _ in range(150)]
    for depth in (1, 4, 60):
        values.append("deep")
        for _ in range(depth):
            values[-1] = {"k": [values[-1], depth]}
    rows = spark.createDataFrame([(n, json.dumps(v), "x") for n, v in enumerate(values)], "n int, body string, v string").repartition(3)
    got = {}
    for r in json_tree.leaves(rows, "body", ["n"]).orderBy("n", "at").collect():
        got.setdefault(r["n"], []).append((tuple(r["path"]), r["kind"], r["value"]))
    assert [got[n] for n in range(len(values))] == [plain_leaves(v) for v in values]
    odd = spark.createDataFrame([(1, '{"a": "one", "a": "two"}'), (2, '{"a": "one"'), (3, None), (4, ""), (5, "[" * 5000 + "]" * 5000), (6, '"s"'), (6, '"s"')], "n int, body string")
    assert [(r["n"], r["value"]) for r in json_tree.strings(odd, "body", ["n"]).orderBy("n").collect()] == [(1, "two"), (6, "s"), (6, "s")]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    assert json_tree.leaves(odd.limit(0), "body", ["n"]).count() == 0


def test_tree_items(spark):
    """J5, G6: items of all channels, depth first, and none of answers of another shape."""
    import json

    from linkloom.operators import json_tree

    nested = {"data": {"channels": [{"channels": [{"issueInfoList": [{"id": 2}]}, {"issueInfoList": []}], "issueInfoList": [{"id": 1}, "x"]}, {"issueInfoList": [{"id": 3}]}]}}
    deep = {"issueInfoList": [{"id": 9}]}
    for _ in range(30):
        deep = {"channels": [deep]}
    bodies = ['{"data": {"channels": ["x"]}}', '{"data": [1]}', '{"data": {"channels": {"a": {"issueInfoList": [1]}}}}', "[1]", "3", "", None, "[" * 100_000, "{", json.dumps(nested), json.dumps({"data": {"channels": [deep]}})]
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {}
    for r in json_tree.tree_items(rows, "body", ["n"], "data.channels", "channels", "issueInfoList").orderBy("n", "at").collect():
        got.setdefault(r["n"], []).append(r["item"])
    assert got == {9: ['{"id":1}', '"x"', '{"id":2}', '{"id":3}'], 10: ['{"id":9}']}
