"""Every operator as a query over a folder of tables. The SQL beside it is in plans.sql; small made-up inputs are in plans.fixtures."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import classify, rules, urls
from ..operators import expand, extract, graph, json_tree, order, responses, rollup, state
from ..sources import inputs, outputs
from ..streaming import feed
from . import answers, captured as captures, fixtures

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.captured_pages(spark, sf_dir)


def raw_links(captured: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return extract.links_of_pages(captured, keep=keep).withColumns({"depth": F.lit(1), "method": F.lit("dom")})


def found(spark: SparkSession, sf_dir: str, aggressive: bool = True) -> DataFrame:
    """Resolved links of all pages, as a table: extracting and normalising is the dear part, and queries read it more than once."""
    return graph.written(graph.resolved(raw_links(pages(spark, sf_dir)), aggressive=aggressive))


def with_site(df: DataFrame, host: str = "host") -> DataFrame:
    """df with the columns of a made-up site whose origin is http://host."""
    h = F.col(host)
    return df.withColumns({"site_key": h, "site_host": h, "site_origin": F.concat(F.lit("http://"), h), "site_family": urls.site_family(h)})


# --- sites and URLs ------------------------------------------------------------------------------------------------


@query
def site_counts(spark, sf_dir):
    f = found(spark, sf_dir)
    return rollup.site_counts(graph.nodes(f), graph.edges(f))


@query
def sites(spark, sf_dir):
    rows = inputs.seeds(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("line")))
    return inputs.sites(rows, "page_id").withColumn("seed_urls", F.array_join("seed_urls", " "))


@query
def site_folder(spark, sf_dir):
    return pages(spark, sf_dir).select("site_key", urls.site_folder(F.col("site_key")).alias("site_folder")).distinct()


@query
def url_normalize(spark, sf_dir):
    return urls.normalize(pages(spark, sf_dir), "source_url", None, "url").select("page_id", "url")


@query
def url_normalize_cases(spark, sf_dir):
    return urls.normalize(with_site(fixtures.cases(spark, sf_dir, "raw_urls")), "raw", "base", "url").select("page_id", "id", "url")


@query
def url_sort_query(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), urls.part(F.col("url"), 4).alias("query"))
    made = fixtures.cases(spark, sf_dir, "queries").select((-100 * F.col("page_id") - F.col("id")).alias("id"), "query")
    return own.unionByName(made).select("id", urls.sort_query(F.col("query")).alias("sorted"))


@query
def seed_normalize(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").alias("line"))
    return urls.normalize_seed(own, "line").select("id", "url", F.col("url_site_key").alias("site_key"))


@query
def seed_normalize_cases(spark, sf_dir):
    made = fixtures.cases(spark, sf_dir, "seeds").select((100 * F.col("page_id") + F.col("id")).alias("id"), "line")
    return urls.normalize_seed(made, "line").select("id", "url", F.col("url_site_key").alias("site_key"))


@query
def title_truncate(spark, sf_dir):
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.truncated(title, 40).alias("title"))


# --- links ---------------------------------------------------------------------------------------------------------


@query
def links_extract(spark, sf_dir):
    return raw_links(pages(spark, sf_dir)).groupBy("source_url", "raw_url", "raw_kind").agg(F.count("*").alias("n"))


@query
def link_clean(spark, sf_dir):
    attrs = extract.attributes(pages(spark, sf_dir).select("page_id", "html"))
    return attrs.select("page_id", "value", extract.clean_link(F.col("value")).alias("cleaned")).distinct()


@query
def links_same_site(spark, sf_dir):
    return found(spark, sf_dir).select("source_url", "raw_url", "url", "same_site")


@query
def links_queueable(spark, sf_dir):
    return found(spark, sf_dir).select("source_url", "raw_url", "queueable")


@query
def should_visit(spark, sf_dir):
    return found(spark, sf_dir, aggressive=False).select("source_url", "raw_url", "should_visit")


@query
def unsafe_urls(spark, sf_dir):
    cases = urls.normalize(with_site(fixtures.cases(spark, sf_dir, "unsafe")), "raw", None, "url")
    return cases.select("page_id", "id", classify.unsafe_action(F.col("url_path"), F.col("url_query")).alias("unsafe"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = urls.normalize(with_site(fixtures.cases(spark, sf_dir, "kinds")), "raw", None, "url")
    return cases.withColumns({"kind": classify.page_kind("url"), "queueable": classify.queueable("url")})


@query
def page_kind(spark, sf_dir):
    return _kinds(spark, sf_dir).select("page_id", "id", "kind")


@query
def workload_class(spark, sf_dir):
    k = _kinds(spark, sf_dir)
    return k.select("page_id", "id", classify.workload_class("url", F.col("kind"), F.col("queueable")).alias("gentle"), classify.workload_class("url", F.col("kind"), F.col("queueable"), True).alias("aggressive"))


@query
def visit_rules(spark, sf_dir):
    k = _kinds(spark, sf_dir)
    visit = lambda a, v: classify.should_visit(F.col("kind"), F.col("queueable"), a, v)
    return k.select("page_id", "id", "queueable", visit(True, False).alias("aggressive"), visit(False, False).alias("gentle"), visit(False, True).alias("with_leaves"))


@query
def method_priority(spark, sf_dir):
    return fixtures.cases(spark, sf_dir, "methods").select("page_id", "method", classify.method_rank(F.col("method")).alias("rank"))


@query
def prioritized_links(spark, sf_dir):
    f = found(spark, sf_dir, aggressive=False)
    order = Window.partitionBy("source_url").orderBy(*classify.priority("url", F.col("page_kind"), F.col("method")), "raw_url")
    return f.select("source_url", "raw_url", "url", F.row_number().over(order).alias("place"))


# --- the graph -----------------------------------------------------------------------------------------------------


@query
def edges(spark, sf_dir):
    return graph.edges(found(spark, sf_dir)).select("site_key", *graph.EDGE)


@query
def nodes(spark, sf_dir):
    return graph.nodes(found(spark, sf_dir)).select("site_key", *graph.NODE)


@query
def page_kind_histogram(spark, sf_dir):
    return rollup.page_kinds(graph.nodes(found(spark, sf_dir)))


def visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.normalize(pages(spark, sf_dir), "source_url", None, "url").select("site_key", "url").distinct()


@query
def frontier_next(spark, sf_dir):
    return graph.frontier_next(found(spark, sf_dir), visited(spark, sf_dir))


@query
def frontier_limit(spark, sf_dir):
    return graph.limited(frontier_next(spark, sf_dir), 100)


@query
def retry_candidates(spark, sf_dir):
    """Failed visits that may be tried again, with the attempts so far."""
    tried = rollup.visit_attempts(visit_log(spark, sf_dir)).filter("not ok").select("requested_url", F.col("attempt").alias("attempts"))
    return graph.retryable(tried)


@query
def bfs_reachability(spark, sf_dir):
    return graph.bfs(*key_graph(spark, sf_dir))


def key_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A cyclic graph over keys: customer, order, supplier, nation, region and its nations; and all customers to start from."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    links = [
        read("orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst")),
        read("lineitem").select(node("o", "l_orderkey").alias("src"), node("s", "l_suppkey").alias("dst")),
        read("supplier").select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst")),
        read("nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")),
        read("nation").select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst")),
    ]
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return every.distinct(), read("customer").select(node("c", "c_custkey").alias("node"))


@query
def crawl_levels(spark, sf_dir):
    """Nodes of a crawl of captured pages, by the level that visited them."""
    captured = pages(spark, sf_dir)
    starts = urls.normalize(captured, "source_url", None, "url").select(*extract.SITE, "url").distinct()
    texts = urls.normalize(captured, "source_url", None, "url").drop("source_url").withColumnRenamed("url", "source_url").select("site_key", "source_url", "html")
    return graph.crawl(texts, starts)[0].groupBy("depth").agg(F.count("*").alias("n"))


# --- coverage and roll-up ------------------------------------------------------------------------------------------


def _even_odd(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of pages with even ids, links of the others as expected URLs, and visited pages with even ids."""
    captured = pages(spark, sf_dir)
    even, odd = (captured.filter(F.col("page_id") % 2 == n) for n in (0, 1))
    known = graph.written(graph.nodes(graph.resolved(raw_links(even))))
    others = graph.written(graph.resolved(raw_links(odd)))
    wanted = others.filter("queueable").select("site_key", F.lit("linked").alias("category"), "url").distinct()
    seen = urls.normalize(even, "source_url", None, "url").select("site_key", "url").distinct()
    return known, wanted, seen


@query
def coverage_missing(spark, sf_dir):
    known, wanted, _ = _even_odd(spark, sf_dir)
    return rollup.missing(wanted, known)


@query
def coverage_samples(spark, sf_dir):
    known, wanted, _ = _even_odd(spark, sf_dir)
    lacks = rollup.sampled(rollup.missing(wanted, known), ["site_key"], "url")
    return lacks.withColumn("sample", F.array_join("sample", " "))


@query
def verification(spark, sf_dir):
    known, wanted, seen = _even_odd(spark, sf_dir)
    waiting = rollup.unvisited(known, seen)
    return rollup.verification(wanted, known, seen, waiting).withColumn("sample", F.array_join("sample", " "))


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of all pages, and as visited the pages that have a visit without error."""
    captured = pages(spark, sf_dir)
    done = visit_log(spark, sf_dir).filter("ok").select("page_id").distinct()
    seen = urls.normalize(captured.join(done, "page_id", "left_semi"), "source_url", None, "url").select("site_key", "url").distinct()
    return graph.written(graph.nodes(found(spark, sf_dir))), graph.written(seen)


@query
def unvisited_queueable(spark, sf_dir):
    return rollup.unvisited(*_saved(spark, sf_dir))


@query
def resume_requeue(spark, sf_dir):
    known, seen = _saved(spark, sf_dir)
    return state.requeued(known, seen, seen.limit(0))


@query
def resume_equivalence(spark, sf_dir):
    """Rows of a state that was saved in two deltas, the second without a frontier, and resumed."""
    known, seen = _saved(spark, sf_dir)
    folder = f"{graph.scratch(spark)}/state-{uuid.uuid4().hex}"
    state.save(spark, folder, {"nodes": known.filter("queueable"), "visited": seen, "frontier": state.requeued(known, seen, seen.limit(0))})
    state.save(spark, folder, {"nodes": known.filter("not queueable")}, completed=True)
    back = state.resume(spark, folder, pages(spark, sf_dir).select(*extract.SITE).distinct())
    rows = lambda name: back[name].select(F.lit(name).alias("part"), "site_key", "url")
    return rows("nodes").unionByName(rows("visited")).unionByName(rows("frontier"))


def _resumed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A state saved in three deltas that share nodes, compacted in between, and resumed with all pages as seeds.

    The third of the pages with page_id % 3 = n is found by delta n: an address that two thirds have captured is found by
    both, each with the links of its own captures, and counts in both. Pages with a visit without error are done: each
    delta's own wait first, the next one takes those that are done from the frontier. The last delta leaves its own in flight.
    """
    captured = pages(spark, sf_dir)
    done = visit_log(spark, sf_dir).filter("ok").select("page_id").distinct().withColumn("done", F.lit(True))
    own = urls.normalize(captured.join(done, "page_id", "left"), "source_url", None, "url")
    own = graph.written(own.select("page_id", *extract.SITE, "url", F.coalesce("done", F.lit(False)).alias("done")))
    thirds = raw_links(captured.withColumn("third", F.col("page_id") % 3), ("third",))
    all_found = graph.written(graph.resolved(thirds, keep=("third",)))
    folder = f"{graph.scratch(spark)}/state-{uuid.uuid4().hex}"
    for n in range(3):
        third = own.filter(F.col("page_id") % 3 == n)
        queue = third.groupBy("site_key", "url").agg(F.lit(0).alias("depth"), F.min("url").alias("discovered_from"), F.lit("seed").alias("discovery_method"), F.lit(n).alias("attempts"))
        tables = {"nodes": graph.nodes(all_found.filter(F.col("third") == n)), "visited": third.filter("done").select("site_key", "url").distinct(), "in_flight" if n == 2 else "frontier": queue}
        state.save(spark, folder, tables, removed={"frontier": own.filter((F.col("page_id") % 3 == n - 1) & F.col("done"))} if n else None)
        if n == 1:
            state.compact(spark, folder)
            state.clear_out(spark, folder)
    sites = captured.select(*extract.SITE).distinct()
    return state.resume(spark, folder, sites, own.select("site_key", "url").distinct())


@query
def resumed_nodes(spark, sf_dir):
    return _resumed(spark, sf_dir)["nodes"].select("site_key", "url", "seen_count", "first_depth", "queueable", "page_kind")


@query
def resumed_frontier(spark, sf_dir):
    return _resumed(spark, sf_dir)["frontier"]


@query
def run_plan(spark, sf_dir):
    """What is to be done for each site, where states know most seeds, and some sites are done, or done under an older policy."""
    rows = inputs.seeds(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("line")))
    known = rows.filter("page_id % 4 < 3").groupBy("site_key").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    saved = known.select("site_key", (F.col("n") % 4 < 3).alias("completed"), (rules.POLICY_VERSION - (F.col("first") % 5 == 0).cast("int")).alias("policy_version"), F.lit(False).alias("visit_leaf_pages"))
    return state.run_plan(rows, saved, rows.filter("page_id % 4 < 3"))


@query
def new_seeds(spark, sf_dir):
    rows = inputs.seeds(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("line")))
    return state.new_seeds(rows, rows.filter("page_id % 2 = 0"))


@query
def nodes_merged(spark, sf_dir):
    """Nodes of even pages, and then those of the others added: an address that both have captured counts in both."""
    captured = pages(spark, sf_dir)
    half = lambda n: graph.nodes(graph.resolved(raw_links(captured.filter(F.col("page_id") % 2 == n))))
    return graph.merged_nodes(half(0), half(1)).select("site_key", "url", "seen_count", "first_depth")


@query
def global_urls(spark, sf_dir):
    return rollup.global_urls(graph.nodes(found(spark, sf_dir)))


@query
def global_links(spark, sf_dir):
    site = pages(spark, sf_dir).select("site_key", "site_host").distinct()
    return rollup.global_links(site, graph.nodes(found(spark, sf_dir)))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir)
    n = graph.nodes(f)
    log = visit_log(spark, sf_dir).drop("site_key").join(pages(spark, sf_dir).select(F.col("page_id"), "site_key"), "page_id")
    counts = rollup.site_counts(n, graph.edges(f), log)
    site = pages(spark, sf_dir).select("site_key", "site_host").distinct()
    waiting = n.filter("seen_count > 2 and should_visit")
    return rollup.sites_summary(counts, rollup.completion(site, waiting))


@query
def sites_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def batch_summary(spark, sf_dir):
    return rollup.batch_summary(_summary(spark, sf_dir))


@query
def saved_sites(spark, sf_dir):
    """Sites as their own folders have them, written and read back: the first one lost its nodes, the last one's have lines that are no JSON."""
    f = found(spark, sf_dir)
    site = pages(spark, sf_dir).select("site_key", "site_host").distinct()
    n = graph.written(graph.nodes(f).withColumn("site_folder", urls.site_folder(F.col("site_key"))))
    counts = rollup.site_counts(n, graph.edges(f), visit_log(spark, sf_dir).drop("site_key").join(pages(spark, sf_dir).select("page_id", "site_key"), "page_id"))
    summary = graph.written(rollup.sites_summary(counts, rollup.completion(site, n.filter("seen_count > 2 and should_visit"))))
    ends = summary.agg(F.min("site_folder").alias("first"), F.max("site_folder").alias("last"))
    root = f"{graph.scratch(spark)}/sites-{uuid.uuid4().hex}"
    outputs.write_sites(n.join(F.broadcast(ends), F.col("site_folder") == F.col("first"), "left_anti"), summary, root)
    lines = ends.select("last", F.explode(F.array(F.lit('{"url": "cut off'), F.lit(""), F.lit("[1]"))).alias("value"))
    lines.withColumnRenamed("last", "site_folder").write.mode("append").partitionBy("site_folder").text(f"{root}/nodes.jsonl")
    return rollup.saved_report(inputs.saved_summaries(spark, root), inputs.saved_nodes(spark, root))


# --- visits --------------------------------------------------------------------------------------------------------


def visit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits made of events: an event visits the page with the number of its user, and an error event fails."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    started = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    failed = F.col("event_type") == "error"
    why = F.when(F.col("event_id") % 3 == 0, "Error: Target closed").when(F.col("event_id") % 3 == 1, "Timeout 30000ms exceeded").otherwise("Protocol Error (x)")
    return e.select(
        F.col("event_id").alias("visit_id"), F.col("user_id").alias("page_id"), F.lit("events").alias("site_key"), F.concat(F.lit("http://e/"), F.col("user_id").cast("string")).alias("requested_url"),
        F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("proxy"), (~failed).alias("ok"), F.when(failed, why).otherwise("").alias("error"),
        started.alias("started_at"), (started + F.col("value") / 8).alias("finished_at"), urls.duration_ms(F.lit(0.0), F.round(F.col("value") * 8) / 64).alias("duration_ms"),
    )


@query
def visits_transport_errors(spark, sf_dir):
    return visit_log(spark, sf_dir).filter(classify.transport_error(F.col("error"))).select("visit_id", "error")


@query
def visits_by_proxy(spark, sf_dir):
    return rollup.visits_by_proxy(visit_log(spark, sf_dir))


@query
def visit_attempts(spark, sf_dir):
    return rollup.visit_attempts(visit_log(spark, sf_dir)).select("visit_id", "attempt")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    started = F.unix_micros(F.col("ts").cast("timestamp"))
    log = e.select(F.lit("events").alias("site_key"), F.col("event_id").alias("visit_id"), started.alias("started"), (started + F.floor(F.col("value") * 125_000)).alias("finished"))
    return order.segments(log, inputs.RunConfig().checkpoint_every_pages, 1_800_000_000)


@query
def save_segments(spark, sf_dir):
    """Which visits a save of the state has in it, where it is due after 10 pages or half an hour."""
    return _segments(spark, sf_dir).drop("site_key")


@query
def run_ticks(spark, sf_dir):
    """What each report of the run adds: visits since the last one, and how they went."""
    return rollup.ticks(visit_log(spark, sf_dir), _segments(spark, sf_dir)).drop("site_key")


@query
def worker_totals(spark, sf_dir):
    """Workers that have every 64th page, of which one fails if its last visit lost the browser, and has no code without visits."""
    log = visit_log(spark, sf_dir).select("page_id", "visit_id", classify.transport_error(F.col("error")).alias("lost"))
    shard = F.col("page_id") % 64
    sites = pages(spark, sf_dir).groupBy(shard.alias("worker")).agg(F.count_distinct("site_key").alias("sites"))
    went = log.groupBy(shard.alias("worker")).agg(F.max_by("lost", "visit_id").cast("int").alias("return_code"))
    return rollup.worker_totals(sites.join(went, "worker", "left"))


def _deque(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What events do to a frontier: purchases and sign-ups take its first page, errors put theirs in front, others put theirs at the end."""
    kind = F.col("event_type")
    op = F.when(kind.isin("purchase", "signup"), order.TAKE).when(kind == "error", order.FRONT).otherwise(order.BACK)
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("events").alias("site_key"), "ts", "event_id", op.alias("op"), F.struct("event_id", "user_id").alias("page"))
    return order.replayed(log, ["site_key"], ["ts", "event_id"], "page")


@query
def deque_taken(spark, sf_dir):
    return _deque(spark, sf_dir)[0].select("event_id", F.col("item.event_id").alias("put_by"), F.col("item.user_id").alias("page_id"), "came")


@query
def deque_waiting(spark, sf_dir):
    left = _deque(spark, sf_dir)[1].select("site_key", "side", "turn", F.col("item.event_id").alias("put_by"), F.col("item.user_id").alias("page_id"))
    return order.numbered(left, ["site_key"], ["side", "turn"]).select("place", "put_by", "page_id", "side")


@query
def dispatch_order(spark, sf_dir):
    """The order in which each site's pages are taken if the best one waiting is always next, from the captured ones on."""
    f = found(spark, sf_dir, aggressive=False)
    own = urls.normalize(pages(spark, sf_dir), "source_url", None, "url")
    starts = own.select("site_key", "url").distinct().withColumn("start", F.lit(True))
    known = f.filter("should_visit").groupBy("site_key", "url").agg(F.min(F.struct(*classify.priority("url", F.col("page_kind"), F.col("method"))[:2])).alias("kind"), F.min("url_path").alias("url_path"))
    items = known.join(starts, ["site_key", "url"], "left").withColumn("start", F.coalesce("start", F.lit(False)))
    links = f.filter("should_visit").join(own.select("site_key", "source_url", F.col("url").alias("src")), ["site_key", "source_url"]).select("site_key", "src", F.col("url").alias("dst"))
    best = ["kind", F.when(F.col("start"), 0).otherwise(1), F.size(urls.segments(F.col("url_path"))), "url"]
    return order.best_first(items, links, ["site_key"], "url", best)


# --- scripts, calls and answers ------------------------------------------------------------------------------------


@query
def issue_list_synthesis(spark, sf_dir):
    return extract.issue_list_links(with_site(fixtures.cases(spark, sf_dir, "issue_pages"))).select("source_url", "issue_url")


@query
def onclick_urls(spark, sf_dir):
    cases = with_site(fixtures.cases(spark, sf_dir, "onclicks"))
    return cases.select("page_id", "id", extract.onclick_url(F.col("value")).alias("url"), extract.onclick_action(F.col("value"))["method"].alias("ajax"))


@query
def portal_requests(spark, sf_dir):
    cases = with_site(fixtures.cases(spark, sf_dir, "onclicks"))
    page = cases.groupBy(*extract.SITE).agg(F.concat_ws("", F.array_sort(F.collect_list(F.concat(F.lit('<a onclick="'), F.replace("value", F.lit('"'), F.lit("'")), F.lit('">'))))).alias("html")).withColumn("source_url", F.concat("site_origin", F.lit("/portal")))
    asked = extract.portal_requests(page, inputs.RunConfig().max_cbpt_portal_ajax_requests_per_page)
    answers = asked.select("key", F.lit('<a href="/portal/x/next">').alias("body"))
    return extract.expand_portal_requests(asked, answers).select("source_url", "raw_url", "method")


@query
def script_routes(spark, sf_dir):
    return extract.script_routes(with_site(fixtures.cases(spark, sf_dir, "scripts"))).select("url", "raw_url", "method")


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.known_routes(answers.routes(spark, sf_dir))


@query
def json_links(spark, sf_dir):
    """Discoveries of all answers, by every expander."""
    return expand.links_of_responses(answers.answers(spark, sf_dir), _routes(spark, sf_dir)).select("source_url", "raw_url", "method").distinct()


@query
def json_items(spark, sf_dir):
    rows = answers.answers(spark, sf_dir).filter("url like '%GetIssueinfoList%'").join(_routes(spark, sf_dir), "site_key", "left")
    return expand.issue_items(expand._items(rows, "api:GetIssueinfoList:issueDetail")).select("source_url", "raw_url", "method")


@query
def year_issue_tree(spark, sf_dir):
    rows = answers.answers(spark, sf_dir).filter("url like '%GetYearVolumeTree%'").join(_routes(spark, sf_dir), "site_key", "left")
    return expand.year_volumes(rows).select("source_url", "raw_url", "method")


@query
def pagination_plan(spark, sf_dir):
    """The next two pages of each series, as a limit on a series asks for."""
    return expand.pagination_plan(answers.answers(spark, sf_dir), 2).select("source_url", "url", "page")


@query
def pagination_plan_all(spark, sf_dir):
    """All further pages."""
    return expand.pagination_plan(answers.answers(spark, sf_dir)).select("source_url", "url", "page")


@query
def answer_coverage(spark, sf_dir):
    """What answers make expected, by category, against the nodes that a state has which was saved before the answers on
    current issues and searches came; leaves are left out, so they are no open pages."""
    links = graph.written(expand.links_of_responses(answers.answers(spark, sf_dir), _routes(spark, sf_dir)))
    f = graph.written(graph.resolved(links.withColumns({"depth": F.lit(1), "pos": F.lit(0)}), aggressive=False))
    late = F.col("method").rlike("^api:(?:GetCurrentPeriod|GetIssueNormalSearch|GetIssueSimpleSearch)")
    known = graph.written(graph.nodes(f.filter(~late)))
    seen = f.select("site_key", F.col("source_url").alias("url")).distinct()
    return rollup.verification(graph.expected(f), known, seen, rollup.unvisited(known, seen)).withColumn("sample", F.array_join("sample", " "))


@query
def response_routing(spark, sf_dir):
    """Which responses are kept, and what they are read as."""
    return responses.routed(captures.responses(spark, sf_dir)).select("source_url", "url", F.lower("resource_type").alias("resource_type"), "route")


@query
def response_links(spark, sf_dir):
    """Links of all responses, answers expanded by the routes that the sites' own scripts name."""
    return responses.links_of_captured(captures.responses(spark, sf_dir)).select("source_url", "raw_url", "method").distinct()


@query
def classic_expansion(spark, sf_dir):
    start = with_site(fixtures.cases(spark, sf_dir, "classic_starts"))
    captured = with_site(fixtures.cases(spark, sf_dir, "classic_pages"))
    return graph.classic_expansion(start, captured).select("root", "url", "depth")


@query
def json_walk(spark, sf_dir):
    """Every value of answers that are nested as deep as their event's number says, around what the event itself has."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    depth = (F.col("event_id") % 12).cast("int")
    opening = F.concat(F.lit('{"at":"http://e/'), F.col("event_id").cast("string"), F.lit('","in":[null,'))
    body = F.concat(F.repeat(opening, depth), F.coalesce("props", F.lit("{}")), F.repeat(F.lit("]}"), depth))
    found = json_tree.leaves(e.select("event_id", body.alias("body")), "body", ["event_id"])
    return found.select("event_id", F.array_join("path", "/").alias("path"), "kind", "value")


# --- streaming -----------------------------------------------------------------------------------------------------


@query
def new_nodes_feed(spark, sf_dir):
    """The batch form of the feed."""
    return feed.new_nodes(pages(spark, sf_dir))


@query
def new_nodes_stream(spark, sf_dir):
    """The feed itself, over pages that arrive in three slices in order of their address; it is started again for each."""
    folder = f"{graph.scratch(spark)}/feed-{uuid.uuid4().hex}"
    captured = order.numbered(pages(spark, sf_dir).select("page_id", *extract.SITE, "source_url", "html"), [], ["source_url", "page_id"])
    captured = graph.written(captured)
    many = captured.count()
    schema = captured.select(*extract.SITE, "source_url", "html").schema
    for n in range(3):
        arrived = captured.filter((F.col("place") > n * many // 3) & (F.col("place") <= (n + 1) * many // 3))
        arrived.select(*schema.names).write.mode("append").parquet(f"{folder}/in")

        def sink(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

        feed.start_feed(feed.page_stream(spark, f"{folder}/in", schema), f"{folder}/checkpoint", sink).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def queries() -> dict[str, Query]:
    return dict(_all)
