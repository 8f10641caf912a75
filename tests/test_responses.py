"""Routing of responses (S8, P18, P19), reports of runs (A9, A16), attempts at hot URLs (W5), edges in order of discovery (K4)."""

import random

from linkloom.operators import graph, responses, rollup
from linkloom.plans.queries import with_site
from linkloom.sources import outputs

COLUMNS = "host string, source_url string, url string, resource_type string, http_method string, post_body string, content_type string, body string"


def captured(spark, *rows, host="h.example"):
    """Responses of (url, resource type, content type, body) to one page of host."""
    return with_site(spark.createDataFrame([(host, f"http://{host}/", url, kind, "GET", None, content, body) for url, kind, content, body in rows], COLUMNS))


def test_routed(spark):
    rows = captured(
        spark,
        ("http://h.example/a", "XHR", None, None),
        ("http://h.example/b", "other", "application/vnd.x+json", "{}"),
        ("http://h.example/c", "other", "application/json", "{}"),
        ("http://h.example/d.JS", "script", "", "x"),
        ("http://o.example/e", "script", "text/javascript", "x"),
        ("http://h.example/static/e", "script", "text/javascript", "x"),
        ("http://h.example/f.json", "fetch", "text/javascript; application/json", "x"),
        ("http://h.example/g.ZIP", "document", "application/zip", None),
        ("http://h.example/h.xml", None, None, None),
        ("http://h.example/i", "Font", "application/json", "{}"),
        ("mailto:x", "fetch", "application/json", "{}"),
        (None, "fetch", "application/json", "{}"),
    )
    got = {(r["url"], r["route"]) for r in responses.routed(rows).collect()}
    at = lambda path: f"http://h.example/{path}"
    assert got == {(at("a"), ""), (at("c"), "json"), (at("d.JS"), "script"), (at("static/e"), "script"), (at("f.json"), "json"), (at("h.xml"), ""), ("mailto:x", "json")}
    sent = {r["url"] for r in responses.routed(rows, blocking=False).collect()}
    assert sent - {url for url, _ in got} == {at("g.ZIP"), at("i")}  # a font that is JSON matters where it is not blocked
    assert responses.routed(rows.limit(0)).count() == 0


def test_scripts_decide_how_answers_are_read(spark):
    """The form of an article's address is the one that a script of the site names, unless it was known before."""
    answer = ("https://api.ajcass.com/api/x/GetIssueinfoList?id=1", "xhr", "application/json", '{"data":[{"id":7,"year":2001,"issue":2}]}')
    script = lambda host: (f"http://{host}/js/a.js", "script", None, "['/issueDetail']")
    sites = {"j1.ajcass.com": [answer], "j2.ajcass.com": [answer, script("j2.ajcass.com")], "j3.ajcass.com": [answer, script("j3.ajcass.com")]}
    rows = None
    for host, seen in sites.items():
        one = captured(spark, *seen, host=host)
        rows = one if rows is None else rows.unionByName(one)
    known = spark.createDataFrame([("j3.ajcass.com", "/issue"), ("j1.ajcass.com", "/no-route"), ("other", "/issueDetail")], "site_key string, route string")
    got = {(r["site_key"], r["raw_url"].partition("/#")[2]) for r in responses.links_of_captured(rows, known).filter("method like 'api:%'").collect()}
    short, full = "/issue?id=7&issue=2&year=2001", "/issueDetail?contentId=7&issue=2&year=2001"
    assert got == {("j1.ajcass.com", short), ("j2.ajcass.com", full), ("j3.ajcass.com", short)}


def test_attempts_at_hot_and_missing_urls(spark):
    rng = random.Random(5)
    rows = [("s", rng.choice(["hot", "hot", "hot", "", None, "u1"]), float(rng.randrange(50)), 1.0, n) for n in range(2000)]
    visits = spark.createDataFrame(rows, "site_key string, requested_url string, started_at double, finished_at double, visit_id long").repartition(7)
    want, seen = {}, {}
    for _, url, _, _, n in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        want[n] = seen[url] = seen.get(url, 0) + 1
    assert {r["visit_id"]: r["attempt"] for r in rollup.visit_attempts(visits).collect()} == want
    assert rollup.visit_attempts(visits.limit(0)).count() == 0


def test_ticks_and_workers(spark, monkeypatch):
    monkeypatch.setattr("linkloom.operators.order.BLOCK", 3)
    rng = random.Random(6)
    rows = [(site, n, rng.random() < 0.7, n // 4) for site, many in (("a", 41), ("b", 3)) for n in range(many)]
    visits = spark.createDataFrame([r[:3] for r in rows], "site_key string, visit_id long, ok boolean")
    parts = spark.createDataFrame([(site, n, segment) for site, n, _, segment in rows], "site_key string, visit_id long, segment long")
    want = set()
    for site in "ab":
        mine = [(ok, segment) for s, _, ok, segment in rows if s == site]
        for k in range(mine[-1][1] + 1):
            new, all_so_far = [ok for ok, s in mine if s == k], [ok for ok, s in mine if s <= k]
            want.add((site, k, len(new), sum(new), len(new) - sum(new), len(all_so_far), sum(all_so_far)))
    names = ["site_key", "segment", "new_visits", "new_ok", "new_failed", "visits", "ok"]
    assert {tuple(r[c] for c in names) for r in rollup.ticks(visits, parts).collect()} == want
    workers = spark.createDataFrame([(1, 0, 5), (2, None, 3), (3, -9, 2), (4, 1, None)], "worker int, return_code int, sites long")
    assert tuple(rollup.worker_totals(workers).first()) == (4, 3, 10, 5)
    assert tuple(rollup.worker_totals(workers.limit(0)).first()) == (0, 0, 0, 0)


def test_edges_in_order_of_discovery(spark, tmp_path):
    rows = [("h.example", f"http://h.example/{name}", "http://h.example/", "dom", pos) for name, pos in (("a", 9), ("z", 1), ("m", 5), ("z", 7))]
    raw = with_site(spark.createDataFrame(rows, "host string, raw_url string, source_url string, method string, pos int")).selectExpr("*", "1 as depth")
    outputs.write_edges(graph.edges(graph.resolved(raw)), str(tmp_path))
    written = [r["target_url"] for r in spark.read.json(f"{tmp_path}/edges_jsonl").coalesce(1).collect()]
    assert sorted(written) == [f"http://h.example/{name}" for name in "amz"]
    parts = sorted((tmp_path / "edges_jsonl").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert [line.split('"target_url":"http://h.example/')[1][0] for line in lines] == ["z", "m", "a"] and '"pos"' not in lines[0]
