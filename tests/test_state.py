"""Saved state (K10, S4, ST4 to ST9, P16, P17, JN7): a keyed log against plain dictionaries."""

import os
import random

import pytest
from linkloom.functions import rules
from linkloom.operators import state
from linkloom.plans import queries as plans
from pyspark.sql import functions as F

NODE = "site_key string, url string, same_site boolean, queueable boolean, first_depth int, first_source string, first_method string, seen_count long, page_kind string, should_visit boolean"
ITEM = "site_key string, url string, depth int, discovered_from string, discovery_method string, attempts int"


def test_random_deltas_against_a_dictionary(spark, tmp_path):
    """Rows put in and taken out in any order, half of them one key's, compacted now and then."""
    rng = random.Random(4)
    path = str(tmp_path / "s")
    waiting, nodes, edges, visits = {}, {}, {}, []
    for version in range(1, 7):
        delta, gone, found, links = {}, set(), {}, {}
        for _ in range(12):
            key = ("s", "hot" if rng.random() < 0.5 else f"u{rng.randrange(6)}")
            delta[key] = (version, rng.randrange(9))
            if rng.random() < 0.4:
                gone.add(("s", f"u{rng.randrange(6)}"))
            found[key] = (rng.randrange(4), f"from{version}", "dom", rng.randrange(1, 5))
            links.setdefault((*key, "t", "dom"), version)
        put = spark.createDataFrame([(*k, d, "f", "dom", a) for k, (d, a) in delta.items()], ITEM)
        took = spark.createDataFrame([(*k, "other") for k in gone], "site_key string, url string, extra string")
        new = spark.createDataFrame([(*k, True, True, d, s, m, c, f"kind{version}", True) for k, (d, s, m, c) in found.items()], NODE)
        arcs = spark.createDataFrame([(*k, v) for k, v in links.items()], "site_key string, source_url string, target_url string, method string, depth int")
        log = spark.createDataFrame([(version, "same"), (version, "same")], "n int, url string")
        assert state.save(spark, path, {"frontier": put, "nodes": new, "edges": arcs, "visits": log}, removed={"frontier": took}, completed=version == 6) == version + (version > 3)
        waiting = {k: v for k, v in (waiting | delta).items() if k not in gone}
        for k, (d, s, m, c) in found.items():
            old = nodes.get(k)
            nodes[k] = (min(d, old[0]), old[1], old[2] + c, f"kind{version}") if old else (d, s, c, f"kind{version}")
        edges = links | edges
        visits += [(version, "same")] * 2
        if version == 3:
            assert state.compact(spark, path) == 4 and state.clear_out(spark, path) == [1, 2, 3]
            assert sorted(d for d in os.listdir(path) if d.startswith("v=")) == ["v=4"]
            assert state.versions(spark, path) == [4] and state.load(spark, path, "frontier").columns[:2] == ["site_key", "url"]
        rows = {(r["site_key"], r["url"]): (r["depth"], r["attempts"]) for r in state.load(spark, path, "frontier").collect()}
        assert rows == waiting and state.load(spark, path, "frontier").count() == len(waiting)
    got = {(r["site_key"], r["url"]): (r["first_depth"], r["first_source"], r["seen_count"], r["page_kind"]) for r in state.load(spark, path, "nodes").collect()}
    assert got == nodes
    assert {tuple(r)[:4]: r["depth"] for r in state.load(spark, path, "edges").select("site_key", "source_url", "target_url", "method", "depth").collect()} == edges
    assert sorted(tuple(r) for r in state.load(spark, path, "visits").select("n", "url").collect()) == visits
    earlier = state.load(spark, path, "visits", upto=5).count()
    assert earlier == 8 and state.load(spark, path, "visits", upto=1) is None and state.load(spark, path, "seeds") is None


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.createDataFrame([("s", "u")], "site_key string, url string")
    assert state.versions(spark, path) == [] and state.meta(spark, path) == {} and state.load(spark, path, "nodes") is None
    assert state.save(spark, path, {"visited": rows}) == 1
    os.makedirs(f"{path}/v=2/visited")  # a save that did not come to its end
    assert state.versions(spark, path) == [1] and state.load(spark, path, "visited").count() == 1
    assert state.save(spark, path, {"visited": rows.withColumn("url", F.lit("v")), "in_flight": rows}, completed=True, visit_leaf_pages=True) == 2
    assert state.load(spark, path, "visited").count() == 2 and state.load(spark, path, "visited", 1).count() == 1
    assert state.save(spark, path, {"in_flight": rows.withColumn("url", F.lit("w"))}) == 3
    assert [r["url"] for r in state.load(spark, path, "in_flight").collect()] == ["w"]
    with pytest.raises(FileExistsError):
        state._commit(spark, path, {"version": 3})
    saved = state.meta(spark, path, 2)
    assert saved["completed"] and state.matches_policy(saved, True) and not state.matches_policy(saved, False) and not state.matches_policy({"policy_version": 4}, False)


def site(spark, *hosts):
    return plans.with_site(spark.createDataFrame([(h,) for h in hosts], "host string")).drop("host")


def test_resume(spark, tmp_path):
    """One node in three deltas, a page in flight, one done, a lost one, one that is no page, and a new seed."""
    path, at = str(tmp_path / "state"), lambda p: f"http://h/{p}"
    node = lambda p, n: ("h", at(p), False, False, n, at("from"), "dom", 1, "stale", False)
    item = lambda p, a: ("h", at(p), 1, at("from"), "dom", a)
    for n in range(3):
        new = [node("thrice", 3 - n), *[node(p, 1) for p in (["done", "flying"], ["waits", "lost"], ["x.pdf"])[n]]]
        tables = {"nodes": spark.createDataFrame(new, NODE)}
        tables |= [{"frontier": spark.createDataFrame([item("done", 0), item("flying", 0), item("both", 0)], ITEM)}, {"frontier": spark.createDataFrame([item("waits", 0), item("x.pdf", 0)], ITEM)}, {"visited": spark.createDataFrame([("h", at("done"))], "site_key string, url string"), "in_flight": spark.createDataFrame([item("flying", 2), item("waits", 7)], ITEM)}][n]
        gone = {"frontier": spark.createDataFrame([("h", at("flying"))], "site_key string, url string")} if n == 2 else None
        state.save(spark, path, tables, removed=gone)
    seeds = spark.createDataFrame([("h", at("seed")), ("h", at("done")), ("h", at("waits")), ("other", "http://other/")], "site_key string, url string")
    back = state.resume(spark, path, site(spark, "h"), seeds)
    nodes = {r["url"]: r for r in back["nodes"].collect()}
    assert back["nodes"].count() == len(nodes) and nodes.keys() == {at(p) for p in ("thrice", "done", "flying", "waits", "lost", "x.pdf", "seed")}
    assert (nodes[at("thrice")]["seen_count"], nodes[at("thrice")]["first_depth"], nodes[at("thrice")]["queueable"]) == (3, 1, True)
    assert nodes[at("x.pdf")]["page_kind"] == "resource" and nodes[at("waits")]["seen_count"] == 2 and nodes[at("seed")]["first_method"] == "seed"
    waiting = {r["url"]: (r["depth"], r["discovery_method"], r["attempts"]) for r in back["frontier"].collect()}
    assert waiting == {at("flying"): (1, "dom", 2), at("waits"): (1, "dom", 0), at("thrice"): (1, "dom", 0), at("lost"): (1, "dom", 0), at("seed"): (0, "seed", 0)}
    empty = state.resume(spark, str(tmp_path / "none"), site(spark, "h"), seeds)
    assert {r["url"] for r in empty["frontier"].collect()} == {at("seed"), at("done"), at("waits")} and empty["visited"].count() == 0


def test_run_plan_and_saved_sites(spark, tmp_path):
    policy = rules.POLICY_VERSION
    saved = spark.createDataFrame([("done", True, policy, False), ("old", True, policy - 1, False), ("leafy", True, policy, True), ("open", False, policy, False), ("more", True, policy + 1, None), ("odd", None, None, None), ("elsewhere", True, policy, False)], "site_key string, completed boolean, policy_version int, visit_leaf_pages boolean")
    seeds = [(s, u) for s in ("done", "old", "leafy", "open", "more", "odd", "new") for u in ("a", "a", "b")]
    known = [(s, u) for s, u in seeds if s != "new" and (s, u) != ("more", "b")] + [("done", "c")]
    frame = lambda rows: spark.createDataFrame(rows, "site_key string, url string")
    plan = lambda **kw: {r["site_key"]: (r["decision"], r["new_seeds"]) for r in state.run_plan(frame(seeds), saved, frame(known), **kw).collect()}
    assert plan() == {"done": ("skip", 0), "old": ("policy", 0), "leafy": ("policy", 0), "open": ("unfinished", 0), "more": ("seeds", 1), "odd": ("unfinished", 0), "new": ("start", 2)}
    assert plan(skip_completed=False)["done"] == ("unfinished", 0) and plan(visit_leaf_pages=True)["leafy"] == ("skip", 0)
    rows = frame([("s", "u")])
    for name, times in (("one", 1), ("two", 3)):
        for n in range(times):
            state.save(spark, f"{tmp_path}/{name}", {"visited": rows}, completed=n == 2)
    got = {r["site_folder"]: (r["version"], r["completed"], r["policy_version"]) for r in state.saved_sites(spark, str(tmp_path)).collect()}
    assert got == {"one": (1, False, policy), "two": (3, True, policy)}
