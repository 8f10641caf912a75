"""Orders worked out for whole logs, against the loops that make them one step at a time. Many random cases are sites of one run."""

import heapq
import random
from collections import deque

import pytest
from linkloom.operators import order
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 7)


def test_numbered(spark):
    rng = random.Random(0)
    rows = [(rng.choice("ab") if n % 2 else "hot", rng.randrange(50), n) for n in range(600)]
    got = order.numbered(spark.createDataFrame(rows, "k string, v int, n int").repartition(5), ["k"], [F.col("v").desc(), "n"]).collect()
    for k in "ab", "hot":
        want = [(r[2], p) for p, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1)]
        assert sorted((r["n"], r["place"]) for r in got if r["k"] == k) == sorted(want)


def plain_segments(visits, pages, micros):
    """ST2: save when so many visits or so much time since the last save have gone by."""
    out, since, segment, held = {}, 0, 0, []
    last = min(started for _, started, _ in visits)
    for visit, _, finished in sorted(visits, key=lambda v: (v[2], v[0])):
        since += 1
        held.append(visit)
        if since >= pages or finished - last >= micros:
            out |= {v: (segment, True) for v in held}
            since, last, segment, held = 0, finished, segment + 1, []
    return out | {v: (segment, False) for v in held}


def test_segments_against_the_loop(spark):
    rng = random.Random(1)
    sites, rows = {}, []
    for n in range(24):
        spread = rng.choice([1, 30, 400])
        visits = [(v, t := rng.randrange(spread * 10), t + rng.randrange(20)) for v in range(rng.choice([1, 2, 9, 60]) if n else 900)]
        sites[f"s{n}"] = visits
        rows += [(f"s{n}", *v) for v in visits]
    log = spark.createDataFrame(rows, "site_key string, visit_id long, started long, finished long").repartition(3)
    for pages, micros in ((4, 50), (11, 1)):
        got = {}
        for r in order.segments(log, pages, micros).collect():
            got.setdefault(r["site_key"], {})[r["visit_id"]] = (r["segment"], r["saved"])
        assert got == {s: plain_segments(v, pages, micros) for s, v in sites.items()}
    assert order.segments(log.limit(0), 4, 50).count() == 0


def plain_replay(ops):
    held, taken = deque(), {}
    for n, (op, item) in enumerate(ops):
        if op == "back":
            held.append((item, "back"))
        elif op == "front":
            held.appendleft((item, "front"))
        else:
            taken[n] = held.popleft() if held else (None, None)
    return taken, [i for i, _ in held]


def test_replay_against_a_deque(spark):
    """G7: whatever the mixture of ends, fronts and takes, of an empty deque too."""
    rng = random.Random(2)
    sites, rows = {}, []
    for n in range(30):
        weights = [rng.random() ** 2 for _ in range(3)]
        length = 700 if n == 0 else rng.choice([1, 5, 40])
        sites[f"s{n}"] = [(rng.choices(["back", "front", "take"], weights)[0], rng.choice([None, "x", f"i{k}", f"i{k}"])) for k in range(length)]
    sites["held"] = [("front", "first"), *[("front", f"f{k}") if k % 2 else ("take", None) for k in range(1, 300)]]
    for s, ops in sites.items():
        rows += [(s, n, op, item) for n, (op, item) in enumerate(ops)]
    log = spark.createDataFrame(rows, "site_key string, n int, op string, url string").repartition(4)
    taken, waiting = order.replayed(log, ["site_key"], ["n"], "url")
    got, left = {}, {}
    for r in taken.collect():
        got.setdefault(r["site_key"], {})[r["n"]] = (r["item"], r["came"])
    for r in waiting.orderBy("site_key", "side", "turn").collect():
        left.setdefault(r["site_key"], []).append(r["item"])
    want = {s: plain_replay(ops) for s, ops in sites.items()}
    assert got == {s: t for s, (t, _) in want.items() if t}
    assert left == {s: w for s, (_, w) in want.items() if w}
    assert all(x.count() == 0 for x in order.replayed(log.limit(0), ["site_key"], ["n"], "url"))


def plain_best_first(nodes, starts, links):
    waiting = [(nodes[s], s) for s in starts]
    heapq.heapify(waiting)
    seen, out = set(starts), []
    while waiting:
        _, u = heapq.heappop(waiting)
        out.append(u)
        for v in links.get(u, ()):
            if v in nodes and v not in seen:
                seen.add(v)
                heapq.heappush(waiting, (nodes[v], v))
    return out


def test_best_first_against_a_queue(spark):
    """O4: cycles, loops, several starts, parts that nothing reaches, links to what is no item."""
    rng = random.Random(3)
    want, items, links = {}, [], []
    for n in range(40):
        size = rng.choice([1, 3, 8, 20])
        nodes = {f"u{k}": rng.randrange(6) for k in range(size)}
        starts = rng.sample(sorted(nodes), rng.randrange(0, min(3, size) + 1))
        out = {}
        for _ in range(int(size * rng.choice([0.5, 1, 2]))):
            a, b = rng.choice([*nodes, "gone"]), rng.choice([*nodes, "gone"])
            out.setdefault(a, []).append(b)
            links += [(f"s{n}", a, b)] * rng.choice([1, 2])
        items += [(f"s{n}", u, p, u in starts) for u, p in nodes.items()]
        want[f"s{n}"] = plain_best_first(nodes, starts, out)
    chain = {f"u{k}": 5 - k for k in range(5)}  # each item is better than the one before
    items += [("chain", u, p, p == 5) for u, p in chain.items()]
    links += [("chain", f"u{k}", f"u{k + 1}") for k in range(4)]
    want["chain"] = [f"u{k}" for k in range(5)]
    df = spark.createDataFrame(items, "site_key string, url string, p int, start boolean")
    arcs = spark.createDataFrame(links, "site_key string, src string, dst string")
    got = {}
    for r in order.best_first(df, arcs, ["site_key"], "url", ["p", "url"]).orderBy("place").collect():
        got.setdefault(r["site_key"], []).append(r["url"])
    assert got == {s: w for s, w in want.items() if w}
    first = order.best_first(df.filter("site_key <> 'chain'"), arcs, ["site_key"], "url", ["p", "url"], budget=3).groupBy("site_key").count().collect()
    assert {r["site_key"]: r["count"] for r in first} == {s: min(3, len(w)) for s, w in want.items() if w and s != "chain"}
