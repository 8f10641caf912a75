"""Vector codes, fill-in-the-middle and neighbours against plain versions, and their edges."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from linkloom.llm import fill_middle, neighbours, queries, vector_codes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


# --- vector codes -------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """All entries compared, in Python's own numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cuts = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, q, _ in kept]
    by_id = sorted(range(len(kept)), key=lambda n: (kept[n][0], kept[n][1]))[:entries]
    books = [[cuts[n][p] for n in by_id] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cuts:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    done = [[near(c[p], books[p]) for p in range(parts)] for c in cuts]
    return [(k[0], [e for _, e in d], sum(x for x, _ in d)) for k, d in zip(kept, done, strict=True)], books


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_plain(spark, seed):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([rng.uniform(-1, 1), 0.0, -0.001, 0.5]) for _ in range(12)]
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(150)]
    rows += [(150 + i, rows[0][1], 1) for i in range(150)]  # half of all rows are one vector
    rows += [(500, None, 1), (501, [math.nan] * 12, 1), (502, [math.inf] + [0.0] * 11, 2), (503, [None] + [0.0] * 11, 2)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(4), parts=3, entries=16)
    want, want_books = plain_codes(rows, 3, 16, 2)
    assert books.tolist() == want_books
    assert sorted((r["id"], list(r["code"]), r["error"]) for r in coded.collect()) == sorted(want)
    errors = {}
    for i, _, e in want:
        errors[rows[i][2]] = errors.get(rows[i][2], 0) + e
    assert {(r["label"], r["label_error"]) for r in vector_codes.with_label_errors(coded).collect()} == set(errors.items())
    assert vector_codes.with_label_errors(coded).count() == 300


def test_search_looks_at_part_of_the_entries_only():
    rng = np.random.default_rng(0)
    book = rng.integers(-1000, 1000, (64, 4))
    x = book[rng.integers(0, 64, 5000)] + rng.integers(-30, 30, (5000, 4))
    lists = vector_codes.neighbour_lists(book)
    want = ((x[:, None] - book) ** 2).sum(axis=2)
    for start in (np.zeros(5000, dtype=np.int64), want.argmin(axis=1), rng.integers(0, 64, 5000)):
        code, d = vector_codes.nearest_entries(x, book, lists, start)
        assert (code == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()
    compared = [np.searchsorted(lists[1][a], 4 * w, side="right") for a, w in zip(want.argmin(axis=1), want.min(axis=1), strict=True)]
    assert np.mean(compared) < 8


def test_codes_of_ties_and_edges(spark):
    near = lambda rows, **kw: vector_codes.compress(spark.createDataFrame(rows, VECTORS), parts=2, **kw)
    coded, books = near([(5, [0.0, 0.0], 1), (4, [0.0, 0.0], 1), (4, [0.0, 0.0], 1)], entries=3)
    assert {tuple(r["code"]) for r in coded.collect()} == {(0, 0)} and coded.count() == 3 and books.shape == (2, 3, 1)
    coded, books = near([(None, [9.0, 9.0], None), (2, [1.0] * 3, 7), (3, [1.0, -1e30], None), (4, [], 1)], entries=1, rounds=0)
    got = {r["id"]: (r["code"], r["error"], r["label"]) for r in coded.collect()}
    assert books.tolist() == [[[256]], [[-vector_codes.LIMIT]]] and got[2] == (None, None, 7) and got[4][0] is None
    assert got[3] == ([0, 0], 0, None) and got[None][1] == (9 * 256 - 256) ** 2 + (9 * 256 + vector_codes.LIMIT) ** 2
    coded, books = near([(1, None, 1)])
    assert coded.count() == 0 and books.shape == (2, 0, 1) and vector_codes.with_label_errors(coded).count() == 0
    clash = spark.createDataFrame([(1, [1.0, 2.0], 3, "x", "y")], "vec_id long, embedding array<float>, label int, id string, code string")
    assert vector_codes.compress(clash, parts=2)[0].first()["code"] == [0, 0]


# --- fill-in-the-middle -------------------------------------------------------------------------------------------


def text_of(rng, n):
    return "".join(rng.choice(["\n", "a", "é", "漢", "😀", "line of words", "\r", "\n\n"]) for _ in range(n))


def test_offsets_against_plain():
    rng = random.Random(3)
    for n in (0, 1, 5, 60, 700):
        for step, window in ((1, 7), (3, 16), (64, 1 << 16)):
            text = text_of(rng, n)
            lines = re.findall(r"[^\n]*\n|[^\n]+", text)
            data = text.encode()
            marks = fill_middle.checkpoints(data, step, window)
            assert marks.n_lines == len(lines) and marks.n_chars == len(text)
            assert len(marks.lines) <= 1 + len(lines) // step and marks.lines == [*range(0, text.count("\n") + 1, step)]
            for k in range(len(lines) + 1):
                head = "".join(lines[:k])
                assert fill_middle.offsets(data, marks, k) == (len(head.encode()), len(head))


def test_fill_in_middle_edges(spark):
    rng = random.Random(5)
    texts = {1: None, 2: "", 3: "no feed", 4: "a <S> b\nc\n", 5: "\n", 6: text_of(rng, 200), 7: "x" * 3_000_000, 8: "é\n" * 500_000, 9: "<P>", 10: text_of(rng, 50), None: "a\nb\nc\n"}
    rows = [(i, t, "clash", 1) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, output string, n int")
    out = fill_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == 12 and len({r for r in got if r["doc_id"] == 6}) == 1
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["back"] == r["text"] == text
        plain = not text or r["doc_id"] in (4, 9)
        assert (r["form"] == "plain") == plain == (r["prefix_chars"] is None) and (not plain or r["output"] == text)
        if plain:
            continue
        h = hashlib.sha256(f"7:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        want = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 50 else f"<P>{prefix}<S>{suffix}<M>{middle}"
        assert (r["n"], r["prefix_chars"], r["middle_chars"], r["output"]) == (len(lines), len(prefix), len(middle), want)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert {r["form"] for r in fill_middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}


# --- neighbours ---------------------------------------------------------------------------------------------------


def plain_neighbours(rows, asked, k=5):
    """{query: [(id, cosine), ...]} by comparing with all rows."""
    sound = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    cosine = lambda a, b: float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
    out = {}
    for q in asked:
        if q in sound:
            near = sorted((-round(cosine(sound[q], v), 12), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(spark, rows, asked, shard_rows=40, block_rows=7, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    index = neighbours.build_index(df, shard_rows=shard_rows)
    got = {}
    for r in neighbours.nearest(index, df.filter(F.col("vec_id").isin(asked)), block_rows=block_rows, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
        assert len(got[r["query_id"]]) == r["rank"]
    return got


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(150)]  # nearly half of all rows are one vector
    rows += [(400, None), (401, [0.0] * 5), (402, [math.nan] * 5), (403, [None] * 5), (None, [1.0] * 5), (404, [1.0, 2.0]), (406, [2.0, 2.0]), (405, [math.inf] * 5)]
    asked = [0, 3, 5, 50, 210, 300, 349, 400, 401, 402, 404, 405]
    assert found(spark, rows, asked, factor=1.0) == plain_neighbours(rows, asked)


def test_pruning_passes_over_much_and_loses_little():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    x = centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 8))
    tree = neighbours.Tree(x, [np.arange(4000)], 6)
    q = neighbours.unit(x[:100])
    want = np.sort(neighbours._distance(q @ tree.unit.T), axis=1)[:, :8]
    compared = []
    leaf = tree._leaf
    tree._leaf = lambda lo, hi, queries, mine: (compared.append((hi - lo) * len(mine)), leaf(lo, hi, queries, mine))
    assert np.allclose(np.sort(tree.search(q, 8, 1.0)[1], axis=1), want, atol=1e-7)
    assert sum(compared) < 0.5 * 100 * 4000
    exact, compared[:] = sum(compared), []
    got = np.sort(tree.search(q, 8, 3.0)[1], axis=1)
    assert sum(compared) < exact and np.mean(np.isclose(got, want, atol=1e-7)) > 0.9
    again = neighbours.Tree.from_bytes(tree.to_bytes())
    assert np.allclose(np.sort(again.search(q, 8, 1.0)[1], axis=1), want, atol=1e-7)


def test_neighbours_edges(spark):
    two = [(50, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (50, [1.0, 0.0])]
    assert found(spark, two, [50]) == {50: [(1, round(1 / math.sqrt(2), 12))]}
    assert found(spark, [(50, [1e-30, 0.0]), (2, [1e30, 0.0])], [50]) == {50: [(2, 1.0)]}
    assert found(spark, [(50, [1.0])], [50]) == {} == found(spark, [(50, [0.0])], [50])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, shard string, dim string")
    assert neighbours.nearest(neighbours.build_index(empty), empty).count() == 0


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_neighbours(rows, [i for i, _ in rows if i % 50 == 0])
    got = {}
    for r in queries.op13_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
