"""Addresses that are captured more than once: their captures may fall into different halves and thirds of the pages, with links of their own."""

import duckdb
import pytest
from linkloom.plans import queries, sql

#: path and link of the pages, numbered from 0. a is captured by two thirds, twice by the first; c, d and e by two or all.
PAGES = [("a", "x"), ("a", "y"), ("b", "x"), ("a", "z"), ("c", ""), ("c", ""), ("d", ""), ("0", "y"), ("d", ""), ("e", ""), ("e", ""), ("e", "")]

#: A link is found in two forms, and an address by its own page in one.
EXPECTED = {
    # each delta's counts add up, and a seed counts once more
    "resumed_nodes": {"a": (3, 0), "b": (2, 0), "c": (3, 0), "d": (3, 0), "e": (4, 0), "0": (2, 0), "x": (4, 1), "y": (4, 1), "z": (2, 1)},
    "nodes_merged": {"a": (2, 1), "b": (1, 1), "c": (2, 1), "d": (1, 1), "e": (2, 1), "0": (1, 1), "x": (4, 1), "y": (4, 1), "z": (2, 1)},
    # what waits in the frontier goes before what is in flight, the later delta's row before the earlier one's; b was in flight alone
    "resumed_frontier": {"a": (0, "a", "seed", 1), "b": (0, "b", "seed", 2), "c": (0, "c", "seed", 1), "d": (0, "d", "seed", 0), "0": (0, "0", "seed", 1), "x": (1, "a", "dom", 0), "y": (1, "0", "dom", 0), "z": (1, "a", "dom", 0)},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("captures"))
    pages = [(n, f"http://h.example/{own}", f'<a href="/{link}">' if link else "") for n, (own, link) in enumerate(PAGES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    visits = spark.createDataFrame([(1, 9, "click"), (2, 10, "error")], "event_id long, user_id long, event_type string")
    visits.selectExpr("*", "timestamp'2024-01-01' AS ts", "1.0D AS value").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", EXPECTED)
def test_against_hand_worked_rows_and_sql(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    rows = [tuple(r) for r in got.collect()]
    short = [tuple(c.removeprefix("http://h.example/") if isinstance(c, str) else c for c in r) for r in rows]
    assert {r[1]: r[2 : 2 + len(EXPECTED[name]["b"])] for r in short} == EXPECTED[name]
    con = duckdb.connect()
    for table in ("pages", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.sql(sql.oracle_sql()[name])
    assert found.columns == got.columns and sorted(found.fetchall()) == sorted(rows)
