"""Every query of the subpackage runs, and equals its SQL where it has one."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def tables():
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def names():
    from linkloom.llm import queries

    return [*queries.queries()]


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    from linkloom.llm import queries

    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    assert rows
    if name in queries.oracle_sql():
        result = tables().sql(queries.oracle_sql()[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert sorted(repr([r[i] for i in at]) for r in result.fetchall()) == rows


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.table(spark, SF, "documents")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = corpus_pipeline.cut(out)
    last = corpus_pipeline.run(spark, SF)
    assert last.count() == docs.count() > before / 2 and last.filter(~last.round_trip).count() == 0


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = corpus_pipeline.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
    assert docs.count() == 0
