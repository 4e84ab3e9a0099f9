"""The registered queries against DuckDB, and the pipeline against what its stages promise."""

import pytest

from soundings.llm import queries

from compare import connect, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, middle, name):
    same(queries.queries()[name](spark, middle), connect(middle), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_each(spark, small, name):
    assert queries.queries()[name](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_pipeline(spark, middle, edge, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{middle}/documents.parquet")
    n = []
    for name, stage in c.STAGES:
        out = stage(spark, docs, middle)
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        n.append(got.count())
        assert name == "encode" or got.columns == docs.columns
        docs = got
    assert 800 < n[0] < 950 and 700 < n[1] < n[0] and n[2] == n[1] and n[4] == n[3]
    assert spark.read.parquet(str(tmp_path / "secret_scan")).where("text RLIKE 'AKIA[A-Z0-9]{14,}'").count() == 0
    assert docs.where("NOT round_trip").count() == 0
    for name, stage in c.STAGES:
        assert stage(spark, edge, middle).count() > 0 and stage(spark, edge.limit(0), middle).count() == 0
