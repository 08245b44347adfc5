"""Every query with an SQL twin agrees with DuckDB on the smallest tables; the entry point works without the text operators."""

import duckdb
import pytest

from covelight.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(str, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query_agrees_with_sql(spark, duck, sf, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


def test_flagship(spark, sf):
    got = catalog.QUERIES[catalog.FLAGSHIP](spark, sf).toPandas()
    assert len(got) == catalog.CONFIG.budget == got["pos"].nunique()


def test_a_selection_reads_the_slices_once(spark, sf, monkeypatch):
    want = [catalog.scored_source(spark, sf), catalog.support(spark, sf), catalog.source_scores(spark, sf)]
    read, old = [], catalog._t
    monkeypatch.setattr(catalog, "_t", lambda spark, sf, name: (read.append(name), old(spark, sf, name))[1])
    monkeypatch.setattr(catalog.curation, "select_sources", lambda source, support, scores, config: (source, support, scores))
    got = catalog._select(spark, sf)
    assert read.count("lineitem") == 1
    for a, b in zip(got, want, strict=True):
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
