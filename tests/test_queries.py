"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from lodestrata import queries as Q
from lodestrata import queries_schema  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v.item() if hasattr(v, "item") else v
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).values.tolist()), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.sql(Q.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_generated_mapping(spark):
    found = {r["map"]: r for r in Q.generated_mapping(spark, FOLDER).collect()}
    assert found["labelsMapping"].subject.endswith("documents/{doc_id}") and found["ordersMapping"].classes == Q.NS + "Orders" and all(r.n_triples > 0 for r in found.values())


def test_the_entry_works_without_the_text_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as E

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("lodestrata.llm", "corpus_pipeline")) else real(n, *a))
    assert set(E.queries()) == set(Q.QUERIES) and set(E.oracle_sql()) == set(Q.SQL)
