"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from palimpsest.plans import ranking
from palimpsest.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canonical(frame, columns):
    def cell(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        return repr(round(float(v), 9)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got, sorted(got.columns)) == canonical(want, sorted(got.columns))


def test_step_points_of_odd_items(spark, tmp_path, monkeypatch):
    """Null items and texts, one that nothing holds and one that several hold; the admissible records are written down once."""
    texts = ["the red boat lay in the bay", "the red boat lay in the sand and then sank", "a blue boat, the red boat lay in the bay", "no boat at all", "", None]
    docs = [(2 + 7 * k, text, "en", "web") for k, text in enumerate(texts * 8)]
    items = [(2, "the red boat lay in"), (4, "no boat at all"), (6, "zzz"), (1, None), (3, "the red boat"), (5, ""), (None, "blue boat"), (-7, "a boat sank")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    scans, scan = [], ranking.records
    monkeypatch.setattr(ranking, "records", lambda *a: scans.append(a) or scan(*a))
    got = QUERIES["E13_step_points"](spark, str(tmp_path)).toPandas()
    want = connection.sql(ORACLE["E13_step_points"]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) == 4 and want["recall"].max() > 0
    assert canonical(got, sorted(got.columns)) == canonical(want, sorted(got.columns))
    assert len(scans) == 1
