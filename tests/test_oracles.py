"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from faintlight.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str([None if v is None or v != v else float(v) if isinstance(v, (int, float)) else v for v in map(plain, r)]) for r in frame.itertuples(index=False))


def plain(v):
    import pandas as pd

    v = v.item() if hasattr(v, "item") else v
    return None if v is pd.NA else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, wanted = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
