"""The driver contract: every oracle belongs to a query and runs on DuckDB."""

import duckdb

import __spark_entry__ as E
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_oracles_belong_to_queries_and_run():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 80
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for name, sql in sqls.items():
        cols = [d[0] for d in con.execute(f"SELECT * FROM ({sql}) x LIMIT 0").description]
        assert len(cols) == len(set(cols)), name
