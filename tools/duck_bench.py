"""Time the oracle SQL of the bench's headline queries on DuckDB (single
process, all cores), as a single-node reference for bench.py.

    python tools/duck_bench.py [sf_dir]
"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from bench import HEADLINE  # noqa: E402
from corpusprep.plans.oracle import oracle_sql  # noqa: E402
from tools.oracle_check import TABLES  # noqa: E402


def main(sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sql = oracle_sql()
    times = {}
    for q in HEADLINE:
        if q not in sql:
            continue
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            con.execute(f"SELECT count(*), max(hash(x)) FROM ({sql[q]}) x").fetchall()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[q] = round(best, 3)
    print(json.dumps({"engine": "duckdb", "sf": sf, "queries": times, "total": round(sum(times.values()), 3)}))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
