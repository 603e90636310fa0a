"""Run registered queries against their SQL oracles: ``python tests/check_oracles.py <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from vitalstrand.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = entry.queries()[name](spark, sf_dir)
    got = normal(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no oracle)"
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want = normal(columns, res.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows"
    extra, missing = set(got) - set(want), set(want) - set(got)
    return False, f"{len(got)} vs {len(want)} rows; only spark {list(extra)[:2]}; only sql {list(missing)[:2]}"


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = []
    for name in names or list(entry.queries()):
        t0 = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t0:6.1f}s {note}", flush=True)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    sys.exit(main(args[0], args[1:]))
