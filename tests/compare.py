"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def normalized(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """Message of the first difference, empty when equal; row count; seconds of each side."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    mine = df.collect()
    t1 = time.time()
    if sql is None:
        return "", len(mine), t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}", len(mine), t1 - t0, t2 - t1
    a, b = normalized(df.columns, mine), normalized(names, theirs)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        return (f"rows {len(a)} vs {len(b)}; only spark ({len(sa - sb)}): {only_a}; only sql ({len(sb - sa)}): {only_b}",
                len(a), t1 - t0, t2 - t1)
    return "", len(a), t1 - t0, t2 - t1


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cargoline.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    names = sys.argv[1:] or list(entry.queries())
    oracle = entry.oracle_sql()
    bad = 0
    for name in names:
        try:
            message, n, s, d = compare(spark, con, entry.queries()[name], oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            message, n, s, d = f"{type(exc).__name__}: {str(exc)[:700]}", -1, 0, 0
        bad += bool(message)
        flag = "FAIL" if message else ("ok" if name in oracle else "rows")
        print(f"{flag:5} {name:28} rows={n:<7} spark={s:6.2f}s sql={d:6.2f}s {message[:1500]}", flush=True)
    print("failed:", bad)
    spark.stop()
