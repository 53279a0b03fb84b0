"""Run registered queries next to their SQL in DuckDB and compare whole results."""

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _sortkey(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float, bool)) else "n"), v if v is not None else 0) for v in row)


def compare(spark, con, fn, sql, sf_dir):
    """``(status, detail)`` where status is exact, close or differs."""
    got = fn(spark, sf_dir)
    gcols = sorted(got.columns)
    grows = [tuple(_norm(r[c]) for c in gcols) for r in got.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != gcols:
        return "differs", f"columns {gcols} != {sorted(names)}"
    idx = [names.index(c) for c in gcols]
    erows = [tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()]
    if len(grows) != len(erows):
        return "differs", f"rows {len(grows)} != {len(erows)}"
    grows.sort(key=_sortkey)
    erows.sort(key=_sortkey)
    if grows == erows:
        return "exact", f"{len(grows)} rows"
    bad = [(g, e) for g, e in zip(grows, erows) if g != e]
    for g, e in bad:
        for a, b in zip(g, e):
            if a != b and not (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)):
                return "differs", f"{len(bad)} rows differ, e.g. {gcols} {g} != {e}"
    return "close", f"{len(bad)} of {len(grows)} rows differ in last digits, e.g. {bad[0]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                status, detail = compare(s, con, fn, oracles[name], sf)
            else:
                status, detail = "rows-only", f"{fn(s, sf).count()} rows"
        except Exception as exc:
            status, detail = "ERROR", str(exc)[:600]
        failed += status in ("differs", "ERROR")
        print(f"{status:9s} {name:40s} {time.time() - t:6.2f}s {detail}", flush=True)
    print("failed", failed)
