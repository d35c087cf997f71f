"""Run a registered query in Spark and its DuckDB oracle; compare results.

CLI: ``python tests/oracle_harness.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def normalise(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pairwise = "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    scols, srows = normalise(df.columns, srows)
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2), "pairwise_join": pairwise}
    if sql is None:
        res["oracle"] = None
        return res
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    dcols, drows = normalise(dcols, drows)
    res.update(oracle_rows=len(drows), cols_ok=scols == dcols, rows_ok=srows == drows)
    if not res["rows_ok"]:
        sset, dset = set(srows), set(drows)
        res["spark_only"] = [r for r in srows if r not in dset][:3]
        res["oracle_only"] = [r for r in drows if r not in sset][:3]
    if not res["cols_ok"]:
        res["spark_cols"], res["oracle_cols"] = scols, dcols
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from sitegraph.session import get_session
    import __spark_entry__ as E

    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        spark = get_session(master="local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        try:
            r = compare(spark, con, name, qs[name], os_.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        ok = "error" not in r and ("oracle_rows" not in r or (r["cols_ok"] and r["rows_ok"]))
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
