"""Compares registered queries with their SQL: ``python tests/compare.py [--sf 0.01] [names…]``."""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from retailscope.session import TABLES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for col in out.columns:
        out[col] = [_cell(v) for v in out[col]]
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def _cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "∅"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    return str(v)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a.equals(b):
        return None
    wrong = (a != b).any(axis=1)
    return f"{int(wrong.sum())} rows differ\nspark {a[wrong].head(3).to_dict('records')}\nsql   {b[wrong].head(3).to_dict('records')}"


def main() -> int:
    from retailscope.plans.catalogue import all_queries

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = session(), database(sf_dir)
    chosen = all_queries()
    if args.module:
        import importlib

        chosen = importlib.import_module(f"retailscope.plans.{args.module}").registry.queries
    bad = 0
    for name, query in chosen.items():
        if args.names and name not in args.names:
            continue
        try:
            t0 = time.time()
            got = query.build(spark, sf_dir).toPandas()
            t1 = time.time()
            if query.sql is None:
                print(f"ROWS {name} {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(query.sql).df()
            t2 = time.time()
            diff = difference(got, want)
            types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if c in want.columns and str(got[c].dtype) != str(want[c].dtype)}
            flag = "ok  " if diff is None else "DIFF"
            empty = " EMPTY" if len(got) == 0 else ""
            print(f"{flag} {name} {len(got)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s{empty} {types or ''}", flush=True)
            if diff:
                bad += 1
                print("     " + diff[:1500], flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
