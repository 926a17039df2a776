"""Run every query beside its SQL and compare rows; used by the tests and by hand.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def compare(spark_df, con, sql):
    """None when both sides agree, else a short account of the difference."""
    got_df, want_df = spark_df.toArrow(), con.execute(sql).to_arrow_table()
    names = sorted(got_df.column_names)
    if names != sorted(want_df.column_names):
        return f"columns {names} != {sorted(want_df.column_names)}"
    kinds = lambda t: [str(t.schema.field(n).type).replace("large_", "") for n in names]
    if kinds(got_df) != kinds(want_df):
        return f"types {list(zip(names, kinds(got_df), kinds(want_df)))}"
    rows = lambda t: sorted(zip(*[[_cell(v) for v in t.column(n).to_pylist()] for n in names]))
    got, want = rows(got_df), rows(want_df)
    if got == want:
        return None
    extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
    return f"{len(got)} rows, want {len(want)}; extra {str(extra)[:400]}; missing {str(missing)[:400]}"


def main():
    import __spark_entry__ as entry
    from rowlantern.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            diff = compare(fn(spark, sf_dir), con, oracle[name])
        except Exception as err:  # report and go on
            diff = f"{type(err).__name__}: {str(err)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
