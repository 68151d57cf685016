"""Compares each query with its SQL on DuckDB: python tests/oracle.py SF_DIR [NAME...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "item"):
        x = x.item()
    try:
        from decimal import Decimal

        x = float(x) if isinstance(x, Decimal) else x
    except ValueError:
        pass
    return round(float(x), 9) if isinstance(x, (int, float)) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, sf_dir, names=None):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    sql = entry.oracle_sql()
    for name, f in entry.queries().items():
        if name in sql and (not names or name in names):
            began = time.time()
            df = f(spark, sf_dir)
            got = rows(df.columns, df.collect())
            took, began = time.time() - began, time.time()
            try:
                cur = db.execute(sql[name])
                want = rows([c[0] for c in cur.description], cur.fetchall())
            except duckdb.Error as e:
                want = ([], [(str(e),)])
            note = ""
            if got != want:
                bad = [x for x in got[1] if x not in set(want[1])][:2], [x for x in want[1] if x not in set(got[1])][:2]
                note = f"columns {got[0]} {want[0]}" if got[0] != want[0] else f"rows {len(got[1])} {len(want[1])}: {bad}"
            yield name, len(got[1]), took, time.time() - began, note


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    for name, n, a, b, note in differences(s, sys.argv[1], sys.argv[2:]):
        print(f"{'DIFFERS' if note else 'same'} {name} rows={n} spark={a:.1f}s duckdb={b:.1f}s {note}"[:600], flush=True)
