"""Runs catalogue queries and their oracle side by side: names, types, rows as multisets."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
FAMILY = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "FLOAT": "float",
          "VARCHAR": "string", "BOOLEAN": "bool", "int": "int32", "bigint": "int64", "double": "double", "string": "string",
          "boolean": "bool", "date": "date", "DATE": "date"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    want = rel.fetchall()
    t2 = time.time()
    names, dnames = df.columns, [c[0] for c in rel.description]
    timing = f"{len(got)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if sorted(names) != sorted(dnames):
        return False, f"columns {sorted(names)} != {sorted(dnames)}"
    dtypes = {n: FAMILY.get(t, t) for n, t in df.dtypes}
    wtypes = {c[0]: FAMILY.get(str(c[1]), str(c[1])) for c in rel.description}
    bad = {n: (dtypes[n], wtypes[n]) for n in names if dtypes[n] != wtypes[n]}
    a, b = rows_of(names, got), rows_of(dnames, want)
    if a != b:
        only = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"{timing}; {sum((a - b).values())} only in spark, {sum((b - a).values())} only in duckdb\n   S {only[0]}\n   D {only[1]}"
    if bad:
        return False, f"{timing}; types {bad}"
    return True, timing


def main(argv: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, wanted = argv[0], argv[1:]
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    failed = []
    for key, fn in entry.queries().items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        if key not in oracle:
            print("NOORACLE", key, fn(spark, sf_dir).count(), flush=True)
            continue
        try:
            ok, info = compare(spark, con, fn, oracle[key], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", key, info, flush=True)
        if not ok:
            failed.append(key)
    print("failed:", " ".join(failed) or "none")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
