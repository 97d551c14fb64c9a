"""Run registered queries against their DuckDB text: python tests/oracle_check.py [name-prefix ...] [--sf 0.01]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if type(value).__name__ == "Decimal":
        return ("decimal", str(value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) else (False, "n", v) for v in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return type(a) is type(b) and abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return type(a) is type(b) and a == b


def compare(spark, con, entry, sf_dir):
    started = time.time()
    df = entry.run(spark, sf_dir)
    got = df.collect()
    spark_time = time.time() - started
    names, left = rows_of(df.columns, got)
    kinds = [f.dataType.simpleString() for f in df.schema.fields if f.dataType.simpleString()[:5] in ("array", "struc", "map<s", "map<i")]
    if entry.sql is None:
        return f"rows-only {len(left)}" if left else "EMPTY", spark_time, 0.0
    started = time.time()
    cur = con.execute(entry.sql)
    other = [d[0] for d in cur.description]
    onames, right = rows_of(other, cur.fetchall())
    sql_time = time.time() - started
    if names != onames:
        return f"COLUMNS {names} vs {onames}", spark_time, sql_time
    if len(left) != len(right):
        return f"ROWS {len(left)} vs {len(right)}", spark_time, sql_time
    if not left:
        return "EMPTY", spark_time, sql_time
    bad = [(a, b) for a, b in zip(left, right) if not all(same(x, y) for x, y in zip(a, b))]
    if bad:
        return f"VALUES {len(bad)}/{len(left)} {names} e.g. spark={bad[0][0]} sql={bad[0][1]}", spark_time, sql_time
    if kinds:
        return f"NESTED {kinds}", spark_time, sql_time
    return f"ok {len(left)}", spark_time, sql_time


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    from memjoin.plans import load_all
    from memjoin.session import local_session

    registry = load_all()
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    failed = []
    for name, entry in registry.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            verdict, t1, t2 = compare(spark, con, entry, sf_dir)
        except Exception as error:  # report and go on with the next query
            verdict, t1, t2 = "ERROR " + str(error).split("JVM stacktrace")[0][:1500], 0.0, 0.0
        good = verdict.startswith("ok") or verdict.startswith("rows-only")
        print(f"{'PASS' if good else 'FAIL'} {name:44s} {t1:6.2f}s {t2:6.2f}s {verdict}", flush=True)
        if not good:
            failed.append(name)
    print("failed:", failed)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
