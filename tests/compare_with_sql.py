"""Run published queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare_with_sql.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def row_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def compare(spark, con, sf_dir, name, builder, sql):
    """Return (ok, message)."""
    start = time.time()
    df = builder(spark, sf_dir)
    columns = df.columns
    ours = row_bag(columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    total = sum(ours.values())
    if sql is None:
        return True, f"rows-only {total} rows {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = row_bag(names, cur.fetchall())
    sql_took = time.time() - start
    if sorted(columns) != sorted(names):
        return False, f"columns {sorted(columns)} != {sorted(names)}"
    types = sorted(zip(columns, (f.dataType.simpleString() for f in df.schema.fields)))
    duck_types = sorted((d[0], str(d[1])) for d in cur.description)
    if ours != theirs:
        only = list((ours - theirs).items())[:3]
        missing = list((theirs - ours).items())[:3]
        return False, f"{total} vs {sum(theirs.values())} rows\n   ours  {only}\n   sql   {missing}\n   {types}"
    if total == 0:
        return False, "no rows"
    odd = [t for t in duck_types if "HUGEINT" in t[1] or "DECIMAL" in t[1]]
    note = f" TYPES {odd}" if odd else ""
    return True, f"{total} rows spark {took:.1f}s sql {sql_took:.1f}s{note}"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from quillspan.session import build_session

    spark = build_session()
    con = connect(args.sf)
    builders, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, builder in builders.items():
        if args.names and name not in args.names and not any(
            n.endswith("*") and name.startswith(n[:-1]) for n in args.names
        ):
            continue
        try:
            ok, message = compare(spark, con, args.sf, name, builder, sqls.get(name))
        except Exception as err:  # report and go on with the next query
            ok, message = False, f"{type(err).__name__}: {str(err)[:700]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            bad.append(name)
    print(len(bad), "failed", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
