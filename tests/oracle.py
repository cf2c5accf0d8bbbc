"""Run registered queries and their SQL side by side: python tests/oracle.py [sf] [name...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns) -> list[str]:
    """Rows as sorted strings, columns by name."""
    import datetime
    import decimal

    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return f"{v:.6f}" if v == v else "nan"
        if isinstance(v, decimal.Decimal):
            return f"{float(v):.6f}"
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(one(x) for x in v) + "]"
        return repr(v)

    return sorted("|".join(one(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, q in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf_dir, q, sqls[name]) if name in sqls else f"rows only: {q(spark, sf_dir).count()}"
        except Exception as e:  # a report of all queries, one by one
            said = f"ERROR {str(e)[:400]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name:40s} {time.time() - t:6.1f}s  {said or 'ok'}", flush=True)
    print("failures:", bad)
