"""Compares queries with their SQL in DuckDB: python tests/oracle.py [--sf sf0.01] [NAME...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return int(v) if isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder, name, query, sql):
    """None if both agree, else what differs."""
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    ref = con.execute(sql)
    names = [c[0] for c in ref.description]
    want = rows(names, ref.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} against {names}"
    if got != want:
        only = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} rows against {len(want)}; only here {only[0]}; only there {only[1]}"


if __name__ == "__main__":
    import __spark_entry__ as E

    from tidemark.session import local_session

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "sf0.01"
    names = [a for a in args if a != "--sf"] or sorted(E.queries())
    folder, spark = f"/root/testdata/{sf}", local_session()
    con = views(folder)
    for n in names:
        t = time.time()
        try:
            if n in E.oracle_sql():
                bad = compare(spark, con, folder, n, E.queries()[n], E.oracle_sql()[n])
                print(f"{n}: {bad or 'ok'} ({time.time() - t:.1f} s)", flush=True)
            else:
                print(f"{n}: {E.queries()[n](spark, folder).count()} rows, no SQL ({time.time() - t:.1f} s)", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{n}: {type(e).__name__} {str(e)[:1500]}", flush=True)
