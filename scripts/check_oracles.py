"""Compare queries with their SQL checks: check_oracles.py [sf_dir] [name-prefix ...]"""

import sys
import time
import os

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from factloom.plans import registry  # noqa: E402
from factloom.session import build_session  # noqa: E402
from factloom.sources.tables import BASE_TABLES  # noqa: E402


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(normal(x) for x in v)
    return v


def main(sf_dir, prefixes):
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    oracles = registry.oracle_sql()
    failed = []
    for name, build in registry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            cols = sorted(df.columns)
            got = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:
            failed.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(oracles[name])
            names = [d[0] for d in cur.description]
            raw = cur.fetchall()
        except Exception as e:
            failed.append(name)
            print(f"FAIL {name}: oracle {str(e)[:600]}", flush=True)
            continue
        if sorted(names) != cols:
            failed.append(name)
            print(f"FAIL {name}: columns {cols} vs {sorted(names)}", flush=True)
            continue
        idx = [names.index(c) for c in cols]
        want = [tuple(normal(r[i]) for i in idx) for r in raw]
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        got.sort(key=key)
        want.sort(key=key)
        if got == want:
            print(f"ok   {name}: {len(got)} rows, {took:.1f}s", flush=True)
        else:
            failed.append(name)
            gs, ws = set(map(str, got)), set(map(str, want))
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows; {cols}", flush=True)
            for r in sorted(gs - ws)[:3]:
                print("   spark ", r[:300])
            for r in sorted(ws - gs)[:3]:
                print("   oracle", r[:300])
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    args = sys.argv[1:]
    directory = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(main(directory, args))
