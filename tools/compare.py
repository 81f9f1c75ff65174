"""Compare registered queries with their SQL equivalents, value by value.

usage: python tools/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sofralytics.plans import load_queries  # noqa: E402
from sofralytics.plans.adapters import TABLE_NAMES  # noqa: E402
from sofralytics.session import build_session  # noqa: E402


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in value.items()) + "}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    registry = load_queries()
    spark = build_session("8")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, build in registry.BUILDERS.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            frame = build(spark, folder)
            got_cols, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {str(error)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in registry.ORACLES:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(registry.ORACLES[name])
            want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb {str(error)[:600]}", flush=True)
            continue
        types = {f.name: f.dataType.simpleString() for f in frame.schema}
        duck = {d[0]: str(d[1]) for d in cur.description}
        if got_cols == want_cols and got == want:
            odd = [f"{c}:{types[c]}/{duck[c]}" for c in got_cols if _family(types[c]) != _family(duck[c])]
            print(f"ok    {name}: {len(got)} rows, {took:.1f}s" + (f"  TYPES {odd}" if odd else ""), flush=True)
        else:
            bad += 1
            diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
            print(f"FAIL  {name}: {got_cols} vs {want_cols}; rows {len(got)} vs {len(want)}; {str(diff)[:900]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


def _family(name: str) -> str:
    name = name.lower()
    table = {
        "bigint": "i8", "long": "i8", "int": "i4", "integer": "i4", "double": "f8", "float": "f4",
        "string": "s", "varchar": "s", "boolean": "b", "date": "d", "timestamp": "t", "timestamp_ntz": "t",
        "smallint": "i2", "hugeint": "i16",
    }
    return table.get(name, name.replace("decimal", "decimal"))


if __name__ == "__main__":
    sys.exit(main())
