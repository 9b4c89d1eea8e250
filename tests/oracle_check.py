"""Run registered queries against their DuckDB oracles.

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: columns equal, row counts, and whether the
sorted rows are equal (doubles compared after rounding to 12 significant
digits, or bit for bit with ORACLE_EXACT=1; text and integers exactly).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


EXACT = os.environ.get("ORACLE_EXACT") == "1"


def _norm(v):
    if isinstance(v, float) and not EXACT:
        return float(f"{v:.12g}") if math.isfinite(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                          for x in r))


SPARK_FAMILY = {"int": "int32", "bigint": "int64", "double": "float64", "string": "text",
                "date": "date", "boolean": "bool"}
DUCK_FAMILY = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "text",
               "DATE": "date", "BOOLEAN": "bool"}


def type_families(df, rel):
    s = {c: SPARK_FAMILY.get(t, t) for c, t in df.dtypes}
    d = {c: DUCK_FAMILY.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    return s, d


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols = df.columns
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    t2 = time.time()
    same_cols = sorted(s_cols) == sorted(d_cols)
    s_types, d_types = type_families(df, rel)
    same = same_cols and canon(s_rows, s_cols) == canon(d_rows, d_cols)
    return dict(name=name, ok=same, cols=same_cols, types=s_types == d_types,
                spark_types=s_types, sql_types=d_types, spark_rows=len(s_rows), sql_rows=len(d_rows),
                spark_sec=round(t1 - t0, 2), sql_sec=round(t2 - t1, 2),
                spark_cols=s_cols, sql_cols=d_cols)


def main(argv):
    import __spark_entry__ as entry
    from basketmine.plans.runtime import session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"{name}: no oracle")
            continue
        try:
            r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # report and go on
            print(f"{name}: ERROR {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        bad += not r["ok"]
        flag = "OK " if r["ok"] else "BAD"
        extra = "" if r["cols"] else f" cols {r['spark_cols']} vs {r['sql_cols']}"
        if not r["types"]:
            extra += f" TYPES {r['spark_types']} vs {r['sql_types']}"
        print(f"{flag} {name}: rows {r['spark_rows']}/{r['sql_rows']} "
              f"spark {r['spark_sec']}s sql {r['sql_sec']}s{extra}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
