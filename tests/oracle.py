"""Compare registered queries with their SQL on the same parquet files.

    python -m tests.oracle [--sf 0.01] [--only name,name] [--module alignments]
"""

from __future__ import annotations

import argparse
import importlib
import math
import time

import duckdb

from cladeframe.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, repr(v + 0.0))
    return (1, str(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, text: str | None):
    """(ok, message) for one query."""
    df = fn(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if text is None:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    want_cols, want = _rows(names, cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} / {want_cols}"
    spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = {"bigint": ("BIGINT", "NUMBER"), "double": ("DOUBLE", "NUMBER"), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "bool")}
    odd = [(c, spark_kinds[c], kinds[c]) for c in names if kinds[c] not in pairs.get(spark_kinds[c], (spark_kinds[c],))]
    note = f" types {odd}" if odd else ""
    if got != want:
        bad = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]
        return False, f"{len(got)} / {len(want)} rows, first differences {bad}{note}"
    return not odd, f"{len(got)} rows{note}"


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    a = ap.parse_args()
    sf_dir = f"/root/testdata/sf{a.sf}"
    if a.module:
        mods = [importlib.import_module(f"cladeframe.plans.{m}") for m in a.module.split(",")]
        queries = {n: f for m in mods for n, f in m.QUERIES.items()}
        sql = {n: s for m in mods for n, s in m.SQL.items()}
    else:
        plans = importlib.import_module("cladeframe.plans")
        queries, sql = plans.all_queries(), plans.all_sql()
    wanted = [n for n in a.only.split(",") if n] or list(queries)
    spark, con = build_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in wanted:
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
