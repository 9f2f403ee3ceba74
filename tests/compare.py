"""Runs a query and its SQL and compares the rows, whatever their order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([_cell(r[i]) for i in order] for r in rows), key=repr)


def difference(df, con, sql):
    """None when equal, else a short description."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = next((g for g in got if g not in want[:5000]), None)
        return f"rows {len(got)} != {len(want)}; e.g. {str(extra)[:300]} / {str(want[:1])[:300]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first:\n  {str(bad[0][0])[:600]}\n  {str(bad[0][1])[:600]}"
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(got_cols, got[0], want[0])
             if type(a) is not type(b) and a is not None and b is not None] if got else []
    return f"types {types}" if types else None
