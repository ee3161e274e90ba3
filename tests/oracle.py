"""Compare a query with its oracle: same columns, same multiset of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    cols = sorted(df.columns)
    ours = Counter(tuple(_norm(x) for x in r) for r in df.select(*cols).collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    if ours == theirs:
        return None
    a, b = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return (f"{sum(ours.values())} vs {sum(theirs.values())} rows; differing "
            f"{sum((ours - theirs).values())}; {cols}\n  spark {a}\n  duck  {b}")
