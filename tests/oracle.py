"""Compare a Spark result with the oracle SQL run by DuckDB on the same files."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return v if v is None else str(v)


def compare(df, con, text: str) -> tuple[bool, str]:
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: only spark {sorted(set(df.columns) - set(names))}, only sql {sorted(set(names) - set(df.columns))}"
    order = sorted(names)
    a = Counter(tuple(_cell(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(_cell(r[i]) for i in at) for r in cur.fetchall())
    if a == b:
        return True, f"{sum(a.values())} rows"
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return False, (
        f"{sum(a.values())} vs {sum(b.values())} rows; {order}\n only spark ({len(only_a)}): {sorted(only_a, key=str)[:3]}"
        f"\n only sql ({len(only_b)}): {sorted(only_b, key=str)[:3]}"
    )
