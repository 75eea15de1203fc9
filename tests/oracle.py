"""Compare a query with its SQL, as rows without order and columns by name."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sessions messages turns records cie_records mix_targets pack_spec roster".split()


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v


def sql_rows(root: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def differences(spark, root: str, query, sql: str) -> str:
    """Empty if both agree."""
    a, x = spark_rows(query(spark, root))
    b, y = sql_rows(root, sql)
    if a != b:
        return f"columns {a} against {b}"
    if x != y:
        return f"{sum(x.values())} rows against {sum(y.values())}; only Spark: {list((x - y).items())[:3]}; only SQL: {list((y - x).items())[:3]}"
    return ""
