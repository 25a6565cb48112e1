"""Row-by-row comparison of a catalog query with its SQL twin on DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, f"{v:.9g}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and the multiset of rows agree."""
    names = sorted(df.columns)
    cur = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cur.description}
    out = []
    if sorted(described) != names:
        return [f"columns {names} != {sorted(described)}"]
    rel = con.sql(sql)
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema.fields:
        if _TYPES.get(f.dataType.simpleString()) != duck_types[f.name]:
            out.append(f"type of {f.name}: {f.dataType.simpleString()} / {duck_types[f.name]}")
    order = [rel.columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=_key)
    ours = sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=_key)
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(_same(x, y) for x, y in zip(a, b))]
    if bad:
        out.append(f"{len(bad)} rows differ, e.g. {bad[0][0]} / {bad[0][1]} of {names}")
    return out
