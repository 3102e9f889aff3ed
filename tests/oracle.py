"""Compare a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, str):
        return v
    f = float(v)
    return round(f, 6) + 0.0


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(norm(v) for v in r) for r in df.itertuples(index=False, name=None)), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in df.columns if not df[c].isna().any()}


def compare(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (len(bad), bad[:3])
    g, w = kinds(got), kinds(want)
    clash = {c: (g[c], w[c]) for c in set(g) & set(w) if g[c] != w[c] and {g[c], w[c]} != {"M"}}
    assert not clash, clash
