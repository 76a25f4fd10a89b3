"""Compare a query with its oracle SQL as bags of rows, columns by name."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        at = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    found = Counter(tuple(map(_plain, r)) for r in df.select(*cols).collect())
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    wanted = Counter(tuple(_plain(row[i]) for i in at) for row in r.fetchall())
    assert found == wanted, (list((found - wanted).items())[:3], list((wanted - found).items())[:3])
