"""Compare registered queries with their SQL: columns, row count, every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if value.__class__.__name__ == "Decimal":
        return float(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, key, query, sql, sf_dir):
    """None when equal, else a text that says what differs."""
    df = query(spark, sf_dir)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = canonical([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns differ: only here {sorted(set(got_cols) - set(want_cols))[:5]}, only there {sorted(set(want_cols) - set(got_cols))[:5]}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b][:4]
        return f"{len(bad)} of {len(got)} rows differ, first: {cells}"
    kinds = [
        (c, type(a).__name__, type(b).__name__)
        for r, s in zip(got[:50], want[:50])
        for c, a, b in zip(got_cols, r, s)
        if a is not None and type(a) is not type(b)
    ]
    return f"types differ: {sorted(set(kinds))[:4]}" if kinds else None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from riskframe.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = duck(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                message = compare(spark, con, name, fn, sqls[name], sf)
            else:
                n = len(fn(spark, sf).collect())
                message = None if n else "no rows"
        except Exception as error:
            message = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name} {time.time() - start:.1f}s{'' if name in sqls else ' (rows only)'} {message or ''}", flush=True)
    print("failed:", failed)
