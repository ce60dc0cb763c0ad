"""Compare a query's rows with its SQL on the same tables."""
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, query, sql, sf_dir):
    """None if all rows are equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        only = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{name}: {len(got)} and {len(want)} rows; only ours {only[0]}, only SQL {only[1]}"
    kinds = dict(df.dtypes)
    types = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    odd = {c: (kinds[c], str(t)) for c, t in zip(rel.columns, rel.types) if types.get(str(t), "?") != kinds[c]}
    return f"{name}: types {odd}" if odd else None
