"""Order-insensitive comparison of a DataFrame and a DuckDB result."""

import math


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def of_duck(con, sql):
    found = con.execute(sql)
    return table([d[0] for d in found.description], found.fetchall())
