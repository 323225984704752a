"""Rows of a Spark query and of its oracle in one comparable form."""

import math


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "is_finite") or isinstance(value, float):
        number = float(value)
        return None if math.isnan(number) else round(number, 6)
    return str(value) if hasattr(value, "isoformat") else value


def same(spark_df, connection, sql):
    names = sorted(spark_df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in spark_df.collect()), key=repr)
    found = connection.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted((tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall()), key=repr)
    assert got == want
