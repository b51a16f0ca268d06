import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(sdf, con, sql):
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(scols) == sorted(ocols)
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    oi = [ocols.index(c) for c in order]
    s = sorted((tuple(norm(r[i]) for i in si) for r in srows), key=_key)
    o = sorted((tuple(norm(r[i]) for i in oi) for r in orows), key=_key)
    assert len(s) == len(o)
    assert s == o
