"""Every core query with SQL against DuckDB on the smallest tables; every other query runs."""

import math

import pytest
from edgeloom.plans import quality, registry


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


NAMES = [n for n in registry.QUERIES if n not in quality.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in registry.SQL:
        assert df.columns
        return
    cur = duck.execute(registry.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got) == sorted(tuple(norm(x) for x in r) for r in cur.fetchall())
