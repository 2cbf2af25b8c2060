"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tracelake.plans import catalog, entities, identity, network, retrieval  # noqa: F401  all register

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(records, cols):
    def key(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(key(r[c]) for c in cols) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    have = rows([r.asDict() for r in got.collect()], cols)
    if name not in catalog.ORACLES:
        assert have
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert have == rows([dict(zip(names, r)) for r in want.fetchall()], cols)
