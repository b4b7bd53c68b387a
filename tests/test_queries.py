"""Every query of the core against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from orbspan.plans import core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if pd.isna(x):
        return None
    return int(x) if isinstance(x, float) and x == int(x) else x


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def engine():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def compare(spark, queries, sql, name):
    got = table(queries[name](spark, DATA).toPandas())
    if name in sql:
        assert got == table(engine().sql(sql[name]).df())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    compare(spark, core.QUERIES, core.SQL, name)


def test_native_covers_against_brute_force(spark, tmp_path):
    from collections import Counter

    from test_kernels import QUAD, brute, xyz

    rings = {k: (xyz(*[(lon + 7 * k, lat + 3 * k) for lon, lat in QUAD]), 3 + k % 4) for k in range(12)}
    rings[12] = rings[3]
    rows = [(k, [tuple(map(float, p)) for p in v], r) for k, (v, r) in rings.items()] + [(13, None, 4)]
    schema = "footprint_id bigint, vertices array<struct<x:double,y:double,z:double>>, resolution int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/footprints.parquet")
    want = {k: brute(v, r).tolist() for k, (v, r) in rings.items()}
    got = {q: list(map(tuple, core.QUERIES[q](spark, str(tmp_path)).collect())) for q in ("cover_footprints_native", "cover_arrays_native", "revisit_count_native", "union_cover_native", "coverage_offsets_native")}
    visits = Counter(c for cells in want.values() for c in cells)
    assert max(visits.values()) > 1
    assert sorted(got["cover_footprints_native"]) == sorted((k, c) for k, cells in want.items() for c in cells)
    assert {k: sorted(c) for k, c in got["cover_arrays_native"]} == want
    assert dict(got["revisit_count_native"]) == visits
    assert sorted(c for (c,) in got["union_cover_native"]) == sorted(visits)
    ends, at = [], 0
    for k in sorted(want):
        ends.append((k, at, at + len(want[k])))
        at += len(want[k])
    assert sorted(got["coverage_offsets_native"]) == ends
