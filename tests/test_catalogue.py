"""Every query with an SQL twin gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewell.operators import trajectories
from tidewell.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 9)
    if isinstance(v, np.generic):
        return v.item()
    return v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_pairs_and_clusters_take_every_vector(spark, con):
    label = dict(con.execute("SELECT vec_id, label FROM embeddings").fetchall())
    vec = {i: np.array(v, dtype=float).reshape(-1, 8) for i, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    pairs = {(a, b) for a in vec for b in vec if a < b and label[a] == label[b]}
    assert max(vec) > 300
    for name, how in (("dtw_banded", {"window": 2}), ("dtw_two_stage", {"two_stage": True})):
        got = {(r.a, r.b): r.d for r in catalogue.QUERIES[name](spark, FOLDER).collect()}
        assert got.keys() == pairs
        for a, b in sorted(pairs)[::97]:
            assert abs(got[a, b] - trajectories.distance(vec[a], vec[b], "joint", **how)["d"]) < 1e-5
    for name in ("hier_cluster", "recursive_cluster", "kmedoids"):
        got = catalogue.QUERIES[name](spark, FOLDER).collect()
        assert {(r.id, r.grp) for r in got} == {*label.items()} and len(got) == len(label)
        dist = lambda i, j: np.linalg.norm(vec[i] - vec[j])
        for g, c in {(r.grp, r.label) for r in got}:
            inside = [r.id for r in got if (r.grp, r.label) == (g, c)]
            cost = {i: sum(dist(i, j) for j in inside) for i in inside}
            (medoid,) = [r.id for r in got if (r.grp, r.label) == (g, c) and r.is_medoid]
            assert cost[medoid] <= min(cost.values()) + 1e-9
