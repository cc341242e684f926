"""Pairs from blocks, and clustering of large groups, against plain definitions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.test_catalogue import FOLDER, rows
from tidewell.operators import blocks
from tidewell.operators import trajectories as t
from tidewell.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def one_label(spark, tmp_path):
    def write(n):
        g = np.random.default_rng(n)
        x = (g.integers(0, 3, n)[:, None] * 5 + g.random((n, 64))).astype(np.float32)
        pd.DataFrame({"vec_id": np.arange(n), "label": np.zeros(n, dtype=np.int32), "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
        return str(tmp_path), x.astype(float)

    return write


def check_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "BLOCK", 16)  # several blocks for each label
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert "zip_with" not in plan(df).lower() and "MapInPandas" not in plan(df)  # no row of two vectors for each pair
    assert rows(df.toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


def check_trajectories(spark, monkeypatch, name, **how):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert "MapInPandas" not in plan(df)  # no row of two trajectories for each pair
    vec = {r.vec_id: np.array(r.embedding, dtype=float).reshape(-1, 8) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    got = df.collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 12432
    for r in got[::53]:
        want = t.distance(vec[r.a], vec[r.b], "joint", **how)
        assert all(abs(r[c] - want[c]) < 2e-6 for c in r.asDict() if c not in "ab")


def check_large(spark, one_label, name, apart=True):
    folder, x = one_label(5100)  # more than 5000 were refused once
    got = sorted(catalogue.QUERIES[name](spark, folder).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(5100))
    blob = np.round((x.mean(axis=1) - 0.5) / 5).astype(int)
    for c in {r.label for r in got}:
        inside = np.array([r.id for r in got if r.label == c])
        assert not apart or len(set(blob[inside])) == 1  # clusters keep to the three clouds
        (middle,) = [r.id for r in got if r.label == c and r.is_medoid]
        sums = [np.linalg.norm(x[inside] - x[i], axis=1).sum() for i in (middle, *inside[:20])]
        assert min(sums) >= sums[0] - 1e-6


@pytest.mark.parametrize("method", ["average", "complete", "single"])
def test_linkage_merges_the_first_smallest_cell(method):
    """Against the plain search of the whole matrix for each merge, with many ties."""
    for seed in range(20):
        g = np.random.default_rng(seed)
        x = g.integers(0, 4, (30, 2)).astype(float) if seed % 2 else g.random((30, 3))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        tree = t.linkage(d, method)
        np.fill_diagonal(d, np.inf)
        names, sizes = list(range(30)), np.ones(30)
        for step, (left, right, height, size) in enumerate(tree):
            i, j = sorted(divmod(int(d.argmin()), 30))
            assert (left, right, size) == (*sorted((names[i], names[j])), sizes[i] + sizes[j]) and height == d[i, j]
            new = {"average": (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j]), "complete": np.maximum(d[i], d[j]), "single": np.minimum(d[i], d[j])}[method]
            d[i] = d[:, i] = new
            d[i, i] = d[j] = d[:, j] = np.inf
            sizes[i] += sizes[j]
            names[i] = 30 + step


def test_distances_in_a_file_are_the_same(monkeypatch):
    x = np.random.default_rng(2).random((5, 40))
    held = t.linkage(t.Points(x))
    monkeypatch.setattr(t, "MOST_IN_MEMORY", 0)
    assert np.array_equal(t.linkage(t.Points(x)), held)


def test_hier_cluster_takes_large_groups(spark, one_label):
    check_large(spark, one_label, "hier_cluster")


def test_kmedoids_takes_large_groups(spark, one_label):
    check_large(spark, one_label, "kmedoids", apart=False)  # a local optimum may split a cloud


def test_recursive_cluster_takes_large_groups(spark, one_label):
    check_large(spark, one_label, "recursive_cluster")


@pytest.mark.parametrize("kind", ["joint", "pose"])
@pytest.mark.parametrize("how", [{}, {"window": 2}, {"window": 0, "normalized": False}, {"normalized": False}, {"two_stage": True}, {"two_stage": True, "window": 1}])
def test_many_distances_are_those_of_one(kind, how):
    g = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 4), (5, 2), (6, 6)):
        a, b = g.integers(0, 3, (n, 8, 9)) / 2, g.random((m, 8, 9))
        got = t.many_distances(a, b, kind, **how)
        for p in range(9):
            want = t.distance(a[:, :, p], b[:, :, p], kind, **how)
            assert all(np.isclose(got[c][p], want[c], rtol=1e-12, atol=1e-12) for c in want)


def test_dtw_banded_from_blocks(spark, monkeypatch):
    check_trajectories(spark, monkeypatch, "dtw_banded", window=2)


def test_dtw_pairs_from_blocks(spark, monkeypatch):
    check_blocks(spark, monkeypatch, "dtw_pairs")
    check_trajectories(spark, monkeypatch, "dtw_pairs", normalized=False)


def test_dtw_two_stage_from_blocks(spark, monkeypatch):
    check_trajectories(spark, monkeypatch, "dtw_two_stage", two_stage=True)


def test_all_pairs_from_blocks(spark, monkeypatch):
    check_blocks(spark, monkeypatch, "all_pairs")


def test_pairs_without_a_distance(spark):
    rows = [(1, 1, [0.0, 0.0]), (1, 2, [3.0, 4.0]), (1, 3, None), (1, 4, [1.0, None]), (1, 5, [1.0]), (1, 5, [2.0]), (1, None, [0.0, 0.0]), (None, 6, [0.0, 0.0]), (2, 7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, k long, v array<float>")
    got = sorted((r.a, r.b, r.d) for r in blocks.distances(df, "g", "k", "v").collect() if r.b != 5)
    assert got == [(1, 2, 5.0), (1, 3, None), (1, 4, None), (2, 3, None), (2, 4, None), (3, 4, None)]
    ends = [(r.a, r.b) for r in blocks.distances(df, "g", "k", "v").collect() if r.b == 5]
    assert sorted(ends) == [(a, 5) for a in (1, 1, 2, 2, 3, 3, 4, 4)]  # equal keys aren't paired
    assert blocks.distances(df.limit(0), "g", "k", "v").count() == 0


def test_matrix_stats_from_blocks(spark, monkeypatch):
    check_blocks(spark, monkeypatch, "matrix_stats")


def test_stats_of_pairs_without_a_distance(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (1, 2, [3.0]), (1, 3, None), (1, 4, [7.0]), (2, 5, None), (2, 6, [1.0])], "g int, k long, v array<float>")
    got = {r.grp: r for r in blocks.distance_stats(df, "g", "k", "v").collect()}
    assert (got[1].min_d, got[1].max_d, got[1].n_pairs) == (3.0, 7.0, 6)
    assert np.isclose(got[1].mean_d, 14 / 3) and np.isclose(got[1].std_d, np.std([3, 4, 7]))
    assert tuple(got[2]) == (2, None, None, None, None, 1)


def test_large_groups_are_not_put_into_one_task(spark):
    df = spark.range(6000).selectExpr("id % 6 AS g", "id AS k", "array(cast(id AS float), 0.0f) AS v")
    assert t.vector_clusters(df, "g", "k", "v").rdd.getNumPartitions() >= 8
