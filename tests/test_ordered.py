"""Sliced running sums and quantiles, Euler conventions, JSON variants and both episode layouts against plain Python."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import rotations, text
from tidewell.operators import conversations, ordered, quality, reports, stats
from tidewell.sources import episodes


def test_binary_search_counts_limits_below(spark):
    for at in ([], [1.0], [-2.0, 0.5, 0.75, 3.0, 9.0], list(map(float, range(100)))):
        values = [None, -5.0, -2.0, 0.5, 0.6, 3.0, 8.5, 9.0, 98.0, 99.5, math.inf]
        got = spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered.slice_of(F.col("x"), at).alias("n")).collect()
        assert [r.n for r in got] == [0 if v is None else sum(a < v for a in at) for v in values]


def test_running_sum_over_hot_and_null_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(["a", "a", "a", "b", None][rng.integers(5)], int(i * 3), None if i % 11 == 0 else int(rng.integers(-3, 9))) for i in rng.permutation(400)]
    df = spark.createDataFrame(rows, "k string, at long, n long")
    got = {(r.k, r["at"]): r.upto for r in ordered.running_sum(df, ["k"], "at", "n", "upto").collect()}
    sums = {}
    for k, at, n in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + (n or 0)
        assert got[k, at] == sums[k]
    assert len(got) == 400
    assert ordered.running_sum(df.limit(0), [], "at", "n", "upto").collect() == []


@pytest.mark.parametrize("spread", [1, 3, 10_000])
def test_quantiles_are_exact(spark, spread):
    rng = np.random.default_rng(spread)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "rare"], 700), "x": rng.integers(0, spread, 700).astype(float)})
    pdf.loc[0, "k"] = "single"
    shares = {"low": 0.0, "q01": 0.01, "third": 1 / 3, "median": 0.5, "q99": 0.99, "high": 1.0}
    got = {r.k: r for r in ordered.quantiles(spark.createDataFrame(pdf), ["k"], "x", shares).collect()}
    assert got.keys() == set(pdf.k)
    for k, g in pdf.groupby("k"):
        for name, p in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(g.x, p), abs=1e-9)


def test_statistics_without_values(spark):
    empty = spark.createDataFrame([], "k string, v array<double>")
    assert stats.by_dimension(empty, "v", ["k"]).collect() == []
    nulls = spark.createDataFrame([(None, [None, 2.0])], "k string, v array<double>")
    got = {r.dim: (r.n, r["min"], r.q99) for r in stats.by_dimension(nulls, "v", ["k"]).collect()}
    assert got == {0: (1, None, None), 1: (1, 2.0, 2.0)}
    row = quality.distribution(spark.createDataFrame([(math.inf,), (math.nan,), (None,)], "x double"), "x").head()
    assert (row.n, row.n_inf, row["median"], row.p99) == (0, 1, None, None)


def test_kruskal_leaves_out_rows_without_value(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 5.0), ("c", 7.0), ("c", 0.5)]
    names, values = zip(*rows)
    ranks = pd.Series(values).rank()
    n = len(rows)
    h = 12 / (n * (n + 1)) * sum(g.sum() ** 2 / len(g) for _, g in ranks.groupby(pd.Series(names))) - 3 * (n + 1)
    ties = sum(t**3 - t for t in pd.Series(values).value_counts())
    df = spark.createDataFrame([*rows, ("a", None), (None, 3.0)], "g string, x double")
    assert reports.kruskal(df, "g", "x").head().h == pytest.approx(h / (1 - ties / (n**3 - n)), abs=1e-6)


def _turned(axis, a):
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m = np.eye(3)
    m[i, i] = m[j, j] = math.cos(a)
    m[i, j], m[j, i] = -math.sin(a), math.sin(a)
    return m


def test_all_euler_conventions(spark):
    angles = [(0.3, 0.4, -1.1), (-2.5, 1.2, 2.9), (0.0, 0.7, 0.0)]
    df = spark.createDataFrame([(list(a),) for a in angles], "e array<double>")
    names = ["".join(c) for c in itertools.product("XYZ", repeat=3) if c[0] != c[1] and c[1] != c[2]]
    columns = [c for n in names for c in (rotations.to_matrix(rotations.decode(F.col("e"), f"euler_{n}")).alias(f"m{n}"), rotations.encode(rotations.decode(F.col("e"), f"euler_{n}"), f"euler_{n}").alias(f"e{n}"))]
    for a, row in zip(angles, df.select(*columns).collect()):
        for n in names:
            x, y, z = (_turned("XYZ".index(c), v) for c, v in zip(n, a))
            assert np.allclose(np.reshape(row[f"m{n}"], (3, 3)), x @ y @ z, atol=1e-9), n
            assert np.allclose(row[f"e{n}"], a, atol=1e-9), n
    assert rotations._axes("ypr") == [2, 1, 0]
    for wrong in ("XX", "XXY", "abc", "XYZX"):
        with pytest.raises(ValueError, match="convention"):
            rotations._axes(wrong)


CASES = {  # answer: what annotation, judge, caption and answers read
    '{"k": 1}': ('{"k": 1}',) * 4,
    "[1]": ("[1]", "[1]", None, None),
    '<think>{"k": 0}</think>```json\n{"k": 1}\n```': ('{"k": 1}',) * 4,
    '<think>{"k": 0}</think>{"k": 1}': ('{"k": 1}', '{"k": 1}', '{"k": 1}', None),
    'lost</think> {"k": 1} }': ('{"k": 1}', '{"k": 1}', None, None),
    '"{" {"k": "}"}': ('{"k": "}"}', None, None, None),
    '{"k": "}"} x': ('{"k": "}"}', None, '{"k": "}"}', '{"k": "}"}'),
    '```\nsee {"k": 1}\n``` {"k": 2}': ('{"k": 1}', '{"k": 1}', None, None),
    '{"k": ': (None,) * 4, "": (None,) * 4, "none": (None,) * 4,
}


def test_json_variants(spark):
    df = spark.createDataFrame([(s,) for s in [*CASES, None]], "s string")
    names = ("annotation", "judge", "caption", "answers")
    for row in df.select("s", *[text.json_answer(F.col("s"), n).alias(n) for n in names]).collect():
        assert tuple(row[n] for n in names) == CASES.get(row.s, (None,) * 4), row.s
    with pytest.raises(ValueError, match="unknown variant"):
        text.json_answer(F.col("s"), "other")
    answers = spark.createDataFrame([('{"answers": {"q1": " a ", "q2": 3}}',), ('{"q": "b"}',), ("none",)], "s string")
    assert [r.m for r in answers.select(text.answer_map(F.col("s")).alias("m")).collect()] == [{"q1": "a", "q2": "3"}, {"q": "b"}, {}]


def test_padding_on_both_sides(spark):
    rows = [(0, 0, [1, 2, 3, 4], [5, 6, 7, 8]), (0, 1, [9], [9]), (1, 2, [], [])]
    df = spark.createDataFrame(rows, "batch long, n long, input_ids array<long>, labels array<long>")
    right = {r.n: r for r in conversations.padded(df, "batch", 3, 0).collect()}
    assert right[1].input_ids == [9, 0, 0] and right[1].labels == [9, -100, -100] and right[1].attention == [True, False, False]
    assert right[0].input_ids == [1, 2, 3] and right[2].input_ids == []
    left = {r.n: r for r in conversations.padded(df, "batch", 3, 0, left=True).collect()}
    assert left[1].input_ids == [0, 0, 0] and left[0].labels == [5, 6, 7]
    flat = {r.batch: r for r in conversations.flattened(df, "batch", "n").collect()}
    assert flat[0].input_ids == [1, 2, 3, 4, 9] and flat[0].bounds == [0, 4, 5] and flat[1].bounds == [0, 0]


def test_paths_from_template_or_listing(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    info = {"total_episodes": 3, "chunks_size": 2, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"}
    (tmp_path / "meta" / "info.json").write_text(json.dumps(info))
    for chunk, ep in ((0, 0), (0, 1), (1, 7)):
        at = tmp_path / "data" / f"chunk-{chunk:03d}"
        at.mkdir(parents=True, exist_ok=True)
        pd.DataFrame({"x": [1]}).to_parquet(at / f"episode_{ep:06d}.parquet")
    paths = {r.episode_index: r.path for r in episodes.episode_paths(spark, str(tmp_path)).collect()}
    assert paths[2] == f"{tmp_path}/data/chunk-001/episode_000002.parquet" and len(paths) == 3
    (tmp_path / "data" / "chunk-000" / "episode_000001.parquet").unlink()
    assert [r.episode_index for r in episodes.episode_paths(spark, str(tmp_path)).collect()] == [0, 7]
    (tmp_path / "meta" / "info.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        episodes.episode_paths(spark, str(tmp_path))


def test_files_of_many_episodes(spark, tmp_path):
    meta, data = tmp_path / "meta" / "episodes" / "chunk-000", tmp_path / "data" / "chunk-000"
    meta.mkdir(parents=True)
    data.mkdir(parents=True)
    shift = "videos/observation.images.wrist/from_timestamp"
    pd.DataFrame({"episode_index": [4, 5], "length": [2, 1], "data/chunk_index": [0, 0], "data/file_index": [0, 1], shift: [0.0, 10.0]}).to_parquet(meta / "file-000.parquet")
    pd.DataFrame({"episode_index": [4, 4, 5], "timestamp": [0.0, 0.5, 7.0]}).to_parquet(data / "file-000.parquet")
    pd.DataFrame({"episode_index": [5], "timestamp": [0.25]}).to_parquet(data / "file-001.parquet")
    rows = episodes.read_v3_episodes(spark, str(tmp_path)).orderBy("episode_index").collect()
    assert [(r.episode_index, r.length, r.file_index, r.file_from_index, r.from_timestamp) for r in rows] == [(4, 2, 0, 0, 0.0), (5, 1, 1, 1, 10.0)]
    got = episodes.scan_v3_frames(spark, str(tmp_path)).collect()
    assert sorted((r.episode_index, r.timestamp) for r in got) == [(4, 0.0), (4, 0.5), (5, 10.25)]
