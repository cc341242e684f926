"""Scans, sinks and flows on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import rotations, text, vectors
from tidewell.operators import quality, scoring, segments
from tidewell.sources import episodes, sinks
from tidewell.streaming import flows


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    for name, depth in (("setA", "arm"), ("setB", "arm")):
        base = at / depth / name
        for ep, n in ((0, 3), (1, 1), (2, 5)):
            rows = [(i, ep, float(i), [0.0, 1.0]) for i in range(n)]
            out = base / "data" / "chunk-000"
            out.mkdir(parents=True, exist_ok=True)
            df = spark.createDataFrame(rows, "frame_index long, episode_index long, timestamp double, action array<double>")
            df.toPandas().to_parquet(out / f"episode_{ep:06d}.parquet")
        (base / "meta").mkdir()
        (base / "meta" / "episodes.jsonl").write_text('{"episode_index": 0, "length": 3, "tasks": ["a"]}\n\n{"episode_index": 1, "length": 1, "tasks": []}\n')
        (base / "meta" / "info.json").write_text(json.dumps({"fps": 30}))
    return at


def test_scan_takes_ids_from_paths(spark, root):
    df = episodes.scan_frames(spark, str(root / "arm" / "setA"), ["frame_index", "episode_index"])
    assert df.count() == 9 and {r.episode_file for r in df.select("episode_file").distinct().collect()} == {0, 1, 2}
    assert episodes.usable_episodes(df).select("episode_index").distinct().count() == 2
    assert episodes.usable_episodes(df, most=1).select("episode_index").distinct().count() == 1
    with pytest.raises(ValueError, match="columns not found"):
        episodes.scan_frames(spark, str(root / "arm" / "setA"), ["none"])


def test_json_lines(spark, root, tmp_path):
    assert episodes.read_jsonl(spark, str(root / "arm/setA/meta/episodes.jsonl"), episodes.EPISODES).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"task_index": 1, "task": "x"}\nnot json\n\n')
    assert episodes.read_jsonl(spark, str(bad), episodes.TASKS, strict=False).count() == 1
    good, wrong = episodes.split_jsonl(spark, str(bad), episodes.TASKS)
    assert good.count() == 1 and wrong.count() == 1
    array = tmp_path / "a.json"
    array.write_text('[{"task_index": 1, "task": "x"}, {"task_index": 2, "task": "y"}]')
    assert episodes.read_json_any(spark, str(array), episodes.TASKS).count() == 2


def test_discovery(spark, root):
    assert [r.name for r in episodes.leaf_datasets(spark, str(root)).collect()] == ["setA", "setB"]
    assert [r.name for r in episodes.leaf_datasets(spark, str(root), skip=("setB",)).collect()] == ["setA"]
    got = episodes.datasets_at_depth(spark, str(root), 2).collect()
    assert [(r.robot_type, r.name) for r in got] == [("arm", "setA"), ("arm", "setB")]


def test_bad_files(spark, root, tmp_path):
    (tmp_path / "episode_000001.parquet").write_bytes(b"")
    (tmp_path / "episode_000002.parquet").write_bytes(b"PAR1 but no footer")
    got = {r.path.split("/")[-1]: r.reason for r in episodes.bad_files(spark, str(tmp_path)).collect()}
    assert got == {"episode_000001.parquet": "empty file", "episode_000002.parquet": "unreadable footer"}
    assert episodes.bad_files(spark, str(root)).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, None), ("a", "y", 2, "no view")], "dataset string, sub_dataset string, v int, reason string")
    sinks.write_unified(df, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2
    kept, skipped = sinks.split_skipped(df)
    assert kept.count() == 1 and skipped.count() == 1
    sinks.write_sidecar({"left": (0, 7)}, {"left": "abs_joint"}, df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).head().slots.left == [0, 7]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_quality_branches(spark):
    still, moves = [0.0, 0.0], [[0.0, 0.0], [1.0, 1.0]]
    rows = [("one", 0, still, still)] + [("still", i, still, still) for i in range(2)] + [("half", i, still, moves[i]) for i in range(2)] + [("same", i, moves[i], moves[i]) for i in range(2)]
    df = spark.createDataFrame(rows, "episode string, frame int, state array<double>, action array<double>")
    got = {r.episode: r.l2_score for r in quality.l2_scores(df).collect()}
    assert got == {"one": None, "still": 0.0, "half": float("inf"), "same": 0.0}
    reasons = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.1,)], "s double").select(quality.l2_reason(F.col("s"), F.lit(0.2)).alias("r")).collect()
    assert [r.r for r in reasons] == ["no_valid_frames", "score_not_a_number", "l2_above_threshold", None]


def test_rotations_round_trip(spark):
    df = spark.createDataFrame([([0.3, -0.5, 1.2],), ([-2.0, 0.1, 0.4],)], "e array<double>").withColumn("q", rotations.from_euler(F.col("e")))
    for kind in ("rotvec", "wxyz", "euler", "matrix", "six"):
        back = df.withColumn("b", rotations.decode(rotations.encode(F.col("q"), kind), kind)).select(rotations.geodesic(F.col("q"), F.col("b")).alias("d")).collect()
        assert all(r.d < 1e-6 for r in back), kind


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(ValueError, match="slots"):
        vectors.slot_fill({"left_gripper": (F.col("v"), 3)})
    value, mask = vectors.slot_fill({"left_joint": (F.col("v"), 3)})
    row = df.select(value.alias("x"), mask.alias("m")).head()
    assert len(row.x) == 80 and sum(row.m) == 3
    noise = df.select(vectors.noisy(F.col("v"), F.lit(1), 0.1, 3, F.transform("v", lambda x: x - 0.05), F.transform("v", lambda x: x + 0.05)).alias("n")).head().n
    assert all(abs(a - b) <= 0.05 + 1e-9 for a, b in zip(noise, [1, 2, 3]))
    with pytest.raises(Exception, match="expected width"):
        df.select(vectors.of_width(F.col("v"), 4)).collect()


def test_text(spark):
    df = spark.createDataFrame([("[“a”, “b”]", 'x {"a": {"b": "}"}} y'), (None, "none"), ("{1}", '```json\n{"k": 1}\n```')], "s string, j string")
    got = df.select(text.parse_steps("s").alias("s"), text.json_object("j").alias("j")).collect()
    assert [r.s for r in got] == [["a", "b"], None, None]
    assert [r.j for r in got] == ['{"a": {"b": "}"}}', None, '{"k": 1}']


def test_direct_alignment(spark):
    rows = [("s", [("action_sequence", "match"), ("quantity", "partial")], [("ran",)])]
    df = spark.createDataFrame(rows, "sample_id string, gt_evaluations array<struct<capability:string,label:string>>, hallucinated_actions array<struct<description:string>>")
    got = {r.capability: (r.G, r.C) for r in scoring.label_counts(scoring.from_direct(df), ["sample_id", "capability"]).collect()}
    assert got == {"action_sequence": (1, 2), "quantity": (1, 1)}


def test_clip_steps(spark):
    eps = spark.createDataFrame([(1, "[[0, 2], [3, 9]]")], "ep long, time_clip string")
    frames = spark.createDataFrame([(1, 0, "go"), (1, 1, "x"), (1, 2, "y")], "ep long, frame long, desc string")
    got = [(r.i, r.desc, r.start, r.end) for r in segments.clip_steps(eps, frames, "ep").orderBy("i").collect()]
    assert got == [(0, "go", 0, 2), (1, "go", 3, 9)]


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.orderBy("event_id").repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = flows.hourly(flows.read_events(spark, str(tmp_path / "in"), 10))
    q = stream.writeStream.format("memory").queryName("hourly_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda r: (r.event_type, r.hour, r.n)
    assert sorted(map(key, spark.table("hourly_test").collect())) == sorted(map(key, flows.hourly(source).collect()))

    q = flows.read_events(spark, str(tmp_path / "in")).writeStream.foreachBatch(flows.upsert_into(str(tmp_path / "out"), "user_id", "event_id")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    got = {r.user_id: r.event_id for r in flows.current(spark, str(tmp_path / "out"), "user_id", "event_id").collect()}
    assert got == {r.user_id: r.m for r in source.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_interval_sampler(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 20")
    source.write.parquet(str(tmp_path / "in"))
    q = flows.sample_by_interval(flows.read_events(spark, str(tmp_path / "in")), 3600).writeStream.format("memory").queryName("due_test").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.event_id) for r in spark.table("due_test").collect()}
    want, due = set(), {}
    for r in sorted(source.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user_id not in due or (r.ts - due[r.user_id]).total_seconds() >= 3600:
            want.add((r.user_id, r.event_id))
            due[r.user_id] = r.ts
    assert got == want
