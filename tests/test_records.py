"""Layouts and records."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import frames, layouts, text
from tidewell.operators import joins, records, stats


def one(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def test_layout_plans(spark):
    assert layouts.type_tag("abs_quat") == ("abs", "quat")
    with pytest.raises(ValueError, match="type tag"):
        layouts.type_tag("quat")
    assert layouts.eef_parts({"left_eef.xyz": "abs_xyz", "left_eef.rot": "delta_euler", "right_joint": "abs_joint"}) == {"left_eef": (["left_eef.xyz", "left_eef.rot"], "delta_euler")}
    assert layouts.effector({"left_hand", "left_gripper"}, "left") == "left_hand" and layouts.effector(set(), "left") is None
    assert layouts.first_side({"left_eef"}, "eef") == "left"
    assert layouts.export_order(["a_gripper", "b"], True) == ["b", "a_gripper"]
    assert layouts.export_mask(["b", "a_gripper"], {"b": 2, "a_gripper": 1}) == [True, True, False]
    assert layouts.dimension_names({"x": ["a", "b"]}, 2) == ["a", "b"] and layouts.dimension_names(None, 2) == ["dim_0", "dim_1"]
    features = {"observation.images.b": {"dtype": "video"}, "observation.images.a": {"dtype": "video"}, "observation.state": {"dtype": "float32"}, "action": {"dtype": "float32"}, "timestamp": {"dtype": "float32"}}
    assert layouts.video_keys(features) == ["a", "b"] and layouts.video_keys(features, ["b"]) == ["b", "a"]
    assert layouts.vector_fields(features) == {"state": ["observation.state"], "action": ["action"]}
    fixed = layouts.repaired_modality({"state": 1}, {"action": 2}, features)
    assert fixed["action"] == 2 and list(fixed["video"]) == ["image_0", "image_1"]
    with pytest.raises(ValueError, match="binary"):
        layouts.transform_key(layouts.KeySpec("q99", continuous=False), F.lit(None), {})
    df = one(spark, "v array<double>, s array<double>, f array<double>", [1.0, 2.0], [0.5, 0.5], [1.0, 1.0])
    row = df.select(layouts.rejointed("rel", "delta", F.col("s"), F.col("v"), F.col("f")).alias("r"), layouts.joint_vector(F.col("v"), None).alias("j"), layouts.joined(layouts.taken_apart(F.col("v"), {"a": 1, "b": 1}), ["b", "a"]).alias("k")).head()
    assert (row.r, row.j, row.k) == ([0.5, 1.5], [1.0, 2.0], [2.0, 1.0])
    six = df.select(layouts.transform_key(layouts.KeySpec("min_max", "euler", "six"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), {}).alias("x")).head().x
    assert six == pytest.approx([1, 0, 0, 0, 1, 0])


def test_poses(spark):
    df = one(spark, "s array<double>, a array<double>", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], [2.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0])
    row = df.select(layouts.reposed("delta", "abs", F.col("s"), F.col("a"), F.col("s")).alias("d"), layouts.reposed("rel", "abs", F.col("s"), F.col("a"), F.col("s")).alias("r")).head()
    assert row.d == pytest.approx([1, 1, 0, 0, 0, 1, 0]) and row.r == pytest.approx([1, 1, 0, 0, 0, 1, 0])


def test_steps_and_routes(spark):
    df = one(spark, "steps array<struct<i:int,desc:string,start:int,end:int>>, raw string", [(0, "none", 0, 1), (1, "go", 1, 2), (2, None, 2, 3), (3, "stop", 3, 4)], "x")
    row = df.select(records.densely_numbered(records.real_steps(F.col("steps"))).alias("d"), records.instruction_steps(records.real_steps(F.col("steps")), F.col("raw")).alias("t"), records.truth_status(F.col("raw"), F.array()).alias("u")).head()
    assert [(s.i, s.desc) for s in row.d] == [(0, "go"), (1, "stop")] and row.t == ["go", "stop"] and row.u == "skip_malformed_gt"
    rows = spark.createDataFrame([(True, ["a"], None), (True, [" "], None), (None, None, None), (True, ["a"], "{")], "ok boolean, steps array<string>, bad string")
    assert [r.route for r in records.routed(rows, "ok", "steps", "bad").collect()] == ["success", "failed", "failed", "bad_json"]
    caps = spark.createDataFrame([("s", [" a  b ", ""], 1), ("s", ["c"], 2)], "sample_id string, caption_result array<string>, line int")
    assert [tuple(r) for r in records.captions(caps, "line").collect()] == [("s", ["c"])]
    views = one(spark, "v array<string>, p array<string>", ["a", "b"], ["b"]).select(records.rejection(F.col("v"), F.col("p")).alias("r"), records.rejection(F.col("v"), F.array()).alias("q")).head()
    assert views.r is None and views.q == "all_videos_missing"


def test_answers_and_prompts(spark):
    df = one(spark, "a map<string,string>, ids array<string>", {"Q1": "yes", "[b]": "no"}, ["a", "b", "c"])
    assert df.select(records.remapped_answers(F.col("a"), F.col("ids")).alias("m")).head().m == {"a": "yes", "b": "no"}
    qs = spark.createDataFrame([("s", 2, "q2", "How many?", None), ("s", 1, "q1", "Which?", ["cup", "box"])], "sample_id string, n int, question_id string, question string, options array<string>")
    assert records.question_blocks(qs).head().prompt == "[q1] Which?\nA. cup\nB. box\n\n[q2] How many?"
    model, number = records.from_file_name(F.lit("out/m_x_round3.json"))
    prefix, trailing = records.id_parts(F.lit("set_a_017"))
    assert tuple(spark.range(1).select(model, number, prefix, trailing).head()) == ("m_x", 3, "set_a", 17)
    views = F.array(F.lit("side"), F.lit("wrist_left"))
    got = spark.range(1).select(text.ordered_views(views, ["wrist_left"]), text.stage_view(["none"], views, "wrist"), text.error_kind(F.lit("Timeout: 3")), text.sampling_rate(F.lit("d%50")), text.ordered_steps(F.create_map(F.lit("step 10"), F.lit("b"), F.lit("step 9"), F.lit("a")))).head()
    assert tuple(got) == (["wrist_left", "side"], "wrist_left", "Timeout", 0.5, ["a", "b"])


def test_stages(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    out = records.run_stages(df, [("a", [], lambda d: (d, F.col("x") * 10, F.col("x") == 1)), ("b", ["a"], lambda d: (d, F.col("a_result") + 1, F.lit(True)))])
    assert [tuple(r)[1:] for r in out.orderBy("x").collect()] == [("success", 10, "success", 11), ("failed", None, "skipped", None)]


def test_frames(spark):
    row = spark.range(1).select(frames.by_clip(F.lit(10), F.lit(3.0), 1.0, 2, 5).alias("c"), frames.by_interval(F.array(*[F.lit(x) for x in (0.0, 0.4, 1.0, 1.5, 2.1)]), 1.0).alias("i"), frames.evenly(F.lit(0), 3).alias("z")).head()
    assert row.c == [0, 4, 9] and row.i == [0.0, 1.0, 2.1] and row.z == []


def test_small_tables(spark):
    limits = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "tag string, config string, fps int")
    assert stats.conflicting_tags(limits.unionByName(limits.where("tag = 'a'").withColumn("fps", F.lit(9))), "tag", ["config", "fps"]).collect()[0].fields == ["fps"]
    twice = spark.createDataFrame([("d", "r", 1, 5), ("d", "r", 2, 6)], "dataset string, robot_type string, n int, weight int")
    assert stats.without_repeats(twice, "n").head().weight == 5
    keys = spark.range(10_001).selectExpr("string(id * 3) AS key", "id AS pos")
    names = spark.createDataFrame([("run/27000x",), ("a/b",), ("",)], "name string")
    assert {r.name: r.key for r in joins.match_names(names, keys).collect()} == {"run/27000x": "0", "a/b": "b", "": ""}
    long = keys.where("length(key) > 3").unionByName(keys.where("pos > 9990").selectExpr("'run/2' AS key", "pos + 50000 AS pos"))
    assert {r.name: r.key for r in joins.match_names(names, long.unionByName(long.selectExpr("key", "pos + 100000 AS pos"))).collect()}["run/27000x"] == "2700"


def test_records_and_noise(spark):
    from tidewell.functions import vectors

    row = spark.range(1).select(records.sample_record(sample_id=F.lit("s"), fps=F.lit(30), extra=F.lit(1)).alias("r")).head().r
    assert list(row.asDict())[:3] == ["sample_id", "dataset", "dataset_dir"] and list(row.asDict())[-2:] == ["error_tags", "extra"]
    assert (row.sample_id, row.fps, row.step_source, row.views, row.double_review, len(row)) == ("s", 30, "none", [], 0, 21)
    x = [r.x for r in spark.range(4000).select(vectors.normal(F.col("id").cast("string")).alias("x")).collect()]
    assert abs(sum(x) / 4000) < 0.06 and abs(sum(v * v for v in x) / 4000 - 1) < 0.1
    qs = spark.createDataFrame([("s", 1, "q", "Which?", [str(i) for i in range(28)])], "sample_id string, n int, question_id string, question string, options array<string>")
    assert records.question_blocks(qs).head().prompt.split("\n")[-3:] == ["Z. 25", "AA. 26", "AB. 27"]


def test_report_order_and_guards(spark):
    from tidewell.operators import quality, reports, scoring

    rows = spark.createDataFrame([("capability", "x", 3), ("answer_type", "number", 9), ("answer_type", "yes_no", 1), ("overall", "all", 5), ("capability", "y", 4)], "dimension string, value string, total int")
    assert [r.value for r in reports.in_report_order(rows, ["yes_no", "number"]).collect()] == ["all", "yes_no", "number", "y", "x"]
    assert reports.without_summaries(spark.createDataFrame([("summary",), (None,), ("row",)], "_type string")).count() == 2
    with pytest.raises(ValueError, match="grippers"):
        quality.comparable_slots(["left_joint", "left_gripper"])
    assert quality.comparable_slots("right_eef") == ["right_eef"]
    got = spark.range(1).select(text.instruction_from_id(F.lit("pickUp_redCup_012")), scoring.facts_field(F.lit('{"atomic_facts": [1]}')), scoring.listed_in_order(F.array(*map(F.lit, scoring.CAPABILITIES)))).head()
    assert tuple(got) == ("pick up red cup", "[1]", True)
