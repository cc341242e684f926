"""Sample records, step normalisation, routing and question blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text

# Step texts that stand for nothing.
PLACEHOLDERS = ["", "none", "[none]", "null"]
# The fields of a sample's record in their order, each with the SQL of its default.
RECORD = {
    "sample_id": "CAST(NULL AS STRING)", "dataset": "CAST(NULL AS STRING)", "dataset_dir": "CAST(NULL AS STRING)", "views": "CAST(array() AS ARRAY<STRING>)",
    "videos": "CAST(map() AS MAP<STRING, STRING>)", "instruction_raw": "CAST(NULL AS STRING)", "duration_sec": "CAST(NULL AS DOUBLE)", "fps": "CAST(NULL AS INT)",
    "resolution": "CAST(NULL AS STRING)", "robot_type": "CAST(NULL AS STRING)", "has_raw_steps": "0", "step_source": "'none'", "steps_raw": "CAST(NULL AS ARRAY<STRING>)",
    "task_type": "CAST(NULL AS STRING)", "object_categories": "CAST(NULL AS ARRAY<STRING>)", "review_level": "CAST(NULL AS STRING)", "review_time_min": "CAST(NULL AS DOUBLE)",
    "review_outcome": "CAST(NULL AS STRING)", "double_review": "0", "error_tags": "CAST(array() AS ARRAY<STRING>)",
}


def sample_record(**given: Column) -> Column:
    """A sample's record: ``RECORD`` in its order, with its defaults for what isn't given, then what else is given."""
    fields = [(name, given.pop(name, F.expr(default))) for name, default in RECORD.items()]
    return F.struct(*[value.alias(name) for name, value in [*fields, *given.items()]])


def real_steps(steps: Column) -> Column:
    """Steps without placeholders; they keep their own numbers."""
    return F.filter(steps, lambda s: s["desc"].isNotNull() & ~F.lower(F.trim(s["desc"])).isin(PLACEHOLDERS))


def densely_numbered(steps: Column) -> Column:
    return F.transform(steps, lambda s, i: F.struct(i.alias("i"), s["desc"].alias("desc"), s["start"].alias("start"), s["end"].alias("end")))


def instruction(own: Column, looked_up: Column, first_of_all: Column, has_index: Column) -> Column:
    """An episode's first task, else the dictionary's for its index, else the dictionary's first where it has no index."""
    return F.coalesce(F.get(own, F.lit(0)), F.when(has_index, looked_up).otherwise(first_of_all))


def instruction_steps(steps: Column, raw: Column) -> Column:
    """Step texts if there are any, else the raw instruction alone."""
    texts = F.filter(F.transform(steps, lambda s: s["desc"]), lambda d: d.isNotNull() & (F.trim(d) != ""))
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(raw))


def truth_status(raw: Column, steps: Column) -> Column:
    """What a ground truth is good for: ``ok``, a black screen, or malformed."""
    black = F.lower(F.coalesce(raw, F.lit(""))).contains("black screen")
    return F.when(black, "skip_black_screen_gt").when(steps.isNull() | (F.size(steps) == 0), "skip_malformed_gt").otherwise("ok")


def captions(rows: DataFrame, order: str) -> DataFrame:
    """``sample_id, steps``: cleaned, and the last one of a sample wins."""
    from tidewell.operators.joins import last_wins

    clean = F.filter(F.transform("caption_result", text.squeeze), lambda s: s != "")
    return last_wins(rows.select("sample_id", clean.alias("steps"), order), ["sample_id"], order).select("sample_id", "steps")


def succeeded(call_ok: Column, steps: Column) -> Column:
    return F.coalesce(call_ok, F.lit(False)) & F.coalesce(F.exists(steps, lambda s: F.trim(s) != ""), F.lit(False))


def routed(rows: DataFrame, call_ok: str, steps: str, broken: str) -> DataFrame:
    """``route``: bad_json, success or failed; one scan serves all three, and counting them is one aggregation."""
    return rows.withColumn("route", F.when(F.col(broken).isNotNull(), "bad_json").when(succeeded(F.col(call_ok), F.col(steps)), "success").otherwise("failed"))


def wanted(samples: DataFrame, mode: str | None = None, datasets: list[str] | None = None, query: str | None = None, columns: tuple[str, ...] = ("sample_id", "dataset")) -> DataFrame:
    """Samples of a mode (``annotate`` or ``review``), of some datasets, and with a text in one of the columns."""
    if mode is not None:
        review = (F.col("has_raw_steps") == 1) | (F.size(F.coalesce("steps_raw", F.array())) > 0)
        samples = samples.where(review if mode == "review" else ~review)
    if datasets is not None:
        samples = samples.where(F.col("dataset").isin(datasets))
    if query:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.lower(F.col(c)).contains(query.lower())
        samples = samples.where(hit)
    return samples


def rejection(views: Column, present: Column) -> Column:
    """Why a sample can't be shown: no view at all, or all videos missing."""
    return F.when(F.coalesce(F.size(views), F.lit(0)) < 1, "no_view").when(~F.exists(views, lambda v: F.array_contains(present, v)), "all_videos_missing")


def remapped_answers(answers: Column, ids: Column) -> Column:
    """Answers by question id from keys ``Q1``, ``[id]`` or ``id``."""
    bare = F.transform_keys(answers, lambda k, _: F.regexp_replace(k, r"^\[|\]$", ""))
    pairs = F.transform(ids, lambda q, i: F.struct(q.alias("id"), F.coalesce(F.try_element_at(bare, q), F.try_element_at(bare, F.concat(F.lit("Q"), (i + 1).cast("string")))).alias("answer")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["answer"].isNotNull()))


def question_blocks(questions: DataFrame, key: str = "sample_id", order: str = "n") -> DataFrame:
    """One prompt part per sample: numbered questions, their options lettered A to Z, then AA, AB and so on."""
    letter = lambda i: F.concat(F.when(i >= 26, F.char(64 + F.floor(i / 26))).otherwise(""), F.char(65 + i % 26))
    options = F.array_join(F.transform("options", lambda o, i: F.concat(letter(i), F.lit(". "), o)), "\n")
    block = F.concat_ws("\n", F.concat(F.lit("["), "question_id", F.lit("] "), "question"), F.nullif(F.coalesce(options, F.lit("")), F.lit("")))
    rows = questions.select(key, F.struct(F.col(order).alias("n"), block.alias("b")).alias("s"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["b"]), "\n\n").alias("prompt"))


def prompt_variant(views: Column, instructions: Column) -> Column:
    """``multi`` or ``single`` view, with none, one or many instructions."""
    n = F.size(F.filter(instructions, lambda x: F.trim(x) != ""))
    return F.concat_ws("_", F.when(F.size(views) > 1, "multi").otherwise("single"), F.when(n == 0, "none").when(n == 1, "one").otherwise("many"))


def slim_facts(facts: DataFrame) -> DataFrame:
    """Facts cut to four fields, gathered by sample, capability and slot."""
    fact = F.struct("fact_id", "step_anchor", "value", "fact_text")
    return facts.groupBy("sample_id", "capability", "slot").agg(F.sort_array(F.collect_list(fact)).alias("facts"))


def from_file_name(name: Column) -> tuple[Column, Column]:
    """Model and round of a result file such as ``model_round2.json``; round 1 if it names none."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(base, r"_round\d+$", ""), F.coalesce(text.trailing_number(base, r"_round(\d+)$"), F.lit(1))


def id_parts(sample_id: Column) -> tuple[Column, Column]:
    """Prefix and trailing number of an id."""
    return F.regexp_replace(sample_id, r"[_-]?\d+$", ""), text.trailing_number(sample_id)


def run_stages(df: DataFrame, stages: list[tuple[str, list[str], Callable[[DataFrame], tuple[DataFrame, Column, Column]]]]) -> DataFrame:
    """Column stages in order: each gives rows with a result and a success flag; a failed dependency makes a stage skipped.

    ``stages`` are (name, names it depends on, function from rows to (rows, result, success)).
    """
    for name, needs, build in stages:
        df, result, ok = build(df)
        ready = F.lit(True)
        for other in needs:
            ready = ready & (F.col(f"{other}_status") == "success")
        df = df.withColumns({f"{name}_status": F.when(~ready, "skipped").when(ok, "success").otherwise("failed"), f"{name}_result": F.when(ready & ok, result)})
    return df
