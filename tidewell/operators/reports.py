"""Accuracy and success reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ordered import running_sum

def accuracy(results: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Accuracy overall and by each column, in one pass with grouping sets; a null value counts as ``unknown``."""
    rows = results.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by], F.col(correct).cast("int").alias("_ok"))
    sets = [[], *[[F.col(c)] for c in by]]
    grouped = rows.groupingSets(sets, *by).agg(F.count("*").alias("total"), F.sum("_ok").alias("correct"), F.grouping_id(*by).alias("_g"))
    full = (1 << len(by)) - 1
    dimension, value = F.lit("overall"), F.lit("all")
    for k, c in enumerate(by):
        mine = full ^ (1 << (len(by) - 1 - k))
        dimension, value = F.when(F.col("_g") == mine, c).otherwise(dimension), F.when(F.col("_g") == mine, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "total", "correct", F.round(F.col("correct") / F.col("total"), 4).alias("accuracy"))


def rounds(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over rounds, and ``m+-s`` where there is more than one."""
    out = results.groupBy(*by).agg(F.count(value).alias("n_rounds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumn("shown", F.when(F.col("n_rounds") > 1, F.format_string("%.2f+-%.2f", F.round("mean", 2), F.round("std", 2))).otherwise(F.format_string("%.2f", F.round("mean", 2))))


def pivot_accuracy(results: DataFrame, row: str, column: str, names: list[str], correct: str = "correct") -> DataFrame:
    """A row per model, a column per capability: the names are given, so no job is spent on finding them."""
    return results.groupBy(row).pivot(column, names).agg(F.round(F.avg(F.col(correct).cast("double")), 4))


def judged(results: DataFrame, by: list[str]) -> DataFrame:
    """Correct, judged and skipped; per cent of the judged ones."""
    out = results.groupBy(*by).agg(F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") != "skip").alias("judged"), F.count_if(F.col("verdict") == "skip").alias("skipped"))
    return out.withColumn("accuracy_pct", F.when(F.col("judged") > 0, F.round(100 * F.col("correct") / F.col("judged"), 2)))


def success_rates(runs: DataFrame, group: str, done: str, tried: str) -> DataFrame:
    """Macro (mean of the rates) and micro (ratio of the sums) success."""
    per = runs.groupBy(group).agg(F.sum(done).alias("d"), F.sum(tried).alias("t"))
    return per.agg(F.round(F.avg(F.col("d") / F.col("t")), 6).alias("macro"), F.round(F.sum("d") / F.sum("t"), 6).alias("micro"))


def by_checkpoint(runs: DataFrame, step: str, task: str, value: str) -> DataFrame:
    """Mean over runs by step and task, then over tasks."""
    return runs.groupBy(step, task).agg(F.avg(value).alias("_m")).groupBy(step).agg(F.count("*").alias("n_tasks"), F.round(F.avg("_m"), 6).alias("mean"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most common values, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def group_tasks(df: DataFrame, task: str, episode: str) -> DataFrame:
    """Sorted episodes and their number by task, most common first."""
    return df.groupBy(task).agg(F.sort_array(F.collect_list(episode)).alias("episodes"), F.count("*").alias("n")).orderBy(F.desc("n"), task)


def status_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status").contains("skipped")).alias("skipped"), F.count_if((F.col("status") != "success") & ~F.col("status").contains("skipped")).alias("failed"), F.round(F.avg("elapsed"), 6).alias("mean_elapsed"))


def mean_max_rank_violation(models: DataFrame) -> DataFrame:
    """Of ``model, a, b``: per model the largest gap in ``b`` to a model that ``a`` orders the other way; then the mean.

    Models are few by nature; the self-join is over a table of results, not of rows.
    """
    x, y = models.toDF("m", "a1", "b1"), models.toDF("n", "a2", "b2")
    gap = F.when((F.col("a1") < F.col("a2")) != (F.col("b1") < F.col("b2")), F.abs(F.col("b1") - F.col("b2"))).otherwise(0.0)
    return x.join(y, F.col("m") != F.col("n")).groupBy("m").agg(F.max(gap).alias("worst")).agg(F.round(F.avg("worst"), 6).alias("mmrv"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """The Kruskal-Wallis statistic with the correction for ties, from counts by group and value; rows without a value or group take no part."""
    pairs = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    counts = pairs.groupBy(value).agg(F.sum("n").alias("t"))
    ranks = running_sum(counts, [], value, "t", "upto").select(value, (F.col("upto") - (F.col("t") - 1) / 2).alias("rank"))
    ranked = pairs.join(ranks, value).groupBy(group).agg(F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("n"))
    total = ranked.agg(F.sum("n").alias("N"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = counts.agg(F.sum(F.expr("CAST(t AS DOUBLE) * t * t - t")).alias("ties"))
    h = 12 / (F.col("N") * (F.col("N") + 1.0)) * F.col("s") - 3 * (F.col("N") + 1)
    return total.withColumn("ties", ties.scalar()).select(F.round(h / (1 - F.col("ties") / (F.expr("CAST(N AS DOUBLE) * N * N - N"))), 6).alias("h"))


def answer_matrix(questions: DataFrame, answers: DataFrame, models: list[str], key: str = "question_id") -> DataFrame:
    """A row per question with the map of each model's answer; null where a model has none. Of repeated answers the last in ``n`` counts."""
    last = answers.where(F.col("model").isin(models)).groupBy(key, "model").agg(F.max_by("answer", "n").alias("answer"))
    per = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("model", "answer"))).alias("_given"))
    given = F.map_from_arrays(F.array(*map(F.lit, models)), F.array(*[F.try_element_at("_given", F.lit(m)) for m in models]))
    return questions.join(per, key, "left").withColumn("answers", given).drop("_given")


def token_usage(stages: DataFrame, by: list[str]) -> DataFrame:
    """Prompt, completion and total tokens summed over stages; a stage without a count adds nothing."""
    return stages.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def first_wrong(results: DataFrame, by: list[str], order: str, n: int = 5, correct: str = "correct") -> DataFrame:
    """The first ``n`` wrong answers of each group."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(order)
    return results.where(~F.col(correct)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def in_report_order(rows: DataFrame, fixed: list[str]) -> DataFrame:
    """An accuracy report as it is read: overall first, answer types in a fixed order, the rest by size."""
    place = F.array_position(F.array(*map(F.lit, fixed)), F.col("value"))
    group = F.when(F.col("dimension") == "overall", 0).when(F.col("dimension") == "answer_type", 1).otherwise(2)
    return rows.orderBy(group, F.when(group == 1, place), "dimension", F.desc("total"), "value")


def without_summaries(rows: DataFrame, kind: str = "_type") -> DataFrame:
    return rows.where(F.coalesce(F.col(kind), F.lit("")) != "summary")
