"""Alignment scores: label counts by capability, ratios, sample scores, and two kinds of summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ten capabilities in their order.
CAPABILITIES = [
    "action_sequence", "object_identity", "object_attribute", "spatial_relation", "quantity",
    "arm_usage", "contact", "motion_detail", "state_change", "scene_context",
]


def label_counts(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """M, P, X, O, H by key and from them G (facts), C (claims) and A (aligned claims)."""
    n = lambda kind: F.count_if(F.col(label) == kind)
    counted = rows.groupBy(*keys).agg(n("match").alias("M"), n("partial").alias("P"), n("contradiction").alias("X"), n("omission").alias("O"), n("hallucination").alias("H"))
    return counted.withColumns({"G": F.expr("M + P + X + O"), "C": F.expr("M + P + X + H"), "A": F.expr("M + P + X")})


def ratios(counts: DataFrame) -> DataFrame:
    """Consistency, coverage and anti-hallucination by row, with their complements; null where a denominator is 0."""
    some = F.col("M") + 0.5 * F.col("P")
    over = lambda a, b: F.when(b != 0, a / b)
    return counts.withColumns({
        "consistency": over(some, F.col("A")), "coverage": over(some, F.col("G")), "omission_rate": over(F.col("O") * 1.0, F.col("G")),
        "anti_hallucination": F.when(F.col("C") != 0, 1 - F.col("H") / F.col("C")), "hallucination_rate": over(F.col("H") * 1.0, F.col("C")),
    })


def _weighted(value: str, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col(value) * weight)) / F.sum(F.when(F.col(value).isNotNull(), weight)), F.lit(0.0))


def sample_scores(scored: DataFrame, key: str = "sample_id", weight: float = 0.1) -> DataFrame:
    """Weighted means over the capabilities that have a value; hallucination counts for action sequences only (1 without claims)."""
    w = F.lit(weight)
    anti = F.coalesce(F.max(F.when(F.col("capability") == "action_sequence", F.col("anti_hallucination"))), F.lit(1.0))
    out = scored.groupBy(key).agg(_weighted("consistency", w).alias("_c"), _weighted("coverage", w).alias("_v"), anti.alias("_a"))
    return out.select(key, F.round("_c", 4).alias("consistency_score"), F.round("_v", 4).alias("weighted_coverage"), F.round("_a", 4).alias("weighted_anti_hallucination"), F.round((F.col("_c") + F.col("_v") + F.col("_a")) / 3, 4).alias("caption_score"))


def summary_macro(samples: DataFrame) -> DataFrame:
    """Means of the rounded sample scores."""
    return samples.agg(F.count("*").alias("n_samples"), *[F.round(F.avg(c), 4).alias(c) for c in ("caption_score", "consistency_score", "weighted_coverage", "weighted_anti_hallucination")])


def summary_by_capability(scored: DataFrame) -> DataFrame:
    return scored.groupBy("capability").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("consistency", "coverage", "anti_hallucination")], *[F.sum(c).alias(c) for c in "GCMPXOH"])


def summary_micro(counts: DataFrame, by: list[str]) -> DataFrame:
    """Ratios of sums, with other formulas than the means have: consistency over all claims, aligned over aligned and invented."""
    total = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("M", "P", "A", "C", "G", "H")])
    some = F.col("M") + 0.5 * F.col("P")
    return total.select(*by, F.round(F.when(F.col("C") != 0, some / F.col("C")), 4).alias("consistency"), F.round(F.when(F.col("G") != 0, some / F.col("G")), 4).alias("coverage"), F.round(F.when(F.col("A") + F.col("H") != 0, F.col("A") / (F.col("A") + F.col("H"))), 4).alias("anti_hallucination"))


def from_direct(direct: DataFrame) -> DataFrame:
    """``sample_id, capability, label`` from direct judgements: evaluations by capability, invented actions as hallucinations."""
    facts = direct.select("sample_id", F.explode("gt_evaluations").alias("e")).select("sample_id", "e.capability", "e.label")
    made_up = direct.select("sample_id", F.explode("hallucinated_actions").alias("h")).select("sample_id", F.lit("action_sequence").alias("capability"), F.lit("hallucination").alias("label"))
    return facts.unionByName(made_up)


def repair_omissions(alignment: DataFrame) -> DataFrame:
    """Alignments without a caption fact, or labelled omission, moved to the omissions."""
    stray = lambda a: a["caption_fact_id"].isNull() | (a["label"] == "omission")
    moved = F.transform(F.filter("alignments", stray), lambda a: F.struct(a["gt_fact_id"].alias("gt_fact_id"), a["note"].alias("note")))
    return alignment.withColumns({"omissions": F.concat("omissions", moved), "alignments": F.filter("alignments", lambda a: ~stray(a))})


def id_faults(expected: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """``key, fault``: ids that are used but unknown, expected but missing, or used more than once."""
    unknown = used.select(*key).distinct().join(expected, key, "left_anti").withColumn("fault", F.lit("unknown"))
    missing = expected.select(*key).distinct().join(used, key, "left_anti").withColumn("fault", F.lit("missing"))
    twice = used.groupBy(*key).count().where("count > 1").drop("count").withColumn("fault", F.lit("duplicate"))
    return unknown.unionByName(missing).unionByName(twice)


def counts_hold(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"facts_ok": F.expr("G = M + P + X + O"), "claims_ok": F.expr("C = M + P + X + H")})


def work_list(samples: DataFrame, done: DataFrame, capabilities: list[str] = CAPABILITIES) -> DataFrame:
    """``sample_id, capability, how`` for what isn't done: nothing to judge without facts or claims, else a task."""
    every = samples.withColumn("capability", F.explode(F.array(*map(F.lit, capabilities))))
    left = every.join(done, ["sample_id", "capability"], "left_anti")
    return left.withColumn("how", F.when(F.col("n_facts") == 0, "no_facts").when(F.col("n_claims") == 0, "all_omitted").otherwise("judge"))


def complete_samples(results: DataFrame, capabilities: list[str] = CAPABILITIES) -> DataFrame:
    """Samples for which every capability has a result; one error makes the sample an error."""
    return results.groupBy("sample_id").agg(F.count_distinct("capability").alias("n"), F.bool_or("error").alias("error")).where(F.col("n") == len(capabilities)).select("sample_id", F.when(F.col("error"), "error").otherwise("ok").alias("status"))


def facts_field(raw: Column, names: tuple[str, ...] = ("gt_atomic_facts", "atomic_facts", "facts", "caption_atomic_facts")) -> Column:
    """The facts of a judge's JSON answer, whichever of the usual names it gives them."""
    return F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in names])


def listed_in_order(capabilities: Column, wanted: list[str] = CAPABILITIES) -> Column:
    """Whether exactly the wanted capabilities are listed, in their order."""
    return capabilities == F.array(*map(F.lit, wanted))
