"""Outputs: partitioned Parquet, JSON lines, CSV summaries, reports and side logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_unified(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "sub_dataset")) -> None:
    """Parquet partitioned by dataset; rows of a partition are brought together first, which avoids many small files."""
    df.repartition(*by).write.partitionBy(*by).mode("overwrite").parquet(path)


def write_sidecar(layout: dict[str, tuple[int, int]], target: dict[str, str], df: DataFrame, path: str) -> None:
    """One JSON row with the slot layout and the target types."""
    slots = F.create_map(*[x for k, (a, b) in layout.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    kinds = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])
    df.sparkSession.range(1).select(slots.alias("slots"), kinds.alias("targets")).coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def merge_json(old: DataFrame, new: DataFrame, path: str) -> None:
    """Old and new rows, written to a new place."""
    old.unionByName(new, allowMissingColumns=True).write.mode("overwrite").json(path)


def preview(df: DataFrame, text: list[str], counts: list[str], width: int = 80) -> DataFrame:
    """A CSV-ready summary: lengths of array columns and the first characters of text columns."""
    return df.select(
        *[c for c, _ in df.dtypes if c not in text and c not in counts],
        *[F.size(c).alias(f"n_{c}") for c in counts],
        *[F.substring(F.coalesce(F.col(c), F.lit("")), 1, width).alias(c) for c in text],
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def wide(df: DataFrame, row: str, column: str, names: list[str], values: list[str]) -> DataFrame:
    """A column per name and value, for a list of names known beforehand: one aggregation, no extra job."""
    return df.groupBy(row).pivot(column, names).agg(*[F.first(v).alias(v) for v in values])


def report(flagged: DataFrame) -> DataFrame:
    """A row per dataset with the number of flagged episodes and the map of their reasons."""
    return flagged.groupBy("dataset").agg(F.count("*").alias("n_flagged"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("episode_id").cast("string"), "reasons")))).alias("flagged"))


def split_skipped(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Results, and the rows that were skipped for a reason."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())
