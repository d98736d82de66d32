"""Tie-aware ranks and the five normalisers, global over a pool or within `by` groups.

Ranks use counts of distinct values and their running sums, so what is ordered is the set of
distinct values, pre-aggregated before the shuffle, in range partitions: first the sums of
each range, then the rank inside it. No window runs over the whole pool in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut

METHODS = ("rank", "ecdf", "minmax", "zscore_sigmoid", "none")
FLAT = 1e-12


def _distinct_ranks(df: DataFrame, value: str, by: Sequence[str], parts: int | None = None) -> DataFrame:
    """(by.., _v, _before, _same): rows below and rows at each distinct value."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_same"))
    dealt = counts.repartitionByRange(n, *by, "_v").withColumn("_part", F.spark_partition_id())
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_same").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum("_same").over(inner), F.lit(0)))
    return ranked.join(starts, [*by, "_part"]).select(*by, "_v", (F.col("_start") + F.col("_in")).alias("_before"), "_same")


def dealt(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), part: str = "_part") -> DataFrame:
    """df in range partitions of by and order, cut, with the partition's number: sums over earlier partitions are few rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by, *order).withColumn(part, F.spark_partition_id()))


def row_numbers(df: DataFrame, order: Sequence[Column], out: str, by: Sequence[str] = ()) -> DataFrame:
    """df plus the row number, from 1, in a total order, per `by`."""
    parts = dealt(df, order, by)
    counts = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return parts.withColumn("_in", inside).join(starts, [*by, "_part"]).select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))


def average_ranks(df: DataFrame, value: str, out: str, by: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """df plus zero-based ranks of value; equal values share the mean of theirs.

    source, by default df, has the same values and gives the counts: pass the table that df was
    derived from, so that a chain of ranks does not compute df again for each.
    """
    ranks = _distinct_ranks(df if source is None else source, value, by).withColumnRenamed("_v", "_key")
    keys = [F.col(value).eqNullSafe(F.col("_key"))]
    renamed = ranks.select(*(F.col(b).alias(f"_by_{b}") for b in by), "_key", "_before", "_same")
    on = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by] + keys
    joined = df.join(renamed, on, "left")
    rank = F.col("_before").cast("double") + (F.col("_same").cast("double") - 1.0) / 2.0
    return joined.select(*df.columns, rank.alias(out))


def normalise(df: DataFrame, value: str, out: str, method: str = "rank", by: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """df plus value on the method's common scale; raises ValueError for an unknown method.

    rank and ecdf come from average_ranks; a constant pool gives 0.5 for rank and zscore_sigmoid, 1 for minmax.
    """
    if method not in METHODS:
        raise ValueError(f"unknown normalisation {method!r}; known: {', '.join(METHODS)}")
    if method == "none":
        return df.withColumn(out, F.col(value))
    base = df if source is None else source
    stats = base.groupBy(*by).agg(F.count(value).cast("double").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    if method in ("rank", "ecdf"):
        ranked = average_ranks(df, value, "_rank", by, base)
        scaled = F.when((F.col("_n") <= 1) | (F.col("_lo") == F.col("_hi")), F.lit(0.5)).otherwise(F.try_divide(F.col("_rank"), F.col("_n") - 1.0)) if method == "rank" else (F.col("_rank") + 1.0) / F.col("_n")
    else:
        ranked = df
        scaled = _minmax() if method == "minmax" else _zscore()
        scaled = scaled(F.col(value))
    joined = ranked.join(stats, list(by)) if by else ranked.join(F.broadcast(stats))  # without groups, stats is one row
    return joined.select(*[c for c in df.columns if c != out], scaled.cast("double").alias(out))


def _minmax():
    span = F.col("_hi") - F.col("_lo")
    return lambda v: F.when(span < FLAT, F.lit(1.0)).otherwise((v - F.col("_lo")) / F.nullif(span, F.lit(0.0)))


def _zscore():
    return lambda v: F.when(F.col("_sd") < FLAT, F.lit(0.5)).otherwise(1.0 / (1.0 + F.exp(-(v - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0)))))


def quantile(value: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(value, q)
