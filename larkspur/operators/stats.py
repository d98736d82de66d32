"""Statistics of scores and selections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.ranks import average_ranks

FLAT = 1e-12
NAN = float("nan")


def pearson(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), out: str = "r") -> DataFrame:
    """NaN for fewer than two rows or a constant side."""
    r = F.when((F.count("*") < 2) | (F.stddev_pop(x) < FLAT) | (F.stddev_pop(y) < FLAT), F.lit(NAN)).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    return df.groupBy(*by).agg(r.alias(out))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), out: str = "rho") -> DataFrame:
    ranked = average_ranks(average_ranks(df, x, "_rx", by), y, "_ry", by, source=df)
    return pearson(ranked, "_rx", "_ry", by, out)


def cohens_d(df: DataFrame, value: str, flag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., d): flagged minus unflagged mean over the pooled deviation; NaN below two rows a side or without spread."""
    a, b = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2))
    return df.groupBy(*by).agg(F.when((na < 2) | (nb < 2) | pooled.isNull() | (pooled < FLAT), F.lit(NAN)).otherwise((F.avg(a) - F.avg(b)) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def summarise(df: DataFrame, value: str, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value)

    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    return df.groupBy(*by).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) < 2, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_distinct(v).alias("distinct"),
        share(v <= 0.01).alias("fraction_near_zero"),
        share(v >= 0.99).alias("fraction_near_one"),
        share(v < 0.1).alias("fraction_below_0_1"),
        *(F.percentile(v, q).alias(f"q{int(q * 100)}") for q in quantiles),
    )


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) for equal widths; the last bin is closed; a constant is in the middle of a range of 1."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    ends = ends.select(F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"), F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width)).cast("long")
    counts = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("_n"))  # ends is one row
    frame = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), F.col("_lo"), width.alias("_w"))
    return frame.join(counts, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), F.coalesce("_n", F.lit(0)).alias("n"))


def coherence_regime(df: DataFrame, coherence: str, size: str) -> DataFrame:
    """(spread, rho, regime)."""
    rho = spearman(df, coherence, size)
    spread = df.agg(F.stddev_pop(coherence).alias("spread"))
    both = spread.join(F.broadcast(rho))  # one row each
    return both.withColumn("regime", F.when(F.col("spread") < 0.01, "inactive").when(F.col("spread") < 0.05, "saturated").when(F.abs("rho") > 0.3, "frequency_confounded").otherwise("informative"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 12) -> DataFrame:
    """(mi, normalised): nats between equal-frequency bins; normalised by the smaller entropy."""
    qs = [i / bins for i in range(1, bins)]
    edges = df.agg(*(F.array_sort(F.array_distinct(F.percentile(c, qs))).alias(f"_e{c}") for c in dict.fromkeys((x, y))))
    def binned(c: str) -> Column:
        return F.size(F.filter(F.col(f"_e{c}"), lambda e: e <= F.col(c)))

    cells = df.join(F.broadcast(edges)).groupBy(binned(x).alias("_x"), binned(y).alias("_y")).agg(F.count("*").cast("double").alias("_n"))  # edges is one row
    n = F.sum("_n").over(Window.partitionBy())
    cells = cells.withColumn("_all", n).withColumn("_nx", F.sum("_n").over(Window.partitionBy("_x"))).withColumn("_ny", F.sum("_n").over(Window.partitionBy("_y")))  # at most bins * bins rows
    p = F.col("_n") / F.col("_all")
    hx = F.sum(-p * F.log(F.col("_nx") / F.col("_all")))
    hy = F.sum(-p * F.log(F.col("_ny") / F.col("_all")))
    mi = F.sum(p * F.log(F.col("_n") * F.col("_all") / (F.col("_nx") * F.col("_ny"))))
    return cells.agg(mi.alias("mi"), F.when(F.least(hx, hy) < FLAT, F.lit(0.0)).otherwise(mi / F.nullif(F.least(hx, hy), F.lit(0.0))).alias("normalised"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) of two labelings from their contingency counts."""
    def pairs(c: Column) -> Column:
        return c.cast("double") * (c.cast("double") - 1) / 2

    cells = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    both = cells.agg(F.sum(pairs(F.col("_n"))).alias("_ij"), F.sum("_n").alias("_all"))
    rows = cells.groupBy("_a").agg(F.sum("_n").alias("_n")).agg(F.sum(pairs(F.col("_n"))).alias("_i"))
    cols = cells.groupBy("_b").agg(F.sum("_n").alias("_n")).agg(F.sum(pairs(F.col("_n"))).alias("_j"))
    one = both.join(F.broadcast(rows)).join(F.broadcast(cols))  # one row each
    expected = F.try_divide(F.col("_i") * F.col("_j"), pairs(F.col("_all")))
    top = (F.col("_i") + F.col("_j")) / 2
    return one.select(F.when((top - expected).isNull() | (top == expected), F.lit(1.0)).otherwise((F.col("_ij") - expected) / F.nullif(top - expected, F.lit(0.0))).alias("ari"))


def power_estimate(delta: float, sigma: float, z_alpha: float = 1.959963984540054, z_beta: float = 0.8416212335729143) -> float:
    """Seeds per arm; inf for no effect, NaN for no finite noise."""
    if not math.isfinite(sigma):
        return NAN
    if abs(delta) < FLAT:
        return math.inf
    return float(math.ceil(2 * (z_alpha + z_beta) ** 2 * sigma**2 / delta**2))


def power_report(runs: DataFrame, reference: str) -> DataFrame:
    """(arm, effect, noise, seeds) from runs(arm, seed, value): noise is the mean deviation of arms with two runs or more."""
    arms = runs.groupBy("arm").agg(F.avg("value").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("value")).alias("sd"))
    noise = arms.agg(F.coalesce(F.avg("sd"), F.lit(NAN)).alias("noise"), F.max(F.when(F.col("arm") == reference, F.col("mean"))).alias("base"))
    joined = arms.where(F.col("arm") != reference).join(F.broadcast(noise))  # one row
    effect = F.col("mean") - F.col("base")
    factor = 2 * (1.959963984540054 + 0.8416212335729143) ** 2
    seeds = F.when(F.isnan("noise"), F.lit(NAN)).when(F.abs(effect) < FLAT, F.lit(math.inf)).otherwise(F.ceil(F.lit(factor) * F.col("noise") * F.col("noise") / F.nullif(effect * effect, F.lit(0.0))).cast("double"))
    return joined.select("arm", effect.alias("effect"), "noise", seeds.alias("seeds"))


def pair_overlaps(selections: DataFrame, order: list[str]) -> DataFrame:
    """(left, right, overlap, left_size, right_size, jaccard) for every ordered pair of strategies in selections(strategy, image_id)."""
    place = F.create_map(*(x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))))
    one = selections.select("strategy", "image_id").distinct()
    sizes = one.groupBy("strategy").agg(F.count("*").alias("n"))
    shared = one.alias("l").join(one.alias("r"), "image_id").where(place[F.col("l.strategy")] < place[F.col("r.strategy")]).groupBy(F.col("l.strategy").alias("left"), F.col("r.strategy").alias("right")).agg(F.count("*").alias("_o"))
    pairs = sizes.alias("a").join(sizes.alias("b"), place[F.col("a.strategy")] < place[F.col("b.strategy")])  # strategies are few
    pairs = pairs.select(F.col("a.strategy").alias("left"), F.col("b.strategy").alias("right"), F.col("a.n").alias("left_size"), F.col("b.n").alias("right_size"))
    o = F.coalesce("_o", F.lit(0))
    return pairs.join(shared, ["left", "right"], "left").select("left", "right", o.alias("overlap"), "left_size", "right_size", F.coalesce(F.try_divide(o.cast("double"), (F.col("left_size") + F.col("right_size") - o).cast("double")), F.lit(NAN)).alias("jaccard"))


def rank_biased_overlap(left: DataFrame, right: DataFrame, *, p: float = 0.9, depth: int) -> DataFrame:
    """(rbo) of two rankings (image_id, rank from 1), truncated at depth, without extrapolation."""
    both = left.select("image_id", F.col("rank").alias("_l")).join(right.select("image_id", F.col("rank").alias("_r")), "image_id")
    enters = both.select(F.greatest("_l", "_r").alias("d")).where(F.col("d") <= depth).groupBy("d").agg(F.count("*").alias("_n"))
    depths = left.sparkSession.range(1, depth + 1).withColumnRenamed("id", "d").join(enters, "d", "left")
    running = F.sum(F.coalesce("_n", F.lit(0))).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))  # depth rows
    scored = depths.withColumn("_t", running.cast("double") / F.col("d") * F.pow(F.lit(p), F.col("d") - 1))
    return scored.agg(((1 - F.lit(p)) * F.sum("_t")).alias("rbo"))


def boundary_gap(images: DataFrame, budget: int) -> DataFrame:
    """(gap): drop of the score at the budget over the spread of scores; NaN without spread; no row if nothing is left out."""
    ranked = images.orderBy(F.col("image_score").desc(), "image_id").limit(budget + 1)
    at = ranked.agg(F.min_by("image_score", F.struct("image_score", "image_id")).alias("_next"), F.count("*").alias("_n"), F.sort_array(F.collect_list("image_score")).alias("_s"))
    ends = images.agg((F.max("image_score") - F.min("image_score")).alias("_span"))
    one = at.join(F.broadcast(ends)).where(F.col("_n") > budget)  # one row each
    return one.select(F.when(F.col("_span") <= FLAT, F.lit(NAN)).otherwise((F.get("_s", 1) - F.get("_s", 0)) / F.nullif(F.col("_span"), F.lit(0.0))).alias("gap"))


def pareto_front(df: DataFrame, key: str, objectives: dict[str, int], tolerance: float = 1e-12) -> DataFrame:
    """Rows of a small table that no row dominates; objectives: +1 to maximise, -1 to minimise; NaN on either side skips one."""
    l, r = df.alias("l"), df.alias("r")
    no_worse, better = F.lit(True), F.lit(False)
    for name, sign in objectives.items():
        a, b = F.col(f"l.{name}") * sign, F.col(f"r.{name}") * sign
        skip = F.isnan(a) | F.isnan(b)
        no_worse = no_worse & (skip | (b >= a - tolerance))
        better = better | (~skip & (b > a + tolerance))
    return l.join(r, (F.col(f"l.{key}") != F.col(f"r.{key}")) & no_worse & better, "left_anti")


#: Rows at most that a silhouette compares.
SAMPLE_ROWS = 5_000


def silhouette(df: DataFrame, *, embedding: str = "embedding", label: str = "pseudo_label", key: str = "proposal_index", sample: int = SAMPLE_ROWS) -> DataFrame:
    """(silhouette): mean Euclidean silhouette of at most `sample` rows, taken by a hash of their key; NaN with fewer than two labels.

    The sample is what defines the measure. It goes to every task as one block of bounded size, and
    each task holds its rows' distances to it.
    """
    import numpy as np
    import pyarrow as pa

    picked = df.select(F.col(key).alias("k"), F.col(label).cast("long").alias("l"), F.col(embedding).cast("array<double>").alias("e")).orderBy(F.xxhash64("k"), "k").limit(min(sample, SAMPLE_ROWS))
    spark = df.sparkSession
    rows = picked.collect()  # at most SAMPLE_ROWS
    labels = np.array([r["l"] for r in rows], dtype=np.int64)
    names, codes = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return spark.range(1).select(F.lit(NAN).alias("silhouette"))
    points = np.array([r["e"] for r in rows])
    held = spark.sparkContext.broadcast((points, codes, np.bincount(codes)))

    def run(batches):
        points, codes, sizes = held.value
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
                sums = np.bincount(codes, weights=d, minlength=len(sizes))
                own = codes[i]
                if sizes[own] == 1:
                    out.append(0.0)
                    continue
                a = sums[own] / (sizes[own] - 1)
                other = sums / sizes
                other[own] = np.inf
                near = other.min()
                out.append(float((near - a) / max(a, near)) if max(a, near) > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["s"])

    return spark.range(len(rows)).mapInArrow(run, "s double").agg(F.avg("s").alias("silhouette"))


def shuffled(df: DataFrame, value: str, *, seed: int, key: str = "proposal_index") -> DataFrame:
    """df with value dealt anew among its rows: the same permutation for the same keys, however they are sliced.

    The value at place i of one hash order goes to the row at place i of another; places come from
    range partitions, so no task orders the whole table.
    """
    from larkspur.operators.reports import positions

    def placed(salt: str, out: str, *columns: str) -> DataFrame:
        rows = df.select(key, *columns).withColumn("_h", F.xxhash64(F.lit(f"{seed}:{salt}"), F.col(key)))
        return positions(rows, "_h", out, key=key)

    gives = placed("from", "_at", value).select("_at", value)
    takes = placed("to", "_at").select(F.col(key).alias("_to"), "_at")
    dealt = takes.join(gives, "_at").select("_to", value)
    return df.drop(value).join(dealt, F.col(key) == F.col("_to")).select(*df.columns)
