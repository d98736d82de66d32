"""Probes over seeds: coverage, the gate against shuffled gates, rank stability, weight surfaces and the choice of an arm.

Selections are (.., seed, image_id) without regard to repeats. Strategies, seeds, trials and grid
points are few; images and proposals are not.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.reports import GROUPS, self_stability, truth_by_image
from larkspur.operators.scoring import ranked_images
from larkspur.operators.stats import FLAT, spearman
from larkspur.session import cut


def overlaps(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on.., shared, either, jaccard) of two sets of images for each key; a key without images has no row."""
    sides = (df.select(*on, "image_id", F.lit(l).alias("_l"), F.lit(r).alias("_r")) for df, l, r in ((left, 1, 0), (right, 0, 1)))
    each = next(sides).unionByName(next(sides)).groupBy(*on, "image_id").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    sums = each.groupBy(*on).agg(F.sum(F.col("_l") * F.col("_r")).alias("shared"), F.count("*").alias("either"))
    return sums.withColumn("jaccard", F.col("shared").cast("double") / F.col("either"))


def coverage_probe(runs: DataFrame, images: DataFrame, objects: DataFrame, groups: DataFrame) -> DataFrame:
    """Per strategy of runs(strategy, seed, image_id): mean and deviation over seeds of the share of selected images that show each group.

    tail_lift divides the mean tail share by that of all images (floor 1e-9); distinct_classes is a mean
    over seeds as well. Deviations over one seed are null.
    """
    picked = runs.select("strategy", "seed", "image_id").distinct()
    rates = truth_by_image(picked, objects, groups).groupBy("strategy", "seed").agg(*(F.avg(F.col(f"has_{g}").cast("double")).alias(g) for g in GROUPS))
    classes = picked.join(objects.select("image_id", "class_name"), "image_id").groupBy("strategy", "seed").agg(F.count_distinct("class_name").alias("_c"))
    pool = truth_by_image(images.select("image_id").distinct(), objects, groups).agg(F.avg(F.col("has_tail").cast("double")).alias("_pool"))
    per = rates.join(classes, ["strategy", "seed"], "left").groupBy("strategy").agg(
        *(F.avg(g).alias(f"{g}_coverage") for g in GROUPS),
        *(F.when(F.count("*") > 1, F.stddev_samp(g)).alias(f"{g}_sd") for g in GROUPS),
        F.avg(F.coalesce("_c", F.lit(0))).alias("distinct_classes"),
    )
    lift = F.col("tail_coverage") / F.greatest("_pool", F.lit(1e-9))
    return per.join(F.broadcast(pool)).withColumn("tail_lift", lift).drop("_pool")  # pool is one row


def gate_falsification(real: DataFrame, shuffled: DataFrame, ungated: DataFrame) -> DataFrame:
    """(seed, real_gate_effect, shuffled_mean, shuffled_sd, trials): how far selections move from the ungated ones.

    real and ungated are (seed, image_id), shuffled (seed, trial, image_id) with coherence dealt anew
    in each trial (see `stats.shuffled`). An effect is 1 less the Jaccard overlap.
    """
    effect = 1 - F.col("jaccard")
    mine = overlaps(real, ungated, ["seed"]).select("seed", effect.alias("real_gate_effect"))
    trials = shuffled.select("seed", "trial").distinct()  # a row a trial
    base = ungated.select("seed", "image_id").join(F.broadcast(trials), "seed")
    fake = overlaps(shuffled, base, ["seed", "trial"]).groupBy("seed").agg(
        F.avg(effect).alias("shuffled_mean"), F.when(F.count("*") > 1, F.stddev_samp(effect)).alias("shuffled_sd"), F.count("*").alias("trials")
    )
    return mine.join(fake, "seed")


def falsification_z(rows: DataFrame) -> DataFrame:
    """(real, shuffled, sd, z, distinguishable) over the seeds of `gate_falsification`; distinguishable from |z| of 2."""
    means = rows.agg(F.avg("real_gate_effect").alias("real"), F.avg("shuffled_mean").alias("shuffled"), F.avg("shuffled_sd").alias("sd"))
    scored = means.withColumn("z", (F.col("real") - F.col("shuffled")) / F.greatest("sd", F.lit(FLAT)))
    return scored.withColumn("distinguishable", F.abs("z") >= 2)


def rank_stability(runs: DataFrame, *, key: str = "proposal_index") -> DataFrame:
    """One row from runs(seed, key, size, true_size, rarity), a row a proposal and clustering seed.

    fidelity: mean rank correlation of cluster size and true class size; spread: mean deviation of
    rarity; stability: mean rank correlation of rarity between every two seeds, null for one.
    """
    runs = cut(runs.select("seed", F.col(key).alias("_k"), "size", "true_size", "rarity"))
    fidelity = spearman(runs, "size", "true_size", ("seed",)).agg(F.avg("rho").alias("fidelity"))
    spread = runs.groupBy("seed").agg(F.stddev_pop("rarity").alias("_s")).agg(F.avg("_s").alias("spread"))
    l, r = (runs.select(F.col("seed").alias(s), "_k", F.col("rarity").alias(v)) for s, v in (("_a", "_x"), ("_b", "_y")))
    pairs = cut(l.join(r, "_k").where(F.col("_a") < F.col("_b")))  # seeds are few
    stability = spearman(pairs, "_x", "_y", ("_a", "_b")).agg(F.avg("rho").alias("stability"))
    return fidelity.join(F.broadcast(spread)).join(F.broadcast(stability))  # one row each


def surface_selections(components: DataFrame, points: Iterable[tuple[float, float, Mapping[str, float]]], *, budget: int, top_k: int = 3, key: str = "proposal_index") -> DataFrame:
    """(x, y, seed, image_id): the images that each grid point's weights over the norm_ columns select, for each seed, in one job."""
    def score(weights: Mapping[str, float]):
        return sum((F.lit(float(w)) * F.col(f"norm_{c}") for c, w in weights.items()), F.lit(0.0)).cast("double")

    each = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), score(w).alias("score")) for x, y, w in points)))
    long = components.select("seed", "image_id", F.col(key).alias("_k"), each.alias("_p")).select("seed", "image_id", "_k", "_p.*")
    place = F.row_number().over(Window.partitionBy("x", "y", "seed", "image_id").orderBy(F.col("score").desc(), "_k"))
    images = long.withColumn("_i", place).where(F.col("_i") <= top_k).groupBy("x", "y", "seed", "image_id").agg(F.avg("score").alias("image_score"))
    return ranked_images(images, (), by=("x", "y", "seed")).where(F.col("rank") <= budget).select("x", "y", "seed", "image_id")


def surface(picked: DataFrame, base: DataFrame) -> DataFrame:
    """(x, y, jaccard, self_jaccard, effect, noise, signal_to_noise) of picked(x, y, seed, image_id) against base(seed, image_id).

    Overlaps are means over seeds and, for self_jaccard, over pairs of seeds; effect and noise are 1
    less these. Without noise signal_to_noise is infinite; with one seed noise is null.
    """
    points = picked.select("x", "y", "seed").distinct()  # a row a point and seed
    against = overlaps(picked, base.select("seed", "image_id").join(F.broadcast(points), "seed"), ["x", "y", "seed"])
    moved = against.groupBy("x", "y").agg(F.avg("jaccard").alias("jaccard"))
    among = self_stability(picked.select(F.struct("x", "y").alias("strategy"), "seed", "image_id"))
    both = moved.join(among.select("strategy.x", "strategy.y", F.col("mean_jaccard").alias("self_jaccard")), ["x", "y"], "left")
    both = both.withColumn("effect", 1 - F.col("jaccard")).withColumn("noise", 1 - F.col("self_jaccard"))
    ratio = F.when(F.col("noise") > FLAT, F.try_divide("effect", "noise")).when(F.col("noise").isNotNull(), F.lit(math.inf))
    return both.withColumn("signal_to_noise", ratio)


def choose_arm(configs: DataFrame, names: Sequence[str]) -> DataFrame:
    """The best of the configurations `names` whose weight_novelty is 0 or null, as one row; none raises ValueError.

    Those with objects in at least half of their images come first, then by tail_image_lift,
    object_positive_image_rate and distinct_gt_classes_selected, all downwards, then by name.
    """
    rate = F.col("object_positive_image_rate")
    open_ = configs.where(F.col("strategy").isin(*names) & (F.coalesce("weight_novelty", F.lit(0.0)) == 0))
    best = open_.orderBy((rate >= 0.5).desc(), F.col("tail_image_lift").desc(), rate.desc(), F.col("distinct_gt_classes_selected").desc(), "strategy").limit(1)
    if best.isEmpty():
        raise ValueError("no configuration without novelty among " + ", ".join(names))
    return best
