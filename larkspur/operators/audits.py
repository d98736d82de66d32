"""Checks of proposal tables, and reports that weigh one ranking against another.

Proposals have proposal_index, image_id and, where a report needs it, gt_group (null off objects).
Strategies, methods and seeds are few; images and proposals may be many.
"""

from __future__ import annotations

import random
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.components import UNCERTAINTY, uncertainty
from larkspur.operators.reports import GROUPS, positions, self_stability
from larkspur.operators.scoring import aggregate_images, select_images
from larkspur.operators.stats import FLAT, NAN, pearson, spearman
from larkspur.session import cut

#: Ids that a draw by Python's generator may gather in the driver.
MOST_IDS = 1_000_000


def _over(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


# checks of tables -----------------------------------------------------------------------


def keep_images(df: DataFrame, images: DataFrame) -> DataFrame:
    """The rows of df whose image_id is among images."""
    return df.join(images.select("image_id").distinct(), "image_id", "left_semi").select(*df.columns)


def check_proposals(df: DataFrame, expected: DataFrame, *, posterior_size: int, embedding_size: int, labels: Collection[int] | None = None, tolerance: float = 1e-5) -> DataFrame:
    """One row (image_count, proposal_count, proposals_per_image) if df covers exactly the expected images; else raises ValueError.

    Every image has the same number of rows; posteriors and embeddings have the given sizes, posteriors
    sum to 1, labels are among `labels`. Null arrays and labels are faults; an empty df for no images passes.
    """
    wanted = expected.select(F.col("image_id").cast("string")).distinct()
    per = df.groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.count("*").alias("n"))
    for what, odd in (("missing", wanted.join(per, "image_id", "left_anti")), ("unexpected", per.join(wanted, "image_id", "left_anti"))):
        if rows := odd.orderBy("image_id").limit(10).collect():
            raise ValueError(f"{what} images: {', '.join(str(r['image_id']) for r in rows)}")
    mass = F.aggregate("posterior", F.lit(0.0), lambda a, x: a + x)
    label = F.col("predicted_label")
    faults = {
        f"posteriors are not of size {posterior_size}": F.coalesce(F.size("posterior") != posterior_size, F.lit(True)),
        f"embeddings are not of size {embedding_size}": F.coalesce(F.size("embedding") != embedding_size, F.lit(True)),
        "posteriors do not sum to 1": F.coalesce(F.isnan(mass) | (F.abs(mass - 1.0) > tolerance), F.lit(True)),
    }
    if labels is not None:
        faults["labels are outside the vocabulary"] = ~F.coalesce(label.isin(*labels), F.lit(False))
    counts = df.agg(*(F.count(F.when(bad, 1)) for bad in faults.values())).first()
    if wrong := [f"{text} in {n} rows" for text, n in zip(faults, counts, strict=True) if n]:
        raise ValueError("; ".join(wrong))
    report = cut(per.agg(F.count("*").alias("image_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("proposal_count"), F.min("n").alias("proposals_per_image"), F.max("n").alias("_top")))
    low, top = report.select("proposals_per_image", "_top").first()
    if low != top:
        raise ValueError(f"proposals per image range from {low} to {top}")
    return report.drop("_top")


# draws that repeat Python's generator ---------------------------------------------------


def _ids(images: DataFrame, most: int) -> list[str]:
    """Distinct ids by first ordinal; more than `most` raise ValueError."""
    once = images.groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.min("ordinal").alias("ordinal"))
    rows = once.orderBy("ordinal", "image_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} ids; draw by hash instead")
    return [r["image_id"] for r in rows]


def shuffled_draw(images: DataFrame, budget: int, seed: object, *, most: int = MOST_IDS) -> DataFrame:
    """(image_id, rank) of the first `budget` of images(image_id, ordinal) after a shuffle by Python's generator of that seed.

    The ids, `most` at the most, pass through the driver: the generator's draws depend on one another.
    """
    ids = _ids(images, most)
    random.Random(seed).shuffle(ids)
    return images.sparkSession.createDataFrame([(k, i) for i, k in enumerate(ids[: max(budget, 0)], 1)], "image_id string, rank int")


def ordered_draw(images: DataFrame, n: int, seed: object, *, most: int = MOST_IDS) -> DataFrame:
    """(image_id, ordinal) of n distinct ids that Python's generator samples, in their own order; repeated ids or too few raise ValueError."""
    ids = _ids(images, most)
    if images.count() != len(ids):
        raise ValueError("repeated ids")
    if n > len(ids):
        raise ValueError(f"{n} ids wanted of {len(ids)}")
    drawn = images.sparkSession.createDataFrame([(k,) for k in random.Random(seed).sample(ids, n)], "image_id string")
    return images.join(drawn, "image_id", "left_semi").orderBy("ordinal")


# reports --------------------------------------------------------------------------------


def driver_metrics(drivers: DataFrame, pool: DataFrame, *, group: str = "gt_group") -> DataFrame:
    """Per strategy of drivers(strategy, image_id, group), the rows behind the selected images: purity and group shares.

    purity: share on objects; object_positive_rate: share of images with such a row; coverage: the
    group's share of the rows; lift: over its share of the pool's rows on objects (null where that is 0).
    """
    on = F.col(group).isNotNull()
    base = pool.where(on).agg(*(_over(F.count(F.when(F.col(group) == g, 1)), F.count("*")).alias(f"_{g}") for g in GROUPS))
    image = drivers.groupBy("strategy", "image_id").agg(F.count("*").alias("_n"), F.count(group).alias("_on"), *(F.count(F.when(F.col(group) == g, 1)).alias(f"_n_{g}") for g in GROUPS))
    per = image.groupBy("strategy").agg(
        _over(F.sum("_on"), F.sum("_n")).alias("purity"),
        F.avg((F.col("_on") > 0).cast("double")).alias("object_positive_rate"),
        *(_over(F.sum(f"_n_{g}"), F.sum("_n")).alias(f"{g}_proposal_coverage") for g in GROUPS),
    )
    joined = per.join(F.broadcast(base))  # base is one row
    lifts = [_over(F.col(f"{g}_proposal_coverage"), F.nullif(F.col(f"_{g}"), F.lit(0.0))).alias(f"{g}_proposal_lift") for g in GROUPS]
    return joined.select("strategy", "purity", "object_positive_rate", (1 - F.col("object_positive_rate")).alias("background_only_rate"), *(f"{g}_proposal_coverage" for g in GROUPS), *lifts)


def rarity_alignment(df: DataFrame, *, rarity: str = "rarity", truth: str = "gt_class") -> DataFrame:
    """One row (rows, rho): how rarity ranks with the inverse frequency of the true class, over rows on objects."""
    on = df.where(F.col(truth).isNotNull())
    counts = on.groupBy(truth).agg((-F.count("*").cast("double")).alias("_inverse"))
    joined = on.select(truth, rarity).join(counts, truth)
    return joined.agg(F.count("*").alias("rows")).join(F.broadcast(spearman(joined, rarity, "_inverse")))  # one row each


def uncertainty_comparison(df: DataFrame, *, budget: int, top_k: int = 3, top_fraction: float = 0.1, key: str = "proposal_index") -> DataFrame:
    """Per uncertainty method: how far it follows confidence and objectness, and which images it would select.

    spearman and pearson with confidence, monotone (|spearman| > 0.999), spearman with objectness,
    prefers_low_objectness (< -0.1), overlap of the top fraction with confidence's (positions by value
    down, then key) and jaccard of the selected images.
    """
    n = df.count()
    top = max(1, round(n * top_fraction))
    placed = positions(df, "confidence", "_pc", key=key)
    first = select_images(aggregate_images(df, method="top_k_mean", top_k=top_k, score="confidence", key=key), budget).select("image_id")
    rows = []
    for method in UNCERTAINTY:
        scored = cut(uncertainty(placed, method, out="_u").select(key, "image_id", "confidence", "objectness", "_pc", "_u"))
        near = positions(scored, "_u", "_pu", key=key).agg(_over(F.count(F.when((F.col("_pu") < top) & (F.col("_pc") < top), 1)), F.lit(top)).alias("top_overlap"))
        mine = select_images(aggregate_images(scored, method="top_k_mean", top_k=top_k, score="_u", key=key), budget).select("image_id")
        both = mine.join(first, "image_id").agg(F.count("*").alias("_o"))
        one = spearman(scored, "_u", "confidence", out="spearman") if n else None
        for other in (pearson(scored, "_u", "confidence", out="pearson"), spearman(scored, "_u", "objectness", out="spearman_objectness"), near, both):
            one = other if one is None else one.join(F.broadcast(other))  # one row each
        rows.append(
            one.select(
                F.lit(method).alias("method"), "spearman", "pearson", (~F.isnan("spearman") & (F.abs("spearman") > 0.999)).alias("monotone"), "spearman_objectness",
                (~F.isnan("spearman_objectness") & (F.col("spearman_objectness") < -0.1)).alias("prefers_low_objectness"), "top_overlap", _over(F.col("_o"), 2 * budget - F.col("_o")).alias("jaccard"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def aggregation_stability(scores: DataFrame, *, budget: int, reference: str, contrast: str, top_k: int = 3) -> DataFrame:
    """Per way of aggregating scores(strategy, seed, image_id, proposal_index, score) to images: is its selection usable?

    signal: how far the contrast's selection differs from the reference's, mean over seeds; noise: how far
    the reference's own selections differ between seeds; gap: the drop of the score at the budget over
    the spread of scores, mean over runs that leave images out. Usable if signal exceeds noise.
    """
    run = ["strategy", "seed"]
    order = Window.partitionBy(*run, "image_id").orderBy(F.col("score").desc(), "proposal_index")
    placed = scores.where(F.col("strategy").isin(reference, contrast)).withColumn("_i", F.row_number().over(order))
    s = F.col("score").cast("double")
    kept = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0 - 1e-12))
    images = placed.groupBy(*run, "image_id").agg(F.avg(F.when(F.col("_i") <= top_k, s)).alias("top_k_mean"), F.max(s).alias("max"), F.avg(s).alias("mean"), (1.0 - F.exp(F.sum(F.log1p(-kept)))).alias("noisy_or"))
    ways = ["top_k_mean", "max", "mean", "noisy_or"]
    long = cut(images.unpivot([*run, "image_id"], ways, "aggregation", "image_score"))
    by = ["aggregation", *run]
    best = Window.partitionBy(*by).orderBy(F.col("image_score").desc(), "image_id")  # cut to the budget before it is dealt
    ranked = cut(long.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= budget + 1))
    picked = ranked.where(F.col("_rank") <= budget).select(*by, "image_id")
    edge = ranked.groupBy(*by).agg(F.max(F.when(F.col("_rank") == budget, F.col("image_score"))).alias("_at"), F.max(F.when(F.col("_rank") == budget + 1, F.col("image_score"))).alias("_next"))
    span = long.groupBy(*by).agg((F.max("image_score") - F.min("image_score")).alias("_span"))
    gaps = edge.where("_next is not null").join(span, by).where(F.col("_span") > FLAT).groupBy("aggregation").agg(F.avg((F.col("_at") - F.col("_next")) / F.col("_span")).alias("gap"))
    noise = self_stability(picked.where(F.col("strategy") == reference).select(F.col("aggregation").alias("strategy"), "seed", "image_id")).select(F.col("strategy").alias("aggregation"), (1 - F.col("mean_jaccard")).alias("noise"))
    ref, other = (F.col("strategy") == reference).cast("int"), (F.col("strategy") == contrast).cast("int")
    sides = picked.groupBy("aggregation", "seed", "image_id").agg(F.max(ref).alias("_r"), F.max(other).alias("_c"))
    seeds = sides.groupBy("aggregation", "seed").agg(F.sum("_r").alias("_nr"), F.sum("_c").alias("_nc"), F.sum(F.col("_r") * F.col("_c")).alias("_both"), F.count("*").alias("_any"))
    signal = seeds.where("_nr > 0 and _nc > 0").groupBy("aggregation").agg(F.avg(1 - F.col("_both") / F.col("_any")).alias("signal"))
    joined = long.select("aggregation").distinct().join(gaps, "aggregation", "left").join(signal, "aggregation", "left").join(noise, "aggregation", "left")
    a, b, nan = F.coalesce("signal", F.lit(NAN)), F.coalesce("noise", F.lit(NAN)), F.lit(NAN)
    finite = ~F.isnan(b) & (b > 1e-12)
    above = ~F.isnan(a) & (a > 0)
    ratio = F.when(finite, a / F.nullif(b, F.lit(0.0))).when(above, F.lit(float("inf"))).otherwise(nan)
    return joined.select("aggregation", F.coalesce("gap", nan).alias("gap"), a.alias("signal"), b.alias("noise"), ratio.alias("signal_to_noise"), (~F.isnan(a) & ~F.isnan(b) & (a > b)).alias("usable"))
