"""Reports that join scores and selections with ground truth, groups and other runs.

Ground truth is objects(image_id, class_name[, gt_idx, box]); groups is (class_name, group).
Selections are (image_id[, rank]) or, for several at once, (strategy, image_id). Shares over
nothing are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators.ranks import average_ranks, normalise
from larkspur.operators.stats import FLAT, NAN, cohens_d, spearman
from larkspur.session import cut

GROUPS = ("head", "medium", "tail")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


# ground truth ---------------------------------------------------------------------------


def truth_by_image(images: DataFrame, objects: DataFrame, groups: DataFrame) -> DataFrame:
    """images plus gt_classes (sorted, distinct, joined by |), gt_count and, per group, has_ and _count.

    Repeated objects count; images without objects have an empty string, 0 and false.
    """
    graded = objects.select("image_id", "class_name").join(groups.select("class_name", "group"), "class_name", "left")
    per = graded.groupBy("image_id").agg(
        F.array_join(F.array_sort(F.collect_set("class_name")), "|").alias("gt_classes"),
        F.count("*").alias("gt_count"),
        *(F.count(F.when(F.col("group") == g, 1)).alias(f"{g}_count") for g in GROUPS),
    )
    joined = images.join(per, "image_id", "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gt_count", *(f"{g}_count" for g in GROUPS))]
    flags = [(F.coalesce(f"{g}_count", F.lit(0)) > 0).alias(f"has_{g}") for g in GROUPS]
    return joined.select(*images.columns, F.coalesce("gt_classes", F.lit("")).alias("gt_classes"), *counts, *flags)


def best_overlap(proposals: DataFrame, objects: DataFrame, *, key: str = "proposal_index", box: str = "box", threshold: float = 0.5) -> DataFrame:
    """(key, best_iou, best_gt, best_class): the object of greatest overlap in the image, first gt_idx on ties.

    Below the threshold the class is `background`; without objects the overlap is 0 and best_gt null.
    """
    mine = proposals.select(F.col(key), "image_id", F.col(box).alias("_box"))
    theirs = objects.select("image_id", F.col("gt_idx").alias("_gt"), F.col("class_name").alias("_class"), F.col("box").alias("_gbox"))
    pairs = mine.join(theirs, "image_id").select(F.col(key).alias("_key"), "_gt", "_class", V.box_iou(F.col("_box"), F.col("_gbox")).alias("_iou"))
    best = pairs.groupBy("_key").agg(F.max(F.struct("_iou", (-F.col("_gt")).alias("_first"), "_class")).alias("_best"))
    iou = F.coalesce("_best._iou", F.lit(0.0))
    joined = proposals.select(key).join(best, F.col(key) == F.col("_key"), "left")
    return joined.select(key, iou.alias("best_iou"), (-F.col("_best._first")).alias("best_gt"), F.when(iou >= threshold, F.col("_best._class")).otherwise("background").alias("best_class"))


def base_rates(images: DataFrame, objects: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: share of images that show, and of objects that belong to, each group."""
    graded = truth_by_image(images.select("image_id").distinct(), objects, groups)
    cols = [_share(F.count(F.when(F.col(f"has_{g}"), 1)), F.count("*")).alias(f"{g}_image_rate") for g in GROUPS]
    cols += [F.coalesce(_share(F.sum(f"{g}_count"), F.sum("gt_count")), F.lit(0.0)).alias(f"{g}_object_rate") for g in GROUPS]
    return graded.agg(*cols)


def selection_metrics(selections: DataFrame, images: DataFrame, objects: DataFrame, groups: DataFrame) -> DataFrame:
    """Per strategy: images, objects, distinct classes and tail classes, and coverage and lift per group.

    Coverage is the group's share of selected images or objects; lift divides it by the pool's share.
    """
    base = base_rates(images, objects, groups)
    picked = selections.select("strategy", "image_id").distinct()
    graded = truth_by_image(picked, objects, groups)
    rates = graded.groupBy("strategy").agg(
        F.count("*").alias("images"),
        F.sum("gt_count").alias("objects"),
        *(_share(F.count(F.when(F.col(f"has_{g}"), 1)), F.count("*")).alias(f"{g}_image_coverage") for g in GROUPS),
        *(F.coalesce(_share(F.sum(f"{g}_count"), F.sum("gt_count")), F.lit(0.0)).alias(f"{g}_object_coverage") for g in GROUPS),
    )
    classes = picked.join(objects.select("image_id", "class_name"), "image_id").select("strategy", "class_name").distinct().join(groups.select("class_name", "group"), "class_name", "left")
    classes = classes.groupBy("strategy").agg(F.count("*").alias("classes"), F.count(F.when(F.col("group") == "tail", 1)).alias("tail_classes"))
    joined = rates.join(classes, "strategy", "left").join(F.broadcast(base))  # base is one row
    lifts = [_share(F.col(f"{g}_{k}_coverage"), F.nullif(F.col(f"{g}_{k}_rate"), F.lit(0.0))).alias(f"{g}_{k}_lift") for k in ("image", "object") for g in GROUPS]
    return joined.select(*rates.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("classes", "tail_classes")), *lifts)


def group_composition(selections: DataFrame, objects: DataFrame, groups: DataFrame) -> DataFrame:
    """(strategy, group, objects, fraction) of the objects in selected images; classes of no group are `none`."""
    mine = selections.select("strategy", "image_id").distinct().join(objects.select("image_id", "class_name"), "image_id").join(groups.select("class_name", "group"), "class_name", "left")
    counts = mine.groupBy("strategy", F.coalesce("group", F.lit("none")).alias("group")).agg(F.count("*").alias("objects"))
    return counts.withColumn("fraction", _share(F.col("objects"), F.sum("objects").over(Window.partitionBy("strategy"))))  # at most four rows a strategy


def cluster_groups(df: DataFrame, *, label: str = "pseudo_label", group: str = "gt_group", name: str = "gt_class", key: str = "proposal_index") -> DataFrame:
    """Per label: rows, rows on objects (group not null), the commonest group and class, tail rows and their fraction.

    The commonest wins ties by its first row (least key). Labels without objects are `background`.
    """
    on = F.col(group).isNotNull()
    totals = df.groupBy(label).agg(F.count("*").alias("proposals"), F.count(group).alias("on_object"), F.count(F.when(F.col(group) == "tail", 1)).alias("tail_objects"))

    def commonest(c: str, out: str) -> DataFrame:
        counts = df.where(on & F.col(c).isNotNull()).groupBy(label, c).agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
        return counts.groupBy(label).agg(F.max_by(c, F.struct("_n", -F.col("_first"))).alias(out))

    joined = totals.join(commonest(group, "_g"), label, "left").join(commonest(name, "_c"), label, "left")
    return joined.select(label, "proposals", "on_object", F.coalesce("_g", F.lit("background")).alias("dominant_group"), F.coalesce("_c", F.lit("")).alias("dominant_class"), "tail_objects", F.coalesce(_share(F.col("tail_objects"), F.col("on_object")), F.lit(0.0)).alias("tail_fraction"))


def label_entropy(df: DataFrame, label: str = "pseudo_label", by: Sequence[str] = ()) -> DataFrame:
    """(by.., entropy) in nats of the labels of df."""
    counts = df.groupBy(*by, label).agg(F.count("*").cast("double").alias("_n"))
    n = F.col("_n")
    # -sum p ln p with p = n / N is ln N - sum(n ln n) / N, so one more aggregate does
    return counts.groupBy(*by).agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("entropy"))


def truth_label(df: DataFrame, objects: DataFrame, groups: DataFrame, out: str = "gt_group") -> DataFrame:
    """df plus the rarest group that its image shows: tail before medium before head, else `none`."""
    per = truth_by_image(df.select("image_id").distinct(), objects, groups)
    rarest = F.when(F.col("has_tail"), "tail").when(F.col("has_medium"), "medium").when(F.col("has_head"), "head").otherwise("none")
    return df.join(per.select("image_id", rarest.alias(out)), "image_id")


def means_by(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """(by, rows, mean_*)."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def tail_against_head(df: DataFrame, values: Sequence[str], group: str = "gt_group") -> DataFrame:
    """(component, ratio, d): mean of the tail over that of the head (floor 1e-12) and Cohen's d between them."""
    long = df.where(F.col(group).isin("head", "tail")).select(group, F.explode(F.array(*(F.struct(F.lit(v).alias("component"), F.col(v).cast("double").alias("value")) for v in values))).alias("_v")).select(group, "_v.*").withColumn("_tail", F.col(group) == "tail")
    ratio = long.groupBy("component").agg((F.avg(F.when(F.col("_tail"), F.col("value"))) / F.greatest(F.avg(F.when(~F.col("_tail"), F.col("value"))), F.lit(FLAT))).alias("ratio"))
    return ratio.join(cohens_d(long, "value", "_tail", ("component",)), "component")


def effect_sizes(df: DataFrame, values: Sequence[str], flag: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., component, d) of flagged against other rows; by groups in which all rows or none are flagged have none."""
    long = df.select(*by, flag, F.explode(F.array(*(F.struct(F.lit(v).alias("component"), F.col(v).cast("double").alias("value")) for v in values))).alias("_v")).select(*by, flag, "_v.*")
    mixed = long.groupBy(*by, "component").agg((F.bool_or(flag) & ~F.bool_and(flag)).alias("_mixed"))
    keys = [*by, "component"]
    return cohens_d(long, "value", flag, tuple(keys)).join(mixed.where("_mixed").drop("_mixed"), keys)


# gate, stability, consensus -------------------------------------------------------------


def gate_impact(df: DataFrame, *, rarity: str = "norm_rarity", gated: str = "norm_gated", key: str = "proposal_index") -> DataFrame:
    """One row: rows, rho, share of positions that change, overlap of the top tenths, mean absolute change.

    Positions order by value down, then key, so each is a rank by (value, key): the distinct-value
    rank plus the place among equals. A position changes if another row stands at it.
    """
    placed = positions(positions(df.select(key, rarity, gated), rarity, "_pr", key=key), gated, "_pg", key=key)
    top = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    sized = placed.join(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    stats = sized.agg(
        F.count("*").alias("proposals"),
        F.avg((F.col("_pr") != F.col("_pg")).cast("double")).alias("changed"),
        _share(F.count(F.when((F.col("_pr") < top) & (F.col("_pg") < top), 1)), F.max(top)).alias("top_overlap"),
        F.avg(F.abs(F.col(gated) - F.col(rarity))).alias("mean_change"),
    )
    return stats.join(F.broadcast(spearman(df, rarity, gated)))  # one row each


def positions(df: DataFrame, value: str, out: str, *, key: str = "proposal_index") -> DataFrame:
    """df plus the zero-based place by value down, then key; global without a window over all rows.

    Range partitions of (value, key) are counted, the counts accumulated, and rows numbered inside them.
    The ranges are drawn by sampling, so they are kept before both readers use them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.select(F.col(key).alias("_pk"), F.col(value).alias("_pv")).repartitionByRange(n, F.col("_pv").desc(), "_pk").withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_pv").desc(), "_pk")))
    ends = inside.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = ends.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row a partition
    ranked = inside.join(starts, "_part").select("_pk", (F.col("_start") + F.col("_in") - 1).alias(out))
    return df.join(ranked, F.col(key) == F.col("_pk")).select(*df.columns, out)


def self_stability(selections: DataFrame) -> DataFrame:
    """(strategy, pairs, mean_jaccard, min_jaccard) over all pairs of seeds in selections(strategy, seed, image_id)."""
    one = selections.select("strategy", "seed", "image_id").distinct()
    sizes = one.groupBy("strategy", "seed").agg(F.count("*").alias("n"))
    l, r = one.alias("l"), one.alias("r")
    shared = l.join(r, (F.col("l.strategy") == F.col("r.strategy")) & (F.col("l.image_id") == F.col("r.image_id")) & (F.col("l.seed") < F.col("r.seed"))).groupBy(F.col("l.strategy").alias("strategy"), F.col("l.seed").alias("a"), F.col("r.seed").alias("b")).agg(F.count("*").alias("_o"))
    a, b = sizes.alias("a"), sizes.alias("b")
    pairs = a.join(b, (F.col("a.strategy") == F.col("b.strategy")) & (F.col("a.seed") < F.col("b.seed"))).select(F.col("a.strategy").alias("strategy"), F.col("a.seed").alias("a"), F.col("b.seed").alias("b"), (F.col("a.n") + F.col("b.n")).alias("_both"))  # seeds are few
    o = F.coalesce("_o", F.lit(0))
    scored = pairs.join(shared, ["strategy", "a", "b"], "left").withColumn("_j", _share(o, F.col("_both") - o))
    return scored.groupBy("strategy").agg(F.count("*").alias("pairs"), F.avg("_j").alias("mean_jaccard"), F.min("_j").alias("min_jaccard"))


def consensus(runs: DataFrame, *, value: str = "norm_gated", key: str = "proposal_index", out: str = "consensus") -> DataFrame:
    """(key, mean, out): value averaged over runs (rows of the same key), then ranked again on the common scale."""
    mean = runs.groupBy(key).agg(F.avg(value).alias("mean"))
    return normalise(mean, "mean", out, "rank")


def weight_sweep(components: DataFrame, weights: Sequence[Mapping[str, float]], *, key: str = "proposal_index", top_k: int = 3, budget: int) -> DataFrame:
    """(sweep, image_id, rank, image_score): the best images under each distinct weighting, in one job.

    components has norm_* columns. Equal weightings are taken once, under the first one's number. Each
    row scores under every weighting as an array, so the components are read once.
    """
    distinct: dict[tuple, int] = {}
    for i, w in enumerate(weights):
        distinct.setdefault(tuple(sorted((k, float(v)) for k, v in w.items() if v)), i)
    scores = [F.struct(F.lit(i).alias("sweep"), sum((F.lit(v) * F.col(f"norm_{k}") for k, v in items), F.lit(0.0)).cast("double").alias("score")) for items, i in distinct.items()]
    long = components.select("image_id", key, F.explode(F.array(*scores)).alias("_s")).select("image_id", key, "_s.*")
    best = long.withColumn("_i", F.row_number().over(Window.partitionBy("sweep", "image_id").orderBy(F.col("score").desc(), key))).where(F.col("_i") <= top_k)
    images = best.groupBy("sweep", "image_id").agg(F.avg("score").alias("image_score"))
    # each sweep keeps `budget` images per partition of images before the final order, so no task sees a whole sweep
    local = images.withColumn("_salt", F.pmod(F.xxhash64("image_id"), F.lit(64)))
    order = [F.col("image_score").desc(), F.col("image_id")]
    near = local.withColumn("_i", F.row_number().over(Window.partitionBy("sweep", "_salt").orderBy(*order))).where(F.col("_i") <= budget)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("sweep").orderBy(*order))).where(F.col("rank") <= budget).select("sweep", "image_id", "rank", "image_score")


# rank-linear models ---------------------------------------------------------------------


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[tuple[str, str], float]]:
    """Row count and population covariances: one aggregate, a handful of numbers to the driver."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    cov = {}
    for i, (a, b) in enumerate(pairs):
        cov[a, b] = cov[b, a] = float(row[f"c{i}"] or 0.0)
    return row["n"], cov


def _ranked(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    out, names = df.select(*columns), []
    for i, c in enumerate(columns):
        out = average_ranks(out, c, f"_r{i}", source=df)
        names.append(f"_r{i}")
    return out.select(*names), names


def _solve(cov: Mapping[tuple[str, str], float], target: str, predictors: Sequence[str]) -> dict[str, float]:
    """Least-squares slopes of target on predictors, of least norm where they are dependent."""
    import numpy as np

    if not predictors:
        return {}
    a = np.array([[cov[p, q] for q in predictors] for p in predictors])
    b = np.array([cov[p, target] for p in predictors])
    return dict(zip(predictors, (float(x) for x in np.linalg.lstsq(a, b, rcond=1e-10)[0]), strict=True))


def semi_partial(df: DataFrame, score: str, components: Sequence[str]) -> dict[str, float]:
    """Per component: correlation of the score's rank with the component's rank, less what the other components' ranks explain.

    All of it follows from the covariances of the ranks. A component that the others explain wholly gives 0;
    a constant score gives NaN.
    """
    ranked, names = _ranked(df, [score, *components])
    _, cov = _moments(ranked, names)
    y, out = names[0], {}
    for i, c in enumerate(components):
        x, others = names[i + 1], [n for j, n in enumerate(names[1:]) if j != i]
        beta = _solve(cov, x, others)
        left = cov[x, x] - sum(b * cov[p, x] for p, b in beta.items())
        both = cov[x, y] - sum(b * cov[p, y] for p, b in beta.items())
        if left < FLAT * max(1.0, cov[x, x]):
            out[c] = 0.0
        elif cov[y, y] < FLAT:
            out[c] = NAN
        else:
            out[c] = both / (left * cov[y, y]) ** 0.5
    return out


def incremental_r2(df: DataFrame, score: str, components: Sequence[str]) -> dict[str, float]:
    """Per component: the share of the score's rank variance that a rank-linear model loses without it; 0 for a constant score."""
    ranked, names = _ranked(df, [score, *components])
    _, cov = _moments(ranked, names)
    y = names[0]
    if cov[y, y] < FLAT:
        return dict.fromkeys(components, 0.0)

    def r2(predictors: Sequence[str]) -> float:
        return sum(b * cov[p, y] for p, b in _solve(cov, y, predictors).items()) / cov[y, y]

    every = names[1:]
    whole = r2(every)
    return {c: whole - r2([n for j, n in enumerate(every) if j != i]) for i, c in enumerate(components)}


# thresholds, splits ---------------------------------------------------------------------


def threshold_counts(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, rows, images) of the rows at or above each threshold, in one pass."""
    hit = F.array(*(F.struct(F.lit(float(t)).alias("threshold")) for t in thresholds))
    long = df.select("image_id", F.explode(F.filter(hit, lambda t: F.col(value) >= t["threshold"])).alias("_t"))
    counts = long.groupBy("_t.threshold").agg(F.count("*").alias("_rows"), F.count_distinct("image_id").alias("_images"))
    frame = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return frame.join(counts, "threshold", "left").select("threshold", F.coalesce("_rows", F.lit(0)).alias("rows"), F.coalesce("_images", F.lit(0)).alias("images"))


def split_overlaps(splits: DataFrame) -> DataFrame:
    """(left, right, shared) for pairs of splits in splits(split, image_id) that share images; disjoint pairs have no row."""
    one = splits.select("split", "image_id").distinct()
    shared = one.groupBy("image_id").agg(F.array_sort(F.collect_set("split")).alias("_s")).where(F.size("_s") > 1)  # splits are few
    pairs = shared.select(F.explode(F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.count("*").alias("shared"))


def stratify(objects: DataFrame, images: DataFrame, known: Sequence[str]) -> DataFrame:
    """images plus stratum: `unknown` if any object is of no known class, `known` if all are known, `empty` without objects."""
    per = objects.groupBy("image_id").agg(F.bool_and(F.col("class_name").isin(*known)).alias("_all"))
    return images.join(per, "image_id", "left").select(*images.columns, F.when(F.col("_all").isNull(), "empty").when(F.col("_all"), "known").otherwise("unknown").alias("stratum"))


def random_sample(images: DataFrame, n: int, seed: object, by: Sequence[str] = ()) -> DataFrame:
    """n rows (of each stratum) in the order of a hash of seed and id: the same in every run, engine and slicing."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("image_id")), 256)
    if not by:
        return images.withColumn("_h", h).orderBy("_h", "image_id").limit(n).drop("_h")
    salted = images.withColumn("_h", h).withColumn("_salt", F.substring("_h", 64, 1))  # a first cut per salt spreads a hot stratum
    near = salted.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy("_h", "image_id"))).where(F.col("_i") <= n)
    return near.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "image_id"))).where(F.col("_i") <= n).select(*images.columns)


# moments, rounds and comparisons ------------------------------------------------------------


def component_statistics(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., component, rows, mean, std, low, high) of each value; std over the rows themselves."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("component"), F.col(v).cast("double").alias("value")) for v in values))).alias("_v")).select(*by, "_v.*")
    return long.groupBy(*by, "component").agg(F.count("value").alias("rows"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


def round_moments(df: DataFrame, values: Sequence[str], by: Sequence[str] = ("variant", "round")) -> DataFrame:
    """(by.., mean_*, std_*): sample deviations, null for a single row."""
    return df.groupBy(*by).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", lambda v: F.when(F.count(v) > 1, F.stddev_samp(v))))))


def means_by_regime(df: DataFrame, size: str, values: Sequence[str]) -> DataFrame:
    """(regime, proposals, mean_*) by regime of cluster size; regimes without proposals have 0 and nulls."""
    regimes = df.sparkSession.createDataFrame([(r,) for r in ("singleton", "2-3", "4-5", "6+")], "regime string")
    got = df.groupBy(V.size_regime(F.col(size)).alias("regime")).agg(F.count("*").alias("proposals"), *(F.avg(v).alias(f"mean_{v}") for v in values))
    return regimes.join(got, "regime", "left").fillna(0, ["proposals"])


def below_neighbours(df: DataFrame, size: str, label: str, coherence: str, neighbours: int) -> DataFrame:
    """One row: proposals in clusters of at most `neighbours`, their fraction and classes, and the mean coherence of them and of the others."""
    below = F.col(size) <= neighbours
    return df.agg(
        F.count_if(below).alias("proposals"),
        F.avg(below.cast("double")).alias("fraction"),
        F.count_distinct(F.when(below, F.col(label))).alias("classes"),
        F.avg(F.when(below, F.col(coherence))).alias("mean_below"),
        F.avg(F.when(~below, F.col(coherence))).alias("mean_above"),
    )


def compare_metrics(old: DataFrame, new: DataFrame, values: Sequence[str], on: Sequence[str] = ("strategy", "budget")) -> DataFrame:
    """(on.., old_*, new_*, delta_*) for the keys that both have."""
    left = old.select(*on, *(F.col(v).alias(f"old_{v}") for v in values))
    right = new.select(*on, *(F.col(v).alias(f"new_{v}") for v in values))
    return left.join(right, list(on)).select("*", *((F.col(f"new_{v}") - F.col(f"old_{v}")).alias(f"delta_{v}") for v in values))


def round_deltas(rounds: DataFrame, value: str = "metric") -> DataFrame:
    """(variant, first_round, last_round, delta) between the last and the first round of each variant."""
    return rounds.groupBy("variant").agg(F.min("round").alias("first_round"), F.max("round").alias("last_round"), (F.max_by(value, "round") - F.min_by(value, "round")).alias("delta"))


def metric_pivot(rounds: DataFrame, value: str = "metric") -> DataFrame:
    """A row a variant, a column r<round> for every round that any variant has."""
    years = [r[0] for r in rounds.select("round").distinct().orderBy("round").collect()]  # a column each
    return rounds.groupBy("variant").pivot("round", years).agg(F.max(value)).select("variant", *(F.col(str(y)).alias(f"r{y}") for y in years))


def overlap_matrix(selections: DataFrame, order: Sequence[str]) -> DataFrame:
    """A row and a column a strategy with the number of images that both select, from selections(strategy, image_id)."""
    names, one = list(order), selections.select("strategy", "image_id").distinct()
    both = one.join(one.select("image_id", F.col("strategy").alias("_other")), "image_id")  # a row a pair of strategies and image
    return both.groupBy("strategy").pivot("_other", names).agg(F.count("image_id")).fillna(0, names)


def class_lookup(df: DataFrame, groups: DataFrame, *, default: str | None = None) -> DataFrame:
    """df plus the group of its class_name: `default` for unlisted classes; without one they raise ValueError."""
    joined = df.join(groups.select("class_name", "group"), "class_name", "left")
    if default is None:
        bad = joined.where("group is null").select("class_name").distinct().limit(20).collect()
        if bad:
            raise ValueError("classes without a group: " + ", ".join(sorted(str(r[0]) for r in bad)))
        return joined
    return joined.fillna(default, ["group"])
