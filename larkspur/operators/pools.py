"""Class groups, support counts and long-tail pools."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def object_counts(objects: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(class_name, n): objects per class; classes without any count 0 if a list is given."""
    n = objects.groupBy("class_name").agg(F.count("*").alias("n"))
    return n if classes is None else classes.select("class_name").distinct().join(n, "class_name", "left").fillna(0, ["n"])


def presence_counts(objects: DataFrame) -> DataFrame:
    """(class_name, n): images that show each class."""
    return objects.select("image_id", "class_name").distinct().groupBy("class_name").agg(F.count("*").alias("n"))


def frequency_ranks(counts: DataFrame) -> DataFrame:
    """counts plus rank: 0 for the most frequent class; ties by name. Classes are few."""
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "class_name")) - 1)


def threshold_groups(counts: DataFrame, head_min: int, tail_max: int) -> DataFrame:
    if head_min <= tail_max:
        raise ValueError("head_min must exceed tail_max")
    return counts.withColumn("group", F.when(F.col("n") <= tail_max, "tail").when(F.col("n") >= head_min, "head").otherwise("medium"))


def third_groups(counts: DataFrame) -> DataFrame:
    """counts plus rank and head, medium or tail by thirds of the ranks, earlier thirds the larger."""
    ranked = frequency_ranks(counts)
    c = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("group", F.when(F.col("rank") < F.floor((c + 2) / 3), "head").when(F.col("rank") < F.floor((2 * c + 2) / 3), "medium").otherwise("tail"))


def support(objects: DataFrame, groups: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """One row: known, unknown, head, medium and tail objects."""
    joined = objects.join(groups.select("class_name", "group"), "class_name", "left")
    k = F.col("class_name").isin(*known) if known else F.lit(False)
    part = {g: F.sum(F.when(~k & (F.col("group") == g), 1).otherwise(0)).alias(g) for g in ("head", "medium", "tail")}
    return joined.agg(F.sum(k.cast("long")).alias("known"), F.sum((~k).cast("long")).alias("unknown"), *part.values())


def class_support(objects: DataFrame, groups: DataFrame) -> DataFrame:
    """(class_name, group, n): the objects of every class; group is null for classes without one."""
    return object_counts(objects).join(groups.select("class_name", "group"), "class_name", "left").select("class_name", "group", "n")


def long_tail_targets(counts: DataFrame, ratio: float) -> DataFrame:
    """counts plus rank and target: a geometric decay from the largest class, at least 1, at most n; 0 for empty classes."""
    ranked = frequency_ranks(counts)
    w = Window.partitionBy()
    span = F.greatest(F.count("*").over(w) - 1, F.lit(1)).cast("double")
    ideal = F.bround(F.max("n").over(w).cast("double") * F.pow(F.lit(float(ratio)), -F.col("rank") / span), 0).cast("long")
    return ranked.withColumn("target", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.least("n", F.greatest(F.lit(1).cast("long"), ideal))).cast("long"))


def group_ratio(pool: DataFrame) -> DataFrame:
    """One row from (group, target, realised): mean of both per group and head over tail, null over 0."""
    by = pool.groupBy("group").agg(F.avg("target").alias("t"), F.avg("realised").alias("r"))
    cols = [F.max(F.when(F.col("group") == g, F.col(c))).alias(f"{g}_{n}") for g in ("head", "medium", "tail") for c, n in (("t", "target"), ("r", "realised"))]
    one = by.agg(*cols)
    return one.withColumn("target_ratio", F.try_divide("head_target", "tail_target")).withColumn("realised_ratio", F.try_divide("head_realised", "tail_realised"))


def _quotas(counts: dict[str, int], want: dict[str, int], seed: int) -> dict[str, int]:
    """Images that the greedy loop takes of each signature.

    Among the images left it takes one that shows most open classes, then one whose classes exceed
    their targets least in sum, then by the signatures' seeded order. Signatures with as many open
    classes and the same full ones always score alike, so they share a bucket. A bucket's excess
    only grows, so the bucket on top of the heap is the best one once its excess is renewed.
    Buckets are made anew whenever a class fills up.
    """
    order = sorted(counts)
    random.Random(seed).shuffle(order)
    sets = [[c for c in s.split("\x1f") if c in want] for s in order]
    left = [counts[s] for s in order]
    have = dict.fromkeys(want, 0)
    changed = True
    while changed:
        changed = False
        buckets: dict[tuple[int, tuple[str, ...]], list[int]] = {}
        for i, classes in enumerate(sets):
            full = tuple(c for c in classes if have[c] >= want[c])
            if left[i] and len(full) < len(classes):
                buckets.setdefault((len(classes) - len(full), full), []).append(i)
        for members in buckets.values():
            members.reverse()  # first at the end
        heap = [(-k, sum(have[c] + 1 - want[c] for c in full), members[-1], full) for (k, full), members in buckets.items()]
        heapq.heapify(heap)
        while heap and not changed:
            k, over, i, full = heap[0]
            now = sum(have[c] + 1 - want[c] for c in full)
            members = buckets[-k, full]
            if now != over:
                heapq.heapreplace(heap, (k, now, i, full))
                continue
            left[i] -= 1
            for c in sets[i]:
                have[c] += 1
                changed |= have[c] == want[c]
            if not left[i]:
                members.pop()
                if members:
                    heapq.heapreplace(heap, (k, now, members[-1], full))
                else:
                    heapq.heappop(heap)
    return {s: counts[s] - n for s, n in zip(order, left, strict=True)}


def long_tail_pool(objects: DataFrame, targets: DataFrame, *, seed: int = 0) -> DataFrame:
    """(image_id): images that greedily fill the class targets; classes without a target do not count.

    Images with the same set of classes are interchangeable up to their random tie-break, so they are
    counted per signature in the engine; only signatures with their counts reach the driver (at most
    as many as images, or as two to the power of the classes), and the draws per signature go back
    as a table.
    """
    want = {r["class_name"]: r["target"] for r in targets.collect()}  # classes are few
    known = objects.join(F.broadcast(targets.select("class_name").distinct()), "class_name", "left_semi")
    sig = known.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("class_name")), "\x1f").alias("signature"))
    counts = {r["signature"]: r["count"] for r in sig.groupBy("signature").count().collect()}
    taken = _quotas(counts, want, seed)
    spark = objects.sparkSession
    draws = spark.createDataFrame([(s, n) for s, n in taken.items() if n] or [("", 0)], "signature string, quota long")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("image_id").cast("string")), 256)
    ranked = sig.join(draws, "signature").withColumn("_i", F.row_number().over(Window.partitionBy("signature").orderBy(h)))
    return ranked.where(F.col("_i") <= F.col("quota")).select("image_id")


def overlap(left: DataFrame, right: DataFrame, key: str = "image_id") -> DataFrame:
    return left.select(key).intersect(right.select(key))
