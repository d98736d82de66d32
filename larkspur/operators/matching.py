"""Detection metrics: greedy matching, recall, average precision, per group, with ignore boxes.

Matching is independent per image: detections and targets of an image are gathered (an
image's boxes are few by nature) and folded over in score order inside the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators.ranks import dealt
from larkspur.session import cut

GROUPS = ("head", "medium", "tail")


def _gathered(df: DataFrame, by: list[str], fields: list[Column], out: str, descending: bool = False) -> DataFrame:
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))


def match(detections: DataFrame, targets: DataFrame, *, ignore: DataFrame | None = None, threshold: float = 0.5, class_aware: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., image_id, det_idx, score, gt_idx, tp, fp, ignored), a row for each detection.

    detections: image_id, det_idx, score, box, class_name; targets and ignore: image_id, gt_idx, box,
    class_name, plus the `by` columns, over which detections are repeated if they lack them. In
    order of score down (then det_idx), a detection takes the free target of its image with the
    greatest IoU >= threshold (the lower gt_idx of equals); else it is ignored if any ignore
    box reaches the threshold, which is not used up; else it is a false positive.
    """
    keys = [*by, "image_id"]
    dets = _gathered(detections, keys, [(-F.col("score")).alias("minus"), F.col("det_idx"), F.col("box"), F.col("class_name").alias("name")], "_dets")
    gts = _gathered(targets, keys, [F.col("gt_idx"), F.col("box"), F.col("class_name").alias("name")], "_gts")
    joined = dets.join(gts, keys, "left")
    if ignore is not None:
        joined = joined.join(_gathered(ignore, keys, [F.col("gt_idx"), F.col("box"), F.col("class_name").alias("name")], "_ign"), keys, "left")
    else:
        joined = joined.withColumn("_ign", F.lit(None).cast("array<struct<gt_idx:bigint,box:struct<x1:double,y1:double,x2:double,y2:double>,name:string>>"))
    same = (lambda d, t: d["name"] == t["name"]) if class_aware else (lambda d, t: F.lit(True))
    empty_gts = F.expr("cast(array() as array<struct<gt_idx:bigint,box:struct<x1:double,y1:double,x2:double,y2:double>,name:string>>)")
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("used"), F.expr("cast(array() as array<struct<det_idx:bigint,score:double,gt_idx:bigint,ignored:boolean>>)").alias("rows"))

    def reaches(iou: Column) -> Column:
        return iou >= threshold if threshold > 0 else iou > 0

    def step(a: Column, d: Column) -> Column:
        reach = F.transform(
            F.filter(F.coalesce("_gts", empty_gts), lambda t: same(d, t) & ~F.array_contains(a["used"], t["gt_idx"]) & reaches(V.box_iou(d["box"], t["box"]))),
            lambda t: F.struct((-V.box_iou(d["box"], t["box"])).alias("minus"), t["gt_idx"].cast("long").alias("gt_idx")),
        )
        taken = F.array_min(reach)["gt_idx"]
        touches = F.exists(F.coalesce("_ign", empty_gts), lambda t: same(d, t) & (V.box_iou(d["box"], t["box"]) >= threshold))

        def after(t: Column) -> Column:
            row = F.struct(d["det_idx"].cast("long").alias("det_idx"), (-d["minus"]).cast("double").alias("score"), t.alias("gt_idx"), (t.isNull() & touches).alias("ignored"))
            used = F.when(t.isNull(), a["used"]).otherwise(F.concat(a["used"], F.array(t)))
            return F.struct(used.alias("used"), F.concat(a["rows"], F.array(row)).alias("rows"))

        return F.element_at(F.transform(F.array(taken), after), 1)  # the search runs once a detection

    folded = joined.select(*keys, F.explode(F.aggregate("_dets", start, step, lambda a: a["rows"])).alias("m"))
    tp = F.col("m.gt_idx").isNotNull()
    return folded.select(*keys, "m.det_idx", "m.score", "m.gt_idx", tp.cast("long").alias("tp"), (~tp & ~F.col("m.ignored")).cast("long").alias("fp"), F.col("m.ignored").cast("long").alias("ignored"))


def recall(matches: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., support, matched, recall); NaN without targets."""
    support = targets.groupBy(*by).agg(F.count("*").alias("support"))
    got = matches.groupBy(*by).agg(F.sum("tp").alias("matched"))
    joined = support.join(got, list(by), "full") if by else support.join(F.broadcast(got))  # one row each
    s, m = F.coalesce("support", F.lit(0)), F.coalesce("matched", F.lit(0))
    return joined.select(*by, s.alias("support"), m.alias("matched"), F.when(s == 0, F.lit(float("nan"))).otherwise(F.try_divide(m.cast("double"), s.cast("double"))).alias("recall"))


def average_precision(matches: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., ap): all-point average precision; NaN without targets, 0 without detections.

    The order (score, image, detection) is global. It is dealt to range partitions: running sums and
    the envelope, the greatest precision from a row on, are made in each and joined with those of the
    partitions before and after it. The envelope runs from the end, so that its frame only grows.
    """
    support = targets.groupBy(*by).agg(F.count("*").alias("_support"))
    order, back = [F.col("score").desc(), F.col("image_id"), F.col("det_idx")], [F.col("score").asc(), F.col("image_id").desc(), F.col("det_idx").desc()]
    rows = dealt(matches.select(*by, "score", "image_id", "det_idx", "tp", "fp"), order, by)
    upto = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_part").agg(F.sum("tp").alias("_t"), F.sum("fp").alias("_f"))
    sums = sums.select(*by, "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_t", "_f")))
    keys = [*by, "_part"]
    curve = rows.withColumn("_tp", F.sum("tp").over(upto)).withColumn("_fp", F.sum("fp").over(upto)).join(sums, keys)
    hits = (F.col("_tp") + F.col("_t")).cast("double")
    curve = curve.withColumn("_p", hits / F.greatest(hits + (F.col("_fp") + F.col("_f")).cast("double"), F.lit(1e-12)))
    curve = curve.withColumn("_inner", F.max("_p").over(Window.partitionBy(*keys).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)))
    curve = cut(curve.select(*keys, "tp", "_inner"))
    best = curve.groupBy(*keys).agg(F.max("_inner").alias("_best"))
    best = best.select(*keys, F.max("_best").over(later).alias("_after"))
    area = curve.join(best, keys).groupBy(*by).agg(F.sum(F.col("tp") * F.greatest("_inner", "_after")).alias("_area"))
    joined = support.join(area, list(by), "left") if by else support.join(F.broadcast(area))
    ap = F.when(F.col("_support") == 0, F.lit(float("nan"))).otherwise(F.coalesce("_area", F.lit(0.0)) / F.nullif(F.col("_support").cast("double"), F.lit(0.0)))
    return joined.select(*by, ap.alias("ap"))


def grouped_matches(detections: DataFrame, truth: DataFrame, groups: DataFrame, *, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(matches, targets) with a column `group`: each group in turn is the target, the other groups are ignored.

    groups: class_name, group (a small dimension). Every detection is matched once a group.
    """
    names = groups.select(F.col("group").alias("_g")).distinct()
    known = truth.join(groups, "class_name")
    targets = known
    repeated = known.withColumnRenamed("group", "_own").join(names, F.col("_own") != F.col("_g")).select("image_id", "gt_idx", "box", "class_name", F.col("_g").alias("group"))
    each = detections.withColumn("_all", F.lit(1)).join(F.broadcast(names.withColumn("_all", F.lit(1))), "_all").drop("_all").withColumnRenamed("_g", "group")  # a row for each group
    return match(each, targets, ignore=repeated, threshold=threshold, by=("group",)), targets


def grouped_metrics(detections: DataFrame, truth: DataFrame, groups: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(group, support, matched, recall, ap) for `overall` and every group."""
    all_targets = truth.join(groups, "class_name").drop("group")
    whole = match(detections, all_targets, threshold=threshold).withColumn("group", F.lit("overall"))
    overall = all_targets.withColumn("group", F.lit("overall"))
    parts, targets = grouped_matches(detections, truth, groups, threshold=threshold)
    columns = ["group", "image_id", "det_idx", "score", "gt_idx", "tp", "fp", "ignored"]
    m = cut(whole.select(*columns).unionByName(parts.select(*columns)))  # two readers
    t = overall.select("group", "image_id", "gt_idx").unionByName(targets.select("group", "image_id", "gt_idx"))
    return recall(m, t, ("group",)).join(average_precision(m, t, ("group",)), "group")


def legacy_grouped_recall(detections: DataFrame, truth: DataFrame, groups: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(group, support, matched, recall) from one matching of all classes, split afterwards."""
    known = truth.join(groups, "class_name")
    hit = match(detections, known, threshold=threshold).where("gt_idx is not null").select("image_id", "gt_idx", F.lit(1).alias("hit"))
    marked = known.join(hit, ["image_id", "gt_idx"], "left")
    return marked.groupBy("group").agg(F.count("*").alias("support"), F.coalesce(F.sum("hit"), F.lit(0)).alias("matched")).withColumn("recall", F.col("matched").cast("double") / F.col("support"))


def validate_metrics(metrics: DataFrame, tolerance: float = 1e-9) -> None:
    """Raise ValueError unless group supports add up and recalls agree with their counts."""
    rows = {r["group"]: r for r in metrics.collect()}  # one row a group
    parts = [r for g, r in rows.items() if g != "overall"]
    if sum(r["support"] for r in parts) != rows["overall"]["support"]:
        raise ValueError("group supports do not add up to the total")
    for r in rows.values():
        if r["matched"] > r["support"]:
            raise ValueError(f"{r['group']}: more matches than targets")
        if r["support"] and abs(r["recall"] - r["matched"] / r["support"]) > tolerance:
            raise ValueError(f"{r['group']}: recall disagrees with its counts")
        if not r["support"] and r["recall"] == r["recall"]:
            raise ValueError(f"{r['group']}: recall without targets")


def validate_categories(df: DataFrame, vocabulary: DataFrame, extra: tuple[str, ...] = ("unknown",)) -> None:
    """Raise ValueError naming classes of df that are neither in vocabulary(class_name) nor extra."""
    bad = df.select("class_name").distinct().where(~F.col("class_name").isin(*extra)).join(vocabulary, "class_name", "left_anti").limit(20).collect()
    if bad:
        raise ValueError("unknown classes: " + ", ".join(sorted(r[0] for r in bad)))
