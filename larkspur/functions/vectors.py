"""Column expressions on ARRAY<DOUBLE> vectors, posteriors and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Left fold of products: the same order everywhere, so equal vectors give equal bits."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalise(v: Column) -> Column:
    """v over the larger of its length and 1e-12."""
    return F.element_at(F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / F.greatest(s["n"], F.lit(TINY)))), 1)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def probabilities(p: Column) -> Column:
    """p over its mass; raises for fewer than two classes, negative entries or no mass."""
    checked = (
        F.when(F.size(p) < 2, F.raise_error(F.lit("a posterior needs two classes or more")))
        .when(F.exists(p, lambda x: x < 0), F.raise_error(F.lit("a posterior has a negative entry")))
        .when(total(p) <= 0, F.raise_error(F.lit("a posterior has no mass")))
        .otherwise(total(p))
    )
    return F.element_at(F.transform(F.array(F.struct(p.alias("p"), checked.cast("double").alias("m"))), lambda s: F.transform(s["p"], lambda x: x / s["m"])), 1)


def entropy(p: Column) -> Column:
    """Shannon entropy of a normalised posterior over log K, clipped to [0, 1]."""
    return clip(-total(F.transform(p, lambda x: x * F.log(x + TINY))) / F.log(F.size(p).cast("double")))


def one_minus_max(p: Column) -> Column:
    return F.lit(1.0) - F.array_max(p)


def margin(p: Column) -> Column:
    return F.element_at(F.transform(F.array(F.sort_array(p, False)), lambda s: F.lit(1.0) - (F.get(s, 0) - F.get(s, 1))), 1)


def legacy_confidence(c: Column) -> Column:
    """1 - |2c - 1|; raises outside [0, 1]."""
    return F.when((c < 0) | (c > 1) | c.isNull() | F.isnan(c), F.raise_error(F.lit("confidence must lie in [0, 1]"))).otherwise(F.lit(1.0) - F.abs(2.0 * c - 1.0)).cast("double")


def argmax(p: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("long")


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of xyxy structs; negative extents count as zero, no union gives zero."""

    def area(x: Column) -> Column:
        return F.greatest(x["x2"] - x["x1"], F.lit(0.0)) * F.greatest(x["y2"] - x["y1"], F.lit(0.0))

    inter = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / F.nullif(union, F.lit(0.0)))


def xyxy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def cxcywh_to_xyxy(box: Column, width: Column, height: Column) -> Column:
    """Normalised centre, width and height to pixel corners."""
    cx, cy, w, h = (F.get(box, i) for i in range(4))
    return xyxy((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def size_regime(n: Column) -> Column:
    return F.when(n <= 1, "singleton").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")


def derive_seed(*parts: Column) -> Column:
    """First four bytes, big-endian, of the SHA-256 of the parts joined by pipes."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("long")


def derive_pool_seed(seed: Column, round_: Column) -> Column:
    """The seed of a round's pool, the same for every strategy."""
    return derive_seed(F.lit("pool"), seed, round_)
