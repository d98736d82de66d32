"""Synthetic proposal pools, drawn in the engine: a row's draws depend on the seed and its number only.

So a pool is the same under any partitioning, and its size is bounded by the cluster, not by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Measured range of the detector's raw objectness, its temperature and width.
RAW_OBJECTNESS, TEMPERATURE, WIDTH = (69.4, 467.2), 1.3, 256

POOL_SCHEMA = "proposal_index long, image_id string, embedding array<double>, confidence double, posterior array<double>, predicted_label long, objectness double, true_class string, on_object boolean, outlier boolean"
REGIME_SCHEMA = "proposal_index long, image_id string, embedding array<double>, true_label long"


def long_tail_schedule(classes: int, largest: int, ratio: float) -> list[int]:
    """Images per class: geometric decay from largest to largest / ratio, rounded half to even, at least 1."""
    if classes < 1 or largest < 1 or ratio < 1:
        raise ValueError("classes, largest and ratio must be 1 or more")
    steps = max(classes - 1, 1)
    return [max(1, round(largest * ratio ** (-i / steps))) for i in range(classes)]


def _centres(seed: int, n: int, dim: int, separation: float) -> np.ndarray:
    return np.random.default_rng([seed, 0]).normal(size=(n, dim)) * separation


def _direction(rng: np.random.Generator, dim: int, radius: float) -> np.ndarray:
    v = rng.normal(size=dim)
    return v * (radius / max(float(np.linalg.norm(v)), 1e-12))


def _drawn(spark: SparkSession, rows: int, one, schema: str) -> DataFrame:
    """one(number) -> dict for each number below rows."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    names = kind.fieldNames()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in range(0, len(ids), 1024):
                made = [one(i) for i in ids[at : at + 1024]]
                yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], arrow.field(n).type) for n in names], schema=arrow)

    return spark.range(rows).mapInArrow(run, kind)


def regime_pool(spark: SparkSession, sizes: Sequence[int], *, isolated: int = 0, dim: int = 32, separation: float = 8.0, spread: float = 0.6, radius: float = 30.0, per_image: int = 4, seed: int = 0) -> DataFrame:
    """Classes of exactly the given sizes, equally well formed, then `isolated` rows that are classes of their own."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(sizes) else 0
    centres = _centres(seed, len(sizes), dim, separation)

    def one(i: int) -> dict:
        rng = np.random.default_rng([seed, 1, i])
        k = int(np.searchsorted(ends, i, side="right"))
        e = centres[k] + rng.normal(scale=spread, size=dim) if i < total else _direction(rng, dim, radius)
        return {"proposal_index": i, "image_id": f"img_{i // per_image:04d}", "embedding": e.tolist(), "true_label": k if i < total else len(sizes) + i - total}

    return _drawn(spark, total + isolated, one, REGIME_SCHEMA)


def long_tail_proposals(
    spark: SparkSession, *, classes: int = 20, largest: int = 30, ratio: float = 20.0, per_image: int = 20, on_object: float = 0.35, outliers: float = 0.05, dim: int = 256, separation: float = 6.0, spread: float = 1.0, background_spread: float = 3.0, radius: float = 25.0, known: int = 40, seed: int = 0
) -> DataFrame:
    """A long-tail pool: rows on an object of the image's class, background rows and planted outliers.

    Rows on objects have higher objectness and more mass on the unknown slot (the last) of the posterior.
    """
    if not 0 < on_object <= 1 or not 0 <= outliers < 1:
        raise ValueError("on_object must lie in (0, 1], outliers in [0, 1)")
    ends = np.cumsum(long_tail_schedule(classes, largest, ratio))
    centres = _centres(seed, classes + 1, dim, separation)  # the last is the background's
    low, high = RAW_OBJECTNESS
    span = high - low

    def one(i: int) -> dict:
        rng = np.random.default_rng([seed, 2, i])
        image = i // per_image
        k = int(np.searchsorted(ends, image, side="right"))
        draw = rng.random()
        planted, hit = draw < outliers, outliers <= draw < outliers + on_object
        if planted:
            e = _direction(rng, dim, radius)
        else:
            e = centres[k if hit else classes] + rng.normal(scale=spread if hit else background_spread, size=dim)
        raw = rng.uniform(low, low + 0.45 * span) if hit else rng.uniform(low + 0.35 * span, high)
        objectness = float(np.exp(-TEMPERATURE / WIDTH * raw))
        logits = rng.normal(-3.8, 1.2, size=known + 1)
        if hit:
            logits[-1] += rng.normal(3.2, 0.9)
        elif planted:
            logits[-1] += rng.normal(1.2, 1.5)
        joint = objectness / (1.0 + np.exp(-logits))
        p = joint / max(float(joint.sum()), 1e-12)
        return {
            "proposal_index": i, "image_id": f"sim_{image:06d}", "embedding": e.tolist(), "confidence": float(min(max(joint[-1], 0.0), 1.0)), "posterior": p.tolist(), "predicted_label": int(p.argmax()),
            "objectness": objectness, "true_class": "outlier" if planted else f"task_class_{k:02d}" if hit else "background", "on_object": bool(hit), "outlier": bool(planted),
        }

    return _drawn(spark, int(ends[-1]) * per_image, one, POOL_SCHEMA)


def long_tail_images(spark: SparkSession, *, classes: int = 20, largest: int = 30, ratio: float = 20.0) -> DataFrame:
    """(image_id, class_name): the ground truth of long_tail_proposals with the same parameters."""
    ends = np.cumsum(long_tail_schedule(classes, largest, ratio)).tolist()
    return _drawn(spark, ends[-1], lambda i: {"image_id": f"sim_{i:06d}", "class_name": f"task_class_{int(np.searchsorted(ends, i, side='right')):02d}"}, "image_id string, class_name string")
