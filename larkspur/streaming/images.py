"""Image scores over streams of scored proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.scoring import AGGREGATIONS


def windowed_image_scores(stream: DataFrame, *, method: str = "max", score: str = "score", time: str = "at", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(begins, image_id, image_score, rows) per event-time window; state is dropped once the watermark passes.

    Methods whose state is a few numbers an image: max, mean and noisy_or. top_k_mean needs the rows
    themselves, so it raises ValueError here; score stored tables with it.
    """
    if method not in AGGREGATIONS or method == "top_k_mean":
        raise ValueError(f"{method!r} has no bounded state; use max, mean or noisy_or")
    s = F.col(score).cast("double")
    value = {"max": F.max(s), "mean": F.avg(s), "noisy_or": 1.0 - F.exp(F.sum(F.log1p(-F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0 - 1e-12)))))}[method]
    timed = stream.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("_w"), "image_id").agg(value.alias("image_score"), F.count("*").alias("rows")).select(F.col("_w.start").alias("begins"), "image_id", "image_score", "rows")
