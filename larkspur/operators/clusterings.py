"""Ways to make pseudo-labels beyond one run of k-means, and how far labels agree between seeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators.components import cluster_sizes, kmeans_labels
from larkspur.operators.stats import SAMPLE_ROWS, adjusted_rand, silhouette, spearman
from larkspur.session import cut


def best_kmeans_labels(df: DataFrame, *, clusters: int = 20, seed: int = 0, starts: int = 10, fit_on: Column | None = None, key: str = "proposal_index", embedding: str = "embedding", out: str = "pseudo_label", max_iter: int = 100) -> DataFrame:
    """df plus the labels of the least costly of `starts` k-means on unit vectors, the first on ties.

    The models are fitted on the rows where fit_on holds (all without it) and label every row. k is at
    most the number of rows fitted on; with one such row, or none, every label is 0.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if starts < 1:
        raise ValueError("starts must be 1 or more")
    unit = df.withColumn("_v", array_to_vector(V.l2_normalise(V.as_double(F.col(embedding)))))
    fitted_on = cut((unit if fit_on is None else unit.where(fit_on)).select(key, "_v")).orderBy(key)
    k = fitted_on.limit(clusters).count()
    if k <= 1:
        return df.withColumn(out, F.lit(0).cast("long"))
    models = (KMeans(k=k, seed=seed * starts + i, maxIter=max_iter, featuresCol="_v", predictionCol="_p").fit(fitted_on) for i in range(starts))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(unit).select(*df.columns, F.col("_p").cast("long").alias(out))


def confident_kmeans_labels(df: DataFrame, *, quantile: float = 0.75, confidence: str = "confidence", **kw) -> DataFrame:
    """df plus labels of k-means fitted on the rows whose confidence is at or above its quantile."""
    level = df.agg(F.percentile(confidence, quantile)).first()[0]
    kw = {"starts": 1} | kw
    return best_kmeans_labels(df, fit_on=F.lit(False) if level is None else F.col(confidence) >= level, **kw)


def choose_clusters(df: DataFrame, counts: Sequence[int] = (10, 20, 40), *, seed: int = 0, key: str = "proposal_index", embedding: str = "embedding", default: int = 20) -> int:
    """The count whose k-means has the greatest silhouette on at most SAMPLE_ROWS rows, taken by a hash of their key; the first on ties.

    Like the silhouette, the sample is part of the measure. Without a defined silhouette it is `default`.
    """
    unit = df.select(key, V.l2_normalise(V.as_double(F.col(embedding))).alias(embedding))
    sample = cut(unit.orderBy(F.xxhash64(F.col(key)), key).limit(SAMPLE_ROWS))
    best, most = default, -1.0
    for k in counts:
        score = silhouette(kmeans_labels(sample, clusters=k, seed=seed, key=key, embedding=embedding), embedding=embedding, key=key).first()[0]
        if score > most:  # false for NaN
            best, most = k, score
    return best


def label_agreement(runs: DataFrame, reference: int, seeds: Sequence[int], *, key: str = "proposal_index", label: str = "pseudo_label") -> DataFrame:
    """(seed, ari, size_rho) of runs(seed, key, label) against the run of the reference seed.

    ari: adjusted Rand index; size_rho: Spearman correlation of the sizes of each row's clusters. Seeds are few.
    """
    def sized(seed: int, l: str, n: str) -> DataFrame:
        one = runs.where(F.col("seed") == seed).select(key, F.col(label).alias(l))
        return cluster_sizes(one, label=l, out=n)

    first, rows = sized(reference, "_a", "_na"), []
    for seed in seeds:
        if seed != reference:
            both = cut(first.join(sized(seed, "_b", "_nb"), key))
            rand = adjusted_rand(both, "_a", "_b")
            rows.append(rand.select(F.col(rand.columns[0]).alias("ari")).join(F.broadcast(spearman(both, "_na", "_nb", out="size_rho"))).select(F.lit(seed).alias("seed"), "ari", "size_rho"))  # one row each
    if not rows:
        raise ValueError("no seed besides the reference")
    return reduce(DataFrame.unionByName, rows)
