"""The five components of a proposal's score: uncertainty, novelty, rarity, coherence and the gate.

Nearest-neighbour work is in nearest.py: exact, by blocks, bit for bit what the column
expressions give. Novelty also has the expression form (a join and a left fold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import vectors as V
from larkspur.operators.nearest import BLOCK_ROWS, greatest_dot, nearest
from larkspur.operators.ranks import average_ranks, normalise

UNCERTAINTY = ("entropy", "margin", "one_minus_max", "objectness_weighted_entropy", "legacy")
RARITY = ("log_inverse_frequency", "inverse_frequency", "negative_count")
COHERENCE = ("density", "relative_within_cluster", "neighbour_consistency")


def uncertainty(df: DataFrame, method: str = "entropy", *, out: str = "uncertainty", posterior: str = "posterior", confidence: str = "confidence", weight: str | None = None) -> DataFrame:
    """df plus an uncertainty in [0, 1]; `weight` replaces confidence in the weighted entropy."""
    if method not in UNCERTAINTY:
        raise ValueError(f"unknown uncertainty {method!r}; known: {', '.join(UNCERTAINTY)}")
    if method == "legacy":
        return df.withColumn(out, V.legacy_confidence(F.col(confidence)))
    p = V.probabilities(V.as_double(F.col(posterior)))
    if method != "objectness_weighted_entropy":
        return df.withColumn(out, {"entropy": V.entropy, "margin": V.margin, "one_minus_max": V.one_minus_max}[method](p))
    base = df.withColumn("_entropy", V.entropy(p))
    ranked = normalise(base, "_entropy", "_re")
    ranked = normalise(ranked, weight or confidence, "_rc", source=df)
    return ranked.select(*df.columns, F.sqrt(F.col("_re") * F.col("_rc")).alias(out))


def novelty(candidates: DataFrame, reference: DataFrame, *, out: str = "novelty", embedding: str = "embedding", blocked: bool | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """candidates plus 1 - the greatest cosine to a reference row; 1 where there is no reference.

    blocked=False takes the expression form, for small references: all of its rows go to each task.
    """
    bank = reference.select(V.l2_normalise(V.as_double(F.col(embedding))).alias("_r"))
    if blocked is not False:
        best = greatest_dot(candidates, bank, embedding=embedding, out=out, block_rows=block_rows)
        return best.withColumn(out, F.coalesce(F.lit(1.0) - F.col(out), F.lit(1.0)))
    # one row with all vectors: each candidate folds over the array
    gathered = bank.agg(F.collect_list("_r").alias("_bank"))
    unit = candidates.withColumn("_u", V.l2_normalise(V.as_double(F.col(embedding))))
    joined = unit.join(F.broadcast(gathered))
    best = F.array_max(F.transform("_bank", lambda r: V.dot(F.col("_u"), r)))
    return joined.select(*candidates.columns, F.coalesce(F.lit(1.0) - best, F.lit(1.0)).alias(out))


def cluster_sizes(df: DataFrame, label: str = "pseudo_label", out: str = "cluster_size") -> DataFrame:
    """df plus the number of rows with its label: a combined count joined back, no window per label."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias(out))
    return df.drop(out).join(counts, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def rarity(df: DataFrame, method: str = "log_inverse_frequency", *, label: str = "pseudo_label", out: str = "rarity", power: float = 1.0) -> DataFrame:
    if method not in RARITY:
        raise ValueError(f"unknown rarity {method!r}; known: {', '.join(RARITY)}")
    if power <= 0:
        raise ValueError("rarity power must be positive")
    sized = cluster_sizes(df, label, "_size")
    n = F.col("_size").cast("double")
    if method == "negative_count":
        return sized.withColumn(out, -n).drop("_size")
    if method == "inverse_frequency":
        return sized.withColumn(out, F.pow(n, F.lit(-power))).drop("_size")
    whole = sized.join(F.broadcast(df.agg(F.count("*").cast("double").alias("_all"))))  # one row
    return whole.withColumn(out, -F.log(n / F.col("_all")) * power).drop("_size", "_all")


def kth_neighbour(df: DataFrame, *, neighbours: int = 5, key: str = "proposal_index", embedding: str = "embedding", label: str | None = None, out: str = "kth_distance") -> DataFrame:
    """(key, out): distance to the min(neighbours, n - 1)-th nearest other row, of the same label if one is given.

    Rows alone in their group get 0. Embeddings are used as they are. See nearest.py for the search.
    """
    return nearest(df, neighbours=neighbours, key=key, embedding=embedding, label=label, out=out).select(key, out)


def neighbour_agreement(df: DataFrame, *, neighbours: int, key: str, embedding: str, label: str) -> DataFrame:
    """(key, _agree): how many of the global nearest rows (own row excluded, ties by key) share the label."""
    return nearest(df, neighbours=neighbours, key=key, embedding=embedding, kind=label).select(key, "_agree")


def coherence(
    df: DataFrame, method: str = "relative_within_cluster", *, neighbours: int = 5, singleton: float = 0.0, minimum_cluster: int = 3, isolation_quantile: float = 0.9, key: str = "proposal_index", embedding: str = "embedding", label: str = "pseudo_label", out: str = "coherence", isolation: bool = True
) -> DataFrame:
    """df plus out, isolated and kth_distance (global), on unit vectors.

    A pool of one row has the singleton value, is isolated and has distance 0. Without isolation
    the last two columns are left out; relative_within_cluster then compares rows of one label only.
    Keys, labels and distances are joined first, so df's other columns are moved once.
    """
    if method not in COHERENCE:
        raise ValueError(f"unknown coherence {method!r}; known: {', '.join(COHERENCE)}")
    unit = df.withColumn("_unit", V.l2_normalise(V.as_double(F.col(embedding))))
    base = cluster_sizes(df.select(key, label), label, "_size")
    if isolation or method != "relative_within_cluster":
        both = nearest(unit, neighbours=neighbours, key=key, embedding="_unit", kind=label, out="kth_distance")  # cut, so searched once
        far = both.select(key, "kth_distance")
        base = base.join(far, key)
        limits = far.agg(F.percentile("kth_distance", isolation_quantile).alias("_limit"), F.percentile("kth_distance", 0.5).alias("_median"), F.count("*").alias("_pool"))
    else:
        limits = df.agg(F.count("*").alias("_pool"))
    base = base.join(F.broadcast(limits))  # one row
    alone = F.col("_size") <= 1
    if method == "density":
        value = V.clip(1.0 / (1.0 + F.col("kth_distance") / F.greatest("_median", F.lit(V.TINY))))
    elif method == "neighbour_consistency":
        base = base.join(both.select(key, "_agree"), key, "left")
        others = F.least(F.lit(neighbours), F.col("_size") - 1).cast("double")
        value = F.when(alone, F.lit(singleton)).otherwise(V.clip(F.col("_agree") / F.nullif(others, F.lit(0.0))))
    else:
        inside = kth_neighbour(unit, neighbours=neighbours, key=key, embedding="_unit", label=label, out="_inside")
        base = base.join(inside, key)
        own = base.where(~alone).groupBy(F.col(label).alias("_cl")).agg(F.percentile("_inside", 0.5).alias("_own"))
        pooled = base.where(~alone).agg(F.percentile("_inside", 0.5).alias("_all"))
        base = base.join(own, F.col(label) == F.col("_cl"), "left").join(F.broadcast(pooled))
        scale = F.greatest(F.when(F.col("_size") >= minimum_cluster, F.col("_own")).otherwise(F.col("_all")), F.lit(V.TINY))
        value = F.when(alone, F.lit(singleton)).otherwise(1.0 / (1.0 + F.col("_inside") / scale))
    one = F.col("_pool") <= 1
    scored = F.when(one, F.lit(singleton)).otherwise(value).cast("double").alias(out)
    if isolation:
        beyond = F.col("kth_distance") > F.col("_limit")
        added = [scored, (one | beyond if method == "density" else one | (alone | beyond)).alias("isolated"), F.col("kth_distance")]
    else:
        added = [scored]
    found = base.select(F.col(key).alias("_key"), *added)
    return df.join(found, F.col(key) == F.col("_key")).drop("_key")


def kmeans_labels(df: DataFrame, *, clusters: int = 20, seed: int = 0, key: str = "proposal_index", embedding: str = "embedding", out: str = "pseudo_label", max_iter: int = 100) -> DataFrame:
    """df plus MLlib k-means labels on unit vectors, k at most the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.limit(clusters).count()
    unit = df.withColumn("_v", array_to_vector(V.l2_normalise(V.as_double(F.col(embedding)))))
    if n <= 1:
        return df.withColumn(out, F.lit(0).cast("long"))
    fitted = KMeans(k=n, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="_p").fit(unit.orderBy(key))
    return fitted.transform(unit).select(*df.columns, F.col("_p").cast("long").alias(out))


def posterior_diagnostics(df: DataFrame, posterior: str = "posterior") -> DataFrame:
    """df plus argmax, max, margin and the unclipped entropy of the posterior."""
    p = V.as_double(F.col(posterior))
    mass = F.greatest(V.total(p), F.lit(V.TINY))
    with_p = df.withColumn("_q", F.transform(p, lambda x: x / mass))
    q = F.col("_q")
    top = F.sort_array(q, False)
    h = -V.total(F.transform(q, lambda x: x * F.log(x + V.TINY)))
    return with_p.select(*df.columns, V.argmax(q).alias("posterior_argmax"), F.array_max(q).alias("posterior_max"), (F.get(top, 0) - F.get(top, 1)).alias("posterior_margin"), h.alias("posterior_entropy"))


__all__ = ["average_ranks", "cluster_sizes", "coherence", "kmeans_labels", "kth_neighbour", "neighbour_agreement", "novelty", "posterior_diagnostics", "rarity", "uncertainty", "T"]
