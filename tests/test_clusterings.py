import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import clusterings as K


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    centres = np.eye(5)
    return [(i, i % 5, (centres[i % 5] + rng.normal(scale=0.02, size=5)).tolist(), float(i % 4) / 4) for i in range(100)]


@pytest.fixture()
def pool(spark, blobs):
    return spark.createDataFrame(blobs, "proposal_index long, blob int, embedding array<double>, confidence double")


def agree(df):
    pairs = {(r["blob"], r["pseudo_label"]) for r in df.select("blob", "pseudo_label").collect()}
    return len(pairs) == len({b for b, _ in pairs}) == len({p for _, p in pairs}) == 5


def test_best_of_many_starts(pool):
    assert agree(K.best_kmeans_labels(pool, clusters=5, seed=1, starts=8))
    assert {r[0] for r in K.best_kmeans_labels(pool.limit(1), clusters=5).select("pseudo_label").collect()} == {0}
    assert K.best_kmeans_labels(pool.limit(0), clusters=5).count() == 0
    with pytest.raises(ValueError):
        K.best_kmeans_labels(pool, starts=0)


def test_fitted_on_the_confident(pool):
    got = K.confident_kmeans_labels(pool, clusters=5, starts=8)
    assert got.count() == 100 and agree(got)
    assert K.confident_kmeans_labels(pool.limit(0), clusters=5).count() == 0


def test_chosen_count(pool):
    assert K.choose_clusters(pool, (2, 5, 30)) == 5
    assert K.choose_clusters(pool.limit(0), (2, 5)) == 20


def test_agreement_between_seeds(pool):
    runs = pool.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed"), "proposal_index", "blob")
    label = F.when(F.col("seed") == 0, F.col("blob")).when(F.col("seed") == 1, 9 - F.col("blob")).otherwise(F.least("blob", F.lit(1)))
    got = {r["seed"]: r for r in K.label_agreement(runs.withColumn("pseudo_label", label), 0, (0, 1, 2)).collect()}
    assert set(got) == {1, 2} and got[1]["ari"] == pytest.approx(1.0) and np.isnan(got[1]["size_rho"])
    # 20 rows alone, 80 together, against five groups of 20
    total = 100 * 99 / 2
    both = 5 * 20 * 19 / 2
    other = 20 * 19 / 2 + 80 * 79 / 2
    want = (both - both * other / total) / ((both + other) / 2 - both * other / total)
    assert got[2]["ari"] == pytest.approx(want)
    with pytest.raises(ValueError):
        K.label_agreement(runs.withColumn("pseudo_label", label), 0, (0,))
