import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import audits as A

POOL = "proposal_index long, image_id string, confidence double, objectness double, posterior array<double>, embedding array<double>, predicted_label long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    return [(i, f"i{i // 4:02d}", *rng.random(2).tolist(), rng.dirichlet(np.ones(4)).tolist(), rng.random(3).tolist(), int(i % 3)) for i in range(80)]


@pytest.fixture()
def pool(spark, rows):
    return spark.createDataFrame(rows, POOL)


def test_kept_images(spark, pool):
    ids = spark.createDataFrame([("i01",), ("i01",), ("none",), (None,)], "image_id string")
    assert sorted(r[0] for r in A.keep_images(pool, ids).select("proposal_index").collect()) == [4, 5, 6, 7]
    assert A.keep_images(pool.limit(0), ids).count() == 0


def test_checked_proposals(spark, pool):
    ids, sizes = pool.select("image_id"), {"posterior_size": 4, "embedding_size": 3}
    assert A.check_proposals(pool, ids, labels=(0, 1, 2), **sizes).first().asDict() == {"image_count": 20, "proposal_count": 80, "proposals_per_image": 4}
    empty = A.check_proposals(pool.limit(0), ids.limit(0), **sizes).first()
    assert (empty["image_count"], empty["proposal_count"], empty["proposals_per_image"]) == (0, 0, None)
    faulty = {
        "missing images: i00": (pool.where("image_id <> 'i00'"), ids),
        "unexpected images: i00": (pool, ids.where("image_id <> 'i00'")),
        "range from 3 to 4": (pool.where("proposal_index <> 7"), ids),
        "not of size 4": (pool.withColumn("posterior", F.expr("if(proposal_index = 3, null, posterior)")), ids),
        "not sum to 1": (pool.withColumn("posterior", F.transform("posterior", lambda x: x * 2)), ids),
        "outside the vocabulary": (pool.withColumn("predicted_label", F.expr("if(proposal_index = 3, null, predicted_label)")), ids),
    }
    for message, (df, wanted) in faulty.items():
        with pytest.raises(ValueError, match=message):
            A.check_proposals(df, wanted, labels=(0, 1, 2), **sizes)


def test_draws_repeat_the_generator(spark):
    names = [f"n{i}" for i in range(30)]
    images = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "image_id string, ordinal int")
    want = names.copy()
    random.Random("offline:3").shuffle(want)
    twice = images.unionByName(images.withColumn("ordinal", F.col("ordinal") + 50))
    assert [r[0] for r in A.shuffled_draw(twice, 7, "offline:3").orderBy("rank").collect()] == want[:7]
    chosen = set(random.Random("1:x").sample(names, 6))
    assert [r[0] for r in A.ordered_draw(images, 6, "1:x").collect()] == [n for n in names if n in chosen]
    assert A.shuffled_draw(images.limit(0), 3, 1).count() == 0
    for df, n, kw in ((twice, 3, {}), (images, 31, {}), (images, 3, {"most": 29})):
        with pytest.raises(ValueError):
            A.ordered_draw(df, n, 1, **kw)


def test_driver_metrics(spark):
    pool = spark.createDataFrame([("a", "head"), ("a", None), ("b", "tail"), ("b", "tail"), ("c", None)], "image_id string, gt_group string")
    drivers = pool.where("image_id <> 'b'").withColumn("strategy", F.lit("s"))
    got = A.driver_metrics(drivers, pool).first().asDict()
    assert got["purity"] == pytest.approx(1 / 3) and got["object_positive_rate"] == got["background_only_rate"] == 0.5
    assert (got["head_proposal_coverage"], got["head_proposal_lift"]) == (pytest.approx(1 / 3), pytest.approx(1.0))
    assert (got["tail_proposal_lift"], got["medium_proposal_lift"]) == (0.0, None)
    assert A.driver_metrics(drivers.limit(0), pool).count() == 0


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x])


def images_of(rows, values, budget, k=3):
    by = {}
    for r, v in zip(rows, values, strict=True):
        by.setdefault(r[1], []).append(v)
    best = sorted(((-np.mean(sorted(v, reverse=True)[:k]), i) for i, v in by.items()))
    return {i for _, i in best[:budget]}


def test_uncertainty_comparison(rows, pool):
    got = {r["method"]: r for r in A.uncertainty_comparison(pool, budget=5).collect()}
    c, o, p = (np.array([r[j] for r in rows]) for j in (2, 3, 4))
    entropy = -(p * np.log(p)).sum(axis=1) / np.log(4)
    top = lambda v: set(np.argsort(-v, kind="stable")[:8])
    e, first = got["entropy"], images_of(rows, c, 5)
    shared = len(images_of(rows, entropy, 5) & first)
    assert e["spearman"] == pytest.approx(np.corrcoef(ranks(entropy), ranks(c))[0, 1])
    assert e["pearson"] == pytest.approx(np.corrcoef(entropy, c)[0, 1])
    assert e["spearman_objectness"] == pytest.approx(rho := np.corrcoef(ranks(entropy), ranks(o))[0, 1])
    assert e["prefers_low_objectness"] == (rho < -0.1) and e["top_overlap"] == len(top(entropy) & top(c)) / 8
    assert e["jaccard"] == pytest.approx(shared / (10 - shared)) and not e["monotone"]
    # the legacy form folds confidence at one half, so it is monotone only below
    fold = np.corrcoef(ranks(1 - np.abs(2 * c - 1)), ranks(c))[0, 1]
    assert got["legacy"]["spearman"] == pytest.approx(fold) and not got["legacy"]["monotone"] and len(got) == 5
    low = {r["method"]: r for r in A.uncertainty_comparison(pool.withColumn("confidence", F.col("confidence") / 2), budget=5).collect()}
    assert low["legacy"]["monotone"] and low["legacy"]["top_overlap"] == low["legacy"]["jaccard"] == 1.0


def test_aggregation_stability(spark, rows):
    runs = [(s, seed, r[1], r[0], r[2] if s == "a" else r[3]) for s in ("a", "b") for seed in (1, 2) for r in rows]
    scores = spark.createDataFrame(runs, "strategy string, seed int, image_id string, proposal_index long, score double")
    got = {r["aggregation"]: r for r in A.aggregation_stability(scores, budget=5, reference="a", contrast="b").collect()}
    o = len(images_of(rows, [r[2] for r in rows], 5) & images_of(rows, [r[3] for r in rows], 5))
    top = got["top_k_mean"]
    assert set(got) == {"top_k_mean", "max", "mean", "noisy_or"} and top["signal"] == pytest.approx(1 - o / (10 - o))
    assert top["noise"] == 0.0 and top["signal_to_noise"] == float("inf") and top["usable"] and 0 < top["gap"] < 1
    alone = A.aggregation_stability(scores.where("seed = 1 and strategy = 'a'"), budget=50, reference="a", contrast="b").collect()
    assert all(np.isnan(r["gap"]) and np.isnan(r["signal"]) and np.isnan(r["noise"]) and not r["usable"] for r in alone)


def test_rarity_alignment(spark):
    df = spark.createDataFrame([("x", 0.1), ("x", 0.2), ("x", 0.15), ("y", 0.9), (None, 5.0)], "gt_class string, rarity double")
    got = A.rarity_alignment(df).first()
    assert got["rows"] == 4 and got["rho"] == pytest.approx(np.corrcoef(ranks([0.1, 0.2, 0.15, 0.9]), ranks([-3, -3, -3, -1]))[0, 1])
