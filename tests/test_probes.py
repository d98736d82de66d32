import math

import pytest
from pyspark.sql import functions as F

from larkspur.operators import probes as B


def rows(df, *names):
    return {tuple(r[n] for n in names): r for r in df.collect()}


def test_overlaps_and_falsification(spark):
    real = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "c")], "seed int, image_id string")
    plain = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "c")], "seed int, image_id string")
    got = rows(B.overlaps(real, plain, ["seed"]), "seed")
    assert (got[1,]["shared"], got[1,]["either"], got[2,]["jaccard"]) == (1, 3, 1.0)
    fake = spark.createDataFrame([(1, 1, "a"), (1, 1, "c"), (1, 2, "x"), (1, 2, "y"), (2, 1, "a"), (2, 1, "b"), (2, 2, "a"), (2, 2, "c")], "seed int, trial int, image_id string")
    per = B.gate_falsification(real, fake, plain)
    kept = rows(per, "seed")
    assert kept[1,]["real_gate_effect"] == pytest.approx(2 / 3) and kept[1,]["shuffled_mean"] == pytest.approx(0.5)
    assert kept[1,]["shuffled_sd"] == pytest.approx(math.sqrt(0.5)) and kept[2,]["trials"] == 2
    z = B.falsification_z(per).first()
    sd = (math.sqrt(0.5) + math.sqrt(((2 / 3) ** 2) / 2)) / 2
    assert z["z"] == pytest.approx((1 / 3 - (0.5 + 1 / 3) / 2) / sd) and not z["distinguishable"]
    assert B.overlaps(real.limit(0), plain.limit(0), ["seed"]).count() == 0


def test_coverage(spark):
    images = spark.createDataFrame([(i,) for i in "abcd"], "image_id string")
    objects = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x"), ("c", "x")], "image_id string, class_name string")
    groups = spark.createDataFrame([("x", "head"), ("y", "tail")], "class_name string, group string")
    runs = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "c"), ("s", 2, "d"), ("t", 1, "d")], "strategy string, seed int, image_id string")
    got = rows(B.coverage_probe(runs, images, objects, groups), "strategy")
    s, t = got["s",], got["t",]
    assert (s["head_coverage"], s["tail_coverage"], s["distinct_classes"], s["tail_lift"]) == (0.75, 0.25, 1.5, 1.0)
    assert s["tail_sd"] == pytest.approx(math.sqrt(0.125)) and t["head_sd"] is None and t["distinct_classes"] == 0


def test_rank_stability(spark):
    data = [(s, k, size, k % 2 + 1, float(-size)) for s, sizes in ((1, (1, 2, 3, 4)), (2, (4, 3, 2, 1))) for k, size in enumerate(sizes)]
    df = spark.createDataFrame(data, "seed int, proposal_index long, size int, true_size int, rarity double")
    got = B.rank_stability(df).first()
    assert got["stability"] == pytest.approx(-1) and got["fidelity"] == pytest.approx(0, abs=1e-12) and got["spread"] == pytest.approx(math.sqrt(1.25))
    assert B.rank_stability(df.where("seed = 1")).first()["stability"] is None


def test_surface_and_arm(spark):
    parts = spark.createDataFrame([(s, f"i{k}", k, float(k), float(-k * s)) for s in (1, 2) for k in range(6)], "seed int, image_id string, proposal_index long, norm_rarity double, norm_gated double")
    picked = B.surface_selections(parts, [(1, 0, {"rarity": 1}), (0, 1, {"gated": 1})], budget=2)
    chosen = {(r["x"], r["seed"]): set() for r in picked.collect()}
    for r in picked.collect():
        chosen[r["x"], r["seed"]].add(r["image_id"])
    assert chosen == {(1.0, s): {"i4", "i5"} for s in (1, 2)} | {(0.0, s): {"i0", "i1"} for s in (1, 2)}
    got = rows(B.surface(picked, picked.where("x = 1").select("seed", "image_id")), "x", "y")
    assert (got[1.0, 0.0]["jaccard"], got[0.0, 1.0]["jaccard"], got[0.0, 1.0]["signal_to_noise"]) == (1.0, 0.0, math.inf)
    configs = spark.createDataFrame([("a", 0.0, 0.4, 9.0, 5), ("b", None, 0.6, 1.0, 5), ("c", 0.0, 0.6, 1.0, 6), ("d", 0.1, 0.9, 9.0, 9)], "strategy string, weight_novelty double, object_positive_image_rate double, tail_image_lift double, distinct_gt_classes_selected int")
    assert B.choose_arm(configs, ("a", "b", "c", "d")).first()["strategy"] == "c"
    with pytest.raises(ValueError):
        B.choose_arm(configs.where(F.col("strategy") == "d"), ("d",))
