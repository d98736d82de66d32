import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import cli, config
from larkspur.operators import components as C
from larkspur.operators import reports as Q
from larkspur.operators import stats as T
from larkspur.plans import campaign
from larkspur.plans.diagnose import diagnose_pool
from larkspur.sources import synthetic
from larkspur.streaming.images import windowed_image_scores


def residual(x, others):
    a = np.column_stack([np.ones(len(x)), *others])
    return x - a @ np.linalg.lstsq(a, x, rcond=None)[0]


def test_rank_linear_models(spark):
    rng = np.random.default_rng(1)
    x = rng.permutation(60).astype(float)
    z = x + rng.normal(scale=20, size=60)
    w = rng.normal(size=60)
    y = x + 10 * w
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, x, z, w, x, strict=True)], "y double, x double, z double, w double, copy double")
    rank = {n: np.argsort(np.argsort(v)).astype(float) for n, v in (("y", y), ("x", x), ("z", z), ("w", w))}
    got = Q.semi_partial(df, "y", ["x", "z", "w"])
    lost = Q.incremental_r2(df, "y", ["x", "z", "w"])
    for n in ("x", "z", "w"):
        others = [rank[m] for m in ("x", "z", "w") if m != n]
        assert got[n] == pytest.approx(np.corrcoef(residual(rank[n], others), rank["y"])[0, 1], abs=1e-9)
        share = [1 - residual(rank["y"], p).var() / rank["y"].var() for p in ([rank[m] for m in ("x", "z", "w")], others)]
        assert lost[n] == pytest.approx(share[0] - share[1], abs=1e-9)
    assert Q.semi_partial(df, "y", ["x", "copy"])["x"] == 0.0
    flat = df.withColumn("y", F.lit(1.0))
    assert Q.incremental_r2(flat, "y", ["x"]) == {"x": 0.0} and np.isnan(Q.semi_partial(flat, "y", ["x"])["x"])


def test_truth_and_positions(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    objects = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "q"), ("b", "y")], "image_id string, class_name string")
    groups = spark.createDataFrame([("x", "head"), ("y", "tail")], "class_name string, group string")
    got = {r["image_id"]: (r["gt_classes"], r["gt_count"], r["head_count"], r["has_tail"]) for r in Q.truth_by_image(images, objects, groups).collect()}
    assert got == {"a": ("q|x", 3, 2, False), "b": ("y", 1, 0, True), "c": ("", 0, 0, False)}
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "proposal_index long, v double").repartition(4)
    order = sorted(range(50), key=lambda i: (-(i % 3), i))
    assert {r["proposal_index"]: r["p"] for r in Q.positions(df, "v", "p").collect()} == {i: at for at, i in enumerate(order)}


def test_silhouette(spark):
    rng = np.random.default_rng(0)
    e = np.vstack([rng.normal(c, 0.5, size=(12, 3)) for c in (0, 4, 9)] + [rng.normal(50, 1, size=(1, 3))])
    lab = [0] * 12 + [1] * 12 + [2] * 12 + [3]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(e, lab, strict=True))], "proposal_index long, embedding array<double>, pseudo_label long")
    d = np.sqrt(((e[:, None] - e[None]) ** 2).sum(-1))
    want = []
    for i, k in enumerate(lab):
        own = [j for j in range(len(lab)) if lab[j] == k and j != i]
        b = min(np.mean([d[i, j] for j in range(len(lab)) if lab[j] == m]) for m in set(lab) - {k})
        a = np.mean([d[i, j] for j in own]) if own else 0
        want.append((b - a) / max(a, b) if own else 0.0)
    assert T.silhouette(df).first()["silhouette"] == pytest.approx(np.mean(want), abs=1e-9)
    assert np.isnan(T.silhouette(df.where("pseudo_label = 0")).first()["silhouette"])


def test_shuffle_test(spark):
    df = spark.createDataFrame([(i, f"i{i // 2}", float(i), float(i % 7)) for i in range(60)], "proposal_index long, image_id string, a double, b double")
    one = T.shuffled(df, "a", seed=1)
    assert sorted(r["a"] for r in one.collect()) == [float(i) for i in range(60)]
    assert [r["a"] for r in one.orderBy("proposal_index").collect()] != [float(i) for i in range(60)]
    again = T.shuffled(df.repartition(5), "a", seed=1)
    assert {r[0]: r["a"] for r in again.collect()} == {r[0]: r["a"] for r in one.collect()}


def test_synthetic_pools(spark):
    assert synthetic.long_tail_schedule(3, 12, 12.0) == [12, 3, 1]
    with pytest.raises(ValueError):
        synthetic.long_tail_schedule(0, 1, 1.0)
    pool = synthetic.regime_pool(spark, (20, 5, 3), isolated=2, seed=4)
    assert {r["true_label"]: r["count"] for r in pool.groupBy("true_label").count().collect()} == {0: 20, 1: 5, 2: 3, 3: 1, 4: 1}
    sized = C.coherence(pool, "relative_within_cluster", label="true_label")
    assert all(r["coherence"] == 0 and r["isolated"] for r in sized.where("true_label > 2").collect())
    big = synthetic.long_tail_proposals(spark, classes=4, largest=6, ratio=3.0, per_image=5, dim=8, known=5, seed=2)
    rows = big.collect()
    assert len(rows) == 5 * sum(synthetic.long_tail_schedule(4, 6, 3.0)) and rows == big.collect()
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 and 0 <= r["confidence"] <= 1 for r in rows)
    truth = {r["image_id"]: r["class_name"] for r in synthetic.long_tail_images(spark, classes=4, largest=6, ratio=3.0).collect()}
    assert all(r["true_class"] == truth[r["image_id"]] for r in rows if r["on_object"])


SETTINGS = {"name": "t", "rounds": {"rounds": 2, "initial_images": 3, "budget_per_round": 2, "seeds": [0]}, "acquisition": {"strategies": ["v2:random", "v2:rarity"], "pseudo_label_source": "predicted", "top_k": 2}}


def test_config(tmp_path, capsys):
    s = config.from_mapping(SETTINGS | {"output": "x"})
    assert [r.top_k for r in s.acquisition.resolved()] == [2, 2] and len(s.fingerprint()) == 64
    assert config.from_mapping({"name": "t", "output": "x", "acquisition": {"uncertainty_mode": "ambiguity"}}).acquisition.resolved()[1].uncertainty_method == "legacy"
    for bad in ({"name": "t"}, SETTINGS, {"name": "t", "output": "x", "extra": {}}, {"name": "t", "output": "x", "acquisition": {"strategies": ["full"]}}, {"name": "t", "output": "x", "rounds": {"seeds": [1, 1]}}, {"name": "t", "output": "x", "acquisition": {"nothing": 1}}, []):
        with pytest.raises(config.ConfigError):
            config.from_mapping(bad)
    path = tmp_path / "c.json"
    path.write_text(json.dumps(SETTINGS | {"output": "x"}))
    assert cli.main(["validate", "--config", str(path), "--manifest", str(tmp_path / "m.json")]) == 0
    assert json.loads((tmp_path / "m.json").read_text())["name"] == "t"
    assert cli.main(["strategies"]) == 0 and "v2:full" in capsys.readouterr().out


class Fake:
    def __init__(self, pool):
        self.pool, self.calls = pool, []

    def train(self, labelled, previous, *, seed):
        self.calls.append(labelled.count())
        return f"{previous}+{seed}"

    def predict(self, checkpoint, images):
        return self.pool.join(images.select("image_id"), "image_id", "left_semi").drop("true_class", "on_object", "outlier")

    def evaluate(self, checkpoint):
        return {"recall": 0.5}


def test_campaign(spark, tmp_path):
    pool = synthetic.long_tail_proposals(spark, classes=3, largest=8, ratio=2.0, per_image=3, dim=6, known=4).cache()
    ids = pool.select("image_id").distinct().orderBy("image_id")
    reference, candidates = ids.limit(3), ids.exceptAll(ids.limit(3))
    settings = config.from_mapping(SETTINGS | {"output": str(tmp_path / "out")})
    fake = Fake(pool)
    got = campaign.run_campaign(spark, settings, fake, candidates=candidates, reference=reference)
    assert got.count() == 4 and sorted(fake.calls) == [5, 5, 7, 7]
    assert campaign.metric_table(got).where("metric = 'recall' and value = 0.5").count() == 4
    with pytest.raises(FileExistsError):
        campaign.run_campaign(spark, settings, fake, candidates=candidates, reference=reference)
    assert campaign.run_campaign(spark, settings, fake, candidates=candidates, reference=reference, resume=True).count() == 4 and len(fake.calls) == 4
    with pytest.raises(campaign.InvariantError):
        campaign.run_campaign(spark, settings, fake, candidates=candidates, reference=candidates)


def test_diagnose(spark, tmp_path):
    pool = synthetic.long_tail_proposals(spark, classes=3, largest=6, ratio=2.0, per_image=4, dim=6, known=4).drop("true_class", "on_object", "outlier").cache()
    out = diagnose_pool(pool, pool.limit(5), str(tmp_path / "d"), strategies=["v2:random", "v2:full"], budget=3, seeds=(0, 1), label="predicted_label")
    assert out["selections"].count() == 12 and out["overlaps"].count() == 2 and out["gate"].count() == 2
    again = diagnose_pool(pool, pool.limit(5), str(tmp_path / "d"), strategies=["v2:random", "v2:full"], budget=3, seeds=(0, 1), label="predicted_label")
    assert again["selections"].count() == 12 and again["gate"].count() == 2
    assert {r["strategy"]: r["min_jaccard"] for r in again["stability"].collect()}["v2:full"] == 1.0
    with pytest.raises(ValueError):
        diagnose_pool(pool.drop("posterior"), pool, str(tmp_path / "e"), strategies=["v2:full"], budget=3)


def test_streamed_image_scores(spark, tmp_path):
    rows = [("a", 0.2, "2024-01-01 00:01:00"), ("a", 0.6, "2024-01-01 00:02:00"), ("b", 0.5, "2024-01-01 00:03:00"), ("a", 0.1, "2024-01-01 00:15:00")]
    schema = "image_id string, score double, at timestamp"
    spark.createDataFrame(rows, "image_id string, score double, at string").select("image_id", "score", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = windowed_image_scores(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), method="noisy_or")
    q = stream.writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["image_id"], r["begins"].minute): (r["image_score"], r["rows"]) for r in spark.table("scores").collect()}
    assert got[("a", 0)] == (pytest.approx(1 - 0.8 * 0.4), 2) and got[("b", 0)][1] == 1 and got[("a", 10)][1] == 1
    with pytest.raises(ValueError):
        windowed_image_scores(stream, method="top_k_mean")
