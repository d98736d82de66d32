import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.operators import matching as M
from larkspur.operators import pools as P
from larkspur.operators import ranks as R
from larkspur.operators import scoring as S
from larkspur.operators import stats as T
from larkspur.sources import files


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 1.0, 5.0, 3.0])], "k long, v double")
    got = {r["k"]: (r["a"], r["s"]) for r in R.normalise(R.average_ranks(df, "v", "a"), "v", "s").collect()}
    assert got == {0: (2.5, 2.5 / 3), 1: (0.0, 0.0), 2: (2.5, 2.5 / 3), 3: (1.0, 1 / 3)}


@pytest.mark.parametrize(("method", "want"), [("rank", 0.5), ("minmax", 1.0), ("zscore_sigmoid", 0.5), ("ecdf", 1.0)])
def test_constant_pool(spark, method, want):
    df = spark.createDataFrame([(2.0,), (2.0,), (2.0,)], "v double")
    got = {r["s"] for r in R.normalise(df, "v", "s", method).collect()}
    assert got == ({want} if method != "ecdf" else {2 / 3})


def test_aggregations(spark):
    df = spark.createDataFrame([(0, "a", 0.9), (1, "a", 0.5), (2, "a", 0.1), (3, "b", 0.4)], "proposal_index long, image_id string, score double")

    def scores(**kw):
        return {r["image_id"]: r["image_score"] for r in S.aggregate_images(df, **kw).collect()}

    assert scores(method="max") == {"a": 0.9, "b": 0.4}
    assert scores(method="mean")["a"] == pytest.approx(0.5)
    assert scores(top_k=2) == pytest.approx({"a": 0.7, "b": 0.4})
    assert scores(method="noisy_or")["a"] == pytest.approx(1 - 0.1 * 0.5 * 0.9)


def test_selection_breaks_ties_by_id(spark):
    images = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "image_id string, image_score double")
    assert [r["image_id"] for r in S.select_images(images, 2).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        S.select_images(images, 4)


def test_golden_scores(spark):
    rows = [(0, "a", 0.5, [1.0, 0.0], 0), (1, "a", 0.4, [1.0, 0.0], 0), (2, "b", 0.9, [-1.0, 0.0], 1), (3, "c", 0.55, [0.0, 1.0], 2)]
    pool = spark.createDataFrame(rows, "proposal_index long, image_id string, confidence double, embedding array<double>, predicted_label long")
    bank = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
    s = S.default_registry().resolve("v1:ungated_full")
    got = S.score_proposals(pool, bank, s, label="predicted_label").orderBy("proposal_index")
    assert [r["score"] for r in got.collect()] == pytest.approx([0.30, 0.24, 0.76, 0.87])


def test_registry():
    r = S.default_registry()
    assert len(r.qualified_names()) == 26
    with pytest.raises(ValueError, match="ambiguous"):
        r.resolve("full")
    with pytest.raises(KeyError):
        r.resolve("nothing")
    with pytest.raises(ValueError):
        S.Strategy("x", weights={"rarity": -1})


def test_matching_takes_each_target_once(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    gt = spark.createDataFrame([("i", 1, "a", (0.0, 0.0, 10.0, 10.0)), ("i", 2, "b", (50.0, 50.0, 60.0, 60.0))], f"image_id string, gt_idx long, class_name string, box {box}")
    det = spark.createDataFrame([("i", 1, 0.9, "u", (0.0, 0.0, 10.0, 10.0)), ("i", 2, 0.8, "u", (0.0, 0.0, 10.0, 9.0)), ("i", 3, 0.7, "u", (90.0, 90.0, 99.0, 99.0))], f"image_id string, det_idx long, score double, class_name string, box {box}")
    m = M.match(det, gt)
    assert {r["det_idx"]: (r["tp"], r["fp"]) for r in m.collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 1)}
    assert M.recall(m, gt).first()["recall"] == 0.5
    assert M.average_precision(m, gt).first()["ap"] == 0.5


def test_thirds_and_long_tail(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 40), ("d", 1)], "class_name string, n long")
    assert {r["class_name"]: r["group"] for r in P.third_groups(counts).collect()} == {"a": "head", "b": "head", "c": "medium", "d": "tail"}
    assert {r["class_name"]: r["target"] for r in P.long_tail_targets(counts, 8.0).collect()} == {"a": 100, "b": 50, "c": 25, "d": 1}


def _brute_pool(images, want, seed):
    """The reference's loop over images; ties by the signatures' seeded order, then by hash."""
    sets = {i: frozenset(c for c in cs if c in want) for i, cs in images.items()}
    names = {i: "\x1f".join(sorted(s)) for i, s in sets.items()}
    order = sorted({n for n in names.values() if n})
    random.Random(seed).shuffle(order)
    tie = {i: (order.index(n), hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()) for i, n in names.items() if n}
    have, picked = dict.fromkeys(want, 0), set()
    while True:
        best = None
        for i in tie.keys() - picked:
            gain = sum(have[c] < want[c] for c in sets[i])
            over = sum(max(0, have[c] + 1 - want[c]) for c in sets[i])
            if gain and (best is None or (-gain, over, tie[i]) < best[0]):
                best = ((-gain, over, tie[i]), i)
        if best is None:
            return picked
        picked.add(best[1])
        for c in sets[best[1]]:
            have[c] += 1


def test_long_tail_pool_against_brute_force(spark):
    rng = random.Random(7)
    differ = 0
    for seed in range(3):
        weights = [3, 2, 2, 2, 2, 2, 2, 1]
        images = {f"i{k}": rng.choices("abcdefgx", weights, k=rng.randrange(1, 6)) for k in range(150)}
        objects = spark.createDataFrame([(i, c) for i, cs in images.items() for c in cs], "image_id string, class_name string")
        targets = P.long_tail_targets(P.presence_counts(objects.where("class_name <> 'x'")), 30.0).cache()
        want = {r["class_name"]: r["target"] for r in targets.collect()}
        got = [r["image_id"] for r in P.long_tail_pool(objects, targets, seed=seed).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute_pool(images, want, seed)
        differ += len(got) < len(images)
    assert differ
    # one class far over its target weighs more than two that are just full
    counts = {"a1\x1fa2\x1fa3\x1fx": 1, "b1\x1fb2\x1fb3\x1fx": 1, "c1\x1fc2\x1fc3\x1fx": 1, "q\x1fy\x1fz": 2, "q\x1fx": 1}
    taken = P._quotas(counts, {c: 1 + (c == "q") for s in counts for c in s.split("\x1f")}, 0)
    assert taken["q\x1fy\x1fz"] == 2 and taken["q\x1fx"] == 0


def test_statistics_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert np.isnan(T.pearson(df, "x", "y").first()["r"])
    assert sum(r["n"] for r in T.histogram(df, "x").collect()) == 2
    assert T.power_estimate(0.01, 0.01) == 16 and T.power_estimate(0.005, 0.01) == 63 and T.power_estimate(0.02, 0.01) == 4


def test_sources(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b x\n\na\nb\n")
    ids = files.id_list(spark, str(tmp_path / "ids.txt"))
    assert [r["image_id"] for r in ids.orderBy("ordinal").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        files.id_list(spark, str(tmp_path / "ids.txt"), strict=True)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "p1.xml").write_text("<annotation><size><width>10</width><height>20</height></size><object><name> couch </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    row = files.voc_objects(spark, str(tmp_path / "v")).first()
    assert (row["image_id"], row["class_name"], row["box"]["x2"], row["width"]) == ("p1", "sofa", 3.0, 10.0)
    (tmp_path / "n").mkdir()
    np.savez(tmp_path / "n" / "p.npz", image_ids=np.array(["a", "b"]), confidence=np.array([0.1, 0.2]), embeddings=np.eye(2))
    assert [r["embedding"] for r in files.npz_proposals(spark, str(tmp_path / "n")).orderBy("proposal_index").collect()] == [[1.0, 0.0], [0.0, 1.0]]
    (tmp_path / "d.json").write_text('{"ground_truth":[{"image_id":"i","class_name":"a","box":[0,0,1,1]}],"detections":[{"image_id":"i","class_name":"u","box":[0,0,1,1],"score":0.5}]}')
    truth, found = files.detection_json(spark, str(tmp_path / "d.json"))
    assert truth.count() == found.count() == 1
    (tmp_path / "g.csv").write_text("class_name,group\na,head\nb,tail\n")
    assert files.class_groups(spark, str(tmp_path / "g.csv")).count() == 2
    with pytest.raises(ValueError):
        files.guard(spark.createDataFrame([(1,)], "gt_class int"))


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert F is not None
