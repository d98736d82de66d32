import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import components as C
from larkspur.operators import nearest as N


def left_fold(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute(rows, k, label=False):
    """{key: (distance, agreement)} by comparing all pairs; rows are (key, vector, label)."""
    got = {}
    for key, e, lab in rows:
        near = sorted((left_fold(e, f), j, m) for j, f, m in rows if j != key and (not label or m == lab))[:k]
        got[key] = (near[-1][0] if near else 0.0, sum(m == lab for _, _, m in near))
    return got


@pytest.fixture(scope="module")
def pool(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=(300, 6))
    m[40:52] = m[40]  # more copies than neighbours
    m[60:75] = m[60] + r.normal(size=(15, 6)) * 1e-9  # closer than a product of matrices tells apart
    m[80] = 0.0
    labels = [7] * 200 + [1] * 97 + [2, 2, 3]
    keys = r.permutation(1000)[:300]
    rows = [(f"p{k:04d}", v.tolist(), lab) for k, v, lab in zip(keys, m, labels, strict=True)]
    return rows, spark.createDataFrame(rows, "k string, e array<double>, label long").repartition(5)


def test_nearest_is_exact_over_many_blocks(pool, monkeypatch):
    rows, df = pool
    for name, n in (("CHUNK_ROWS", 40), ("BLOCK_ROWS", 64), ("TILE", 16)):
        monkeypatch.setattr(N, name, n)
    got = {r["k"]: (r["_kth"], r["_agree"]) for r in N.nearest(df, neighbours=5, key="k", embedding="e", kind="label").collect()}
    assert got == brute(rows, 5)
    got = {r["k"]: r["d"] for r in C.kth_neighbour(df, key="k", embedding="e", label="label", out="d").collect()}
    assert got == {k: d for k, (d, _) in brute(rows, 5, label=True).items()}


def test_search_in_narrow_tiles(pool):
    rows, _ = pool
    rows = sorted(rows)
    m = np.array([e for _, e, _ in rows])
    y = N._Side(m, np.zeros(len(m), np.int8))
    kinds = np.array([lab for *_, lab in rows])
    best = N._Best(N._Side(m, np.zeros(len(m), np.int8)), 0, 5)
    for t in range(0, len(m), 13):
        best.see(np.arange(len(m)), y, np.hstack([m, -y.squares[:, None] / 2]), 0, t, min(t + 13, len(m)), kinds)
    want = brute(rows, 5)
    assert best.kth(np.full(len(m), len(m) - 1)).tolist() == [want[k][0] for k, *_ in rows]
    assert (best.kind == kinds[:, None]).sum(axis=1).tolist() == [want[k][1] for k, *_ in rows]


def test_no_join_makes_a_row_for_each_pair(pool):
    _, df = pool
    plan = C.kth_neighbour(df, key="k", embedding="e")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_rows_without_vectors_come_last(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [3.0, 4.0], "a"), (3, None, "a"), (4, [math.nan, 0.0], "a"), (5, [1.0, 0.0], None), (6, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "k long, e array<double>, label string")

    def far(k, **kw):
        return {r["k"]: r["d"] for r in C.kth_neighbour(df, neighbours=k, key="k", embedding="e", out="d", **kw).collect()}

    assert [far(1, label="label")[k] for k in (1, 2, 3, 5, 6)] == [5.0, 5.0, 0.0, 0.0, 0.0]
    assert math.isnan(far(2, label="label")[1]) and far(3, label="label")[1] == 0.0
    assert far(1)[5] == 0.0 and far(2)[5] == 1.0
    assert {r["k"] for r in C.kth_neighbour(df.where("k < 0"), key="k", embedding="e").collect()} == set()
    with pytest.raises(Exception, match="differ in length"):
        C.kth_neighbour(spark.createDataFrame([(1, [1.0], "a"), (2, [1.0, 2.0], "a")], "k long, e array<double>, label string"), key="k", embedding="e").collect()


def test_novelty_is_that_of_the_expression(spark, pool):
    _, df = pool
    bank = df.where("k < 'p0500'").select("e")
    got, want = ({r["k"]: r["n"] for r in C.novelty(df, bank, embedding="e", out="n", blocked=b, block_rows=50).collect()} for b in (None, False))
    assert got == want and len(got) == 300
    odd = spark.createDataFrame([(1, None), (2, [math.nan, 1.0]), (3, [1.0, 0.0])], "k long, e array<double>")
    got = {r["k"]: r["n"] for r in C.novelty(odd, odd.where("k <> 2"), embedding="e", out="n").collect()}
    assert got[1] == 1.0 and math.isnan(got[2]) and got[3] == 0.0
    assert math.isnan(C.novelty(odd.where("k = 3"), odd, embedding="e", out="n").first()["n"])
    assert C.novelty(odd, odd.where(F.lit(False)), embedding="e", out="n").where("n <> 1").count() == 0
