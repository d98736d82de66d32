import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F
from test_nearest import brute

from larkspur.operators import components as C
from larkspur.operators import nearest as N


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    m = r.normal(size=(400, 6))
    m[30:50] = m[30]  # more copies than neighbours, of several kinds
    m[60:75] = m[60] + r.normal(size=(15, 6)) * 1e-9
    return [(int(k), v.tolist(), int(k) % 3) for k, v in zip(r.permutation(1000)[:400], m, strict=True)]


def test_no_vector_passes_through_the_driver(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "k long, e array<double>, label long").repartition(4)

    def never(*_, **__):
        raise AssertionError("rows are brought to the driver")

    monkeypatch.setattr(SparkContext, "broadcast", never)
    monkeypatch.setattr(type(df), "toLocalIterator", never)
    monkeypatch.setattr(N, "LEAST_ROWS", 50)
    far = N.nearest(df, neighbours=5, key="k", embedding="e", kind="label")
    within = C.kth_neighbour(df, key="k", embedding="e", label="label", out="d")
    novel = C.novelty(df, df.where("label = 0"), embedding="e", out="n", block_rows=40)
    monkeypatch.undo()
    assert {r["k"]: (r["_kth"], r["_agree"]) for r in far.collect()} == brute(rows, 5)
    assert {r["k"]: r["d"] for r in within.collect()} == {k: d for k, (d, _) in brute(rows, 5, label=True).items()}
    assert novel.count() == len(rows) and novel.where("label = 0 and n > 1e-12").count() == 0


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e6])
def test_any_order_and_precision_gives_the_same(rows, kind, scale):
    rows = sorted((k, [x * scale for x in e], lab) for k, e, lab in rows)
    m, kinds = np.array([e for _, e, _ in rows]), np.array([lab for *_, lab in rows])
    y = N._Side(m, np.zeros(len(m), np.int8))
    assert y.precision(y) == np.float32
    best = N._Best(N._Side(m, np.zeros(len(m), np.int8)), 0, 5)
    for t, end in reversed(list(N._even(0, len(m), 37))):
        best.see(np.arange(len(m)), y, y.wide(kind), 0, t, end, kinds)
    want = brute(rows, 5)
    assert best.kth(np.full(len(m), len(m) - 1)).tolist() == [want[k][0] for k, *_ in rows]
    assert (best.kind == kinds[:, None]).sum(axis=1).tolist() == [want[k][1] for k, *_ in rows]


def test_squares_that_overflow_or_vanish_keep_double_precision(spark):
    for at in (1e-18, 1e25):
        rows = [(i, [at * x for x in v], 0) for i, v in enumerate(np.random.default_rng(3).normal(size=(40, 3)).tolist())]
        df = spark.createDataFrame(rows, "k long, e array<double>, label long")
        got = {r["k"]: r["d"] for r in C.kth_neighbour(df, key="k", embedding="e", out="d").collect()}
        assert got == {k: d for k, (d, _) in brute(rows, 5).items()}


def test_batches_are_small_only_while_a_search_runs(spark, rows):
    df = spark.createDataFrame(rows, "k long, e array<double>, label long")
    before = spark.conf.get(N.BATCH_BYTES, None)
    C.kth_neighbour(df, key="k", embedding="e").agg(F.count("*")).collect()
    assert spark.conf.get(N.BATCH_BYTES, None) == before


def test_packed_rows_of_nulls_alone_and_of_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_ROWS", 2)
    rows = [(1, None), (2, None), (3, None), (4, [0.0, 0.0]), (5, [3.0, 4.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, e array<double>")

    def far(k):
        return {r["k"]: r["d"] for r in C.kth_neighbour(df, neighbours=k, key="k", embedding="e", out="d").collect()}

    assert far(2) == {1: 0.0, 2: 0.0, 3: 0.0, 4: 5.0, 5: 5.0, 6: 18.0**0.5}
    assert set(far(3).values()) == {0.0}
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0])], "k long, e array<double>")
    with pytest.raises(Exception, match="differ in length"):
        C.kth_neighbour(odd, key="k", embedding="e").collect()


@pytest.mark.parametrize("label", [None, "label"])
def test_several_packed_rows_in_a_task(spark, rows, label, monkeypatch):
    for name, n in (("TASK_ROWS", 150), ("LEAST_ROWS", 150), ("CHUNK_ROWS", 20)):
        monkeypatch.setattr(N, name, n)
    df = spark.createDataFrame(rows, "k long, e array<double>, label long").repartition(4)
    near = N.nearest(df, neighbours=5, key="k", embedding="e", label=label, kind=None if label else "label").collect()
    want = brute(rows, 5, label=True) if label else brute(rows, 5)
    assert {r["k"]: r["_kth"] for r in near} == {k: d for k, (d, _) in want.items()}
    novel = C.novelty(df, df.where("label = 0"), embedding="e", out="n", block_rows=16)
    plain = C.novelty(df, df.where("label = 0"), embedding="e", out="n", blocked=False)
    assert sorted(novel.select("k", "n").collect()) == sorted(plain.select("k", "n").collect())


def test_what_a_task_has_is_not_sent_to_it_again(spark, rows, monkeypatch):
    for name, n in (("TASK_ROWS", 400), ("LEAST_ROWS", 400), ("CHUNK_ROWS", 40)):
        monkeypatch.setattr(N, name, n)
    sent, whole = spark.sparkContext.accumulator(0), type(spark.range(0)).mapInArrow

    def counted(self, run, schema, *a):
        def pairs(batches):
            def seen():
                for b in batches:
                    if "_vectors" in b.schema.names and "vectors" in b.schema.names:
                        sent.add(sum(len(x) for n in ("_vectors", "vectors") for x in b.column(b.schema.names.index(n)).to_pylist() if x))
                    yield b

            return run(seen())

        return whole(self, pairs, schema, *a)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    df = spark.createDataFrame(rows, "k long, e array<double>, label long")
    N.nearest(df, neighbours=5, key="k", embedding="e").count()
    assert sent.value == 2 * len(rows) * 6 * 8  # one task: its own and each streamed vector once, of 10 x 10 pairs of packed rows


@pytest.mark.parametrize("few", [1, 100, 1 << 16])
def test_pairs_of_several_products_are_merged_together(rows, few, monkeypatch):
    for name, n in (("FEW", few), ("TILE", 37), ("FOLD", 10)):
        monkeypatch.setattr(N, name, n)
    rows = sorted(rows)
    m, kinds = np.array([e for _, e, _ in rows]), np.array([lab for *_, lab in rows])
    y, merged, merge = N._Side(m, np.zeros(len(m), np.int8)), [], N._Best._merge
    monkeypatch.setattr(N._Best, "_merge", lambda self, *a: merged.append(0) or merge(self, *a))
    best = N._Best(y, 0, 5)
    best.see(np.arange(len(m)), y, y.wide(np.float32), 0, 0, len(m), kinds)
    want = brute(rows, 5)
    assert best.kth(np.full(len(m), len(m) - 1)).tolist() == [want[k][0] for k, *_ in rows]
    assert (best.kind == kinds[:, None]).sum(axis=1).tolist() == [want[k][1] for k, *_ in rows]
    assert len(merged) == 1 or few < 1 << 16


def test_great_values_are_reached_by_k_columns():
    g = np.random.default_rng(2).normal(size=(50, 700))
    for k, n in ((1, 700), (5, 700), (5, 119), (5, 121), (5, 6)):
        assert ((g[:, :n] >= N._great(g[:, :n], k)[:, None]).sum(axis=1) >= k).all()


def test_half_as_many_tasks_read_all_packed_rows():
    assert N._parts(100_000) == 24
    assert N._parts(10 * 32_768 * 24) == 240
