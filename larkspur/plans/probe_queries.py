"""Queries over the probes, beside their SQL; importing this module registers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import probes as B
from larkspur.operators import reports as Q
from larkspur.operators import scoring as S
from larkspur.plans import fixtures as X
from larkspur.plans.queries import BUDGET, micro, query, sql_micro
from larkspur.plans.report_queries import _BASE, _groups, _orders

SEEDS, TRIALS, RUN_IMAGES = (1, 2, 3), (1, 2, 3, 4), 200
_RUNS = [("first", s, s) for s in SEEDS] + [("second", s, s + 3) for s in SEEDS]
_SEEDS = f"sd AS (SELECT unnest({list(SEEDS)}) AS seed)"


def _sql_coverage() -> str:
    runs = ", ".join(f"('{n}', {s}, {h})" for n, s, h in _RUNS)
    flags = ", ".join(f"bool_or(g = '{g}') AS {g}" for g in Q.GROUPS)
    rates = ", ".join(f"avg(CASE WHEN {g} THEN 1.0 ELSE 0.0 END) AS {g}" for g in Q.GROUPS)
    cols = ", ".join([f"{sql_micro(f'avg({g})')} AS {g}_coverage" for g in Q.GROUPS] + [f"{sql_micro(f'stddev_samp({g})')} AS {g}_sd" for g in Q.GROUPS])
    return (
        f"WITH {_BASE}, im AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS image_id FROM orders), "
        f"runs AS (SELECT strategy, seed, image_id FROM (SELECT strategy, seed, image_id, row_number() OVER (PARTITION BY h ORDER BY sha256(CAST(h AS VARCHAR) || ':' || image_id), image_id) AS i FROM im, (VALUES {runs}) v(strategy, seed, h)) WHERE i <= {RUN_IMAGES}), "
        f"f AS (SELECT image_id, {flags} FROM li JOIN grp USING (class_name) GROUP BY 1), cov AS (SELECT strategy, seed, {rates} FROM runs LEFT JOIN f USING (image_id) GROUP BY 1, 2), "
        "cl AS (SELECT strategy, seed, count(DISTINCT class_name) AS n FROM runs JOIN li USING (image_id) GROUP BY 1, 2), pool AS (SELECT avg(CASE WHEN tail THEN 1.0 ELSE 0.0 END) AS rate FROM im LEFT JOIN f USING (image_id)) "
        f"SELECT strategy, {cols}, {sql_micro('avg(coalesce(n, 0))')} AS distinct_classes, {sql_micro('avg(tail) / any_value(rate)')} AS tail_lift FROM cov LEFT JOIN cl USING (strategy, seed), pool GROUP BY 1"
    )


@query(_sql_coverage())
def coverage_probe(spark, sf):
    images = _orders(spark, sf)
    runs = [S.random_images(images, RUN_IMAGES, (h,)).select(F.lit(n).alias("strategy"), F.lit(s).alias("seed"), "image_id") for n, s, h in _RUNS]
    got = B.coverage_probe(reduce(DataFrame.unionByName, runs), images, X.objects(spark, sf), _groups(spark, sf))
    return got.select("strategy", *(micro(c).alias(c) for c in got.columns[1:]))


# a trial's gate takes another column of the posterior in place of the shuffled coherence
_KINDS = [("ungated", 0, "objectness")] + [("real", 0, "objectness * posterior[10]")] + [("shuffled", t, f"objectness * posterior[{10 + t}]") for t in TRIALS]


def _sql_falsification() -> str:
    long = " UNION ALL ".join(f"SELECT '{k}' AS kind, seed, {t} AS trial, image_id, confidence + 0.2 * posterior[seed] + 0.5 * {e} AS s FROM c, sd" for k, t, e in _KINDS)
    moved = f"e AS (SELECT a.kind, a.seed, a.trial, count(b.image_id) AS o FROM pk a LEFT JOIN pk b ON b.kind = 'ungated' AND b.seed = a.seed AND b.image_id = a.image_id WHERE a.kind <> 'ungated' GROUP BY 1, 2, 3), x AS (SELECT kind, seed, trial, 1 - o / CAST({2 * BUDGET} - o AS DOUBLE) AS effect FROM e)"
    rows = "rw AS (SELECT seed, max(effect) FILTER (kind = 'real') AS real_, avg(effect) FILTER (kind = 'shuffled') AS mean_, stddev_samp(effect) FILTER (kind = 'shuffled') AS sd_ FROM x GROUP BY 1), t AS (SELECT avg(real_) AS real_, avg(mean_) AS mean_, avg(sd_) AS sd_ FROM rw), z AS (SELECT *, (real_ - mean_) / greatest(sd_, 1e-12) AS z FROM t)"
    pick = f"pk AS (SELECT kind, seed, trial, image_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, seed, trial ORDER BY s DESC, image_id) AS i FROM (SELECT kind, seed, trial, image_id, max(s) AS s FROM long GROUP BY 1, 2, 3, 4)) WHERE i <= {BUDGET})"
    return f"WITH {X.P_SQL}, {_SEEDS}, long AS ({long}), {pick}, {moved}, {rows} SELECT {sql_micro('real_')} AS \"real\", {sql_micro('mean_')} AS shuffled, {sql_micro('sd_')} AS sd, {sql_micro('z')} AS z, abs(z) >= 2 AS distinguishable FROM z"


@query(_sql_falsification())
def gate_falsification(spark, sf):
    def gate(t: int | None):
        return F.col("objectness") if t is None else F.col("objectness") * F.get("posterior", 9 + t)

    places = {"ungated": None}
    runs = [F.struct(F.lit(k).alias("kind"), F.lit(s).alias("seed"), F.lit(t).alias("trial"), (F.col("confidence") + 0.2 * F.get("posterior", s - 1) + 0.5 * gate(places.get(k, t))).alias("s")) for s in SEEDS for k, t, _ in _KINDS]
    images = X.candidates(spark, sf).select("image_id", F.explode(F.array(*runs)).alias("r")).groupBy("r.kind", "r.seed", "r.trial", "image_id").agg(F.max("r.s").alias("image_score"))
    picked = S.ranked_images(images, (), by=("kind", "seed", "trial")).where(F.col("rank") <= BUDGET)
    real, shuffled, ungated = (picked.where(F.col("kind") == k) for k in ("real", "shuffled", "ungated"))
    got = B.falsification_z(B.gate_falsification(real, shuffled, ungated))
    return got.select(*(micro(c).alias(c) for c in ("real", "shuffled", "sd", "z")), "distinguishable")


def _sql_stability() -> str:
    ranked = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"
    runs = "q AS (SELECT seed, proposal_index, CAST(floor(posterior[seed] * 40) AS BIGINT) AS label, skew_label FROM c, sd), runs AS (SELECT seed, proposal_index, count(*) OVER (PARTITION BY seed, label) AS size, count(*) OVER (PARTITION BY seed, skew_label) AS true_size FROM q)"
    kept = f"k AS (SELECT seed, {ranked.format(by='seed', v='size')} AS a, {ranked.format(by='seed', v='true_size')} AS b FROM runs), fi AS (SELECT avg(r) AS fidelity FROM (SELECT corr(a, b) AS r FROM k GROUP BY seed))"
    pairs = f"pr AS (SELECT l.seed AS s1, r.seed AS s2, -l.size AS x, -r.size AS y FROM runs l JOIN runs r ON l.proposal_index = r.proposal_index AND l.seed < r.seed), pk AS (SELECT s1, s2, {ranked.format(by='s1, s2', v='x')} AS a, {ranked.format(by='s1, s2', v='y')} AS b FROM pr), st AS (SELECT avg(r) AS stability FROM (SELECT corr(a, b) AS r FROM pk GROUP BY s1, s2))"
    return f"WITH {X.P_SQL}, {_SEEDS}, {runs}, {kept}, {pairs}, sp AS (SELECT avg(d) AS spread FROM (SELECT stddev_pop(-size) AS d FROM runs GROUP BY seed)) SELECT {', '.join(f'{sql_micro(n)} AS {n}' for n in ('fidelity', 'spread', 'stability'))} FROM fi, sp, st"


@query(_sql_stability())
def rank_stability(spark, sf):
    from larkspur.operators.components import cluster_sizes

    c = cluster_sizes(X.candidates(spark, sf), "skew_label", "true_size")
    labels = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.floor(F.get("posterior", s - 1) * 40).alias("label")) for s in SEEDS)))
    rows = c.select("proposal_index", "true_size", labels.alias("r")).select("proposal_index", "true_size", "r.*")
    sizes = rows.groupBy("seed", "label").agg(F.count("*").alias("size"))
    got = B.rank_stability(rows.join(sizes, ["seed", "label"]).withColumn("rarity", -F.col("size").cast("double")))
    return got.select(*(micro(n).alias(n) for n in ("fidelity", "spread", "stability")))


_GRID = (0.0, 0.5, 1.0)


def _sql_surface() -> str:
    grid = f"pt AS (SELECT x, y FROM (SELECT unnest({list(_GRID)}::DOUBLE[]) AS x) a, (SELECT unnest({list(_GRID)}::DOUBLE[]) AS y) b WHERE x + y > 0)"
    score = "s AS (SELECT x, y, seed, image_id, proposal_index, 0.3 * confidence + 0.2 * objectness + x * posterior[seed] + y * posterior[10 + seed] AS score FROM c, pt, sd)"
    pick = f"t AS (SELECT *, row_number() OVER (PARTITION BY x, y, seed, image_id ORDER BY score DESC, proposal_index) AS i FROM s), im AS (SELECT x, y, seed, image_id, avg(score) AS v FROM t WHERE i <= 3 GROUP BY 1, 2, 3, 4), pk AS (SELECT x, y, seed, image_id FROM (SELECT *, row_number() OVER (PARTITION BY x, y, seed ORDER BY v DESC, image_id) AS k FROM im) WHERE k <= {BUDGET})"
    against = "j AS (SELECT a.x, a.y, a.seed, count(b.image_id) AS o FROM pk a LEFT JOIN pk b ON b.x = 0 AND b.y = 0.5 AND b.seed = a.seed AND b.image_id = a.image_id GROUP BY 1, 2, 3)"
    among = "n AS (SELECT a.x, a.y, a.seed AS s1, b.seed AS s2, count(*) FILTER (a.image_id = b.image_id) AS o FROM pk a JOIN pk b ON a.x = b.x AND a.y = b.y AND a.seed < b.seed GROUP BY 1, 2, 3, 4)"
    share = f"avg(o / CAST({2 * BUDGET} - o AS DOUBLE))"
    both = f"f AS (SELECT x, y, {share} AS jaccard FROM j GROUP BY 1, 2), g AS (SELECT x, y, {share} AS self_jaccard FROM n GROUP BY 1, 2), h AS (SELECT *, CASE WHEN 1 - self_jaccard > 1e-12 THEN (1 - jaccard) / (1 - self_jaccard) END AS ratio FROM f JOIN g USING (x, y))"
    return f"WITH {X.P_SQL}, {_SEEDS}, {grid}, {score}, {pick}, {against}, {among}, {both} SELECT x, y, {sql_micro('jaccard')} AS jaccard, {sql_micro('self_jaccard')} AS self_jaccard, {sql_micro('ratio')} AS signal_to_noise FROM h"


@query(_sql_surface())
def weight_surface(spark, sf):
    parts = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.get("posterior", s - 1).alias("norm_rarity"), F.get("posterior", 9 + s).alias("norm_gated")) for s in SEEDS)))
    components = X.candidates(spark, sf).select("proposal_index", "image_id", F.col("confidence").alias("norm_uncertainty"), F.col("objectness").alias("norm_novelty"), parts.alias("p")).select("proposal_index", "image_id", "norm_uncertainty", "norm_novelty", "p.*")
    points = [(x, y, {"uncertainty": 0.3, "novelty": 0.2, "rarity": x, "gated": y}) for x in _GRID for y in _GRID if x + y > 0]
    picked = B.surface_selections(components, points, budget=BUDGET)
    got = B.surface(picked, picked.where("x = 0 and y = 0.5").select("seed", "image_id"))
    finite = F.when(F.col("noise") > 1e-12, F.col("signal_to_noise"))
    return got.select("x", "y", micro("jaccard").alias("jaccard"), micro("self_jaccard").alias("self_jaccard"), micro(finite).alias("signal_to_noise"))


_ARMS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query(
    "WITH a AS (SELECT o_orderpriority AS strategy, CASE WHEN o_orderpriority LIKE '2%' THEN 0.2 ELSE 0.0 END AS weight_novelty, avg(CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END) AS rate, CAST(count(*) % 5 AS BIGINT) AS lift, CAST(count(DISTINCT o_custkey) AS BIGINT) AS classes FROM orders GROUP BY 1) "
    f"SELECT strategy, lift AS tail_image_lift, classes AS distinct_gt_classes_selected FROM a WHERE weight_novelty = 0 AND strategy IN {_ARMS} ORDER BY rate >= 0.5 DESC, lift DESC, rate DESC, classes DESC, strategy LIMIT 1"
)
def arm_choice(spark, sf):
    name = F.col("o_orderpriority").alias("strategy")
    arms = X.table(spark, sf, "orders").groupBy(name).agg(
        F.avg((F.col("o_orderkey") % 2 == 0).cast("double")).alias("object_positive_image_rate"), (F.count("*") % 5).alias("tail_image_lift"), F.count_distinct("o_custkey").alias("distinct_gt_classes_selected")
    )
    arms = arms.withColumn("weight_novelty", F.when(F.col("strategy").startswith("2"), 0.2).otherwise(0.0))
    return B.choose_arm(arms, _ARMS).select("strategy", "tail_image_lift", "distinct_gt_classes_selected")
