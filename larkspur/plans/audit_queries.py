"""Queries over the audits, beside their SQL; importing this module registers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import audits as A
from larkspur.operators import reports as Q
from larkspur.operators import scoring as S
from larkspur.plans import fixtures as X
from larkspur.plans.queries import _ENT, _Q, _RANK, _UNC, BUDGET, micro, query, sql_micro, sql_normalised
from larkspur.plans.report_queries import _SEEN

_TRUTH = _SEEN.replace("SELECT proposal_index,", "SELECT proposal_index, image_id, confidence, objectness,")
_BY = ("confidence", "objectness")


def _graded(spark, sf) -> DataFrame:
    on = F.col("confidence") >= 0.1
    group = F.element_at(F.array(*map(F.lit, Q.GROUPS)), (F.col("skew_label") % 3 + 1).cast("int"))
    name = F.concat(F.lit("class"), (F.col("skew_label") % 7).cast("string"))
    return X.candidates(spark, sf).withColumn("gt_class", F.when(on, name)).withColumn("gt_group", F.when(on, group))


@query("SELECT vec_id AS proposal_index, label AS predicted_label FROM embeddings JOIN (SELECT DISTINCT vec_id // 5 AS i FROM embeddings WHERE vec_id // 5 % 3 = 0) ON i = vec_id // 5")
def keep_images(spark, sf):
    p = X.proposals(spark, sf)
    every_third = p.where(F.expr("proposal_index div 5 % 3 = 0"))
    return A.keep_images(p, every_third).select("proposal_index", "predicted_label")


def _sql_drivers() -> str:
    both = " UNION ALL ".join(f"SELECT '{v}' AS strategy, *, {v} AS score FROM o" for v in _BY)
    cols = {"purity": "count(gt_group) / CAST(count(*) AS DOUBLE)", **{f"{g}_proposal_coverage": f"count(*) FILTER (gt_group = '{g}') / CAST(count(*) AS DOUBLE)" for g in Q.GROUPS}}
    pool = ", ".join(f"count(*) FILTER (gt_group = '{g}') / CAST(count(gt_group) AS DOUBLE) AS {g}_base" for g in Q.GROUPS)
    return (
        f"WITH {X.P_SQL}, {_TRUTH}, t AS (SELECT *, row_number() OVER (PARTITION BY strategy, image_id ORDER BY score DESC, proposal_index) AS i FROM ({both})), "
        f"im AS (SELECT strategy, image_id, row_number() OVER (PARTITION BY strategy ORDER BY avg(score) DESC, image_id) AS rank FROM t WHERE i <= 3 GROUP BY 1, 2), "
        f"m AS (SELECT t.* FROM t JOIN im USING (strategy, image_id) WHERE i <= 3 AND rank <= {BUDGET}), b AS (SELECT {pool} FROM o), "
        f"g AS (SELECT strategy, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM m GROUP BY 1), "
        f"k AS (SELECT strategy, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS object_positive_rate FROM (SELECT strategy, image_id, count(gt_group) AS n FROM m GROUP BY 1, 2) GROUP BY 1) "
        f"SELECT strategy, {', '.join(f'{sql_micro(n)} AS {n}' for n in (*cols, 'object_positive_rate'))}, {sql_micro('1 - object_positive_rate')} AS background_only_rate, "
        + ", ".join(f"{sql_micro(f'{g}_proposal_coverage / {g}_base')} AS {g}_proposal_lift" for g in Q.GROUPS)
        + " FROM g JOIN k USING (strategy), b"
    )


@query(_sql_drivers())
def driver_metrics(spark, sf):
    pool, parts = _graded(spark, sf), []
    for v in _BY:
        best = S.select_images(S.aggregate_images(pool, score=v), BUDGET)
        parts.append(A.keep_images(S.top_rows(pool, 3, score=v), best).select(F.lit(v).alias("strategy"), "image_id", "gt_group"))
    m = A.driver_metrics(reduce(DataFrame.unionByName, parts), pool)
    return m.select("strategy", *(micro(c).alias(c) for c in m.columns[1:]))


@query(f"WITH {X.P_SQL}, {_TRUTH}, n AS (SELECT objectness, -count(*) OVER (PARTITION BY gt_class) AS inv FROM o WHERE gt_class IS NOT NULL), z AS (SELECT {_RANK.format(v='objectness')} AS a, {_RANK.format(v='inv')} AS b FROM n) SELECT count(*) AS rows, {sql_micro('corr(a, b)')} AS rho FROM z")
def rarity_alignment(spark, sf):
    return A.rarity_alignment(_graded(spark, sf), rarity="objectness").select("rows", micro("rho").alias("rho"))


def _sql_comparison() -> str:
    e = f"e AS (SELECT *, {_ENT} AS ent FROM q), e1 AS ({sql_normalised('e', 'ent', 're', 'rank')}), e2 AS ({sql_normalised('e1', 'confidence', 'rc', 'rank')})"
    values = {**_UNC, "objectness_weighted_entropy": "sqrt(re * rc)"}
    long = " UNION ALL ".join(f"SELECT '{m}' AS method, proposal_index, image_id, confidence, objectness, {x} AS u FROM e2" for m, x in (*values.items(), ("", "confidence")))

    def ranked(v: str) -> str:
        return f"rank() OVER (PARTITION BY method ORDER BY {v}) + (count(*) OVER (PARTITION BY method, {v}) - 1) / 2.0"

    z = f"z AS (SELECT *, {ranked('u')} AS ru, {ranked('confidence')} AS rf, {ranked('objectness')} AS ro, row_number() OVER (PARTITION BY method ORDER BY u DESC, proposal_index) AS pu, row_number() OVER (PARTITION BY method ORDER BY confidence DESC, proposal_index) AS pf, greatest(1, round_even(count(*) OVER (PARTITION BY method) * 0.1, 0)) AS top, row_number() OVER (PARTITION BY method, image_id ORDER BY u DESC, proposal_index) AS i FROM (SELECT * FROM long))"
    stats = "st AS (SELECT method, corr(ru, rf) AS spearman, corr(u, confidence) AS pearson, corr(ru, ro) AS spearman_objectness, count(*) FILTER (pu <= top AND pf <= top) / CAST(max(top) AS DOUBLE) AS top_overlap FROM z GROUP BY 1)"
    best = f"best AS (SELECT method, image_id FROM (SELECT method, image_id, row_number() OVER (PARTITION BY method ORDER BY avg(u) DESC, image_id) AS k FROM z WHERE i <= 3 GROUP BY 1, 2) WHERE k <= {BUDGET})"
    shared = "sh AS (SELECT a.method, count(b.image_id) AS o FROM best a LEFT JOIN best b ON b.method = '' AND b.image_id = a.image_id GROUP BY 1)"
    cols = ", ".join(f"{sql_micro(c)} AS {c}" for c in ("spearman", "pearson", "spearman_objectness", "top_overlap"))
    return f"WITH {X.P_SQL}, {_Q}, {e}, long AS ({long}), {z}, {stats}, {best}, {shared} SELECT method, {cols}, {sql_micro(f'o / CAST({2 * BUDGET} - o AS DOUBLE)')} AS jaccard, abs(spearman) > 0.999 AS monotone, spearman_objectness < -0.1 AS prefers_low_objectness FROM st JOIN sh USING (method) WHERE method <> ''"


@query(_sql_comparison())
def uncertainty_comparison(spark, sf):
    got = A.uncertainty_comparison(X.candidates(spark, sf), budget=BUDGET)
    return got.select("method", *(micro(c).alias(c) for c in ("spearman", "pearson", "spearman_objectness", "top_overlap", "jaccard")), "monotone", "prefers_low_objectness")


def _sql_stability() -> str:
    runs = f"runs AS (SELECT v.strategy, s.seed, image_id, proposal_index, 0.8 * CASE v.strategy WHEN 'confidence' THEN confidence ELSE objectness END + 0.2 * posterior[s.seed] AS score FROM c, (SELECT unnest(['confidence', 'objectness']) AS strategy) v, (SELECT unnest([1, 2, 3]) AS seed) s)"
    images = "im AS (SELECT strategy, seed, image_id, avg(score) FILTER (i <= 3) AS top_k_mean, max(score) AS max, avg(score) AS mean, 1 - exp(sum(ln(1 - least(greatest(score, 0), 1 - 1e-12)))) AS noisy_or FROM (SELECT *, row_number() OVER (PARTITION BY strategy, seed, image_id ORDER BY score DESC, proposal_index) AS i FROM runs) GROUP BY 1, 2, 3)"
    long = "l AS (" + " UNION ALL ".join(f"SELECT '{w}' AS aggregation, strategy, seed, image_id, {w} AS s FROM im" for w in ("top_k_mean", "max", "mean", "noisy_or")) + ")"
    rank = "placed AS (SELECT *, row_number() OVER (PARTITION BY aggregation, strategy, seed ORDER BY s DESC, image_id) AS k, max(s) OVER (PARTITION BY aggregation, strategy, seed) - min(s) OVER (PARTITION BY aggregation, strategy, seed) AS span FROM l)"
    gap = f"g AS (SELECT aggregation, avg((a - b) / span) AS gap FROM (SELECT aggregation, strategy, seed, max(s) FILTER (k = {BUDGET}) AS a, max(s) FILTER (k = {BUDGET + 1}) AS b, max(span) AS span FROM placed GROUP BY 1, 2, 3) GROUP BY 1)"
    pick = f"best AS (SELECT * FROM placed WHERE k <= {BUDGET})"
    shared = "(SELECT count(*) FROM best x JOIN best y USING (aggregation, image_id) WHERE aggregation = w.aggregation AND x.strategy = 'confidence' AND y.strategy = w.other AND x.seed = w.a AND y.seed = w.b)"
    pairs = f"w AS (SELECT DISTINCT aggregation, 'confidence' AS other, a, b FROM best, (VALUES (1, 2), (1, 3), (2, 3)) q(a, b) UNION ALL SELECT DISTINCT aggregation, 'objectness', seed, seed FROM best), j AS (SELECT *, {shared} AS o FROM w)"
    far = f"f AS (SELECT aggregation, avg(1 - o / CAST({2 * BUDGET} - o AS DOUBLE)) FILTER (other = 'objectness') AS signal, avg(1 - o / CAST({2 * BUDGET} - o AS DOUBLE)) FILTER (other = 'confidence') AS noise FROM j GROUP BY 1)"
    return f"WITH {X.P_SQL}, {runs}, {images}, {long}, {rank}, {gap}, {pick}, {pairs}, {far} SELECT aggregation, {', '.join(f'{sql_micro(n)} AS {n}' for n in ('gap', 'signal', 'noise'))}, {sql_micro('signal / nullif(noise, 0)')} AS signal_to_noise, signal > noise AS usable FROM g JOIN f USING (aggregation)"


@query(_sql_stability())
def aggregation_stability(spark, sf):
    runs = F.explode(F.array(*(F.struct(F.lit(v).alias("strategy"), F.lit(s).alias("seed"), (0.8 * F.col(v) + 0.2 * F.get("posterior", s - 1)).alias("score")) for v in _BY for s in (1, 2, 3))))
    scores = X.candidates(spark, sf).select("image_id", "proposal_index", runs.alias("r")).select("image_id", "proposal_index", "r.*")
    got = A.aggregation_stability(scores, budget=BUDGET, reference="confidence", contrast="objectness")
    return got.select("aggregation", *(micro(c).alias(c) for c in ("gap", "signal", "noise", "signal_to_noise")), "usable")
