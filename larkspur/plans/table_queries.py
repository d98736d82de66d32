"""Queries over rankings, lookups, moments and comparisons, beside their SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import pools as P
from larkspur.operators import reports as Q
from larkspur.operators import scoring as S
from larkspur.operators import stats as T
from larkspur.plans import fixtures as X
from larkspur.plans.queries import micro, query, sql_micro
from larkspur.plans.report_queries import _BASE, _PICK, _groups, _picked

WIDTH, HEIGHT, BUDGETS = 640, 480, (5, 50)
_REGIME = "CASE WHEN {n} <= 1 THEN 'singleton' WHEN {n} <= 3 THEN '2-3' WHEN {n} <= 5 THEN '4-5' ELSE '6+' END"
_SIZED = f"{X.P_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY skew_label) AS size FROM c)"
_LINES = "confidence", "raw_value", "quantity"


def _sized(spark, sf):
    from larkspur.operators.components import cluster_sizes

    return cluster_sizes(X.candidates(spark, sf), "skew_label", "size")


_CORNERS = {"x1": ("0.5 + embedding[23] / 4", "0.1 + abs(embedding[25]) / 4", "-", WIDTH), "y1": ("0.5 - embedding[24] / 4", "0.1 + abs(embedding[26]) / 4", "-", HEIGHT), "x2": ("0.5 + embedding[23] / 4", "0.1 + abs(embedding[25]) / 4", "+", WIDTH), "y2": ("0.5 - embedding[24] / 4", "0.1 + abs(embedding[26]) / 4", "+", HEIGHT)}


@query(f"WITH {X.P_SQL} SELECT proposal_index, " + ", ".join(f"{sql_micro(f'(({c}) {sign} ({w}) / 2) * {size}')} AS {n}" for n, (c, w, sign, size) in _CORNERS.items()) + " FROM c")
def box_corners(spark, sf):
    box = V.cxcywh_to_xyxy(F.col("box_cxcywh"), F.lit(WIDTH), F.lit(HEIGHT))
    return X.candidates(spark, sf).select("proposal_index", *(micro(box[n]).alias(n) for n in _CORNERS))


@query(f"WITH {_SIZED} SELECT skew_label AS label, size, {_REGIME.format(n='size')} AS regime, count(*) AS n FROM sized GROUP BY 1, 2, 3")
def size_regimes(spark, sf):
    return _sized(spark, sf).groupBy(F.col("skew_label").alias("label"), "size", V.size_regime(F.col("size")).alias("regime")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS round FROM orders) SELECT round, CAST('0x' || substr(sha256('pool|7|' || round), 1, 8) AS BIGINT) AS seed FROM r")
def pool_seeds(spark, sf):
    return X.rounds(spark, sf).select("round").distinct().select("round", V.derive_pool_seed(F.lit(7), F.col("round")).alias("seed"))


@query(f"WITH {X.P_SQL} SELECT proposal_index, image_id FROM c WHERE predicted_label = 3")
def unknown_predicted(spark, sf):
    return S.unknown_predicted(X.candidates(spark, sf), 3).select("proposal_index", "image_id")


_IMAGES = f"{X.L_SQL}, im AS (" + " UNION ALL ".join(f"SELECT '{v}' AS strategy, image_id, max({v}) AS image_score FROM li GROUP BY 2" for v in ("raw_value", "quantity")) + ")"


def _images(spark, sf):
    both = [S.aggregate_images(X.lines(spark, sf), method="max", score=v).select(F.lit(v).alias("strategy"), "image_id", "image_score") for v in ("raw_value", "quantity")]
    return both[0].unionByName(both[1])


@query(f"WITH {_IMAGES}, z AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY image_score DESC, image_id) AS rank FROM im) SELECT strategy, image_id, rank, " + ", ".join(f"rank <= {b} AS selected_at_{b}" for b in BUDGETS) + " FROM z")
def ranked_images(spark, sf):
    return S.ranked_images(_images(spark, sf), BUDGETS, by=("strategy",)).select("strategy", "image_id", F.col("rank").cast("long").alias("rank"), *(f"selected_at_{b}" for b in BUDGETS))


@query(f"WITH {X.P_SQL}, f AS (SELECT image_id, min(proposal_index) AS first FROM c GROUP BY 1) SELECT image_id, row_number() OVER (ORDER BY first) AS place FROM f")
def first_seen(spark, sf):
    c = X.candidates(spark, sf)
    return S.first_seen(c.select("image_id").distinct(), c).select("image_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_IMAGES}, o AS (SELECT strategy, CAST(length(image_id) AS BIGINT) AS budget, CAST(count(*) AS BIGINT) AS images, max(image_score) AS best FROM im GROUP BY 1, 2), n AS (SELECT strategy, budget, images * 2 AS images, best + 1 AS best FROM o WHERE budget > 2) SELECT strategy, budget, o.images AS old_images, n.images AS new_images, n.images - o.images AS delta_images, {sql_micro('n.best - o.best')} AS delta_best FROM o JOIN n USING (strategy, budget)")
def metric_comparison(spark, sf):
    old = _images(spark, sf).groupBy("strategy", F.length("image_id").cast("long").alias("budget")).agg(F.count("*").alias("images"), F.max("image_score").alias("best"))
    new = old.where("budget > 2").select("strategy", "budget", (F.col("images") * 2).alias("images"), (F.col("best") + 1).alias("best"))
    return Q.compare_metrics(old, new, ("images", "best")).select("strategy", "budget", "old_images", "new_images", "delta_images", micro("delta_best").alias("delta_best"))


@query(f"WITH {_BASE} SELECT p_brand AS class_name, p_partkey AS part, coalesce(CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE g END, 'none') AS \"group\" FROM part LEFT JOIN grp ON class_name = p_brand")
def class_lookup(spark, sf):
    parts = X.table(spark, sf, "part").select(F.col("p_brand").alias("class_name"), F.col("p_partkey").alias("part"))
    return Q.class_lookup(parts, _groups(spark, sf).where("class_name <> 'Brand#11'"), default="none").select("class_name", "part", "group")


@query(f"WITH {_BASE} SELECT CAST(count(*) FILTER (known) AS BIGINT) AS known, CAST(count(*) FILTER (NOT known) AS BIGINT) AS unknown, " + ", ".join(f"CAST(count(*) FILTER (NOT known AND g = '{n}') AS BIGINT) AS {n}" for n in Q.GROUPS) + " FROM (SELECT class_name IN ('Brand#11', 'Brand#22') AS known, g FROM li LEFT JOIN grp USING (class_name))")
def support_counts(spark, sf):
    return P.support(X.objects(spark, sf), _groups(spark, sf), ("Brand#11", "Brand#22")).select(*(F.col(n).cast("long").alias(n) for n in ("known", "unknown", *Q.GROUPS)))


@query(f"WITH {_BASE} SELECT class_name, g AS \"group\", count(*) AS n FROM li LEFT JOIN grp USING (class_name) GROUP BY 1, 2")
def class_support(spark, sf):
    return P.class_support(X.objects(spark, sf), _groups(spark, sf))


_RATIO = [f"{g}_{c}" for g in Q.GROUPS for c in ("target", "realised")]


@query(
    f"WITH {_BASE}, q AS (SELECT g, n AS target, n // 2 AS realised FROM rk JOIN grp USING (class_name)), m AS (SELECT "
    + ", ".join(f"avg({n.split('_')[1]}) FILTER (g = '{n.split('_')[0]}') AS {n}" for n in _RATIO)
    + f" FROM q) SELECT {', '.join(f'{sql_micro(n)} AS {n}' for n in _RATIO)}, {sql_micro('head_target / nullif(tail_target, 0)')} AS target_ratio, {sql_micro('head_realised / nullif(tail_realised, 0)')} AS realised_ratio FROM m"
)
def group_ratio(spark, sf):
    counts = P.object_counts(X.objects(spark, sf))
    pool = P.third_groups(counts).select("group", F.col("n").alias("target"), F.expr("n div 2").alias("realised"))
    got = P.group_ratio(pool)
    return got.select(*(micro(c).alias(c) for c in got.columns))


@query(f"WITH {_SIZED}, w AS (SELECT unnest(['singleton', '2-3', '4-5', '6+']) AS regime) SELECT w.regime, count(s.proposal_index) AS proposals, {sql_micro('avg(s.confidence)')} AS mean_confidence, {sql_micro('avg(s.objectness)')} AS mean_objectness FROM w LEFT JOIN sized s ON {_REGIME.format(n='s.size')} = w.regime GROUP BY 1")
def means_by_regime(spark, sf):
    return Q.means_by_regime(_sized(spark, sf), "size", ("confidence", "objectness")).select("regime", "proposals", micro("mean_confidence").alias("mean_confidence"), micro("mean_objectness").alias("mean_objectness"))


@query(f"WITH {_SIZED} SELECT count(*) FILTER (size <= 5) AS proposals, {sql_micro('avg(CASE WHEN size <= 5 THEN 1.0 ELSE 0.0 END)')} AS fraction, count(DISTINCT CASE WHEN size <= 5 THEN skew_label END) AS classes, {sql_micro('avg(confidence) FILTER (size <= 5)')} AS mean_below, {sql_micro('avg(confidence) FILTER (size > 5)')} AS mean_above FROM sized")
def below_neighbours(spark, sf):
    got = Q.below_neighbours(_sized(spark, sf), "size", "skew_label", "confidence", 5)
    return got.select("proposals", micro("fraction").alias("fraction"), "classes", micro("mean_below").alias("mean_below"), micro("mean_above").alias("mean_above"))


@query("SELECT o_orderpriority AS variant, CAST(year(o_orderdate) AS BIGINT) AS round, " + ", ".join(f"{sql_micro(e)} AS {n}" for n, e in (("mean_price", "avg(CAST(o_totalprice AS DOUBLE))"), ("std_price", "CASE WHEN count(*) > 1 THEN stddev_samp(CAST(o_totalprice AS DOUBLE) / 1000) END"))) + " FROM orders GROUP BY 1, 2")
def round_moments(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variant"), F.year("o_orderdate").cast("long").alias("round"), F.col("o_totalprice").cast("double").alias("price"))
    rows = o.withColumn("small", F.col("price") / 1000)
    got = Q.round_moments(rows, ("price", "small"))
    return got.select("variant", "round", micro("mean_price").alias("mean_price"), micro("std_small").alias("std_price"))


@query(f"WITH {X.L_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{v}' AS component, {v} / 1000 AS x FROM li" for v in _LINES) + f") SELECT component, count(*) AS rows, {sql_micro('avg(x)')} AS mean, {sql_micro('stddev_pop(x)')} AS std, {sql_micro('min(x)')} AS low, {sql_micro('max(x)')} AS high FROM v GROUP BY 1")
def component_statistics(spark, sf):
    rows = X.lines(spark, sf).select(*((F.col(v) / 1000).alias(v) for v in _LINES))
    return Q.component_statistics(rows, _LINES).select("component", "rows", *(micro(c).alias(c) for c in ("mean", "std", "low", "high")))


@query(f"WITH {X.L_SQL}, s AS ({_PICK}), m AS (SELECT l.strategy, r.strategy AS other, count(*) AS n FROM s l JOIN s r USING (image_id) GROUP BY 1, 2), n AS (SELECT DISTINCT strategy FROM s) SELECT n.strategy, " + ", ".join(f"CAST(coalesce(max(m.n) FILTER (m.other = '{v}'), 0) AS BIGINT) AS {v}" for v in ("raw_value", "quantity")) + " FROM n LEFT JOIN m USING (strategy) GROUP BY 1")
def overlap_matrix(spark, sf):
    names = ["raw_value", "quantity"]
    return Q.overlap_matrix(_picked(spark, sf), names).select("strategy", *(F.col(n).cast("long").alias(n) for n in names))


@query(f"WITH {_SIZED}, k AS (SELECT confidence, size, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS a, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS b FROM sized), z AS (SELECT stddev_pop(confidence) AS spread, corr(a, b) AS rho FROM k) SELECT {sql_micro('spread')} AS spread, {sql_micro('rho')} AS rho, CASE WHEN spread < 0.01 THEN 'inactive' WHEN spread < 0.05 THEN 'saturated' WHEN abs(rho) > 0.3 THEN 'frequency_confounded' ELSE 'informative' END AS regime FROM z")
def coherence_regime(spark, sf):
    return T.coherence_regime(_sized(spark, sf), "confidence", "size").select(micro("spread").alias("spread"), micro("rho").alias("rho"), "regime")


# strategies are compared on whole millionths, whose sums both engines agree on
_POOL = f"{X.P_SQL}, pool AS (SELECT proposal_index, image_id, skew_label AS pseudo_label, floor(confidence * 1e6) AS uncertainty, floor(objectness * 1e6) AS novelty, floor(abs(embedding[27]) * 1e6) AS rarity, floor(abs(embedding[28]) * 1e6) AS coherence FROM c)"
_SCORES = {"full": "uncertainty + novelty + rarity", "uncertainty": "uncertainty", "rarity_no_coherence": "uncertainty + rarity"}
_MEANS = "uncertainty", "novelty", "rarity", "coherence", "rarity_bonus"


def _sql_compare() -> str:
    parts = []
    for name, score in _SCORES.items():
        bonus = "rarity" if name != "uncertainty" else "0.0"
        parts.append(
            f"SELECT '{name}' AS strategy, * FROM (SELECT *, {bonus} AS rarity_bonus, avg(s) FILTER (i <= 3) OVER (PARTITION BY image_id) AS image_score FROM (SELECT *, {score} AS s, row_number() OVER (PARTITION BY image_id ORDER BY {score} DESC, proposal_index) AS i FROM pool)) WHERE i <= 3"
        )
    return (
        f"WITH {_POOL}, z AS ({' UNION ALL '.join(parts)}), im AS (SELECT DISTINCT strategy, image_id, image_score FROM z), sel AS (SELECT strategy, image_id FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY image_score DESC, image_id) AS r FROM im) WHERE r <= 20),"
        " low AS (SELECT quantile_cont(coherence, 0.1) AS low FROM pool), ch AS (SELECT z.*, low FROM z JOIN sel USING (strategy, image_id), low),"
        " lab AS (SELECT strategy, count(*) AS unique_pseudo_classes, sum(-c / n * ln(c / n)) AS entropy FROM (SELECT strategy, CAST(count(*) AS DOUBLE) AS c, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY strategy) AS n FROM ch GROUP BY strategy, pseudo_label) GROUP BY 1),"
        " ov AS (SELECT strategy, count(*) AS selected_image_count, CAST(count(*) FILTER (image_id IN (SELECT image_id FROM sel WHERE strategy = 'full')) AS BIGINT) AS overlap_with_full FROM sel GROUP BY 1)"
        f" SELECT strategy, selected_image_count, overlap_with_full, unique_pseudo_classes, {sql_micro('any_value(entropy)')} AS pseudo_class_entropy, {sql_micro('avg(CASE WHEN coherence <= low THEN 1.0 ELSE 0.0 END)')} AS low_coherence_fraction, "
        + ", ".join(f"CAST(floor(avg({m})) AS BIGINT) AS mean_{m}" for m in _MEANS)
        + " FROM ch JOIN lab USING (strategy) JOIN ov USING (strategy) GROUP BY 1, 2, 3, 4"
    )


def _compared(spark, sf):
    e = F.col("embedding")
    pool = X.candidates(spark, sf).select("proposal_index", "image_id", F.col("skew_label").alias("pseudo_label"), *(F.floor(x * 1e6).cast("double").alias(n) for n, x in (("uncertainty", F.col("confidence")), ("novelty", F.col("objectness")), ("rarity", F.abs(F.get(e, 26))), ("coherence", F.abs(F.get(e, 27))))))
    pool = pool.select("*", *(F.expr(x).alias(f"score_{n}") for n, x in _SCORES.items()))
    return S.compare_strategies(pool, {n: f"score_{n}" for n in _SCORES}, budget=20, bonus={"full": "rarity", "rarity_no_coherence": "rarity"})


@query(_sql_compare())
def compare_strategies(spark, sf):
    summary, _ = _compared(spark, sf)
    return summary.select("strategy", "selected_image_count", "overlap_with_full", "unique_pseudo_classes", micro("pseudo_class_entropy").alias("pseudo_class_entropy"), micro("low_coherence_fraction").alias("low_coherence_fraction"), *(F.floor(f"mean_{m}").cast("long").alias(f"mean_{m}") for m in _MEANS))


