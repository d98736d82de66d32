"""Queries over the reports, beside their SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import pools as P
from larkspur.operators import reports as Q
from larkspur.operators import scoring as S
from larkspur.plans import fixtures as X
from larkspur.plans.queries import _RANK, _RANKED, micro, query, sql_micro, sql_normalised

PICKED = 200
_GRP = "grp AS (SELECT class_name, CASE WHEN rank < (nc + 2) // 3 THEN 'head' WHEN rank < (2 * nc + 2) // 3 THEN 'medium' ELSE 'tail' END AS g FROM rk)"
_BASE = f"{X.L_SQL}, {_RANKED}, {_GRP}"
_PICK = " UNION ALL ".join(f"SELECT * FROM (SELECT '{v}' AS strategy, image_id FROM (SELECT image_id, max({v}) AS s FROM li GROUP BY 1) ORDER BY s DESC, image_id LIMIT {PICKED})" for v in ("raw_value", "quantity"))
_GRADED = "count(o.class_name) AS gt_count, " + ", ".join(f"count(*) FILTER (g = '{n}') AS {n}_count" for n in Q.GROUPS)


def _groups(spark, sf) -> DataFrame:
    return P.third_groups(P.object_counts(X.objects(spark, sf))).select("class_name", "group")


def _orders(spark, sf) -> DataFrame:
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("image_id")).distinct()


def _picked(spark, sf) -> DataFrame:
    out = None
    for v in ("raw_value", "quantity"):
        best = S.select_images(S.aggregate_images(X.lines(spark, sf), method="max", score=v), PICKED).select(F.lit(v).alias("strategy"), "image_id")
        out = best if out is None else out.unionByName(best)
    return out


@query(f"WITH {_BASE}, im AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS image_id FROM orders), t AS (SELECT image_id, coalesce(string_agg(DISTINCT o.class_name, '|' ORDER BY o.class_name), '') AS gt_classes, {_GRADED} FROM im LEFT JOIN li o USING (image_id) LEFT JOIN grp ON grp.class_name = o.class_name GROUP BY 1) SELECT *, head_count > 0 AS has_head, medium_count > 0 AS has_medium, tail_count > 0 AS has_tail FROM t")
def truth_by_image(spark, sf):
    return Q.truth_by_image(_orders(spark, sf), X.objects(spark, sf), _groups(spark, sf))


@query(f"WITH {X.D_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY iou DESC, gt_idx) AS i FROM iou) SELECT det.det_idx, {sql_micro('coalesce(b.iou, 0)')} AS best_iou, b.gt_idx AS best_gt, CASE WHEN coalesce(b.iou, 0) >= 0.5 THEN b.gn ELSE 'background' END AS best_class FROM det LEFT JOIN b ON b.det_idx = det.det_idx AND b.i = 1")
def best_overlap(spark, sf):
    return Q.best_overlap(X.detections(spark, sf), X.truth(spark, sf), key="det_idx").select("det_idx", micro("best_iou").alias("best_iou"), "best_gt", "best_class")


_RATES = "br AS (SELECT " + ", ".join(f"count(*) FILTER ({n}_count > 0) / CAST(count(*) AS DOUBLE) AS {n}_image_rate, sum({n}_count) / CAST(sum(gt_count) AS DOUBLE) AS {n}_object_rate" for n in Q.GROUPS) + f" FROM (SELECT image_id, {_GRADED} FROM li o JOIN grp USING (class_name) GROUP BY 1))"
_RATE_NAMES = [f"{g}_{k}_rate" for k in ("image", "object") for g in Q.GROUPS]


@query(f"WITH {_BASE}, {_RATES} SELECT {', '.join(f'{sql_micro(n)} AS {n}' for n in _RATE_NAMES)} FROM br")
def base_rates(spark, sf):
    o = X.objects(spark, sf)
    return Q.base_rates(o, o, _groups(spark, sf)).select(*(micro(n).alias(n) for n in _RATE_NAMES))


def _sql_selection() -> str:
    cover = {f"{g}_{k}": e for g in Q.GROUPS for k, e in (("image", f"count(*) FILTER ({g}_count > 0) / CAST(count(*) AS DOUBLE)"), ("object", f"sum({g}_count) / CAST(sum(gt_count) AS DOUBLE)"))}
    per = f"per AS (SELECT strategy, image_id, {_GRADED} FROM ({_PICK}) s JOIN li o USING (image_id) JOIN grp USING (class_name) GROUP BY 1, 2)"
    agg = f"ag AS (SELECT strategy, count(*) AS images, CAST(sum(gt_count) AS BIGINT) AS objects, {', '.join(f'{e} AS {n}' for n, e in cover.items())} FROM per GROUP BY 1)"
    cls = f"cl AS (SELECT strategy, count(DISTINCT class_name) AS classes, count(DISTINCT CASE WHEN g = 'tail' THEN class_name END) AS tail_classes FROM ({_PICK}) s JOIN li USING (image_id) JOIN grp USING (class_name) GROUP BY 1)"
    cols = [f"{sql_micro(n)} AS {n}_coverage, {sql_micro(f'{n} / {n}_rate')} AS {n}_lift" for n in cover]
    return f"WITH {_BASE}, {_RATES}, {per}, {agg}, {cls} SELECT strategy, images, objects, classes, tail_classes, {', '.join(cols)} FROM ag JOIN cl USING (strategy), br"


@query(_sql_selection())
def selection_metrics(spark, sf):
    o = X.objects(spark, sf)
    m = Q.selection_metrics(_picked(spark, sf), o, o, _groups(spark, sf))
    plain = ("strategy", "images", "objects", "classes", "tail_classes")
    return m.select(*plain, *(micro(c).alias(c) for c in m.columns if c not in plain))


@query(f"WITH {_BASE}, c AS (SELECT strategy, g, count(*) AS objects FROM ({_PICK}) s JOIN li USING (image_id) JOIN grp USING (class_name) GROUP BY 1, 2) SELECT strategy, g AS \"group\", objects, {sql_micro('objects / CAST(sum(objects) OVER (PARTITION BY strategy) AS DOUBLE)')} AS fraction FROM c")
def group_composition(spark, sf):
    return Q.group_composition(_picked(spark, sf), X.objects(spark, sf), _groups(spark, sf)).select("strategy", "group", "objects", micro("fraction").alias("fraction"))


_SEEN = "o AS (SELECT proposal_index, predicted_label, CASE WHEN confidence >= 0.1 THEN 'class' || CAST(skew_label % 7 AS VARCHAR) END AS gt_class, CASE WHEN confidence >= 0.1 THEN ['head', 'medium', 'tail'][1 + skew_label % 3] END AS gt_group FROM c)"


def _mode(c: str, out: str) -> str:
    return f"{out} AS (SELECT predicted_label, {c} AS {out}, row_number() OVER (PARTITION BY predicted_label ORDER BY count(*) DESC, min(proposal_index)) AS i FROM o WHERE {c} IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {X.P_SQL}, {_SEEN}, {_mode('gt_group', 'mg')}, {_mode('gt_class', 'mc')}, t AS (SELECT predicted_label, count(*) AS proposals, count(gt_group) AS on_object, count(*) FILTER (gt_group = 'tail') AS tail_objects FROM o GROUP BY 1) SELECT t.predicted_label, proposals, on_object, coalesce(mg.mg, 'background') AS dominant_group, coalesce(mc.mc, '') AS dominant_class, tail_objects, {sql_micro('coalesce(tail_objects / nullif(CAST(on_object AS DOUBLE), 0), 0)')} AS tail_fraction FROM t LEFT JOIN mg ON mg.predicted_label = t.predicted_label AND mg.i = 1 LEFT JOIN mc ON mc.predicted_label = t.predicted_label AND mc.i = 1")
def cluster_groups(spark, sf):
    on = F.col("confidence") >= 0.1
    group = F.element_at(F.array(*map(F.lit, Q.GROUPS)), (F.col("skew_label") % 3 + 1).cast("int"))
    d = X.candidates(spark, sf).withColumn("gt_class", F.when(on, F.concat(F.lit("class"), (F.col("skew_label") % 7).cast("string")))).withColumn("gt_group", F.when(on, group))
    c = Q.cluster_groups(d, label="predicted_label")
    return c.select(*c.columns[:-1], micro("tail_fraction").alias("tail_fraction"))


@query(f"WITH {X.L_SQL}, n AS (SELECT class_name, pseudo_label, CAST(count(*) AS DOUBLE) AS n FROM li GROUP BY 1, 2), p AS (SELECT class_name, n / sum(n) OVER (PARTITION BY class_name) AS p FROM n) SELECT class_name, {sql_micro('-sum(p * ln(p))')} AS entropy FROM p GROUP BY 1")
def pseudo_class_entropy(spark, sf):
    return Q.label_entropy(X.lines(spark, sf), by=("class_name",)).select("class_name", micro("entropy").alias("entropy"))


_LABELLED = f"{_BASE}, tl AS (SELECT image_id, CASE WHEN bool_or(g = 'tail') THEN 'tail' WHEN bool_or(g = 'medium') THEN 'medium' ELSE 'head' END AS gt_group FROM li JOIN grp USING (class_name) GROUP BY 1), lg AS (SELECT li.*, gt_group FROM li JOIN tl USING (image_id))"


def _labelled(spark, sf) -> DataFrame:
    return Q.truth_label(X.lines(spark, sf), X.objects(spark, sf), _groups(spark, sf))


@query(f"WITH {_LABELLED} SELECT gt_group, count(*) AS rows, {sql_micro('avg(raw_value)')} AS mean_raw_value, {sql_micro('avg(quantity)')} AS mean_quantity FROM lg GROUP BY 1")
def means_by_truth_group(spark, sf):
    return Q.means_by(_labelled(spark, sf), "gt_group", ["raw_value", "quantity"]).select("gt_group", "rows", micro("mean_raw_value").alias("mean_raw_value"), micro("mean_quantity").alias("mean_quantity"))


def _sql_d(v: str, flag: str) -> str:
    a, b = f"FILTER ({flag})", f"FILTER (NOT ({flag}))"
    pooled = f"sqrt(((count({v}) {a} - 1) * var_samp({v}) {a} + (count({v}) {b} - 1) * var_samp({v}) {b}) / (count({v}) - 2))"
    return f"(avg({v}) {a} - avg({v}) {b}) / {pooled}"


@query(f"WITH {_LABELLED}, ht AS (SELECT * FROM lg WHERE gt_group IN ('head', 'tail')) " + " UNION ALL ".join(f"SELECT '{v}' AS component, {sql_micro(f'''avg({v}) FILTER (gt_group = 'tail') / avg({v}) FILTER (gt_group = 'head')''')} AS ratio, {sql_micro(_sql_d(v, '''gt_group = 'tail' '''))} AS d FROM ht" for v in ("raw_value", "quantity")))
def tail_against_head(spark, sf):
    return Q.tail_against_head(_labelled(spark, sf), ["raw_value", "quantity"]).select("component", micro("ratio").alias("ratio"), micro("d").alias("d"))


@query(f"WITH {X.L_SQL} " + " UNION ALL ".join(f"SELECT class_name, '{v}' AS component, {sql_micro(_sql_d(v, 'confidence > 0.5'))} AS d FROM li GROUP BY 1" for v in ("raw_value", "raw_novelty")))
def component_effect_sizes(spark, sf):
    d = X.lines(spark, sf).withColumn("picked", F.col("confidence") > 0.5)
    return Q.effect_sizes(d, ["raw_value", "raw_novelty"], "picked", ("class_name",)).select("class_name", "component", micro("d").alias("d"))


_PLACE = "row_number() OVER (ORDER BY {v} DESC, proposal_index) - 1"


@query(f"WITH {X.P_SQL}, z AS (SELECT *, {_PLACE.format(v='confidence')} AS a, {_PLACE.format(v='objectness')} AS b, {_RANK.format(v='confidence')} AS ra, {_RANK.format(v='objectness')} AS rb, greatest(1, count(*) OVER () // 10) AS top FROM c) SELECT count(*) AS proposals, {sql_micro('avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END)')} AS changed, {sql_micro('count(*) FILTER (a < top AND b < top) / CAST(max(top) AS DOUBLE)')} AS top_overlap, {sql_micro('avg(abs(objectness - confidence))')} AS mean_change, {sql_micro('corr(ra, rb)')} AS rho FROM z")
def gate_impact(spark, sf):
    g = Q.gate_impact(X.candidates(spark, sf), rarity="confidence", gated="objectness")
    return g.select("proposals", *(micro(c).alias(c) for c in ("changed", "top_overlap", "mean_change", "rho")))


_SEEDS = (1, 2, 3)
_RAND = " UNION ALL ".join(f"SELECT * FROM (SELECT {s} AS seed, image_id FROM (SELECT DISTINCT image_id FROM c) ORDER BY sha256('{s}:' || image_id), image_id LIMIT 20)" for s in _SEEDS)


@query(f"WITH {X.P_SQL}, rd AS ({_RAND}), sp AS (SELECT a.seed AS x, b.seed AS y FROM (SELECT DISTINCT seed FROM rd) a JOIN (SELECT DISTINCT seed FROM rd) b ON a.seed < b.seed), j AS (SELECT sp.x, sp.y, (SELECT count(*) FROM rd a JOIN rd b USING (image_id) WHERE a.seed = sp.x AND b.seed = sp.y) AS o FROM sp) SELECT 'random' AS strategy, count(*) AS pairs, {sql_micro('avg(o / CAST(40 - o AS DOUBLE))')} AS mean_jaccard, {sql_micro('min(o / CAST(40 - o AS DOUBLE))')} AS min_jaccard FROM j")
def self_stability(spark, sf):
    images, runs = X.candidates(spark, sf).select("image_id").distinct(), None
    for s in _SEEDS:
        one = S.random_images(images, 20, (s,)).select(F.lit("random").alias("strategy"), F.lit(s).alias("seed"), "image_id")
        runs = one if runs is None else runs.unionByName(one)
    return Q.self_stability(runs).select("strategy", "pairs", micro("mean_jaccard").alias("mean_jaccard"), micro("min_jaccard").alias("min_jaccard"))


@query(f"WITH {X.P_SQL}, m AS (SELECT proposal_index, (confidence + objectness + posterior[1]) / 3 AS mean FROM c), z AS ({sql_normalised('m', 'mean', 'consensus', 'rank')}) SELECT proposal_index, {sql_micro('mean')} AS mean, {sql_micro('consensus')} AS consensus FROM z")
def consensus_gate(spark, sf):
    runs = X.candidates(spark, sf).select("proposal_index", F.explode(F.array("confidence", "objectness", F.get("posterior", 0))).alias("norm_gated"))
    return Q.consensus(runs).select("proposal_index", micro("mean").alias("mean"), micro("consensus").alias("consensus"))


_SWEEP = [{"uncertainty": 1.0}, {"uncertainty": 0.3, "novelty": 0.7}, {"novelty": 0.7, "uncertainty": 0.3, "rarity": 0.0}, {"novelty": 1.0}]
_SWEPT = " UNION ALL ".join(f"SELECT {i} AS sweep, proposal_index, image_id, {' + '.join(f'{w} * {dict(uncertainty='confidence', novelty='objectness')[k]}' for k, w in sorted(_SWEEP[i].items()))} AS score FROM c" for i in (0, 1, 3))


@query(f"WITH {X.P_SQL}, s AS ({_SWEPT}), t AS (SELECT *, row_number() OVER (PARTITION BY sweep, image_id ORDER BY score DESC, proposal_index) AS i FROM s), im AS (SELECT sweep, image_id, avg(score) AS image_score FROM t WHERE i <= 3 GROUP BY 1, 2), best AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY image_score DESC, image_id) AS rank FROM im) SELECT sweep, image_id, CAST(rank AS INTEGER) AS rank, {sql_micro('image_score')} AS image_score FROM best WHERE rank <= 10")
def weight_sweep(spark, sf):
    parts = X.candidates(spark, sf).select("proposal_index", "image_id", F.col("confidence").alias("norm_uncertainty"), F.col("objectness").alias("norm_novelty"), F.lit(0.0).alias("norm_rarity"))
    return Q.weight_sweep(parts, _SWEEP, budget=10).select("sweep", "image_id", "rank", micro("image_score").alias("image_score"))


_CORR = f"z AS (SELECT {_RANK.format(v='raw_value')} AS y, {_RANK.format(v='quantity')} AS a, {_RANK.format(v='confidence')} AS b FROM li), k AS (SELECT corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM z)"


def _by_component(spark, values: dict[str, float], out: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"component string, {out} double").select("component", micro(out).alias(out))


@query(f"WITH {X.L_SQL}, {_CORR} SELECT 'quantity' AS component, {sql_micro('(ya - yb * ab) / sqrt(1 - ab * ab)')} AS r FROM k UNION ALL SELECT 'confidence', {sql_micro('(yb - ya * ab) / sqrt(1 - ab * ab)')} FROM k")
def semi_partial(spark, sf):
    return _by_component(spark, Q.semi_partial(X.lines(spark, sf), "raw_value", ["quantity", "confidence"]), "r")


@query(f"WITH {X.L_SQL}, {_CORR}, w AS (SELECT *, (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) AS r2 FROM k) SELECT 'quantity' AS component, {sql_micro('r2 - yb * yb')} AS loss FROM w UNION ALL SELECT 'confidence', {sql_micro('r2 - ya * ya')} FROM w")
def incremental_r2(spark, sf):
    return _by_component(spark, Q.incremental_r2(X.lines(spark, sf), "raw_value", ["quantity", "confidence"]), "loss")


_LEVELS = (0.0, 0.25, 0.5, 0.75, 2.0)


@query(f"WITH {X.L_SQL}, t AS (SELECT unnest([{', '.join(map(str, _LEVELS))}]) AS t) SELECT CAST(t AS DOUBLE) AS threshold, count(image_id) AS rows, count(DISTINCT image_id) AS images FROM t LEFT JOIN li ON confidence >= t GROUP BY 1")
def threshold_counts(spark, sf):
    return Q.threshold_counts(X.lines(spark, sf), "confidence", _LEVELS)


@query("WITH s AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS image_id, 'every' || CAST(n AS VARCHAR) AS split FROM orders, (SELECT unnest([2, 3, 5]) AS n) WHERE o_orderkey % n = 0) SELECT a.split AS \"left\", b.split AS \"right\", count(*) AS shared FROM s a JOIN s b ON a.image_id = b.image_id AND a.split < b.split GROUP BY 1, 2")
def split_overlaps(spark, sf):
    o, k = X.table(spark, sf, "orders"), F.col("o_orderkey")
    splits = o.select(k.cast("string").alias("image_id"), F.explode(F.filter(F.array(*map(F.lit, (2, 3, 5))), lambda n: k % n == 0)).alias("n"))
    return Q.split_overlaps(splits.select("image_id", F.concat(F.lit("every"), F.col("n").cast("string")).alias("split")))


_KNOWN = [f"Brand#{i}{j}" for i in (1, 2, 3, 4) for j in (1, 2, 3, 4, 5)]
_IN = ", ".join(f"'{k}'" for k in _KNOWN)


@query(f"WITH {X.L_SQL}, im AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS image_id FROM orders), st AS (SELECT image_id, CASE WHEN count(class_name) = 0 THEN 'empty' WHEN bool_and(class_name IN ({_IN})) THEN 'known' ELSE 'unknown' END AS stratum FROM im LEFT JOIN li USING (image_id) GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || image_id), image_id) AS i FROM st) SELECT image_id, stratum FROM r WHERE i <= 25")
def stratified_sample(spark, sf):
    return Q.random_sample(Q.stratify(X.objects(spark, sf), _orders(spark, sf), _KNOWN), 25, 7, ("stratum",))
