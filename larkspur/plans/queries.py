"""Registered queries over the harness tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import components as C
from larkspur.operators import matching as M
from larkspur.operators import pools as P
from larkspur.operators import reports as Q
from larkspur.operators import ranks as R
from larkspur.operators import scoring as S
from larkspur.operators import stats as T
from larkspur.plans import fixtures as X
from larkspur.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BUDGET = 10


def micro(c: Column | str) -> Column:
    """Millionths as a long: what both engines agree on for sums of doubles. NaN becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | F.isnan(c), F.lit(None)).otherwise(F.floor(c * 1e6 + 0.5)).cast("long")


def sql_micro(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT) END"


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return add


# normalisers ------------------------------------------------------------------------------

_RANK = "rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"
_SCALE = {
    "rank": "CASE WHEN n <= 1 OR lo = hi THEN 0.5 ELSE ar / nullif(n - 1.0, 0) END",
    "ecdf": "(ar + 1.0) / n",
    "minmax": "CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE ({v} - lo) / nullif(hi - lo, 0) END",
    "zscore_sigmoid": "CASE WHEN sd < 1e-12 THEN 0.5 ELSE 1.0 / (1.0 + exp(-({v} - mu) / nullif(sd, 0))) END",
    "none": "{v}",
}


def sql_normalised(source: str, v: str, out: str, method: str) -> str:
    """source plus `out`, as a SELECT."""
    inner = f"SELECT *, {_RANK.format(v=v)} AS ar, count(*) OVER () AS n, min({v}) OVER () AS lo, max({v}) OVER () AS hi, avg({v}) OVER () AS mu, stddev_pop({v}) OVER () AS sd FROM {source}"
    return f"SELECT * EXCLUDE (ar, n, lo, hi, mu, sd), CAST({_SCALE[method].format(v=v)} AS DOUBLE) AS {out} FROM ({inner})"


def _add_normalisers() -> None:
    for method in R.METHODS:
        sql = f"WITH {X.L_SQL}, z AS ({sql_normalised('li', 'confidence', 'scaled', method)}) SELECT {sql_micro('confidence')} AS value, {sql_micro('scaled')} AS scaled, count(*) AS n FROM z GROUP BY 1, 2"

        def run(spark, sf, method=method):
            return R.normalise(X.lines(spark, sf), "confidence", "scaled", method).groupBy(micro("confidence").alias("value"), micro("scaled").alias("scaled")).agg(F.count("*").alias("n"))

        query(sql, f"norm_{method}")(run)


_add_normalisers()


@query(f"WITH {X.L_SQL}, z AS (SELECT confidence, {_RANK.format(v='confidence')} AS ar FROM li) SELECT {sql_micro('confidence')} AS value, {sql_micro('ar')} AS avg_rank, count(*) AS n FROM z GROUP BY 1, 2")
def average_ranks(spark, sf):
    return R.average_ranks(X.lines(spark, sf), "confidence", "avg_rank").groupBy(micro("confidence").alias("value"), micro("avg_rank").alias("avg_rank")).agg(F.count("*").alias("n"))


# uncertainty ------------------------------------------------------------------------------

_Q = "q AS (SELECT *, list_transform(posterior, lambda x: x / list_sum(posterior)) AS pr FROM c)"
_ENT = "least(greatest(-list_sum(list_transform(pr, lambda x: x * ln(x + 1e-12))) / ln(len(pr)), 0), 1)"
_UNC = {"entropy": _ENT, "margin": "1 - (list_reverse_sort(pr)[1] - list_reverse_sort(pr)[2])", "one_minus_max": "1 - list_max(pr)", "legacy": "1 - abs(2 * confidence - 1)"}


def _add_uncertainty() -> None:
    for method, expression in _UNC.items():

        def run(spark, sf, method=method):
            return C.uncertainty(X.candidates(spark, sf), method).select("proposal_index", micro("uncertainty").alias("uncertainty"))

        query(f"WITH {X.P_SQL}, {_Q} SELECT proposal_index, {sql_micro(expression)} AS uncertainty FROM q", f"unc_{method}")(run)
    for name, weight in (("unc_objectness_weighted", "confidence"), ("unc_objectness_weighted_stage1", "objectness")):

        def weighted(spark, sf, weight=weight):
            return C.uncertainty(X.candidates(spark, sf), "objectness_weighted_entropy", weight=weight).select("proposal_index", micro("uncertainty").alias("uncertainty"))

        sql = f"WITH {X.P_SQL}, {_Q}, e AS (SELECT *, {_ENT} AS ent FROM q), e1 AS ({sql_normalised('e', 'ent', 're', 'rank')}), e2 AS ({sql_normalised('e1', weight, 'rc', 'rank')}) SELECT proposal_index, {sql_micro('sqrt(re * rc)')} AS uncertainty FROM e2"
        query(sql, name)(weighted)


_add_uncertainty()


@query(f"WITH {X.P_SQL}, {_Q} SELECT proposal_index, CAST(list_position(pr, list_max(pr)) - 1 AS BIGINT) AS posterior_argmax, {sql_micro('list_max(pr)')} AS posterior_max, {sql_micro('list_reverse_sort(pr)[1] - list_reverse_sort(pr)[2]')} AS posterior_margin, {sql_micro('-list_sum(list_transform(pr, lambda x: x * ln(x + 1e-12)))')} AS posterior_entropy FROM q")
def posterior_diagnostics(spark, sf):
    d = C.posterior_diagnostics(X.candidates(spark, sf))
    return d.select("proposal_index", "posterior_argmax", *(micro(n).alias(n) for n in ("posterior_max", "posterior_margin", "posterior_entropy")))


# vectors ----------------------------------------------------------------------------------


@query(f"WITH {X.P_SQL} SELECT proposal_index, {sql_micro('unit[1]')} AS first, {sql_micro('list_dot_product(unit, unit)')} AS squared FROM c")
def l2_normalise(spark, sf):
    d = X.candidates(spark, sf).withColumn("u", V.l2_normalise(F.col("embedding")))
    return d.select("proposal_index", micro(F.get("u", 0)).alias("first"), micro(V.dot(F.col("u"), F.col("u"))).alias("squared"))


_NOV = "nov AS (SELECT c.proposal_index, 1.0 - max(list_dot_product(c.unit, r.unit)) AS nov FROM c, r GROUP BY 1)"


@query(f"WITH {X.P_SQL}, {_NOV} SELECT proposal_index, {sql_micro('nov')} AS novelty FROM nov")
def novelty_raw(spark, sf):
    return C.novelty(X.candidates(spark, sf), X.reference(spark, sf)).select("proposal_index", micro("novelty").alias("novelty"))


@query(f"WITH {X.P_SQL}, {_NOV} SELECT proposal_index, {sql_micro('nov')} AS novelty FROM nov")
def novelty_blocked(spark, sf):
    return C.novelty(X.candidates(spark, sf), X.reference(spark, sf), blocked=True).select("proposal_index", micro("novelty").alias("novelty"))


@query(f"WITH {X.P_SQL}, {_NOV}, z AS ({sql_normalised('nov', 'nov', 'scaled', 'minmax')}) SELECT proposal_index, {sql_micro('scaled')} AS novelty FROM z")
def novelty_minmax(spark, sf):
    n = cut(C.novelty(X.candidates(spark, sf), X.reference(spark, sf)))  # read twice
    return R.normalise(n, "novelty", "scaled", "minmax").select("proposal_index", micro("scaled").alias("novelty"))


@query(f"WITH {X.P_SQL} SELECT proposal_index, CAST(1000000 AS BIGINT) AS novelty FROM c")
def novelty_empty_reference(spark, sf):
    return C.novelty(X.candidates(spark, sf), X.reference(spark, sf).where("false")).select("proposal_index", micro("novelty").alias("novelty"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.unit, b.unit), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


def sql_kth(label: str | None, out: str) -> str:
    same = f" AND a.{label} = b.{label}" if label else ""
    part = f"PARTITION BY {label}" if label else ""
    return (
        f"{out}_d AS (SELECT a.proposal_index, {_DIST} AS d FROM c a JOIN c b ON a.proposal_index <> b.proposal_index{same}),"
        f" {out}_k AS (SELECT proposal_index, d, row_number() OVER (PARTITION BY proposal_index ORDER BY d) AS i FROM {out}_d),"
        f" {out}_n AS (SELECT proposal_index, least(5, count(*) OVER ({part}) - 1) AS want FROM c),"
        f" {out} AS (SELECT n.proposal_index, coalesce(k.d, 0.0) AS {out} FROM {out}_n n LEFT JOIN {out}_k k ON k.proposal_index = n.proposal_index AND k.i = n.want)"
    )


@query(f"WITH {X.P_SQL}, {sql_kth(None, 'far')} SELECT proposal_index, {sql_micro('far')} AS kth_distance FROM far")
def knn_kth_global(spark, sf):
    d = X.candidates(spark, sf).withColumn("u", V.l2_normalise(F.col("embedding")))
    return C.kth_neighbour(d, embedding="u").select("proposal_index", micro("kth_distance").alias("kth_distance"))


@query(f"WITH {X.P_SQL}, {sql_kth('skew_label', 'near')} SELECT proposal_index, {sql_micro('near')} AS kth_distance FROM near")
def knn_kth_within(spark, sf):
    d = X.candidates(spark, sf).withColumn("u", V.l2_normalise(F.col("embedding")))
    return C.kth_neighbour(d, embedding="u", label="skew_label").select("proposal_index", micro("kth_distance").alias("kth_distance"))


# rarity, coherence ------------------------------------------------------------------------

_RAR = {"log_inverse_frequency": "-ln(sz / al)", "inverse_frequency": "1.0 / sz", "negative_count": "-sz"}


def _add_rarity() -> None:
    for method, expression in _RAR.items():

        def run(spark, sf, method=method):
            return C.rarity(X.lines(spark, sf), method).groupBy("pseudo_label").agg(micro(F.max("rarity")).alias("rarity"), F.count("*").alias("n"))

        query(f"WITH {X.L_SQL}, z AS (SELECT pseudo_label, CAST(count(*) OVER (PARTITION BY pseudo_label) AS DOUBLE) AS sz, count(*) OVER () AS al FROM li), y AS (SELECT pseudo_label, {expression} AS rarity FROM z) SELECT pseudo_label, {sql_micro('max(rarity)')} AS rarity, count(*) AS n FROM y GROUP BY 1", f"rarity_{method}")(run)


_add_rarity()


@query(f"WITH {X.P_SQL}, s AS (SELECT proposal_index, count(*) OVER (PARTITION BY skew_label) AS n FROM c) SELECT proposal_index, n AS cluster_size, CASE WHEN n <= 1 THEN 'singleton' WHEN n <= 3 THEN '2-3' WHEN n <= 5 THEN '4-5' ELSE '6+' END AS regime FROM s")
def cluster_sizes(spark, sf):
    return C.cluster_sizes(X.candidates(spark, sf), "skew_label").select("proposal_index", "cluster_size", V.size_regime(F.col("cluster_size")).alias("regime"))


def sql_coherence(method: str, label: str) -> str:
    """CTEs that end in coh(proposal_index, coh, isolated)."""
    size = f"sz AS (SELECT proposal_index, {label} AS lab, count(*) OVER (PARTITION BY {label}) AS n FROM c), lim AS (SELECT quantile_cont(far, 0.9) AS lim, quantile_cont(far, 0.5) AS med FROM far)"
    far = sql_kth(None, "far")
    if method == "density":
        return f"{far}, {size}, coh AS (SELECT f.proposal_index, least(greatest(1.0 / (1.0 + f.far / greatest(lim.med, 1e-12)), 0), 1) AS coh, f.far > lim.lim AS isolated FROM far f, lim)"
    if method == "neighbour_consistency":
        return (
            f"{far}, {size}, g AS (SELECT a.proposal_index, a.{label} = b.{label} AS same, row_number() OVER (PARTITION BY a.proposal_index ORDER BY {_DIST}, b.proposal_index) AS i FROM c a JOIN c b ON a.proposal_index <> b.proposal_index),"
            f" ag AS (SELECT proposal_index, sum(CASE WHEN same THEN 1 ELSE 0 END) AS agree FROM g WHERE i <= 5 GROUP BY 1),"
            f" coh AS (SELECT f.proposal_index, CASE WHEN n <= 1 THEN 0.0 ELSE least(greatest(agree / CAST(least(5, n - 1) AS DOUBLE), 0), 1) END AS coh, n <= 1 OR f.far > lim.lim AS isolated FROM far f JOIN sz USING (proposal_index) JOIN ag USING (proposal_index), lim)"
        )
    return (
        f"{far}, {size}, {sql_kth(label, 'near')}, j AS (SELECT f.proposal_index, f.far, near, n, lab FROM far f JOIN near USING (proposal_index) JOIN sz USING (proposal_index)),"
        f" own AS (SELECT lab, quantile_cont(near, 0.5) AS own FROM j WHERE n > 1 GROUP BY 1), pool AS (SELECT quantile_cont(near, 0.5) AS med FROM j WHERE n > 1),"
        f" coh AS (SELECT proposal_index, CASE WHEN n <= 1 THEN 0.0 ELSE 1.0 / (1.0 + near / greatest(CASE WHEN n >= 3 THEN own.own ELSE pool.med END, 1e-12)) END AS coh, n <= 1 OR far > lim.lim AS isolated FROM j LEFT JOIN own USING (lab), pool, lim)"
    )


def _add_coherence() -> None:
    for method in C.COHERENCE:

        def run(spark, sf, method=method):
            return C.coherence(X.candidates(spark, sf), method, label="skew_label").select("proposal_index", micro("coherence").alias("coherence"), "isolated")

        query(f"WITH {X.P_SQL}, {sql_coherence(method, 'skew_label')} SELECT proposal_index, {sql_micro('coh')} AS coherence, isolated FROM coh", f"coherence_{method}")(run)


_add_coherence()

# aggregation and selection ----------------------------------------------------------------

_AGG = {
    "top_k_mean": "(SELECT image_id, avg(confidence) AS image_score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, proposal_index) AS i FROM c) WHERE i <= 3 GROUP BY 1)",
    "max": "(SELECT image_id, max(confidence) AS image_score FROM c GROUP BY 1)",
    "mean": "(SELECT image_id, avg(confidence) AS image_score FROM c GROUP BY 1)",
    "noisy_or": "(SELECT image_id, 1.0 - exp(sum(ln(1 - least(greatest(confidence, 0), 1 - 1e-12)))) AS image_score FROM c GROUP BY 1)",
}


def _add_aggregations() -> None:
    for method, expression in _AGG.items():

        def run(spark, sf, method=method):
            return S.aggregate_images(X.candidates(spark, sf), method=method, score="confidence").select("image_id", micro("image_score").alias("image_score"))

        query(f"WITH {X.P_SQL} SELECT image_id, {sql_micro('image_score')} AS image_score FROM {expression}", f"agg_{method}")(run)


_add_aggregations()
_TOP = f"(SELECT image_id, image_score, row_number() OVER (ORDER BY image_score DESC, image_id) AS rank FROM {_AGG['top_k_mean']})"


def _images(spark, sf):
    return S.aggregate_images(X.candidates(spark, sf), score="confidence")


@query(f"WITH {X.P_SQL} SELECT image_id, CAST(rank AS INTEGER) AS rank, {sql_micro('image_score')} AS image_score FROM {_TOP} WHERE rank <= {BUDGET}")
def select_images(spark, sf):
    return S.select_images(_images(spark, sf), BUDGET).select("image_id", "rank", micro("image_score").alias("image_score"))


@query(f"WITH {X.P_SQL}, s AS (SELECT image_id FROM {_TOP} WHERE rank <= {BUDGET}) SELECT proposal_index, image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, proposal_index) AS i FROM c WHERE image_id IN (SELECT image_id FROM s)) WHERE i <= 3")
def selected_proposal_mask(spark, sf):
    rows = X.candidates(spark, sf).withColumn("score", F.col("confidence"))
    return S.selected_mask(rows, S.select_images(_images(spark, sf), BUDGET), S.Strategy("mask")).select("proposal_index", "image_id")


@query(f"WITH {X.P_SQL} SELECT image_id FROM {_TOP} WHERE rank > {BUDGET}")
def remaining_pool(spark, sf):
    images = _images(spark, sf)
    return S.remaining(images, S.select_images(images, BUDGET)).select("image_id")


# strategies -------------------------------------------------------------------------------


def sql_strategy(s: S.Strategy, label: str = "predicted_label") -> str:
    """Images and scores of a strategy with given labels."""
    active = set(s.active())
    need = active | ({"rarity", "coherence"} if "gated" in active else set())
    unc = {"legacy": _UNC["legacy"], "entropy": _ENT}[s.uncertainty_method]
    ctes = [X.P_SQL, _Q]
    joins, cols = [], ["q.proposal_index", "q.image_id", f"{unc} AS raw_uncertainty" if "uncertainty" in need else "0.0 AS raw_uncertainty"]
    if "novelty" in need:
        ctes.append(_NOV)
        joins.append("JOIN nov USING (proposal_index)")
        cols.append("nov AS raw_novelty")
    if "rarity" in need:
        e = _RAR[s.rarity_method]
        ctes.append(f"rr AS (SELECT proposal_index, {e} AS raw_rarity FROM (SELECT proposal_index, CAST(count(*) OVER (PARTITION BY {label}) AS DOUBLE) AS sz, count(*) OVER () AS al FROM c))")
        joins.append("JOIN rr USING (proposal_index)")
        cols.append("raw_rarity")
    if "coherence" in need:
        ctes.append(sql_coherence(s.coherence_method, label))
        joins.append("JOIN coh USING (proposal_index)")
        cols.append("coh AS raw_coherence")
    ctes.append(f"b0 AS (SELECT {', '.join(cols)} FROM q {' '.join(joins)})")
    last = "b0"
    for c in ("uncertainty", "novelty", "rarity", "coherence"):
        if c in need:
            ctes.append(f"n_{c} AS ({sql_normalised(last, f'raw_{c}', f'norm_{c}', s.scale_of(c))})")
            last = f"n_{c}"
    if "gated" in need:
        ctes.append(f"gt0 AS (SELECT *, norm_rarity * pow(raw_coherence, {s.coherence_exponent}) AS raw_gated FROM {last})")
        ctes.append(f"n_gated AS ({sql_normalised('gt0', 'raw_gated', 'norm_gated', s.scale_of('gated'))})")
        last = "n_gated"
    total = " + ".join(f"{s.weights[c]} * norm_{c}" for c in S.COMPONENTS if c in active) or "0.0"
    if s.divide_by_weights:
        total = f"({total}) / {sum(s.weights[c] for c in active)}"
    ctes.append(f"sc AS (SELECT proposal_index, image_id, {total} AS score FROM {last})")
    # equal scores may differ in the last bit between engines, which moves no image score by more than that bit
    top = "(SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, proposal_index) AS i FROM sc)"
    return f"WITH {', '.join(ctes)} SELECT image_id, {sql_micro('avg(score)')} AS image_score FROM {top} WHERE i <= 3 GROUP BY 1"


def run_strategy(spark, sf, s: S.Strategy, label: str = "predicted_label") -> DataFrame:
    scored = S.score_proposals(X.candidates(spark, sf), X.reference(spark, sf), s, label=label, isolation=False)  # which rows are isolated is in no image score
    return S.aggregate_images(scored, method=s.aggregation, top_k=s.top_k)


def _add_strategies() -> None:
    registry = S.default_registry()
    for full in registry.qualified_names():
        s = registry.resolve(full)
        if s.random:
            continue

        def run(spark, sf, s=s):
            return run_strategy(spark, sf, s).select("image_id", micro("image_score").alias("image_score"))

        query(sql_strategy(s), f"strategy_{s.version}_{s.name}")(run)


_add_strategies()


@query(f"WITH {X.P_SQL} SELECT image_id FROM (SELECT DISTINCT image_id FROM c) ORDER BY sha256('7:1:random:' || image_id), image_id LIMIT {BUDGET}")
def random_hash(spark, sf):
    return S.random_images(X.candidates(spark, sf).select("image_id").distinct(), BUDGET, (7, 1, "random"))


@query(f"WITH {X.P_SQL} SELECT DISTINCT image_id, CAST('0x' || substr(sha256('pool|' || image_id || '|3'), 1, 8) AS BIGINT) AS seed FROM c")
def derived_seeds(spark, sf):
    return X.candidates(spark, sf).select("image_id").distinct().select("image_id", V.derive_seed(F.lit("pool"), F.col("image_id"), F.lit(3)).alias("seed"))


# detection metrics ------------------------------------------------------------------------


@query(f"WITH {X.D_SQL} SELECT det_idx, gt_idx, {sql_micro('iou')} AS iou FROM iou WHERE iou > 0")
def box_iou(spark, sf):
    d, t = X.detections(spark, sf).withColumnRenamed("box", "db").drop("class_name"), X.truth(spark, sf)
    return d.join(t, "image_id").withColumn("iou", V.box_iou(F.col("db"), F.col("box"))).where("iou > 0").select("det_idx", "gt_idx", micro("iou").alias("iou"))


def sql_match(aware: bool = False) -> str:
    """CTEs that end in m(image_id, det_idx, score, gt_idx)."""
    only = " AND dn = gn" if aware else ""
    return (
        f"RECURSIVE {X.D_SQL}, cand AS (SELECT det_idx, list(gt_idx ORDER BY iou DESC, gt_idx) AS c FROM iou WHERE iou >= 0.5{only} GROUP BY 1),"
        " d AS (SELECT det.image_id, det.det_idx, det.score, coalesce(cand.c, []) AS c, row_number() OVER (PARTITION BY det.image_id ORDER BY score DESC, det.det_idx) AS rn FROM det LEFT JOIN cand USING (det_idx)),"
        " st AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det_idx, CAST(NULL AS BIGINT) AS gt_idx FROM (SELECT DISTINCT image_id FROM det)"
        " UNION ALL SELECT d.image_id, d.rn, CASE WHEN list_filter(d.c, lambda x: NOT list_contains(st.used, x))[1] IS NULL THEN st.used ELSE list_append(st.used, list_filter(d.c, lambda x: NOT list_contains(st.used, x))[1]) END,"
        " d.det_idx, list_filter(d.c, lambda x: NOT list_contains(st.used, x))[1] FROM st JOIN d ON d.image_id = st.image_id AND d.rn = st.k + 1),"
        " m AS (SELECT st.image_id, st.det_idx, det.score, st.gt_idx FROM st JOIN det USING (det_idx))"
    )


@query(f"WITH {sql_match()} SELECT image_id, det_idx, gt_idx FROM m")
def match_greedy(spark, sf):
    return M.match(X.detections(spark, sf), X.truth(spark, sf)).select("image_id", "det_idx", "gt_idx")


@query(f"WITH {sql_match(True)} SELECT image_id, det_idx, gt_idx FROM m")
def match_class_aware(spark, sf):
    return M.match(X.detections(spark, sf), X.truth(spark, sf), class_aware=True).select("image_id", "det_idx", "gt_idx")


_AP = "c1 AS (SELECT *, CASE WHEN gt_idx IS NULL THEN 0 ELSE 1 END AS tp FROM m), c2 AS (SELECT *, sum(tp) OVER w AS ctp, count(*) OVER w AS cn FROM c1 WINDOW w AS (ORDER BY score DESC, image_id, det_idx ROWS UNBOUNDED PRECEDING)), c3 AS (SELECT tp, max(ctp / CAST(cn AS DOUBLE)) OVER (ORDER BY score DESC, image_id, det_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c2)"


@query(f"WITH {sql_match()}, {_AP} SELECT (SELECT count(*) FROM gt) AS support, CAST((SELECT sum(tp) FROM c1) AS BIGINT) AS matched, {sql_micro('(SELECT sum(tp) FROM c1) / CAST((SELECT count(*) FROM gt) AS DOUBLE)')} AS recall, {sql_micro('(SELECT sum(tp * env) FROM c3) / (SELECT count(*) FROM gt)')} AS ap")
def detection_overall(spark, sf):
    t = X.truth(spark, sf)
    m = cut(M.match(X.detections(spark, sf), t))  # two readers
    return M.recall(m, t).join(F.broadcast(M.average_precision(m, t))).select("support", "matched", micro("recall").alias("recall"), micro("ap").alias("ap"))  # one row each


_GROUPS = "cls AS (SELECT class_name, row_number() OVER (ORDER BY count(*) DESC, class_name) - 1 AS rk, count(*) OVER () AS nc FROM gt GROUP BY 1), grp AS (SELECT class_name, CASE WHEN rk < (nc + 2) // 3 THEN 'head' WHEN rk < (2 * nc + 2) // 3 THEN 'medium' ELSE 'tail' END AS g FROM cls)"


def _groups(spark, sf) -> DataFrame:
    return P.third_groups(P.object_counts(X.truth(spark, sf))).select("class_name", "group")


@query(f"WITH {sql_match()}, {_GROUPS} SELECT g AS \"group\", count(*) AS support, CAST(sum(CASE WHEN m.gt_idx IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS matched FROM gt JOIN grp USING (class_name) LEFT JOIN m USING (gt_idx) GROUP BY 1")
def legacy_grouped_recall(spark, sf):
    return M.legacy_grouped_recall(X.detections(spark, sf), X.truth(spark, sf), _groups(spark, sf)).select("group", "support", "matched")


def sql_grouped() -> str:
    """(group, support, matched, ignored) with each group matched apart and the others ignored."""
    return (
        f"WITH RECURSIVE {X.D_SQL}, {_GROUPS}, gs AS (SELECT DISTINCT g FROM grp), io AS (SELECT iou.*, grp.g AS own FROM iou JOIN grp ON grp.class_name = gn WHERE iou >= 0.5),"
        " cand AS (SELECT own AS g, det_idx, list(gt_idx ORDER BY iou DESC, gt_idx) AS c FROM io GROUP BY 1, 2), ign AS (SELECT DISTINCT gs.g, det_idx FROM io, gs WHERE own <> gs.g),"
        " d AS (SELECT gs.g, det.image_id, det.det_idx, coalesce(cand.c, []) AS c, row_number() OVER (PARTITION BY gs.g, det.image_id ORDER BY score DESC, det.det_idx) AS rn FROM det CROSS JOIN gs LEFT JOIN cand ON cand.det_idx = det.det_idx AND cand.g = gs.g),"
        " st AS (SELECT g, image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det_idx, CAST(NULL AS BIGINT) AS gt_idx FROM (SELECT DISTINCT g, image_id FROM d)"
        " UNION ALL SELECT d.g, d.image_id, d.rn, CASE WHEN list_filter(d.c, lambda x: NOT list_contains(st.used, x))[1] IS NULL THEN st.used ELSE list_append(st.used, list_filter(d.c, lambda x: NOT list_contains(st.used, x))[1]) END,"
        " d.det_idx, list_filter(d.c, lambda x: NOT list_contains(st.used, x))[1] FROM st JOIN d ON d.g = st.g AND d.image_id = st.image_id AND d.rn = st.k + 1),"
        " sup AS (SELECT g, count(*) AS support FROM gt JOIN grp USING (class_name) GROUP BY 1)"
        " SELECT sup.g AS \"group\", any_value(support) AS support, CAST(sum(CASE WHEN st.gt_idx IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN st.gt_idx IS NULL AND ign.det_idx IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS ignored"
        " FROM st JOIN sup USING (g) LEFT JOIN ign ON ign.g = st.g AND ign.det_idx = st.det_idx WHERE st.det_idx IS NOT NULL GROUP BY 1"
    )


@query(sql_grouped())
def grouped_matching(spark, sf):
    m, t = M.grouped_matches(X.detections(spark, sf), X.truth(spark, sf), _groups(spark, sf))
    s = t.groupBy("group").agg(F.count("*").alias("support"))
    return m.groupBy("group").agg(F.sum("tp").alias("matched"), F.sum("ignored").alias("ignored")).join(s, "group").select("group", "support", "matched", "ignored")


@query()
def grouped_metrics(spark, sf):
    return M.grouped_metrics(X.detections(spark, sf), X.truth(spark, sf), _groups(spark, sf)).select("group", "support", "matched", micro("recall").alias("recall"), micro("ap").alias("ap"))


# groups and pools -------------------------------------------------------------------------


@query(f"WITH {X.L_SQL} SELECT class_name, count(*) AS n FROM li GROUP BY 1")
def class_frequency(spark, sf):
    return P.object_counts(X.objects(spark, sf))


@query(f"WITH {X.L_SQL} SELECT class_name, count(DISTINCT image_id) AS n FROM li GROUP BY 1")
def presence_frequency(spark, sf):
    return P.presence_counts(X.objects(spark, sf))


@query(f"WITH {X.L_SQL}, z AS (SELECT class_name, count(*) AS n FROM li GROUP BY 1) SELECT class_name, n, CASE WHEN n <= 2300 THEN 'tail' WHEN n >= 2500 THEN 'head' ELSE 'medium' END AS \"group\" FROM z")
def groups_threshold(spark, sf):
    return P.threshold_groups(P.object_counts(X.objects(spark, sf)), 2500, 2300)


_RANKED = "z AS (SELECT class_name, count(*) AS n FROM li GROUP BY 1), rk AS (SELECT class_name, n, row_number() OVER (ORDER BY n DESC, class_name) - 1 AS rank, count(*) OVER () AS nc, max(n) OVER () AS mx FROM z)"


@query(f"WITH {X.L_SQL}, {_RANKED} SELECT class_name, n, CAST(rank AS INTEGER) AS rank, CASE WHEN rank < (nc + 2) // 3 THEN 'head' WHEN rank < (2 * nc + 2) // 3 THEN 'medium' ELSE 'tail' END AS \"group\" FROM rk")
def groups_thirds(spark, sf):
    return P.third_groups(P.object_counts(X.objects(spark, sf))).select("class_name", "n", "rank", "group")


@query(f"WITH {X.L_SQL}, {_RANKED} SELECT class_name, n, CAST(rank AS INTEGER) AS rank, CASE WHEN n = 0 THEN 0 ELSE CAST(least(n, greatest(1, round_even(mx * pow(20.0, -rank / CAST(greatest(nc - 1, 1) AS DOUBLE)), 0))) AS BIGINT) END AS target FROM rk")
def longtail_targets(spark, sf):
    return P.long_tail_targets(P.object_counts(X.objects(spark, sf)), 20.0).select("class_name", "n", "rank", "target")


@query()
def longtail_pool(spark, sf):
    o = X.objects(spark, sf)
    return P.long_tail_pool(o, P.long_tail_targets(P.presence_counts(o), 5.0), seed=3)


# similarity of selections -----------------------------------------------------------------

_PAIR = ("v2:uncertainty", "v2:rarity_coherence", "v1:full")


def _selections(spark, sf) -> DataFrame:
    registry, out = S.default_registry(), None
    for name in _PAIR:
        picked = S.select_images(run_strategy(spark, sf, registry.resolve(name)).withColumn("image_score", micro("image_score").cast("double")), BUDGET).select(F.lit(name).alias("strategy"), "image_id", "rank")
        out = picked if out is None else out.unionByName(picked)
    return out


def _sql_selections() -> str:
    registry = S.default_registry()
    parts = [f"SELECT '{n}' AS strategy, image_id, row_number() OVER (ORDER BY image_score DESC, image_id) AS rank FROM ({sql_strategy(registry.resolve(n))})" for n in _PAIR]
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rank <= {BUDGET})"


@query(f"WITH s AS {_sql_selections()}, o AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {i})' for i, n in enumerate(_PAIR))}) t(strategy, i)), p AS (SELECT a.strategy AS \"left\", b.strategy AS \"right\" FROM o a JOIN o b ON a.i < b.i), v AS (SELECT p.\"left\", p.\"right\", count(y.image_id) AS overlap FROM p JOIN s x ON x.strategy = p.\"left\" LEFT JOIN s y ON y.strategy = p.\"right\" AND y.image_id = x.image_id GROUP BY 1, 2) SELECT \"left\", \"right\", overlap, {sql_micro(f'overlap / CAST({2 * BUDGET} - overlap AS DOUBLE)')} AS jaccard FROM v")
def jaccard_pairs(spark, sf):
    return T.pair_overlaps(_selections(spark, sf), list(_PAIR)).select("left", "right", "overlap", micro("jaccard").alias("jaccard"))


_DEEP = 50


@query(f"WITH {X.P_SQL}, a AS (SELECT proposal_index, row_number() OVER (ORDER BY confidence DESC, proposal_index) AS l, row_number() OVER (ORDER BY objectness DESC, proposal_index) AS r FROM c), d AS (SELECT CAST(range AS DOUBLE) AS d FROM range(1, {_DEEP + 1})), t AS (SELECT d, (SELECT count(*) FROM a WHERE greatest(l, r) <= d) / d * pow(0.9, d - 1) AS t FROM d) SELECT {sql_micro('(1 - 0.9) * sum(t)')} AS rbo FROM t")
def rbo(spark, sf):
    d = X.candidates(spark, sf)

    def ranked(c: str) -> DataFrame:
        top = d.orderBy(F.col(c).desc(), "proposal_index").limit(_DEEP)
        return top.select(F.col("proposal_index").alias("image_id"), F.row_number().over(Window.orderBy(F.col(c).desc(), "proposal_index")).alias("rank"))

    return T.rank_biased_overlap(ranked("confidence"), ranked("objectness"), depth=_DEEP).select(micro("rbo").alias("rbo"))


@query(f"WITH {X.P_SQL}, t AS (SELECT * FROM {_TOP}) SELECT {sql_micro(f'((SELECT image_score FROM t WHERE rank = {BUDGET}) - (SELECT image_score FROM t WHERE rank = {BUDGET + 1})) / ((SELECT max(image_score) FROM t) - (SELECT min(image_score) FROM t))')} AS gap")
def boundary_gap(spark, sf):
    return T.boundary_gap(_images(spark, sf), BUDGET).select(micro("gap").alias("gap"))


# statistics -------------------------------------------------------------------------------


@query(f"WITH {X.L_SQL} SELECT {sql_micro('corr(confidence, raw_value)')} AS r FROM li")
def pearson(spark, sf):
    return T.pearson(X.lines(spark, sf), "confidence", "raw_value").select(micro("r").alias("r"))


@query(f"WITH {X.L_SQL}, z AS (SELECT {_RANK.format(v='confidence')} AS a, {_RANK.format(v='raw_value')} AS b FROM li) SELECT {sql_micro('corr(a, b)')} AS rho FROM z")
def spearman(spark, sf):
    return T.spearman(X.lines(spark, sf), "confidence", "raw_value").select(micro("rho").alias("rho"))


@query(f"WITH {X.L_SQL}, z AS (SELECT avg(raw_value) FILTER (confidence > 0.5) AS a, avg(raw_value) FILTER (NOT confidence > 0.5) AS b, var_samp(raw_value) FILTER (confidence > 0.5) AS va, var_samp(raw_value) FILTER (NOT confidence > 0.5) AS vb, count(*) FILTER (confidence > 0.5) AS na, count(*) FILTER (NOT confidence > 0.5) AS nb FROM li) SELECT {sql_micro('(a - b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))')} AS d FROM z")
def cohens_d(spark, sf):
    return T.cohens_d(X.lines(spark, sf).withColumn("flag", F.col("confidence") > 0.5), "raw_value", "flag").select(micro("d").alias("d"))


@query(f"WITH {X.L_SQL} SELECT count(confidence) AS count, {sql_micro('avg(confidence)')} AS mean, {sql_micro('stddev_samp(confidence)')} AS std, {sql_micro('min(confidence)')} AS min, {sql_micro('max(confidence)')} AS max, count(DISTINCT confidence) AS \"distinct\", " + ", ".join(f"{sql_micro(e)} AS {n}" for e, n in (("avg(CASE WHEN confidence <= 0.01 THEN 1.0 ELSE 0.0 END)", "fraction_near_zero"), ("avg(CASE WHEN confidence >= 0.99 THEN 1.0 ELSE 0.0 END)", "fraction_near_one"), ("avg(CASE WHEN confidence < 0.1 THEN 1.0 ELSE 0.0 END)", "fraction_below_0_1"), *((f"quantile_cont(confidence, {q})", f"q{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)))) + " FROM li")
def summarise(spark, sf):
    s = T.summarise(X.lines(spark, sf), "confidence")
    return s.select("count", "distinct", *(micro(c).alias(c) for c in s.columns if c not in ("count", "distinct")))


@query(f"WITH {X.L_SQL}, e AS (SELECT min(raw_value) AS lo, (max(raw_value) - min(raw_value)) / 20 AS w FROM li), b AS (SELECT least(19, CAST(floor((raw_value - lo) / w) AS BIGINT)) AS bin, count(*) AS n FROM li, e GROUP BY 1) SELECT CAST(r.range AS BIGINT) AS bin, {sql_micro('lo + r.range * w')} AS low, {sql_micro('lo + (r.range + 1) * w')} AS high, coalesce(n, 0) AS n FROM range(0, 20) r CROSS JOIN e LEFT JOIN b ON b.bin = r.range")
def histogram(spark, sf):
    return T.histogram(X.lines(spark, sf), "raw_value").select("bin", micro("low").alias("low"), micro("high").alias("high"), "n")


@query(f"WITH {X.L_SQL}, z AS (SELECT pseudo_label AS a, class_name AS b, count(*) AS n FROM li GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2.0) AS v, sum(n) AS al FROM z), i AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM z GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM z GROUP BY b)) SELECT {sql_micro('(ij.v - i.v * j.v / (al * (al - 1) / 2.0)) / ((i.v + j.v) / 2 - i.v * j.v / (al * (al - 1) / 2.0))')} AS ari FROM ij, i, j")
def adjusted_rand(spark, sf):
    return T.adjusted_rand(X.lines(spark, sf), "pseudo_label", "class_name").select(micro("ari").alias("ari"))


@query(f"WITH {X.P_SQL}, q1 AS (SELECT list_sort(list_distinct(quantile_cont(confidence, [i / 12.0 for i in range(1, 12)]))) AS e1, list_sort(list_distinct(quantile_cont(objectness, [i / 12.0 for i in range(1, 12)]))) AS e2 FROM c), z AS (SELECT len(list_filter(e1, lambda e: e <= confidence)) AS x, len(list_filter(e2, lambda e: e <= objectness)) AS y FROM c, q1), k AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS n FROM z GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER () AS al, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM k) SELECT {sql_micro('sum(n / al * ln(n * al / (nx * ny)))')} AS mi, {sql_micro('sum(n / al * ln(n * al / (nx * ny))) / least(sum(-n / al * ln(nx / al)), sum(-n / al * ln(ny / al)))')} AS normalised FROM w")
def mutual_information(spark, sf):
    return T.mutual_information(X.candidates(spark, sf), "confidence", "objectness").select(micro("mi").alias("mi"), micro("normalised").alias("normalised"))


@query("WITH r AS (SELECT o_orderpriority AS arm, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_orderpriority, year(o_orderdate)), a AS (SELECT arm, avg(value) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(value) END AS sd FROM r GROUP BY 1), n AS (SELECT avg(sd) AS noise, max(mean) FILTER (arm = '1-URGENT') AS base FROM a) SELECT arm, " + sql_micro("mean - base") + " AS effect, " + sql_micro("noise") + " AS noise FROM a, n WHERE arm <> '1-URGENT'")
def power_report(spark, sf):
    r = X.rounds(spark, sf).select(F.col("variant").alias("arm"), F.col("metric").cast("double").alias("value"))
    return T.power_report(r, "1-URGENT").select("arm", micro("effect").alias("effect"), micro("noise").alias("noise"))


_ROUNDS = "r AS (SELECT o_orderpriority AS variant, CAST(year(o_orderdate) AS BIGINT) AS round, count(*) AS metric FROM orders GROUP BY 1, 2)"


@query(f"WITH {_ROUNDS} SELECT variant, min(round) AS first_round, max(round) AS last_round, arg_max(metric, round) - arg_min(metric, round) AS delta FROM r GROUP BY 1")
def round_deltas(spark, sf):
    return Q.round_deltas(X.rounds(spark, sf))


@query(f"WITH {_ROUNDS} SELECT v.variant, y.round, r.metric FROM (SELECT DISTINCT variant FROM r) v JOIN (SELECT DISTINCT round FROM r) y ON true LEFT JOIN r ON r.variant = v.variant AND r.round = y.round")
def metric_pivot(spark, sf):
    p = Q.metric_pivot(X.rounds(spark, sf))
    wide = p.columns[1:]
    return p.unpivot("variant", wide, "round", "metric").select("variant", F.substring("round", 2, 10).cast("long").alias("round"), "metric")


@query(f"WITH {_ROUNDS}, s AS (SELECT variant, CAST(avg(metric) AS DOUBLE) AS a, CAST(min(metric) AS DOUBLE) AS b FROM r GROUP BY 1) SELECT l.variant FROM s l WHERE NOT EXISTS (SELECT 1 FROM s r WHERE r.variant <> l.variant AND r.a >= l.a - 1e-12 AND -r.b >= -l.b - 1e-12 AND (r.a > l.a + 1e-12 OR -r.b > -l.b + 1e-12))")
def pareto_skyline(spark, sf):
    s = X.rounds(spark, sf).groupBy("variant").agg(F.avg("metric").cast("double").alias("a"), F.min("metric").cast("double").alias("b"))
    return T.pareto_front(s, "variant", {"a": 1, "b": -1}).select("variant")


@query()
def kmeans_labels(spark, sf):
    return C.kmeans_labels(X.candidates(spark, sf), clusters=8, seed=1).groupBy("pseudo_label").agg(F.count("*").alias("n"))
