"""Offline diagnosis of a stored pool: every strategy under every seed, and how far the choices agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import reports as Q
from larkspur.operators import scoring as S
from larkspur.operators import stats as T


def proposal_table(scored: DataFrame) -> DataFrame:
    """Identity, labels, raw and scaled components and score of each proposal, for storing."""
    first = [c for c in ("proposal_index", "image_id", "confidence", "objectness", "predicted_label", "pseudo_label", "isolated", "kth_distance") if c in scored.columns]
    return scored.select(*first, *(f"{kind}_{c}" for c in S.COMPONENTS for kind in ("raw", "norm")), "score")


def diagnose_pool(candidates: DataFrame, reference: DataFrame, output: str, *, strategies: Sequence[str], budget: int, seeds: Sequence[int] = (0, 1, 2), label: str | None = None) -> dict[str, DataFrame]:
    """Writes proposals, selections, overlaps, stability and gate under output and returns them as read back.

    Overlaps are given for every seed, the gate for every scored strategy and seed. Each strategy and
    seed has a folder of its own that a rerun replaces. Strategies that need a posterior are skipped where
    candidates has none.
    """
    spark, registry, root = candidates.sparkSession, S.default_registry(), output.rstrip("/")
    specs = [(n, registry.resolve(n)) for n in strategies]
    specs = [(n, s) for n, s in specs if "posterior" in candidates.columns or not s.needs_posterior()]
    if not specs:
        raise ValueError("no strategy fits the pool")
    proposals, selections = [], []
    for seed in seeds:
        for name, s in specs:
            here = f"strategy={name.replace(':', '_')}/seed={seed}"
            if s.random:
                chosen = S.random_images(candidates.select("image_id").distinct(), budget, ("offline", seed)).withColumn("rank", F.lit(None).cast("int"))
            else:
                scored = S.score_proposals(candidates, reference, s, label=label, seed=seed, all_components=True)
                proposals.append(_written(proposal_table(scored).withColumn("strategy", F.lit(name)).withColumn("seed", F.lit(seed).cast("long")), f"{root}/proposals/{here}"))
                chosen = S.select_images(S.aggregate_images(proposals[-1], method=s.aggregation, top_k=s.top_k), budget)
            selections.append(_written(chosen.select("image_id", F.col("rank").cast("long").alias("rank"), F.lit(name).alias("strategy"), F.lit(seed).cast("long").alias("seed")), f"{root}/selections/{here}"))
    out = {"selections": reduce(DataFrame.unionByName, selections)}
    names = [n for n, _ in specs]
    out["stability"] = Q.self_stability(out["selections"])
    out["overlaps"] = reduce(DataFrame.unionByName, (T.pair_overlaps(out["selections"].where(F.col("seed") == seed), names).withColumn("seed", F.lit(seed).cast("long")) for seed in seeds))
    if proposals:
        out["proposals"] = reduce(DataFrame.unionByName, proposals)
        scored_names = [(n, seed) for seed in seeds for n, s in specs if not s.random]
        out["gate"] = reduce(DataFrame.unionByName, (Q.gate_impact(rows).withColumn("strategy", F.lit(n)).withColumn("seed", F.lit(seed).cast("long")) for rows, (n, seed) in zip(proposals, scored_names, strict=True)))
    for name in ("stability", "overlaps", "gate"):
        if name in out:
            out[name] = _written(out[name], f"{root}/{name}")
    return out


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
