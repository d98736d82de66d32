"""Rounds of annotation: train, predict, score, select, evaluate, with a detector that the caller supplies.

Ids and selections stay tables under the campaign's output folder, which executors and driver
share; each round reads the one before, so a stopped campaign goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.config import Campaign
from larkspur.operators import scoring as S
from larkspur.sources.files import guard


class Detector(Protocol):
    """What trains on images, proposes boxes in them and measures itself."""

    def train(self, labelled: DataFrame, previous: str, *, seed: int) -> str:
        """A checkpoint from the labelled images (image_id)."""

    def predict(self, checkpoint: str, images: DataFrame) -> DataFrame:
        """Proposals (proposal_index, image_id, embedding, posterior, confidence, ...) in the images."""

    def evaluate(self, checkpoint: str) -> Mapping[str, float]:
        """Metrics of the checkpoint."""


class InvariantError(RuntimeError):
    """A round broke what must hold of its tables."""


@dataclass(frozen=True)
class Round:
    seed: int
    strategy: S.Strategy
    number: int

    def folder(self, root: str) -> str:
        return f"{root.rstrip('/')}/seed={self.seed}/strategy={self.strategy.version}_{self.strategy.name}/round={self.number}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def disjoint(left: DataFrame, right: DataFrame, what: str) -> None:
    if shared := left.select("image_id").intersect(right.select("image_id")).limit(3).collect():
        raise InvariantError(f"{what} share images: {', '.join(r[0] for r in shared)}")


def initial_labelled(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """n candidates in the order of a hash of seed and id, the same for every strategy."""
    return S.random_images(candidates, n, ("initial", seed)) if n else candidates.select("image_id").limit(0)


def run_round(spark: SparkSession, settings: Campaign, detector: Detector, at: Round, *, candidates: DataFrame, reference: DataFrame, labelled: DataFrame, checkpoint: str, resume: bool = False) -> tuple[DataFrame, str]:
    """(labelled images after the round, checkpoint). A finished round is read back with resume, refused without."""
    base = at.folder(settings.output)
    if _exists(spark, f"{base}/metrics/_SUCCESS"):
        if not resume:
            raise FileExistsError(f"{base} holds a finished round")
        return spark.read.parquet(f"{base}/labelled"), spark.read.parquet(f"{base}/metrics").first()["checkpoint"]
    disjoint(labelled, reference, "labelled and reference images")
    pool = S.remaining(candidates.select("image_id"), labelled)
    budget = settings.rounds.budget_per_round
    if at.strategy.random:
        if pool.limit(budget).count() < budget:
            raise ValueError("the budget exceeds the number of images")
        chosen = S.random_images(pool, budget, (at.seed, at.number, at.strategy.name))
    else:
        proposals = guard(detector.predict(checkpoint, pool))
        bank = detector.predict(checkpoint, reference)
        label = "predicted_label" if at.strategy.label_source == "predicted" else None
        scored = S.score_proposals(proposals, bank, at.strategy, label=label, seed=at.seed, isolation=False)
        images = _written(S.aggregate_images(scored, method=at.strategy.aggregation, top_k=at.strategy.top_k), f"{base}/image_scores")
        chosen = S.select_images(images, budget)
    selected = _written(chosen.select("image_id"), f"{base}/selected")
    disjoint(selected, labelled, "selected and labelled images")
    after = _written(labelled.select("image_id").unionByName(selected), f"{base}/labelled")
    if after.count() != labelled.count() + budget:
        raise InvariantError("the labelled images did not grow by the budget")
    trained = detector.train(after, checkpoint, seed=at.seed)
    metrics = {k: float(v) for k, v in detector.evaluate(trained).items()}
    row = spark.createDataFrame([(at.seed, f"{at.strategy.version}:{at.strategy.name}", at.number, trained, metrics)], "seed long, strategy string, round long, checkpoint string, metrics map<string,double>")
    row.write.mode("overwrite").parquet(f"{base}/metrics")  # last: its _SUCCESS marks the round as finished
    return after, trained


def run_campaign(spark: SparkSession, settings: Campaign, detector: Detector, *, candidates: DataFrame, reference: DataFrame, evaluation: DataFrame | None = None, checkpoint: str = "", resume: bool = False) -> DataFrame:
    """(seed, strategy, round, checkpoint, metrics) of every round; all strategies of a seed start from the same images."""
    disjoint(candidates, reference, "candidate and reference images")
    if evaluation is not None:
        disjoint(candidates, evaluation, "candidate and evaluation images")
        disjoint(reference, evaluation, "reference and evaluation images")
    paths = []
    for seed in settings.rounds.seeds:
        first = _written(initial_labelled(candidates, settings.rounds.initial_images, seed), f"{settings.output.rstrip('/')}/seed={seed}/initial")
        for strategy in settings.acquisition.resolved():
            labelled, model = first, checkpoint
            for number in range(1, settings.rounds.rounds + 1):
                at = Round(seed, strategy, number)
                labelled, model = run_round(spark, settings, detector, at, candidates=candidates, reference=reference, labelled=labelled, checkpoint=model, resume=resume)
                paths.append(f"{at.folder(settings.output)}/metrics")
    return spark.read.parquet(*paths)


def metric_table(rounds: DataFrame) -> DataFrame:
    """(seed, strategy, round, metric, value), one row a metric."""
    return rounds.select("seed", "strategy", "round", F.explode("metrics").alias("metric", "value"))
