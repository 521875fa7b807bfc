"""Job: build features, fit the acceptance model, and write model and evaluation tables.

    python -m cabinlift.plans.train_model --input IN --output OUT [--iterations N ...]

Everything of a run goes to ``OUT/runs/ID``; ``OUT/manifest`` lists the finished
runs with their parameters and metrics. The same run is not made twice.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabinlift.operators import evaluate, learn
from cabinlift.session import build_session
from cabinlift.sources import runs, tables
from cabinlift.sources.shared import scratch, written

TEST_FROM = "2025-05-01"


def evaluation_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """Every report over the scored test rows; the curves share one table."""
    counts = written(evaluate.running_counts(scored), "runs")
    return {
        "metrics": evaluate.threshold_metrics(scored),
        "confusion": evaluate.confusion(scored),
        "roc_points": evaluate.roc_points_of(counts),
        "roc_auc": evaluate.roc_auc_of(counts),
        "pr_points": evaluate.pr_points_of(counts),
        "average_precision": evaluate.average_precision_of(counts),
        "score_histogram": evaluate.score_histogram(scored),
    }


def run(
    spark: SparkSession, source: str, output: str, params: learn.Params, test_from: str = TEST_FROM
) -> str:
    """The id of the run, which is made only if it is not there yet."""
    began, clock = datetime.now(timezone.utc), time.monotonic()
    with scratch(spark):
        offers = tables.read_training_input(spark, source)
        run = runs.run_id(asdict(params) | {"test_from": test_from}, offers)
        if runs.is_committed(spark, output, run):
            return run
        place = runs.run_path(output, run)
        table = written(learn.training_table(offers, test_from, keep=[]), "features")
        fitted = learn.fit(table, params)
        fitted.model.write().overwrite().save(f"{place}/model")
        scored = written(learn.score(fitted.model, table.filter(F.col("split") == "test")), "scored")
        reports = evaluation_tables(scored) | {
            "importances": learn.importance_table(fitted.model, spark),
            "change_importances": learn.change_importance_table(fitted.model, table.filter(F.col("split") == "train")),
            "loss_curve": learn.loss_curve(fitted.full, table),
            "auc_curve": fitted.curve,
        }
        for name, report in reports.items():
            tables.write_parquet(report, f"{place}/{name}")
        about: dict = {"started_at": began, "test_from": test_from, "best_iteration": fitted.best_iteration}
        about |= learn.run_summary(table, params).first().asDict()
        for name in ("metrics", "roc_auc", "average_precision"):
            about |= spark.read.parquet(f"{place}/{name}").first().asDict()
        # A metric without a value is left out; readers see null.
        about = {name: value for name, value in about.items() if value is not None}
        runs.commit(spark, output, run, about | {"seconds": time.monotonic() - clock})
    return run


def load_model(output: str, run: str) -> PipelineModel:
    """The model of a run, which scores plain offers."""
    return PipelineModel.load(f"{runs.run_path(output, run)}/model")


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--input", required=True)
    options.add_argument("--output", required=True)
    options.add_argument("--test_from", default=TEST_FROM)
    for name in ("iterations", "depth", "learning_rate", "max_bins", "seed", "target_encoded"):
        options.add_argument(f"--{name}")
    chosen = vars(options.parse_args())
    spark = build_session("acceptance-model")
    print(run(spark, chosen["input"], chosen["output"], learn.parse_params(chosen), chosen["test_from"]))
    spark.stop()


if __name__ == "__main__":
    main()
