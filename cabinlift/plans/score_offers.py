"""Job: score plain offers with the model of a run.

    python -m cabinlift.plans.score_offers --model OUT/runs/ID/model --input OFFERS --output SCORES

Offers need the training columns but not the state; auctions should be whole,
because the model's group statistics are taken over the given table.
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from cabinlift import schema as S
from cabinlift.operators import learn
from cabinlift.session import build_session
from cabinlift.sources import tables
from cabinlift.sources.shared import scratch


def run(spark: SparkSession, model: str, source: str, output: str) -> None:
    with scratch(spark):
        offers = tables.read_table(spark, source, S.struct(S.TRAINING_INPUT_TYPES))
        tables.write_parquet(learn.score_offers(PipelineModel.load(model), offers), output)


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    for name in ("model", "input", "output"):
        options.add_argument(f"--{name}", required=True)
    chosen = options.parse_args()
    spark = build_session("score-offers")
    run(spark, chosen.model, chosen.input, chosen.output)
    spark.stop()


if __name__ == "__main__":
    main()
