"""A folder of runs, each of which is there as a whole or not at all.

    FOLDER/runs/ID/...        tables and model of a run
    FOLDER/manifest/run_id=ID one row, written when all of it is there

A run is named by a hash of its settings and of its input rows. Whoever repeats
a run finds it; a run that broke off has no manifest, and the next attempt
writes over what it left. Runs never share a folder, so they may go on side by
side.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_digest(df: DataFrame) -> list[int]:
    """Number of rows and two sums of their hashes, whatever their order; one pass, three numbers."""
    hashed = F.xxhash64(*[F.col(f"`{name}`") for name in sorted(df.columns)])
    row = df.select(hashed.alias("h")).agg(
        F.count("*"), F.sum(F.shiftrightunsigned("h", 32)), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF))).first()
    return [int(value or 0) for value in row]


def run_id(settings: dict[str, Any], *inputs: DataFrame) -> str:
    """The same for the same settings and rows, in any session."""
    content = json.dumps([settings, [[sorted(df.columns), input_digest(df)] for df in inputs]], sort_keys=True)
    return "r" + hashlib.sha256(content.encode()).hexdigest()[:24]


def run_path(folder: str, run: str) -> str:
    """Where the tables of a run go before and after it is committed."""
    return f"{folder}/runs/{run}"


def committed(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row per committed run; None before the first one."""
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{folder}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def is_committed(spark: SparkSession, folder: str, run: str) -> bool:
    runs = committed(spark, folder)
    return runs is not None and not runs.filter(F.col("run_id") == run).isEmpty()


def commit(spark: SparkSession, folder: str, run: str, row: dict[str, Any]) -> None:
    """Make a run visible, with ``row`` as what is known about it.

    The one file appears when the write is finished, never in part; repeating
    the commit replaces it.
    """
    about = spark.createDataFrame([tuple(row.values())], list(row))
    about.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/run_id={run}")
