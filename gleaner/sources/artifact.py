"""Results artifacts: one JSON object with the sections summary, segments, coverage_curve and actions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artifact_path(path: str | None = None, variable: str = "RESULTS_PATH", default: str = "results.json", base: str = ".") -> str:
    """The argument, else the environment's, else the default; ``~`` is expanded and relative paths start at ``base``."""
    found = Path(path or os.environ.get(variable) or default).expanduser()
    return str(found if found.is_absolute() else Path(base) / found)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(doc, source_error): one row; doc is the object as VARIANT, NULL with a reason where it can't be had.

    Bare NaN and Infinity, which some writers emit, count as null.
    """
    try:
        raw = spark.read.text(path, wholetext=True)
        bare = F.regexp_replace("value", r"(?<=[:\[,\s])-?(NaN|Infinity)(?=\s*[,}\]])", "null")
        parsed = raw.select(F.try_parse_json(bare).alias("v"))
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        return parsed.select(
            F.when(is_object, F.col("v")).alias("doc"),
            F.when(F.col("v").isNull(), "not valid JSON").when(~is_object, "the top level is not an object").alias("source_error"),
        )
    except Exception as e:  # a missing or unreadable file is an empty artifact with a reason
        reason = str(e).splitlines()[0]
        return spark.range(1).select(F.try_parse_json(F.lit(None).cast("string")).alias("doc"), F.lit(reason).alias("source_error"))
