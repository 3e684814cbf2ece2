"""Parquet tables, registries behind JDBC, and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import recording_root


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def registry(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A registry table behind JDBC; filters and columns are pushed down to the database."""
    return spark.read.jdbc(url, name, properties=options)


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, modified) of all files below ``root``; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))


EPISODES = "path string, total_frames int, fps double, task_name string, embodiment string, feature_keys array<string>"


def episode_metadata(spark: SparkSession, root: str, name: str = "zarr.json") -> DataFrame:
    """EPISODES from the attributes of each recording, in order of their paths; a missing root has none."""
    from gleaner.sources.files import _file_system

    target, fs = _file_system(spark, root)
    if not fs.exists(target):
        return spark.createDataFrame([], EPISODES)
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    v = F.try_parse_json("value")
    get = lambda key, kind: F.try_variant_get(v, f"$.attributes.{key}", kind)
    keys = F.array_sort(F.map_keys(get("features", "map<string, variant>")))
    return raw.select(
        F.coalesce(recording_root(F.col("_metadata.file_path")), F.regexp_replace("_metadata.file_path", r"/[^/]+$", "")).alias("path"),
        get("total_frames", "int").alias("total_frames"),
        get("fps", "double").alias("fps"),
        get("task_name", "string").alias("task_name"),
        get("embodiment", "string").alias("embodiment"),
        F.coalesce(keys, F.array().cast("array<string>")).alias("feature_keys"),
    ).orderBy(F.split("path", "/"))
