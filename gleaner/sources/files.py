"""Small files through Spark's file systems, recordings and their arrays, and sources by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import recording_root

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, source: Callable[..., DataFrame]) -> None:
    """Makes ``source(spark, **options)`` known by name, so that a caller can bring a source of their own."""
    _SOURCES[name] = source


def source(spark: SparkSession, name: str, **options) -> DataFrame:
    """The registered source ``name``, else the format of that name; RuntimeError with those known if there is neither."""
    if name in _SOURCES:
        return _SOURCES[name](spark, **options)
    try:
        return spark.read.format(name).options(**options).load()
    except Exception as e:
        raise RuntimeError(f"no source {name!r}; registered are: {', '.join(sorted(_SOURCES)) or 'none'}") from e


def object_store(spark: SparkSession, endpoint: str, key: str, secret: str) -> None:
    """Object-store access for s3a paths of this session, by an endpoint and a pair of credentials."""
    conf = spark._jsc.hadoopConfiguration()
    for name, value in (("endpoint", endpoint), ("access.key", key), ("secret.key", secret), ("path.style.access", "true")):
        conf.set(f"fs.s3a.{name}", value)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, complete or not there: written beside its place and renamed."""
    target, fs = _file_system(spark, path)
    partial, _ = _file_system(spark, path + ".partial")
    out = fs.create(partial, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(partial, target):
        raise OSError(f"could not rename to {path}")
    spark.catalog.refreshByPath(path)


def write_json(one: DataFrame, path: str) -> None:
    """The only row of ``one`` as an indented JSON document."""
    text = one.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    write_text(one.sparkSession, path, json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(v) The document at ``path`` as VARIANT; no row where there is no such file."""
    target, fs = _file_system(spark, path)
    if not fs.exists(target):
        return spark.range(0).select(F.try_parse_json(F.lit(None).cast("string")).alias("v"))
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))


def zarr_array(spark: SparkSession, root: str, array: str) -> DataFrame:
    """(episode, frame, data): the byte strings of a one-dimensional array of every recording below ``root``.

    Chunks are files that Spark reads and deals out; metadata, one small file for each recording, name the chunk's length
    and its codecs: vlen-bytes, then gzip or zstd if any. Frames past the array's length are padding and left out.
    KeyError where a recording lacks the array.
    """
    file = F.col("_metadata.file_path")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "zarr.json").text(root, wholetext=True).select(file.alias("file"), F.try_parse_json("value").alias("v"))
    own = raw.where(F.endswith("file", F.lit(f"/{array}/zarr.json"))).select(
        F.regexp_replace("file", r"/zarr\.json$", "").alias("base"),
        F.try_variant_get("v", "$.shape[0]", "long").alias("n"),
        F.try_variant_get("v", "$.chunk_grid.configuration.chunk_shape[0]", "long").alias("size"),
        F.transform(F.try_variant_get("v", "$.codecs", "array<variant>"), lambda c: F.try_variant_get(c, "$.name", "string")).alias("codecs"),
    )
    groups = raw.where(~F.endswith("file", F.lit(f"/{array}/zarr.json")) & (F.try_variant_get("v", "$.node_type", "string") == "group")).select(F.concat(F.regexp_replace("file", r"zarr\.json$", ""), F.lit(array)).alias("base"))
    lacking = groups.join(own, "base", "left_anti").limit(1).collect()
    if lacking:
        raise KeyError(f"{lacking[0][0]} is not there")
    path = F.col("path")
    chunks = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    chunks = chunks.where(F.contains(path, F.lit(f"/{array}/c/"))).select(F.regexp_extract(path, rf"^(.*/\Q{array}\E)/c/(\d+)$", 1).alias("base"), F.regexp_extract(path, r"/(\d+)$", 1).cast("long").alias("chunk"), "content")
    met = chunks.withColumn("base", F.regexp_replace("base", r"^file:/+", "/")).join(own.withColumn("base", F.regexp_replace("base", r"^file:/+", "/")), "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for row in batch.to_pylist():
                data = row["content"]
                for codec in reversed(row["codecs"]):
                    if codec == "gzip":
                        data = gzip.decompress(data)
                    elif codec == "zstd":
                        import zstandard

                        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                    elif codec not in ("vlen-bytes", "bytes"):
                        raise ValueError(f"unknown codec {codec}")
                count, at, frames = int.from_bytes(data[:4], "little"), 4, []
                for _ in range(count):
                    n = int.from_bytes(data[at : at + 4], "little")
                    frames.append(data[at + 4 : at + 4 + n])
                    at += 4 + n
                first = row["chunk"] * row["size"]
                frames = frames[: max(0, row["n"] - first)]
                yield pa.RecordBatch.from_arrays([pa.array([row["base"]] * len(frames), pa.string()), pa.array(range(first, first + len(frames)), pa.int64()), pa.array(frames, pa.binary())], names=["base", "frame", "data"])

    out = met.mapInArrow(run, "base string, frame long, data binary")
    return out.select(F.coalesce(recording_root("base"), F.regexp_replace("base", rf"/\Q{array}\E$", "")).alias("episode"), "frame", "data")
