"""Reports on listings, ingestion and inspection, and manifests of cut recordings.

A listing has (path, length); recordings are folders whose name ends with ``.zarr``, or any folder that holds metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.paths import extension, recording_root, relative
from gleaner.operators.segments import frame_windows, frames_per_window


def files_only(listing: DataFrame, exclude: str | None = None) -> DataFrame:
    """Without markers of folders, and without paths that match the glob ``exclude``."""
    kept = listing.where(~F.endswith("path", F.lit("/")))
    if exclude:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in exclude)
        kept = kept.where(~F.col("path").rlike(f"^{pattern}$"))
    return kept


def by_parts(path: Column) -> Column:
    """A sort key by which paths go part by part, so that a folder's files follow it."""
    return F.split(path, "/")


def first_roots(listing: DataFrame, most: int, prefix: str = "") -> DataFrame:
    """(root): the first ``most`` recordings in listing order."""
    named = listing.where(F.startswith("path", F.lit(prefix))).select(recording_root(relative(F.col("path"), prefix)).alias("root"), "path")
    return named.where("root is not null").groupBy("root").agg(F.min("path").alias("first")).orderBy("first").limit(most).select("root")


def ingestion_report(listing: DataFrame, most: int, prefix: str = "") -> DataFrame:
    """(episode, files, bytes, complete) of the first ``most`` recordings below ``prefix``, and their total with a null
    episode. Complete are those with metadata."""
    if most < 1:
        raise ValueError("most must be 1 or more")
    inside = files_only(listing).where(F.startswith("path", F.lit(prefix)))
    rel = relative(F.col("path"), prefix)
    own = inside.select(recording_root(rel).alias("root"), rel.alias("rel"), "length")
    own = own.join(first_roots(listing, most, prefix), "root")
    meta = F.max((F.col("rel") == F.concat(F.col("root"), F.lit("/zarr.json"))).cast("int"))
    each = own.groupBy("root").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), (meta == 1).alias("complete"))
    return each.rollup("root").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.every("complete").alias("complete")).withColumnRenamed("root", "episode")


def complete(report: DataFrame) -> DataFrame:
    """``report``; RuntimeError if a recording lacks its metadata, or if there is none."""
    rows = report.where("episode is not null")
    if rows.isEmpty():
        raise RuntimeError("no recordings there")
    lacking = rows.where("not complete").orderBy("episode").limit(1).collect()
    if lacking:
        raise RuntimeError(f"incomplete recording: {lacking[0]['episode']} lacks its metadata")
    return report


def episode_folders(listing: DataFrame, root: str = "", name: str = "zarr.json") -> DataFrame:
    """(episode): folders right below ``root`` that hold metadata, in order."""
    rel = relative(F.col("path"), root)
    found = listing.where(F.startswith("path", F.lit(root))).select(F.regexp_extract(rel, rf"^([^/]+)/\Q{name}\E$", 1).alias("episode"))
    return found.where("episode <> ''").distinct().orderBy("episode")


def inspection(listing: DataFrame, root: str = "", samples: int = 10) -> DataFrame:
    """One row: (episode_count, file_count, total_bytes, total_gib, extensions, sample_episodes, sample_files); extensions
    by falling count, samples in order of their parts."""
    rows = files_only(listing)
    total = rows.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
    total = total.withColumn("total_gib", F.bround(F.col("total_bytes") / (1 << 30), 3))
    kinds = rows.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))
    kinds = kinds.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "extension"))), lambda e: F.struct(e["extension"].alias("extension"), (-e["m"]).alias("files"))).alias("extensions"))
    episodes = episode_folders(listing, root)
    first = episodes.limit(samples).agg(F.array_sort(F.collect_list("episode")).alias("sample_episodes"))
    count = episodes.agg(F.count("*").alias("episode_count"))
    rel = relative(F.col("path"), root)
    some = rows.select(rel.alias("rel")).orderBy(by_parts(F.col("rel"))).limit(samples)
    some = some.agg(F.transform(F.array_sort(F.collect_list(F.struct(by_parts(F.col("rel")).alias("k"), "rel"))), lambda e: e["rel"]).alias("sample_files"))
    out = total
    for one in (kinds, first, count, some):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out.select("episode_count", "file_count", "total_bytes", "total_gib", "extensions", "sample_episodes", "sample_files")


def probe(contents: DataFrame, preview: int = 160, first: int = 16) -> DataFrame:
    """(episode, metadata_path, metadata_preview, chunk_path, chunk_size_bytes, first_bytes_hex) of the first recording of
    ``contents`` (path, length, content): a look at its metadata and at its first chunk."""
    folder = F.regexp_extract("path", r"^(.*)/zarr\.json$", 1)
    meta = contents.where(F.endswith("path", F.lit("/zarr.json"))).select(folder.alias("folder"), F.col("path").alias("metadata_path"), F.substring(F.decode("content", "UTF-8"), 1, preview).alias("metadata_preview"))
    meta = meta.orderBy(F.size(F.split("folder", "/")), "folder").limit(1)
    chunk = F.array_contains(F.split(F.col("path"), "/"), F.lit("c"))
    chunks = contents.where(chunk).select(F.col("path").alias("chunk_path"), F.col("length").alias("chunk_size_bytes"), F.lower(F.hex(F.substring("content", 1, first))).alias("first_bytes_hex"))
    met = F.broadcast(meta).join(chunks, F.startswith("chunk_path", F.concat("folder", F.lit("/"))))  # one row
    return met.orderBy(by_parts(F.col("chunk_path"))).limit(1).select(F.element_at(F.split("folder", "/"), -1).alias("episode"), "metadata_path", "metadata_preview", "chunk_path", "chunk_size_bytes", "first_bytes_hex")


def segmentation_manifest(episodes: DataFrame, seconds: float = 1.0, camera: str = "images.front_1") -> DataFrame:
    """(episode, camera_key, fps, total_frames, frames_per_segment, requested_segment_seconds, segment_count, segments) of
    (episode, fps, total_frames); segments in order."""
    parts = F.array_sort(F.collect_list(F.struct("start_frame", "file", "end_frame_exclusive", "start_seconds", "duration_seconds")))
    segments = F.transform(parts, lambda p: F.struct(p["file"].alias("file"), p["start_frame"].alias("start_frame"), p["end_frame_exclusive"].alias("end_frame_exclusive"), p["start_seconds"].alias("start_seconds"), p["duration_seconds"].alias("duration_seconds")))
    cut = frame_windows(episodes, seconds).groupBy("episode").agg(segments.alias("segments"))
    n = frames_per_window(F.col("fps"), seconds)
    none = F.array().cast("array<struct<file: string, start_frame: int, end_frame_exclusive: int, start_seconds: double, duration_seconds: double>>")
    return episodes.join(cut, "episode", "left").select(
        "episode",
        F.lit(camera).alias("camera_key"),
        "fps",
        F.col("total_frames").cast("int").alias("total_frames"),
        n.alias("frames_per_segment"),
        F.lit(float(seconds)).alias("requested_segment_seconds"),
        F.ceil(F.greatest(F.lit(0), F.col("total_frames")) / n).cast("int").alias("segment_count"),
        F.coalesce("segments", none).alias("segments"),
    )


def resume_state(wanted: DataFrame, previous: DataFrame, existing: DataFrame) -> DataFrame:
    """(episode, segment_count, status): already_complete where the ``previous`` manifest has the wanted count, camera,
    seconds and frame rate, and every wanted file is among the ``existing`` (episode, file, length) and not empty; else to
    be created. Files that are not wanted don't matter."""
    names = ("segment_count", "camera_key", "requested_segment_seconds", "fps")
    before = previous.select("episode", F.struct(*names).alias("before"))
    found = existing.where("length > 0").select("episode", "file").distinct().withColumn("there", F.lit(1))
    files = wanted.select("episode", F.explode(F.col("segments.file")).alias("file")).join(found, ["episode", "file"], "left")
    there = files.groupBy("episode").agg(F.count("there").alias("n_there"))
    both = wanted.join(before, "episode", "left").join(there, "episode", "left")
    same = F.coalesce(F.struct(*names) == F.col("before"), F.lit(False)) & (F.coalesce("n_there", F.lit(0)) == F.col("segment_count"))
    return both.select("episode", "segment_count", F.when(same, "already_complete").otherwise("created").alias("status"))


def synced(files: DataFrame, keep: Column, skip: str | None = "*images*") -> DataFrame:
    """What a bulk sync copies: files of the recordings that ``keep`` selects, without those that match ``skip``."""
    return files_only(files.where(keep), skip)


def last_lines(log: DataFrame, most: int = 80) -> DataFrame:
    """(pos, value): the last lines of a log (pos, value), in order; what an error report shows."""
    return log.orderBy(F.desc("pos")).limit(most).orderBy("pos")


def ranked_paths(listing: DataFrame) -> DataFrame:
    """``listing`` with ``place`` in order of path parts; a listing of a recording is bounded, and each is ranked by itself."""
    w = Window.partitionBy(recording_root(F.col("path"))).orderBy(by_parts(F.col("path")))
    return listing.withColumn("place", F.row_number().over(w))
