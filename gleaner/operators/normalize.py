"""From a loosely typed artifact to typed relations: segments, summary, coverage curve and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.coerce import clamp, json_boolean, json_integer, json_number, json_text


def _items(doc: Column, section: str) -> Column:
    """The section's array of variants; anything else counts as empty."""
    return F.coalesce(F.try_variant_get(doc, f"$.{section}", "array<variant>"), F.array().cast("array<variant>"))


def _value(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def segments(artifact: DataFrame, *carried: str) -> DataFrame:
    """One row for each entry, also for entries of another type; ids default to the entry's place. ``carried`` columns of the artifact stay."""
    raw = artifact.select(*carried, F.posexplode(_items(F.col("doc"), "segments")).alias("pos", "v"))
    start = clamp(json_number(_value(F.col("v"), "start")), 0)
    raw = raw.select(*carried, "pos", "v", start.alias("start"))
    end = F.greatest("start", json_number(_value(F.col("v"), "end"), F.col("start")))

    def neighbour(n: Column) -> Column:
        return F.struct(
            json_text(_value(n, "segment_id"), json_text(_value(n, "id"), F.lit(None))).alias("segment_id"),
            clamp(json_number(_value(n, "similarity")), 0, 1).alias("similarity"),
            json_text(_value(n, "explanation"), "").alias("explanation"),
        )

    near = F.filter(F.transform(_items(F.col("v"), "neighbors"), neighbour), lambda n: n["segment_id"].isNotNull())
    episode = json_text(_value(F.col("v"), "episode_id"), "unknown_episode")
    return raw.select(
        *carried,
        "pos",
        json_text(_value(F.col("v"), "id"), F.format_string("segment_%03d", F.col("pos") + 1)).alias("id"),
        episode.alias("episode_id"),
        json_text(_value(F.col("v"), "video_id"), episode).alias("video_id"),
        F.lower(json_text(_value(F.col("v"), "verb"), "unlabeled")).alias("verb"),
        "start",
        end.alias("end"),
        json_text(_value(F.col("v"), "clip_path"), "").alias("clip_path"),
        json_text(_value(F.col("v"), "cluster"), "unclustered").alias("cluster"),
        clamp(json_number(_value(F.col("v"), "distinctiveness_percentile")), 0, 100).alias("distinctiveness_percentile"),
        json_boolean(_value(F.col("v"), "keep")).alias("keep"),
        near.alias("neighbors"),
    )


def summary(artifact: DataFrame, segs: DataFrame) -> DataFrame:
    """One row; stated values go before those derived from the segments."""
    length = F.col("end") - F.col("start")
    derived = segs.agg(
        F.countDistinct("episode_id").alias("_episodes"),
        F.count("*").alias("_segments"),
        F.coalesce(F.sum(length) / 3600, F.lit(0.0)).alias("_hours"),
        F.coalesce(F.sum(F.when(F.col("keep"), length)) / 3600, F.lit(0.0)).alias("_kept"),
    )
    one = derived.crossJoin(artifact.select(F.try_variant_get("doc", "$.summary", "variant").alias("s")))  # one row each
    get = lambda key, fallback: json_number(_value(F.col("s"), key), fallback)
    one = one.select("*", get("original_hours", F.col("_hours")).alias("original_hours"), get("selected_hours", F.col("_kept")).alias("selected_hours"))
    reduction = F.when(F.col("original_hours") > 0, clamp((1 - F.col("selected_hours") / F.col("original_hours")) * 100, 0, 100)).otherwise(0.0)
    return one.select(
        F.coalesce(F.nullif(json_integer(_value(F.col("s"), "total_videos"), -1), F.lit(-1)), "_episodes").alias("total_videos"),
        F.coalesce(F.nullif(json_integer(_value(F.col("s"), "total_segments"), -1), F.lit(-1)), "_segments").alias("total_segments"),
        "original_hours",
        "selected_hours",
        get("data_reduction_percent", reduction).alias("data_reduction_percent"),
        *[get(k, F.lit(0.0)).alias(k) for k in ("coverage_retained", "composition_diversity", "execution_diversity")],
    )


def coverage_curve(artifact: DataFrame, original_hours: float) -> DataFrame:
    """Hours and percent fill each other where one is zero. In order of (retained_hours, pos): a curve is a report."""
    raw = artifact.select(F.posexplode(_items(F.col("doc"), "coverage_curve")).alias("pos", "v"))
    hours, percent = json_number(_value(F.col("v"), "retained_hours")), json_number(_value(F.col("v"), "retained_percent"))
    if original_hours > 0:
        hours = F.when((hours == 0) & (percent != 0), percent / 100 * original_hours).otherwise(hours)
        percent = F.when(percent == 0, hours / original_hours * 100).otherwise(percent)
    return raw.select(
        "pos",
        hours.alias("retained_hours"),
        clamp(percent, 0, 100).alias("retained_percent"),
        *[clamp(json_number(_value(F.col("v"), k)), 0, 100).alias(k) for k in ("diversity_coverage", "random_coverage")],
    ).orderBy("retained_hours", "pos")


def actions(artifact: DataFrame, segs: DataFrame) -> DataFrame:
    """Stated rows, or counts by verb where none are stated."""
    raw = artifact.select(F.explode(_items(F.col("doc"), "actions")).alias("v"))
    count = lambda a, b: clamp(json_number(_value(F.col("v"), a), json_number(_value(F.col("v"), b))), 0)
    verb = F.lower(json_text(_value(F.col("v"), "verb"), json_text(_value(F.col("v"), "action"), "unlabeled")))
    stated = raw.select(verb.alias("verb"), count("before", "before_count").alias("before"), count("after", "after_count").alias("after"))
    none = artifact.where(F.size(_items(F.col("doc"), "actions")) == 0).select(F.lit(1).alias("none"))
    derived = composition(segs).join(F.broadcast(none), F.lit(True), "left_semi")  # one row at most
    return stated.unionByName(derived)


def composition(segs: DataFrame) -> DataFrame:
    return segs.groupBy("verb").agg(F.count("*").cast("double").alias("before"), F.count_if("keep").cast("double").alias("after"))
