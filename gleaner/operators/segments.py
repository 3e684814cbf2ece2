"""Cutting recordings: fixed frame windows, runs of one action, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames_per_window(fps: Column, seconds: float) -> Column:
    """At least one; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(fps * seconds).cast("int"))


def frame_windows(episodes: DataFrame, seconds: float = 1.0) -> DataFrame:
    """(episode, total_frames, fps) to one row for each window of the frames; the last may be short, no frames give no row."""
    n = frames_per_window(F.col("fps"), seconds)
    starts = F.when(F.col("total_frames") > 0, F.sequence(F.lit(0), F.col("total_frames").cast("int") - 1, n)).otherwise(F.array().cast("array<int>"))
    each = episodes.select("episode", "fps", F.col("total_frames").cast("int").alias("total_frames"), n.alias("n"), F.posexplode(starts).alias("i", "start_frame"))
    end = F.least(F.col("start_frame") + F.col("n"), "total_frames")
    return each.select(
        "episode",
        F.format_string("%06d.mp4", "i").alias("file"),
        "start_frame",
        end.alias("end_frame_exclusive"),
        (F.col("start_frame") / F.col("fps")).alias("start_seconds"),
        ((end - F.col("start_frame")) / F.col("fps")).alias("duration_seconds"),
    )


def islands(segs: DataFrame, min_seconds: float = 0.5, order: str = "pos") -> DataFrame:
    """Runs of one verb within an episode become one cycle; cycles under ``min_seconds`` go."""
    w = Window.partitionBy("episode_id").orderBy("start", order)
    changed = segs.withColumn("_new", F.coalesce((F.col("verb") != F.lag("verb").over(w)).cast("int"), F.lit(1)))
    numbered = changed.withColumn("island", F.sum("_new").over(w))
    cycles = numbered.groupBy("episode_id", "island").agg(
        F.min("verb").alias("verb"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_segments")
    )
    return cycles.where(F.col("end") - F.col("start") >= min_seconds)


def resampled(points: DataFrame, key: str, at: str, value: str, n: int = 30) -> DataFrame:
    """``n`` evenly spaced values of each series, linear between its points; the span of a series must be positive."""
    w = Window.partitionBy(key).orderBy(at)
    pairs = points.select(
        key,
        F.col(at).alias("t0"),
        F.col(value).alias("y0"),
        F.lead(at).over(w).alias("t1"),
        F.lead(value).over(w).alias("y1"),
        F.min(at).over(Window.partitionBy(key)).alias("lo"),
        F.max(at).over(Window.partitionBy(key)).alias("hi"),
    ).where("t1 > t0")
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    # Grid points in [t0, t1), and the end for the last pair; each pair makes its own.
    grid = pairs.withColumn("step", step).withColumn(
        "i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((F.col("lo") + i * F.col("step") >= F.col("t0")) & (F.col("lo") + i * F.col("step") < F.col("t1")) & (i < n - 1)) | ((i == n - 1) & (F.col("t1") == F.col("hi")))))
    )
    t = F.when(F.col("i") == n - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * F.col("step"))
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * (t - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return grid.select(key, "i", t.alias("t"), y.alias("y"))


def interpolated(points: DataFrame, curve: DataFrame, x: str, y: str, at: str) -> DataFrame:
    """``points`` with the value at ``at`` of the piecewise linear curve(x, y): 0 if it is empty, and
    its first and last value beyond its ends. The curve is a report of bounded size."""
    w = Window.orderBy(x)
    knots = curve.groupBy(x).agg(F.first(y).alias(y)).select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"))
    ends = curve.agg(F.min_by(y, x).alias("_first"), F.min(x).alias("_lo"), F.max_by(y, x).alias("_last"))
    inside = points.join(F.broadcast(knots), (F.col(at) > F.col("_x")) & (F.col(at) <= F.col("_x1")), "left").crossJoin(F.broadcast(ends))
    line = F.col("_y") + (F.col("_y1") - F.col("_y")) * (F.col(at) - F.col("_x")) / (F.col("_x1") - F.col("_x"))
    value = F.coalesce(line, F.when(F.col(at) <= F.col("_lo"), F.col("_first")), F.col("_last"), F.lit(0.0))
    return inside.select(*points.columns, value.alias(y))
