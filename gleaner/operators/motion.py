"""Segments by tracking and by fused signals, and features of how hands move.

Tables: tracking (episode_id, frame, hand, valid); points (series, t, hand, p), p a position; signals by (episode_id, frame).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.pose import distance, in_head_frame, turn
from gleaner.functions.vectors import minus

#: Joints at the tips of the five fingers.
FINGERTIPS = (4, 8, 12, 16, 20)


def tracked_share(segs: DataFrame, tracking: DataFrame, fps: float = 30.0) -> DataFrame:
    """``segs`` with ``tracking_valid_frac``, the share of valid rows of tracking within [start, end); null without any.
    Segments and frames meet by episode and second, so that no episode's frames meet all its segments."""
    second = F.floor(F.col("frame") / fps)
    frames = tracking.select("episode_id", second.alias("second"), (F.col("frame") / fps).alias("t"), "valid")
    spread = segs.select("episode_id", "id", "start", "end", F.explode(F.sequence(F.floor("start"), F.floor("end"))).alias("second"))
    met = spread.join(frames, ["episode_id", "second"]).where("t >= start and t < end")
    share = met.groupBy("episode_id", "id").agg(F.avg(F.col("valid").cast("int")).alias("tracking_valid_frac"))
    return segs.join(share, ["episode_id", "id"], "left")


def well_tracked(segs: DataFrame, tracking: DataFrame, least: float = 0.7, fps: float = 30.0) -> DataFrame:
    return tracked_share(segs, tracking, fps).where(F.col("tracking_valid_frac") >= least)


def relevant(frames: DataFrame, label: str = "label", wanted: str = "TASK") -> DataFrame:
    """Frames that a classifier, whose answer is a column, has given the wanted label."""
    return frames.where(F.col(label) == wanted)


def labelled(frames: DataFrame, classify, schema: str = "episode_id string, frame long, label string") -> DataFrame:
    """Frames with the labels of ``classify``, which gets an iterator of pandas frames: a model is loaded once a task."""
    return frames.mapInPandas(classify, schema)


def attempts(signals: list[DataFrame], reach: int = 2, least: float = 0.5) -> DataFrame:
    """(episode_id, start_frame, end_frame, n): contiguous runs of frames whose signals (episode_id, frame, s), averaged over
    those that are there and over ``reach`` frames on either side, are at least ``least``."""
    named = [x.select("episode_id", "frame", F.col("s").alias(f"s{k}")) for k, x in enumerate(signals)]
    both = reduce(lambda a, b: a.join(b, ["episode_id", "frame"], "full_outer"), named)
    parts = [F.col(f"s{k}") for k in range(len(signals))]
    there = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    fused = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]) / there
    w = Window.partitionBy("episode_id").orderBy("frame")
    smooth = both.select("episode_id", "frame", F.avg(fused).over(w.rowsBetween(-reach, reach)).alias("s"))
    active = smooth.where(F.col("s") >= least).withColumn("run", F.col("frame") - F.row_number().over(w))
    return active.groupBy("episode_id", "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n")).drop("run")


def cycles(segs: DataFrame, verb: str = "fold") -> DataFrame:
    """(episode_id, cycles): how many segments of an episode have the verb."""
    return segs.groupBy("episode_id").agg(F.count_if(F.col("verb") == verb).alias("cycles"))


def _steps(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("series", "hand").orderBy("t")
    return points.select("*", distance(F.col("p"), F.lag("p").over(w)).alias("step"), (F.col("t") - F.lag("t").over(w)).alias("dt"))


def dynamics(points: DataFrame, still: float = 0.01) -> DataFrame:
    """(series, hand, duration, path_length, velocity, pauses): pauses are steps slower than ``still``. With an orientation
    ``q`` also turned, the sum of angles, and angular_velocity."""
    steps = _steps(points)
    aggs = [(F.max("t") - F.min("t")).alias("duration"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"), F.count_if(F.try_divide("step", "dt") < still).alias("pauses")]
    if "q" in points.columns:
        w = Window.partitionBy("series", "hand").orderBy("t")
        steps = steps.withColumn("angle", turn(F.col("q"), F.lag("q").over(w)))
        aggs.append(F.coalesce(F.sum("angle"), F.lit(0.0)).alias("turned"))
    out = steps.groupBy("series", "hand").agg(*aggs).withColumn("velocity", F.coalesce(F.try_divide("path_length", "duration"), F.lit(0.0)))
    return out.withColumn("angular_velocity", F.coalesce(F.try_divide("turned", "duration"), F.lit(0.0))) if "q" in points.columns else out


def activity_counts(steps: DataFrame, moving: float) -> DataFrame:
    """(series, left, right, both, idle) from steps (series, t, hand, step, dt)."""
    speed = steps.select("series", "t", "hand", F.coalesce(F.try_divide("step", "dt") > moving, F.lit(False)).alias("m"))
    at = speed.groupBy("series", "t").agg(F.bool_or((F.col("hand") == "left") & F.col("m")).alias("l"), F.bool_or((F.col("hand") == "right") & F.col("m")).alias("r"))
    l, r = F.col("l"), F.col("r")
    return at.groupBy("series").agg(F.count_if(l & ~r).alias("left"), F.count_if(r & ~l).alias("right"), F.count_if(l & r).alias("both"), F.count_if(~l & ~r).alias("idle"))


def hand_activity(points: DataFrame, moving: float = 0.05) -> DataFrame:
    """(series, left, right, both, idle, handedness): at how many times only one hand, both or none moves faster than
    ``moving``; handedness is the hand that moves more often, or both."""
    handed = F.when(F.col("left") > F.col("right"), "left").when(F.col("right") > F.col("left"), "right").otherwise("both")
    return activity_counts(_steps(points), moving).withColumn("handedness", handed)


def head_relative(points: DataFrame, heads: DataFrame) -> DataFrame:
    """``points`` with ``p`` as the head at the series' first time, of heads (series, t, position, rotation), sees it, less
    the hand's place at its own first time."""
    first = heads.groupBy("series").agg(F.min_by(F.struct("position", "rotation"), "t").alias("head"))
    w = Window.partitionBy("series", "hand").orderBy("t")
    met = points.withColumn("origin", F.first("p").over(w)).join(first, "series")
    return met.withColumn("p", in_head_frame(F.col("p"), F.col("head.position"), F.col("head.rotation"), F.col("origin"))).drop("origin", "head")


def fingertips(joints: DataFrame, tips: tuple[int, ...] = FINGERTIPS, wrist: int = 0) -> DataFrame:
    """(series, t, hand, tips): the places of the fingertips relative to the hand's wrist, of (series, t, hand, joint, p)."""
    some = joints.where(F.col("joint").isin(wrist, *tips)).groupBy("series", "t", "hand").agg(F.map_from_entries(F.collect_list(F.struct("joint", "p"))).alias("at"))
    rel = [minus(F.try_element_at("at", F.lit(k)), F.try_element_at("at", F.lit(wrist))) for k in tips]
    return some.select("series", "t", "hand", F.array(*rel).alias("tips"))


def hand_distance(points: DataFrame) -> DataFrame:
    """(series, t, distance) between both hands, where both are there."""
    at = points.groupBy("series", "t").agg(F.min(F.when(F.col("hand") == "left", F.col("p"))).alias("l"), F.min(F.when(F.col("hand") == "right", F.col("p"))).alias("r"))
    return at.where("l is not null and r is not null").select("series", "t", distance(F.col("l"), F.col("r")).alias("distance"))


def feature_vector(points: DataFrame, duration: Column) -> DataFrame:
    """(series, v): a series' places in order of hand and time, one after another, and its duration behind; a series is
    resampled before, so its length is fixed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("hand", "t", "p"))), lambda e: e["p"])
    return points.groupBy("series").agg(ordered.alias("ps"), duration.alias("d")).select("series", F.concat(F.flatten("ps"), F.array("d")).alias("v"))
