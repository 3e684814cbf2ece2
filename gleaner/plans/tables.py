"""The entities of the engine, as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.tables import table

SEG_SQL = """seg as (
  select event_id pos, cast(event_id as varchar) id, cast(user_id as varchar) episode_id, cast(user_id as varchar) video_id, event_type verb,
         date_diff('microsecond', timestamp '2024-01-01', ts) / 1e6 as "start",
         date_diff('microsecond', timestamp '2024-01-01', ts) / 1e6 + value as "end",
         event_type || '-style-' || (event_id % 6) "cluster", (event_id * 37 % 1001) / 10.0::double pct, value >= 10 keep
  from events)"""


def segments(spark, root: str) -> DataFrame:
    """Segments from ``events``: an episode for each user, ``value`` seconds long."""
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D")
    return table(spark, root, "events").select(
        F.col("event_id").alias("pos"),
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("episode_id"),
        F.col("user_id").cast("string").alias("video_id"),
        F.col("event_type").alias("verb"),
        start.alias("start"),
        (start + F.col("value")).alias("end"),
        F.concat("event_type", F.lit("-style-"), (F.col("event_id") % 6).cast("string")).alias("cluster"),
        (F.col("event_id") * 37 % 1001 / F.lit(10.0)).alias("distinctiveness_percentile"),
        (F.col("value") >= 10).alias("keep"),
        F.array().cast("array<struct<segment_id: string, similarity: double, explanation: string>>").alias("neighbors"),
    )


REG_SQL = """reg as (
  select cast(c_custkey as varchar) episode_hash, c_mktsegment task, n_name lab, cast(null as varchar) scene,
         case when c_custkey % 3 = 0 then '' else c_name end "operator", c_name demonstrator,
         case when c_custkey % 7 = 0 then ' ' else 's3://' || c_name end zarr_processed_path, c_acctbal < 0 is_deleted
  from customer join nation on c_nationkey = n_nationkey)"""


def registry(spark, root: str) -> DataFrame:
    """Episode registry from ``customer``; nations are a table of fixed size."""
    nations = F.broadcast(table(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    c = table(spark, root, "customer").join(nations, "c_nationkey")
    return c.select(
        F.col("c_custkey").cast("string").alias("episode_hash"),
        F.col("c_mktsegment").alias("task"),
        F.col("n_name").alias("lab"),
        F.lit(None).cast("string").alias("scene"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("operator"),
        F.col("c_name").alias("demonstrator"),
        F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.concat(F.lit("s3://"), "c_name")).alias("zarr_processed_path"),
        (F.col("c_acctbal") < 0).alias("is_deleted"),
    )


def files(spark, root: str) -> DataFrame:
    """A file listing from ``pages``."""
    return table(spark, root, "pages").select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("length"))


FEAT_SQL = """raw as (select vec_id id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings where embedding is not null),
feat as (select id, cast(label as bigint) grp, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) v from raw)"""


def features(spark, root: str) -> DataFrame:
    """(id, grp, v): unit vectors from ``embeddings``."""
    from gleaner.operators.similarity import unit

    e = table(spark, root, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), unit(F.col("embedding")).alias("v"))


CURVE_SQL = """days as (select cast(date_diff('day', timestamp '2024-01-01', ts) as double) d, sum(value) v, count(*) n from events group by 1),
curve as (select d x, round(sum(v) over (order by d) / 3600, 9) y from days)"""


def curve(spark, root: str) -> DataFrame:
    """(x, y): hours gathered up to each day; a row a day."""
    from pyspark.sql import Window

    day = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(86_400_000_000)).cast("double")
    days = table(spark, root, "events").groupBy(day.alias("x")).agg(F.sum("value").alias("v"))
    return days.select("x", F.round(F.sum("v").over(Window.orderBy("x")) / 3600, 9).alias("y"))
