"""Reproducible bounded selection, incremental copies and checks of sets."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.coerce import is_missing, text_or_empty

EVERYTHING = ("*", "all", "__all__")


def guard(task: str, max_episodes: int, confirmed: bool = False, workers: int = 1) -> str:
    """The trimmed task; ValueError for what would select without bound and isn't confirmed."""
    task = task.strip()
    if not task:
        raise ValueError("a task is needed")
    if max_episodes < 0 or workers < 1:
        raise ValueError("max_episodes must be 0 or more, workers 1 or more")
    if (max_episodes == 0 or task.lower() in EVERYTHING) and not confirmed:
        raise ValueError("selecting without bound must be confirmed")
    return task


def available(registry: DataFrame) -> DataFrame:
    """Rows that aren't deleted and have an id and a path."""
    return registry.where(~F.coalesce("is_deleted", F.lit(False)) & ~is_missing(F.col("episode_hash")) & ~is_missing(F.col("zarr_processed_path")))


def choices(registry: DataFrame, task: str, predicate: str | None = None) -> DataFrame:
    """(episode_id, task, lab, scene, demonstrator, zarr_processed_path) of a task, or of all for one of EVERYTHING, in
    order of their ids. ``predicate`` is a SQL condition on the registry's rows; it is parsed, never evaluated as code."""
    rows = registry if task.strip().lower() in EVERYTHING else registry.where(F.col("task") == task)
    rows = rows.where(F.expr(predicate)) if predicate else rows
    text = lambda *names: F.coalesce(*[F.nullif(text_or_empty(F.col(n)), F.lit("")) for n in names if n in registry.columns], F.lit("unknown"))
    return rows.select(
        F.col("episode_hash").cast("string").alias("episode_id"),
        text_or_empty(F.col("task")).alias("task"),
        text("lab").alias("lab"),
        text("scene").alias("scene"),
        text("operator", "demonstrator").alias("demonstrator"),
        text_or_empty(F.col("zarr_processed_path")).alias("zarr_processed_path"),
    ).orderBy("episode_id")


def sampled_exactly(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows as Python's random.Random(seed).sample picks them from the rows in order of their key; 0 means all.
    For registries, whose order fits in one place; sampled() has no such bound."""
    total = rows.count()
    if n == 0 or n >= total:
        return rows
    picked = random.Random(seed).sample(range(total), n)
    return rows.withColumn("_i", F.row_number().over(Window.orderBy(key)) - 1).where(F.col("_i").isin(picked)).drop("_i")


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by the order of a seeded hash of the key: independent of row order, and one pass."""
    if n == 0:
        return rows
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), key).limit(n)


def of_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def fetched_exactly(wanted: DataFrame, fetched: DataFrame, key: str = "episode_id") -> None:
    """RuntimeError unless both hold the same set of ids."""
    row = same_set(wanted, fetched, key).first()
    if not row["equal"]:
        raise RuntimeError(f"the fetched ids are not those selected: {row['missing']} missing, {row['unexpected']} unexpected")


def tasks_preview(registry: DataFrame, most: int = 20) -> DataFrame:
    """One row: the first ``most`` tasks that are stated, or none."""
    stated = registry.where(~is_missing(F.col("task"))).select("task").distinct().orderBy("task").limit(most)
    return stated.agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list("task")), ", "), F.lit("")), F.lit("none")).alias("tasks"))


def manifest(selected: DataFrame, task: str, seed: int) -> DataFrame:
    """One row (requested_task, seed, episode_count, episodes), episodes in order of their ids. A selection is bounded."""
    episodes = F.array_sort(F.collect_list(F.struct("episode_id", "task", "lab", "scene", "demonstrator", "zarr_processed_path")))
    return selected.agg(F.lit(task).alias("requested_task"), F.lit(seed).alias("seed"), F.count("*").cast("int").alias("episode_count"), episodes.alias("episodes"))


def text_table(rows: DataFrame, *columns: str) -> DataFrame:
    """(pos, line): a header, a rule and the rows by their first column, padded to the widest value of each column; no
    lines for no rows. For listings of a bounded selection."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    widths = rows.select(*cells).agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"w_{c}") for c in columns], F.count("*").alias("n"))
    lines = F.array(F.struct(F.lit(0).alias("pos"), *[F.lit(c).alias(c) for c in columns]), F.struct(F.lit(1).alias("pos"), *[F.repeat(F.lit("-"), F.col(f"w_{c}")).alias(c) for c in columns]))
    head = widths.where("n > 0").select(F.inline(lines))
    body = rows.select(*cells).withColumn("pos", F.row_number().over(Window.orderBy(columns[0])) + 1).select("pos", *columns)
    padded = [F.rpad(F.col(c), F.col(f"w_{c}"), F.lit(" ")) for c in columns]
    return head.unionByName(body).crossJoin(F.broadcast(widths.drop("n"))).select("pos", F.concat_ws("  ", *padded).alias("line"))  # one row of widths


@dataclass
class Selection:
    """What run() chose: the episodes, how many there were to choose from, and the manifest's path unless it was a dry run."""

    episodes: DataFrame
    available: int
    seed: int
    manifest_path: str | None = None


def run(registry: DataFrame, task: str, max_episodes: int, seed: int, output: str, fetch: Callable[[DataFrame], DataFrame], dry_run: bool = False, confirm_unbounded: bool = False, confirm_complete: bool = False, workers: int = 1) -> Selection:
    """Chooses a bounded sample of a task's episodes, fetches just these and writes selection_manifest.json.

    ValueError for what selects without bound and isn't confirmed; RuntimeError where no episode matches, where the
    selection is all there is and that isn't confirmed, and where ``fetch``, which gets the episodes and returns those it
    has fetched, returns other ids. A dry run neither fetches nor writes.
    """
    from gleaner.sources.files import write_json

    task = guard(task, max_episodes, confirm_unbounded, workers)
    ready = available(registry)
    candidates = choices(ready, task)
    n = candidates.count()
    if not n:
        raise RuntimeError(f"no episode to fetch has the task {task!r}; there are: {tasks_preview(ready).first()[0]}")
    picked = sampled_exactly(candidates, "episode_id", max_episodes, seed).orderBy("episode_id")
    if picked.count() == ready.count() and not confirm_complete:
        raise RuntimeError("the selection is the complete dataset, which must be confirmed")
    if dry_run:
        return Selection(picked, n, seed)
    fetched_exactly(picked, fetch(picked))
    path = f"{output.rstrip('/')}/selection_manifest.json"
    write_json(manifest(picked, task, seed), path)
    return Selection(picked, n, seed, path)


def to_copy(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Files that ``local`` lacks, or has with another length."""
    return remote.join(local.select("path", "length"), ["path", "length"], "left_anti")


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(missing, unexpected, equal): one row."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer").agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unexpected"))
    return both.withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def placed(rows: DataFrame, order: list, value: str | None = None) -> DataFrame:
    """``rows`` with ``place``, from 1 in the order of the columns ``order``, ``all_rows``, their number, and ``running``, the sum
    of ``value`` up to each row, without one task that sorts all: rows are dealt out by ranges once, and only the ranges'
    counts and sums are added up."""
    from gleaner.sources.shared import checkpoint

    dealt = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    amount = F.col(value) if value else F.lit(0.0)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_sum"), F.sum("_n").over(Window.partitionBy()).alias("all_rows"))
    own = Window.partitionBy("_part").orderBy(*order)
    out = dealt.withColumn("_nth", F.row_number().over(own)).withColumn("_run", F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(counts), "_part")  # one row a partition
    return out.select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("place"), "all_rows", (F.col("_sum") + F.col("_run")).alias("running"))


def ranked_percent(rows: DataFrame, value: str, key: str) -> DataFrame:
    """``rows`` with ``percentile``, 100 times the percent rank by (value, key)."""
    out = placed(rows, [value, key])
    return out.withColumn("percentile", F.coalesce(F.try_divide((F.col("place") - 1) * 100.0, F.col("all_rows") - 1), F.lit(0.0))).drop("place", "all_rows", "running")
