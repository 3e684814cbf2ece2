"""What the product shows, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Canonical names of verbs written in several ways.
SYNONYMS = {"smoothing": "smooth", "smoothen": "smooth", "smoothed": "smooth", "grab": "pick", "grabs": "pick", "picks": "pick"}


def explore(segs: DataFrame, search: str = "", verbs=(), episodes=(), percentile: tuple[float, float] | None = None, status: str = "All") -> DataFrame:
    """Segments that pass every filter given; an empty filter passes all."""
    tests: list[Column] = []
    if search.strip():
        tests.append(F.contains(F.lower(F.concat_ws(" ", "id", "episode_id", "verb", "cluster")), F.lit(search.strip().lower())))
    if verbs:
        tests.append(F.col("verb").isin(*verbs))
    if episodes:
        tests.append(F.col("episode_id").isin(*episodes))
    if percentile:
        tests.append(F.col("distinctiveness_percentile").between(*percentile))
    if status in ("Keep", "Drop"):
        tests.append(F.col("keep") if status == "Keep" else ~F.col("keep"))
    return segs.where(reduce(lambda a, b: a & b, tests)) if tests else segs


def timeline(segs: DataFrame) -> DataFrame:
    """Bars by start: kept ones wide and opaque; each verb's first bar in an episode makes its legend."""
    first = F.row_number().over(Window.partitionBy("episode_id", "verb").orderBy("start", "pos")) == 1
    length = F.col("end") - F.col("start")
    return segs.select(
        "*",
        F.greatest(F.lit(0.01), length).alias("duration"),
        F.when(F.col("keep"), 0.48).otherwise(0.34).alias("width"),
        F.when(F.col("keep"), 1.0).otherwise(0.38).alias("opacity"),
        (length >= 2.4).alias("labelled"),
        first.alias("legend"),
    )


def registry_summary(registry: DataFrame, needle: str) -> DataFrame:
    """Episodes by task, those whose lab holds ``needle`` in any case, and those with a path."""
    return registry.groupBy("task").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.contains(F.lower("lab"), F.lit(needle.lower())), F.lit(False))).alias(f"with_{needle}"),
        F.count_if(F.trim(F.coalesce("zarr_processed_path", F.lit(""))) != "").alias("ready"),
    )


def counted(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column's values but null, most frequent first."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def equals(column: str, value: str) -> Column:
    """Equality by which null is the empty text."""
    return F.coalesce(F.col(column), F.lit("")) == value


def within_budget(rows: DataFrame, key: str, score: str, hours: str, share: float) -> DataFrame:
    """``rows`` with ``rank`` and running ``total`` by falling score while the total is at most ``share`` of all hours."""
    from gleaner.operators.selection import placed

    every = rows.agg(F.sum(hours).alias("_all"))
    ranked = placed(rows, [F.desc(score), F.col(key)], hours).select(*rows.columns, F.col("place").cast("int").alias("rank"), F.col("running").alias("total"))
    return ranked.crossJoin(F.broadcast(every)).where(F.col("total") <= share * F.col("_all")).drop("_all")  # one row


def episode_rank(rows: DataFrame, score: str = "contribution") -> DataFrame:
    """(episode_id, n, total, mean, rank): the segments' scores by episode, the highest mean first."""
    from gleaner.operators.selection import placed

    each = rows.groupBy("episode_id").agg(F.count("*").alias("n"), F.sum(score).alias("total"), F.round(F.avg(score), 9).alias("mean"))
    return placed(each, [F.desc("mean"), F.col("episode_id")]).select("episode_id", "n", "total", "mean", F.col("place").alias("rank")).orderBy("rank")


def strip(rows: DataFrame, score: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` highest and the ``n`` lowest rows by score, with ``side`` and ``place``."""
    top = rows.orderBy(F.desc(score), key).limit(n).withColumn("side", F.lit("top"))
    low = rows.orderBy(F.asc(score), key).limit(n).withColumn("side", F.lit("bottom"))
    w = Window.partitionBy("side").orderBy(F.when(F.col("side") == "top", -F.col(score)).otherwise(F.col(score)), key)
    return top.unionByName(low).withColumn("place", F.row_number().over(w))


def random_curve(rows: DataFrame, key: str, hours: str, kind: str, seed: int) -> DataFrame:
    """(place, retained_hours, coverage): rows in an order by a seeded hash, the hours gathered, and the percentage of all
    kinds met so far: what choosing at random covers."""
    from gleaner.operators.selection import placed

    mixed = rows.select(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))).alias("h"), F.col(key).alias("k"), F.col(hours).alias("hours"), F.col(kind).alias("kind"))
    first = mixed.groupBy("kind").agg(F.min(F.struct("h", "k")).alias("f")).select("kind", "f.h", "f.k")
    new = mixed.join(first.withColumn("new", F.lit(1.0)), ["kind", "h", "k"], "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
    kinds = mixed.agg(F.countDistinct("kind").alias("kinds"))
    by_hours = placed(new, ["h", "k"], "hours").select("h", "k", "place", F.col("running").alias("retained_hours"))
    by_kind = placed(new, ["h", "k"], "new").select("h", "k", "running")
    both = by_hours.join(by_kind, ["h", "k"]).crossJoin(F.broadcast(kinds))  # one row
    return both.select("place", "retained_hours", (F.col("running") / F.col("kinds") * 100).alias("coverage"))


def budget_comparison(budgets: DataFrame, curve: DataFrame, original_hours: float) -> DataFrame:
    """``budgets`` (hours) with coverage by choice and at random, their lift, and the shares kept and saved, from the curve
    (retained_hours, diversity_coverage, random_coverage)."""
    from gleaner.operators.segments import interpolated

    by_choice = interpolated(budgets, curve, "retained_hours", "diversity_coverage", "hours")
    out = interpolated(by_choice, curve, "retained_hours", "random_coverage", "hours")
    hours, least = F.col("hours"), max(original_hours, 0.1)
    saved = F.lit(0.0) if original_hours <= 0 else (1 - hours / original_hours) * 100
    return out.select(
        "*",
        F.greatest(F.lit(0.0), F.col("diversity_coverage") - F.col("random_coverage")).alias("lift"),
        F.least(F.lit(100.0), hours / least * 100).alias("retained_percent"),
        saved.alias("reduction"),
    )


def largest_budget(curve: DataFrame, original_hours: float) -> DataFrame:
    """One row (hours): the longest of the curve and of the original hours."""
    return curve.agg(F.greatest(F.max("retained_hours"), F.lit(max(original_hours, 0.1))).alias("hours"))


def initial_budget(summary: DataFrame) -> DataFrame:
    """``summary`` with ``budget``: the selected hours, within 0 and the original ones."""
    return summary.withColumn("budget", F.least(F.greatest(F.col("selected_hours"), F.lit(0.0)), F.greatest(F.col("original_hours"), F.lit(0.1))))


def cards(summary: DataFrame) -> DataFrame:
    """One row of the overview's figures as they are shown; ``summary`` has ``budget`` and ``coverage`` too."""
    hours = lambda c: F.format_string("%.1fh", F.bround(c, 1))
    whole = lambda c: F.format_string("%.0f", F.bround(c, 0))
    saved = F.when(F.col("original_hours") > 0, (1 - F.col("budget") / F.col("original_hours")) * 100).otherwise(0.0)
    return summary.select(
        F.format_number("total_videos", 0).alias("total_videos"),
        F.format_number("total_segments", 0).alias("total_segments"),
        hours(F.col("original_hours")).alias("original_hours"),
        hours(F.col("budget")).alias("selected_hours"),
        F.concat(whole(F.greatest(F.lit(0.0), saved)), F.lit("%")).alias("data_reduction"),
        F.concat(whole(F.col("coverage")), F.lit("%")).alias("behavioral_coverage"),
        whole(F.col("composition_diversity")).alias("composition_diversity"),
        whole(F.col("execution_diversity")).alias("execution_diversity"),
    )


def clips(segs: DataFrame, files: DataFrame) -> DataFrame:
    """``segs`` with ``clip_kind``: remote, file if ``files`` (path) has it, else placeholder, and the ``clip_label`` of that."""
    there = files.select(F.col("path").alias("clip_path")).distinct().withColumn("_there", F.lit(True))
    path = F.col("clip_path")
    remote = F.startswith(path, F.lit("https://")) | F.startswith(path, F.lit("http://"))
    kind = F.when(remote, "remote").when(F.col("_there") & (path != ""), "file").otherwise("placeholder")
    label = F.when(path == "", "No clip_path supplied").otherwise(F.element_at(F.split(path, "/"), -1))
    both = segs.join(there, "clip_path", "left").withColumn("clip_kind", kind)
    return both.withColumn("clip_label", F.when(F.col("clip_kind") == "placeholder", label)).drop("_there")


def selected_row(found: DataFrame, every: DataFrame, wanted: str | None) -> DataFrame:
    """The first segment with the ``wanted`` id of all segments, also of those that were filtered out; else the first that
    was found; no row where nothing was found."""
    any_found = found.orderBy("pos").limit(1)
    stated = every.where(F.col("id") == wanted).orderBy("pos").limit(1).join(any_found.select(F.lit(1).alias("_any")), F.lit(True), "left_semi")
    both = stated.withColumn("_o", F.lit(0)).unionByName(any_found.withColumn("_o", F.lit(1)))
    return both.orderBy("_o").limit(1).drop("_o")


def episodes_nested(segs: DataFrame) -> DataFrame:
    """(episode_id, segments): each episode's segments by start, as an array."""
    return segs.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("start", "pos", "id", "verb"))).alias("segments"))


def canonical_verb(word: Column) -> Column:
    """Synonyms by name, then the endings -ing and -ed off longer words."""
    names = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]) if SYNONYMS else F.create_map()
    stem = (
        F.when(word.isin("pick"), word)
        .when((F.length(word) > 5) & word.endswith("ing"), F.left(word, F.length(word) - 3))
        .when((F.length(word) > 4) & word.endswith("ed"), F.left(word, F.length(word) - 2))
        .otherwise(word)
    )
    return F.coalesce(F.try_element_at(names, word), stem)
