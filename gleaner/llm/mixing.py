"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source is expected in the mix rate = target / source_size times, at most 3.
Within each source the expected copies are summed up in one order, one random offset is added,
and a document is emitted once for each integer that its sum crosses. The order goes by size
class first (sixteenths of an octave) and by a hash second, so that equal sizes are spread evenly
over the copies and a source's taken words come near its target.

No source is gathered in one task: ranks come from cells (source, size class, slice), whose
rows are counted first; only the counts are summed up along the order. Rows are dealt by cell.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; if all sizes are 0 nothing is taken; a null doc_id and repeated rows are rows like
others, each with its own copies; an empty table gives an empty table; input columns named as
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import DOCUMENTS, fresh, table, word_count
from gleaner.sources.shared import checkpoint, written

RESULTS = ("size", "source_size", "target", "copies", "taken")
#: Slices of a size class; a hot class is dealt to so many tasks.
SLICES = 256


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, get the weights in turn; targets share the sum of all
    sizes by weight, stop at ``most`` times their source's size, and the excess goes to those below
    by weight until none is above. One row a source: the order needs them in one place.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    # A source is at its cap if the level (target over weight) is over cap / weight: fill the lowest such ratio first.
    ranked = sizes.select("source", "source_size", turn.alias("w")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("_cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("_w_before"),
        F.sum("source_size").over(every).alias("_total"),
        F.sum("w").over(every).alias("_w_total"),
    )
    # Level if exactly the sources before this one are at their caps; it falls along the order, and the
    # first source that it leaves below its cap sets it.
    filled = filled.withColumn("_level", (F.col("_total") - F.col("_cap_before")) / (F.col("_w_total") - F.col("_w_before")))
    below = F.when(F.col("_level") * F.col("w") <= F.col("cap"), F.col("_level"))
    level = F.max(below).over(every)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w")))
    return filled.select("source", F.col("source_size"), target.alias("target"))


def _size_class(size: Column) -> Column:
    return F.when(size <= 0, F.lit(-1)).otherwise(F.floor(F.log2(size.cast("double")) * 16).cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17, size: str | None = None) -> DataFrame:
    """``docs`` with RESULTS added; ``copies`` is how often the mix takes the document. Reruns agree. ``size`` names a
    column with the documents' sizes, which are else the words of ``text``."""
    of_source, of_class, tie, part, n_rows, words, before, rank = fresh(docs, "source", "class", "tie", "slice", "rows", "words", "before", "rank")
    rest = [c for c in docs.columns if c.lower() not in RESULTS]
    sized = docs.select(*rest, (F.col(size).cast("long") if size else word_count(F.col("text"))).alias("size"))
    ties = ("doc_id", "size") if size else ("text",)
    keyed = sized.select(
        "*",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias(of_source),
        _size_class(F.col("size")).alias(of_class),
        F.xxhash64(*ties).alias(tie),
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(SLICES)).cast("int").alias(part),
    )
    cell = [of_source, of_class, part]
    counted = keyed.groupBy(*cell).agg(F.first("source").alias("source"), F.count("*").alias(n_rows), F.sum("size").alias(words))
    cells = checkpoint(counted)
    sums = cells.groupBy(of_source).agg(F.first("source").alias("source"), F.sum(words).alias("source_size"))
    by_source = targets(sums, weights, most).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias(of_source), "source_size", "target")
    # A source has a bounded number of cells: size classes times slices.
    order = Window.partitionBy(of_source).orderBy(of_class, part).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select(*cell, F.coalesce(F.sum(n_rows).over(order), F.lit(0)).alias(before)).join(by_source, of_source)
    inside = Window.partitionBy(*cell).orderBy("size", "doc_id", tie)
    joined = keyed.withColumn(rank, F.row_number().over(inside)).join(placed, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(of_source, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = F.col(before) + F.col(rank)
    copies = F.floor(rate * at + offset) - F.floor(rate * (at - 1) + offset)
    return joined.select(
        *rest,
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words are not taken; null ids and sources and
    repeated rows are rows like others; an empty table gives an empty one."""
    mixed = mix(docs.select(*DOCUMENTS)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*DOCUMENTS)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Words are counted once: the sizes are a table that the mix reads instead of the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n"))
    return mix(written(docs, "sizes"), size="n").select("doc_id", "size", "source_size", "target", "taken")
