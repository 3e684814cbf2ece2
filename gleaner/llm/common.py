"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Columns of documents, in order.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taken(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, can't clash with computed ones."""
    return docs.select(*names)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as keep them apart from every column of ``df``."""
    have, under = {c.lower() for c in df.columns}, "_"
    while any(under + n in have for n in names):
        under += "_"
    return [under + n for n in names]


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), as long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, size: int = 512, char_col: str | None = None, chars: int = 4_000_000, begin: Callable[[], Callable] | None = None) -> DataFrame:
    """mapInArrow over lists of column values. fn gets at most ``size`` rows at once, and at most about
    ``chars`` characters of ``char_col`` unless one row has more, so memory is bounded by a batch. ``begin``, if
    given, makes the function anew for each partition, for one that remembers what it has seen there."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_rows = begin() if begin else fn
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, at + size)
                if char_col is not None:
                    total, cut = 0, at
                    for x in batch.column(char_col).slice(at, end - at):
                        total += len(x.as_buffer()) if x.is_valid else 0
                        if cut > at and total > chars:
                            break
                        cut += 1
                    end = cut
                part = batch.slice(at, end - at)
                got = of_rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if len(got[out.names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
                at = end
        pa.default_memory_pool().release_unused()  # workers are kept from stage to stage

    return df.mapInArrow(run, schema)
