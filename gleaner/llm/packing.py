"""Best-fit packing by exact complements, on the counts of lengths.

Documents become token pieces of at most ``capacity`` ids. How pieces fill sequences depends on their
lengths alone, so the packing is worked out on the histogram of lengths, which has at most
``capacity`` entries however many documents there are: the longest length is joined with one, two or
three others that fill its gap exactly, as often as their counts allow; lengths without such
complements are filled by best fit. Each decision is a run: pieces number a to b of one length go
to the same place of sequences s, s + 1 and so on. Pieces get their number within their length from
the partition that wrote them and from counts of lengths by partition, so that no length, however
frequent, is gathered in one task.

Defined cases: a null or empty text is the end id alone; documents longer than ``capacity`` are cut,
their last piece may be shorter; a null doc_id and repeated rows are packed like others; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import map_rows, table, taken
from gleaner.llm.tokens import encoder, vocabulary
from gleaner.sources.shared import written


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, part, nth): ids packed as little-endian unsigned 32-bit integers;
    ``part`` is the partition that cut a piece, ``nth`` its number among that partition's pieces of the same length.
    Pieces are cut and numbered by one function, so that a task has one Python worker."""
    end = np.array([end_id], "<u4").tobytes()

    def begin():
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}

        def run(rows):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth")}
            for doc, ids in zip(rows["doc_id"], encoder(path).encode(rows["text"])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for name, v in zip(out, (doc, k, at // 4, n, part, zlib.crc32(part), task, seen.get(n, 0))):
                        out[name].append(v)
                    seen[n] = seen.get(n, 0) + 1
            return out

        return run

    schema = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long"
    return map_rows(taken(docs, "doc_id", "text"), None, schema, char_col="text", begin=begin)


class _Index:
    """Lengths still to be packed, indexed by the sums of one, two and three of them.

    ``single`` has the lengths that are left, ``pairs`` for each sum the number of ways to make it of two lengths that
    the counts allow; it is kept up to date as lengths run out. The sums of three are those of a length and a pair.
    """

    def __init__(self, counts: np.ndarray):
        self.count = counts.astype(np.int64).copy()
        self.single = self.count > 0
        n = len(counts)
        self.pairs = np.zeros(2 * n, np.int64)
        for a in np.nonzero(self.single)[0].tolist():
            self._add(a, a, 1)
            if self.count[a] >= 2:
                self.pairs[2 * a] += 1

    def _add(self, a: int, below: int, sign: int) -> None:
        """Counts, or no longer counts, the pairs of ``a`` with the lengths under ``below``."""
        other = np.nonzero(self.single[:below])[0]
        self.pairs[other[other != a] + a] += sign

    def change(self, length: int, n: int) -> None:
        """``n`` more pieces of ``length``, or fewer."""
        before, after = int(self.count[length]), int(self.count[length]) + n
        self.count[length] = after
        if (before > 0) != (after > 0):
            self.single[length] = after > 0
            self._add(length, len(self.single), 1 if after > 0 else -1)
        self.pairs[2 * length] += (after >= 2) - (before >= 2)

    def pair(self, total: int) -> tuple[int, int] | None:
        """The two lengths a >= b of sum ``total`` with the largest a."""
        if total < 2 or not self.pairs[total]:
            return None
        top = min(total - 1, len(self.single) - 1)
        a = np.arange(top, (total - 1) // 2, -1)
        fits = self.single[a] & self.single[total - a] & ((2 * a != total) | (self.count[a] >= 2))
        a = int(a[fits.argmax()])
        return a, total - a

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three lengths a >= b >= c of sum ``total`` with the largest a."""
        for a in self._firsts(total):
            self.change(a, -1)  # the pair must leave it one piece
            two = self.pair(total - a)
            self.change(a, 1)
            if two and two[0] <= a:
                return a, *two
        return None

    def _firsts(self, total: int) -> list[int]:
        if total < 3:
            return []
        a = np.arange(min(total - 2, len(self.single) - 1), (total - 1) // 3, -1)
        return a[self.single[a] & (self.pairs[total - a] > 0)].tolist()

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths of sum ``gap``."""
        if self.single[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def pack_counts(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times), ...] and in how many sequences each is used; counts[n] pieces of length n are used up."""
    free, out = _Index(counts), []

    def use(pattern: tuple[int, ...]) -> None:
        need = {x: pattern.count(x) for x in pattern}
        n = min(int(free.count[x]) // k for x, k in need.items())
        for x, k in need.items():
            free.change(x, -n * k)
        out.append((sorted(need.items(), reverse=True), n))

    for length in range(capacity, 0, -1):
        while free.count[length]:
            free.change(length, -1)  # its own complement must leave it
            rest = free.complement(capacity - length) if length < capacity else ()
            free.change(length, 1)
            if rest is None:
                break
            use((length, *rest))
    for length in range(capacity, 0, -1):  # best fit, longest first
        while free.count[length]:
            pattern, gap = {}, capacity
            fits = length
            while fits:
                left = int(free.count[fits]) - pattern.get(fits, 0)
                times = min(gap // fits, left)
                if times:
                    pattern[fits] = pattern.get(fits, 0) + times
                    gap -= times * fits
                below = np.nonzero(free.single[1 : min(gap, fits - 1) + 1])[0]
                fits = int(below[-1]) + 1 if len(below) else 0
            n = min(int(free.count[x]) // k for x, k in pattern.items())
            for x, k in pattern.items():
                free.change(x, -n * k)
            out.append((list(pattern.items()), n))
    return out


def runs_of(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Runs by (length, first number): pieces ``first`` and on lie in sequences from ``sequence``, ``times`` in each, from ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            first = used.get(length, 0)
            rows.append((length, first, sequence, times, offset))
            used[length] = first + n * times
            offset += length * times
        sequence += n
    rows.sort()
    return dict(zip(("length", "first", "sequence", "times", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset added; pieces has a ``length`` of 1 to capacity, and ``part`` and ``nth``
    of token_pieces(), as read back from a table. The driver gets the histogram only: capacity rows at most."""
    cells = pieces.groupBy("part", "length").count()
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("part", "length", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    runs = runs_of(pack_counts(counts, capacity))
    starts = runs["length"] << 40 | runs["first"]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, number):
        import pandas as pd

        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        k = np.searchsorted(starts, length << 40 | number, side="right") - 1
        done = number - runs["first"][k]
        return pd.DataFrame({"sequence_id": runs["sequence"][k] + done // runs["times"][k], "offset": runs["offset"][k] + done % runs["times"][k] * length})

    # Hashed, not sorted: a cell is a row, and sorting both sides would take a task's memory for nothing.
    placed = pieces.join(before.hint("shuffle_hash"), ["part", "length"]).withColumn("_at", place("length", F.col("before") + F.col("nth")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "nth")], "_at.sequence_id", "_at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence, from rows with ids. A sequence is bounded by the capacity."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    empty = F.lit(b"")
    return parts.select("sequence_id", F.aggregate("p", empty, lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset) of all documents."""
    path = vocabulary("word_bpe_49k.json", path)
    # Only what one attempt of a task has committed is read back, so the numbers hold whatever is computed again.
    return pack(written(token_pieces(docs, path, end_id, capacity), "pieces"), capacity)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie, without their ids. Rows of a null doc_id, null texts and repeated
    rows are packed like others; an empty table gives an empty one."""
    return packed(docs).drop("ids")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")
