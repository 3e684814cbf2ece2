"""Token ids in files of Re-Pair grammars.

Documents are dealt out by ranges of doc_id and encoded; each shard of about ``shard_tokens`` ids becomes
one block. In a block the most frequent pairs of neighbouring ids are replaced by nonterminals, round
after round, until a round gains little. A block holds its rules, the expansion length of each rule and
where each document starts, so that any document, or a slice of one, is decoded by itself.

Layout of a block, little-endian: ``RPR1``, then seven unsigned 32-bit numbers (bytes per symbol, documents,
rules, symbols, first nonterminal, tokens, nulls), doc_ids (signed 64-bit), a byte for each that is 1 where
doc_id is null, documents + 1 symbol offsets and as many token offsets (unsigned 32-bit), expansion lengths of
the rules (unsigned 32-bit), rules (two symbols each), symbols. Blocks are the rows of a Parquet table, with
the shard's place in the order, so that they can be written to and read from any store that Spark reaches.

Defined cases: a null or empty text is the end id alone; a null doc_id comes before all others; rows of one doc_id
follow in the order of their texts, repeated rows included; an empty table gives an empty file set; other columns
are not read; a document longer than a shard is a shard of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table, taken
from gleaner.llm.tokens import encoder, vocabulary
from gleaner.sources.shared import written

MAGIC = b"RPR1"


def grammar(ids: np.ndarray, last: np.ndarray, base: int, rounds: int = 4, least: int = 8, per_round: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules): pairs are replaced within documents only; last marks the end of each.

    A round counts all pairs (in buckets first, exactly in the buckets that reach ``least``), takes the
    ``per_round`` most frequent and replaces them from left to right. Rounds end early below 1 % gain.
    """
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    for _ in range(rounds):
        n = len(seq)
        if n < 2 * least:
            break
        bucket = ((seq[:-1] * np.uint32(2654435761) + seq[1:] * np.uint32(2246822519)) >> np.uint32(12)).astype(np.intp)
        size = np.bincount(bucket, minlength=1 << 20)
        reached = np.cumsum(np.bincount(size)[::-1])  # buckets of at least max, max - 1, ... pairs
        size_floor = max(least, len(reached) - 1 - int(np.searchsorted(reached, 2 * per_round)))
        heavy = size >= size_floor
        at = np.nonzero(heavy[bucket] & ~last[:-1])[0]
        if not len(at):
            break
        # Nearly all pairs of a bucket are one pair; only the others are told apart by sorting.
        place, n_heavy = np.empty(len(size), np.int32), int(heavy.sum())
        place[heavy] = np.arange(n_heavy)
        key, which = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], place[bucket[at]]
        common = np.zeros(n_heavy, np.uint64)
        common[which] = key
        apart = np.nonzero(common[which] != key)[0]
        rare, inverse = np.unique(key[apart], return_inverse=True)
        which[apart] = n_heavy + inverse
        pair, count = np.concatenate([common, rare]), np.bincount(which, minlength=n_heavy + len(rare))
        top = np.argsort(-count, kind="stable")[:per_round]
        chosen = np.zeros(len(pair), bool)
        chosen[top] = count[top] >= least
        hit = chosen[which]
        at, which = at[hit], which[hit]
        if not len(at):
            break
        # Of overlapping pairs every other one, from the left.
        begins = np.concatenate([[True], np.diff(at) != 1])
        runs = np.nonzero(begins)[0]
        odd = (np.arange(len(at)) - runs[np.cumsum(begins) - 1]) % 2 == 1
        at, which = at[~odd], which[~odd]
        used = np.bincount(which, minlength=len(pair)) >= max(3, least // 2)
        keep = used[which]
        at, which = at[keep], which[keep]
        if not len(at):
            break
        number = np.cumsum(used) - 1
        new = pair[used]
        seq[at] = base + len(rules) + number[which]
        rules = np.concatenate([rules, np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)])
        last[at] = last[at + 1]
        stay = np.ones(n, bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        if len(at) < 0.01 * n:
            break
    return seq, last, rules


def levels(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules, in order, whose symbols are terminals or rules of earlier ranges; about one for each round."""
    start, highest = 0, rules.max(axis=1, initial=0).astype(np.int64) - base
    while start < len(rules):
        later = np.nonzero(highest[start:] >= start)[0]
        stop = start + int(later[0]) if len(later) else len(rules)
        if stop == start:
            raise ValueError(f"rule {start} is not made of earlier symbols")
        yield start, stop
        start = stop


def write_block(doc_ids: list[int | None], packed: list[bytes], rounds: int = 4) -> bytes:
    """One block from the packed ids (unsigned 32-bit) of documents, none empty."""
    tokens = np.array([len(x) // 4 for x in packed], np.int64)
    ids = np.frombuffer(b"".join(packed), "<u4")
    last = np.zeros(len(ids), bool)
    last[np.cumsum(tokens) - 1] = True
    base = int(ids.max()) + 1
    seq, last, rules = grammar(ids, last, base, rounds)
    length = np.ones(base + len(rules), np.uint32)
    for start, stop in levels(rules, base):
        length[base + start : base + stop] = length[rules[start:stop]].sum(axis=1)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    ends = np.nonzero(last)[0] + 1
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, struct.pack("<7I", width, len(packed), len(rules), len(seq), base, len(ids), int(null.sum())),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(),
        np.concatenate([[0], ends]).astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(tokens)]).astype("<u4").tobytes(),
        length[base:].astype("<u4").tobytes(), rules.astype(f"<u{width}").tobytes(), seq.astype(f"<u{width}").tobytes(),
    ])


class Block:
    """Random access to the documents of a block."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        width, docs, rules, symbols, self.base, self.n_tokens, _ = struct.unpack_from("<7I", blob, 4)
        at = 32

        def read(kind, n):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids, null = read("<i8", docs), read("<u1", docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.symbol_at, self.token_at = read("<u4", docs + 1).astype(np.int64), read("<u4", docs + 1).astype(np.int64)
        lengths = read("<u4", rules)
        self.rules = read(f"<u{width}", 2 * rules).reshape(-1, 2)
        self.symbols = read(f"<u{width}", symbols)
        self.length = np.concatenate([np.ones(self.base, np.int64), lengths])
        # Expansions of all rules, one after another; terminals expand to themselves.
        self.starts = np.concatenate([np.arange(self.base), self.base + np.cumsum(lengths) - lengths]).astype(np.int64)
        self.flat = np.zeros(self.base + int(lengths.sum()), "<u4")
        self.flat[: self.base] = np.arange(self.base)
        for start, stop in levels(self.rules, self.base):
            at = int(self.starts[self.base + start])
            self.flat[at : at + int(lengths[start:stop].sum())] = self._expand(self.rules[start:stop].ravel())

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        before = np.cumsum(n) - n
        return self.flat[np.repeat(self.starts[symbols] - before, n) + np.arange(int(n.sum()))]

    def tokens(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document k; only the symbols that cover them are expanded."""
        own = self.symbols[self.symbol_at[k] : self.symbol_at[k + 1]]
        total = int(self.token_at[k + 1] - self.token_at[k])
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, "<u4")
        ends = np.cumsum(self.length[own])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop - 1, side="right") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self._expand(own[a:b])[start - skipped : stop - skipped]

    def all_tokens(self) -> np.ndarray:
        return self._expand(self.symbols)


BLOCKS = "part int, block int, n_docs int, n_tokens long, data binary"


def token_blocks(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = 1 << 20, rounds: int = 4, words: int = 600_000) -> DataFrame:
    """BLOCKS in ascending doc_id order by (part, block). Each worker remembers the ids of at most about ``words`` words."""
    import pyarrow as pa

    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, block, ids, packed, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            values = ([part], [block], [len(ids)], [size // 4], [write_block(ids, packed, rounds)])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "block", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, x in zip(some.column("doc_id").to_pylist(), encoder(path, words).encode(some.column("text").to_pylist())):
                    if ids and size + len(x) + 4 > 4 * shard_tokens:
                        yield row()
                        block, ids, packed, size = block + 1, [], [], 0
                    ids.append(doc)
                    packed.append(x + end)
                    size += len(x) + 4
        if ids:
            yield row()

    ordered = taken(docs, "doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, BLOCKS)


def written_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2, **options) -> DataFrame:
    """The files of ``docs`` in the shared folder, as a table of BLOCKS that reads them."""
    return written(token_blocks(docs, vocabulary("byte_bpe_50k.json", path), end_id, **options), "tokens")


def read_tokens(blocks: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files; start counts the ids of all documents before."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part, block, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "data"))):
                b = Block(data)
                raw = b.all_tokens().tobytes()
                cuts = (4 * b.token_at).tolist()
                docs = [raw[x:y] for x, y in zip(cuts, cuts[1:])]
                n = len(docs)
                columns = [pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(b.doc_ids, pa.int64()), pa.array(b.token_at[:-1]), pa.array(np.diff(b.token_at)), pa.array(list(map(zlib.crc32, docs)), pa.int64())]
                names = ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array(docs, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    decoded = blocks.select("part", "block", "data").mapInArrow(run, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    # Ids before a block: those of earlier parts, one row a partition, and of earlier blocks of its part.
    sizes = blocks.select("part", "block", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("part_before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("block_before")).join(parts, "part")
    before = before.select("part", "block", (F.col("part_before") + F.col("block_before")).alias("before"))
    out = decoded.join(before, ["part", "block"])
    return out.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    return read_tokens(written_tokens(table(spark, sf_dir, "documents")), ids=False)
