"""SimHash near-duplicate classes by the generalised pigeonhole principle.

Fingerprints that differ in at most ``tau`` bits are linked; a class is what links reach.
The 64 bits are grouped into m parts, correlated bits together, and the parts get unequal
thresholds t_i >= -1 with sum tau - m + 1 (Qin et al., 2018): two fingerprints within tau
differ in at most t_i bits of some part i. m, and the thresholds by dynamic programming, are
those with the fewest estimated probes and candidates over all distinct fingerprints. Each
part of a threshold of at least 0 is indexed by its value and probed with every value within
t_i bits; candidates are verified on all 64 bits.

Equal fingerprints are one row from the start, so a group of copies costs one fingerprint. A
bucket of over ``max_bucket`` distinct fingerprints isn't compared pair by pair: each of its
fingerprints is sent to its 65 neighbours within one bit, and fingerprints that meet there
(65 at most) are linked, which finds every pair within two bits and no other.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a null
doc_id gets its class like others and never names one unless all its members are null; repeated
rows are returned as often as they occur; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import DOCUMENTS, map_rows, table, taken
from gleaner.operators.graph import connected_components
from gleaner.sources.shared import checkpoint, written

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes of the shingles of ``width`` words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -width] + 1]).tolist()
        digest = xxhash.xxh64_digest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(rows):
        fps = np.array([fingerprint(x, width, seed) for x in rows["text"]], np.uint64).view(np.int64)
        return {"doc_id": rows["doc_id"], "fp": fps}

    return map_rows(taken(docs, "doc_id", "text"), run, "doc_id long, fp long", char_col="text")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j set, over all of them."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1 << 16):
                x = _unpacked(fp[at : at + (1 << 16)]).astype(np.float32)
                total += x.T @ x
                n += len(x)
        if n:
            flat = np.concatenate([[n], total.ravel()]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "v"])

    rows = distinct.select("fp").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 4,097 rows
    flat = np.zeros(1 + BITS * BITS)
    for k, v in rows:
        flat[k] = v
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def _unpacked(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, bit 0 the lowest."""
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width: each starts with a free bit and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda b: (corr[b, sorted(free)].max(), -b))]
        free.discard(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def thresholds(n: int, both: np.ndarray, parts: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum tau - m + 1 of the least estimated cost, and that cost.

    A part's cost at t is its probes, n times the values within t bits, and its candidate pairs, n**2
    times the chance that two fingerprints differ in at most t of its bits, from each bit's frequency.
    """
    freq = np.diag(both) / max(n, 1)
    costs = []
    for part in parts:
        differ = np.zeros(tau + 1)
        differ[0] = 1
        for b in part:
            q = 2 * freq[b] * (1 - freq[b])
            differ = differ * (1 - q) + np.concatenate([[0], differ[:-1]]) * q
        probes = np.cumsum([len(list(combinations(range(len(part)), t))) for t in range(tau + 1)])
        costs.append([0.0] + [n * float(probes[t]) + n * n * float(differ[: t + 1].sum()) / 8 for t in range(tau + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of t_i + 1
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, tau + 1):
                if used + t + 1 <= tau + 1 and (used + t + 1 not in after or c + cost[t + 1] < after[used + t + 1][0]):
                    after[used + t + 1] = (c + cost[t + 1], [*ts, t])
        best = after
    return best[tau + 1]


def plan(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are probed."""
    options = []
    for m in range(1, 2 * tau + 1):
        parts = grouped_bits(n, both, m)
        cost, ts = thresholds(n, both, parts, tau)
        options.append((cost, m, [(p, t) for p, t in zip(parts, ts) if t >= 0]))
    return min(options)[2]


def _entries(distinct: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, own): one row for each indexed part, and one for each other value that it probes."""
    rows = []
    for i, (bits, t) in enumerate(chosen):
        mask = sum(1 << b for b in bits)
        flips = [0] + [sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(bits, k)]
        signed = [x - (1 << 64) if x >> 63 else x for x in (mask, *flips)]
        value = F.col("fp").bitwiseAND(F.lit(signed[0]))
        if t == 0:
            rows.append(distinct.select(F.lit(i).alias("part"), value.alias("value"), "fp", F.lit(True).alias("own")))
        else:
            flip = F.explode(F.array(*map(F.lit, signed[1:])))
            probes = distinct.select("fp", value.alias("v"), flip.alias("flip"))
            rows.append(probes.select(F.lit(i).alias("part"), F.col("v").bitwiseXOR(F.col("flip")).alias("value"), "fp", (F.col("flip") == 0).alias("own")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _verified(entries: DataFrame, tau: int) -> DataFrame:
    """(a, b): links that reach what all pairs of a bucket within tau bits reach. Reads sorted buckets
    one after another; a bucket has a bounded number of rows."""
    import pyarrow as pa

    def links(own: np.ndarray, every: np.ndarray) -> list[tuple[int, int]]:
        """One link for each two groups that a pair within tau bits joins; own is part of every, both sorted."""
        if len(every) == 2:
            a, b = every.tolist()
            return [(a, b)] if len(own) and (a ^ b).bit_count() <= tau else []
        out, label = [], np.arange(len(every))
        for p in np.searchsorted(every, own):
            near = np.nonzero(np.bitwise_count(every ^ every[p]) <= tau)[0]
            groups, first = np.unique(label[near], return_index=True)
            if len(groups) > 1:
                out += [(int(every[p]), int(every[near[k]])) for g, k in zip(groups, first) if g != label[p]]
                label[np.isin(label, groups)] = groups[0]
        return out

    def run(batches):
        key, own, every = None, [], []
        out: list[tuple[int, int]] = []

        def closed():
            if len(every) > 1:
                out.extend(links(np.unique(np.array(own, np.uint64)), np.unique(np.array(every, np.uint64))))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            part, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value"))
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            mine = batch.column("own").to_numpy(zero_copy_only=False)
            edge = np.nonzero((np.diff(value) != 0) | (np.diff(part) != 0))[0] + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            # Buckets of one row inside the batch have no pair.
            keep = (ends - starts > 1) | (starts == 0) | (ends == len(fp))
            for a, b in zip(starts[keep].tolist(), ends[keep].tolist()):
                k = (int(part[a]), int(value[a]))
                if k != key:
                    closed()
                    key, own, every = k, [], []
                own.extend(fp[a:b][mine[a:b]].tolist())
                every.extend(fp[a:b].tolist())
            if out:
                yield _pairs(pa, out)
                out = []
        closed()
        if out:
            yield _pairs(pa, out)

    return entries.repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(run, "a long, b long")


def _pairs(pa, out):
    both = np.array(out, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _met(distinct: DataFrame) -> DataFrame:
    """(a, b): links that reach all pairs within two bits, through the values within one bit of each."""
    flips = [0] + [(1 << b) - ((1 << 64) if b == 63 else 0) for b in range(BITS)]
    spread = distinct.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    spread = spread.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    first = spread.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    return spread.join(first, "at").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_links(distinct: DataFrame, tau: int = 2, max_bucket: int = 2048) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``distinct(fp)``; what they reach is what all pairs within tau reach."""
    n, both = bit_statistics(distinct)
    if n < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    entries = _entries(distinct, plan(n, both, tau))
    if tau != 2:
        return _verified(entries, tau)
    hot = checkpoint(entries.groupBy("part", "value").count().where(F.col("count") > max_bucket).select("part", "value"))
    if hot.isEmpty():
        return _verified(entries, tau)
    rest = entries.join(hot, ["part", "value"], "left_anti")
    crowded = entries.join(hot, ["part", "value"], "left_semi").select("fp").distinct()
    return _verified(rest, tau).unionByName(_met(crowded))


def near_duplicates(docs: DataFrame, tau: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    fps = written(fingerprints(docs, width, seed), "simhash")
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(distinct.select("fp"), tau))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = checkpoint(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays (an empty text is one of a class, too; an empty table stays empty): the one whose doc_id names it. Of repeated rows with that
    doc_id the smallest (text, source, lang, n_chars) stays; rows of a null doc_id stay as they are."""
    docs = docs.select(*DOCUMENTS)
    named = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(named, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("d"))
    kept = kept.select("doc_id", "d.text", "d.lang", "d.source", "d.n_chars")
    return kept.unionByName(docs.where("doc_id is null"))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
