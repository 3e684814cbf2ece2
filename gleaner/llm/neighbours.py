"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``tables`` hash tables applies fast Hadamard pseudo-rotations (three rounds of random signs and a
Walsh-Hadamard transform) to the unit vector and takes the nearest signed axis; with ``hashes`` > 1 a bucket is
a tuple of such axes. A query probes the buckets of its ``probes`` nearest axes in each table. Candidates are
scored exactly, on the original vectors in double precision, where index and query rows of a bucket meet.

Equal vectors are one class from the start: of a class only the k + 1 smallest ids can be among the k nearest of
any query, so these are carried and a crowd of copies is no crowd in a bucket. Buckets of over ``block_rows``
index rows or queries are split into blocks, so that none is gathered whole. The number of probes is measured:
the neighbours of at most ``sample`` queries are found by brute force over all rows, and the fewest probes that
reach ``recall`` on them are taken. All rows are indexed.

Defined cases: vectors that are null, of norm zero, with null or non-finite components, or not of the table's
most frequent length take no part, nor do rows without vec_id; repeated rows count once; ties go to smaller ids; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.sources.shared import checkpoint, written


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows, a power of two long, scaled to keep norms."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """Bucket numbers; the same seed gives the same rotations on every worker."""

    def __init__(self, dim: int, tables: int = 8, hashes: int = 1, seed: int = 7):
        self.dim, self.tables, self.hashes = dim, tables, hashes
        self.width = 1 << max(0, dim - 1).bit_length()
        self.axes = 2 * self.width
        self.buckets = self.axes**hashes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def closeness(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, hashes, axes): the inner product of each rotated row with each signed axis."""
        unit = np.zeros((len(x), self.width))
        unit[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = np.empty((len(x), self.tables, self.hashes, self.axes), np.float32)
        for t in range(self.tables):
            for h in range(self.hashes):
                y = reduce(lambda v, s: hadamard(v * s), self.signs[t, h], unit)
                out[:, t, h, 0::2], out[:, t, h, 1::2] = y, -y
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row within each table."""
        near = self.closeness(x).argmax(3)
        return reduce(lambda a, h: a * self.axes + near[:, :, h], range(self.hashes), np.zeros(near.shape[:2], np.int64))

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """(rows, tables, probes): buckets from the nearest on, ``most`` at most. Memory is bounded by blocks of rows."""
        most = min(most, self.buckets)
        # The i-th best of what there is so far and the j-th best axis can be among the ``most`` best together only if
        # (i + 1) * (j + 1) is at most ``most``.
        size = self.tables * (self.axes * self.hashes + 4 * most * (1 + int(np.log(most))))
        block = max(1, (1 << 22) // size)
        return np.concatenate([self._order(x[at : at + block], most) for at in range(0, len(x), block)]) if len(x) else np.zeros((0, self.tables, most), np.int64)

    def _order(self, x: np.ndarray, most: int) -> np.ndarray:
        c = self.closeness(x)
        per = min(self.axes, most)
        score = code = None
        for h in range(self.hashes):
            axis = np.argsort(-c[:, :, h], axis=2, kind="stable")[:, :, :per]
            value = np.take_along_axis(c[:, :, h], axis, 2)
            if score is None:
                score, code = value, axis.astype(np.int64)
                continue
            pairs = [(i, j) for i in range(min(most, score.shape[2])) for j in range(min(per, most // (i + 1)))]
            i, j = np.array(pairs).T
            both = score[..., i] + value[..., j]
            best = np.argsort(-both, axis=2, kind="stable")[:, :, :most]
            score = np.take_along_axis(both, best, 2)
            code = np.take_along_axis(code[..., i] * self.axes + axis[..., j], best, 2)
        return code


def _vectors(df: DataFrame, dim: int, every: int) -> DataFrame:
    """(vec_id, key, vec, query): valid rows; key names equal vectors."""
    kind = "<f4" if df.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for batch in batches:
            ids, keys, vecs = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not v.is_valid or len(v) != dim or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                if np.isfinite(x).all() and x.any():
                    raw = x.astype(kind).tobytes()
                    ids.append(i)
                    vecs.append(raw)
                    keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            n = np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(n % every == 0)], names=["vec_id", "key", "vec", "query"])

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, key binary, vec binary, query boolean")


def _matrix(raw, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row: the same two vectors give the same number wherever they stand."""
    return (q * x).sum(1)


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(key, vec, ids, query): distinct vectors with their k + 1 smallest ids; query if one of their ids asks."""
    rank = F.dense_rank().over(Window.partitionBy("key", "query").orderBy("vec_id"))
    least = vectors.withColumn("_r", rank).where(F.col("_r") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    return least.groupBy("key").agg(F.first("vec").alias("vec"), ids.alias("ids"), F.max("query").alias("query"))


def measured_probes(classes: DataFrame, lsh: CrossPolytope, kind: str, k: int, recall: float, sample: int) -> int:
    """The fewest probes a table by which the k nearest classes of the sampled queries are met with the given recall.

    The driver gets the buckets of k classes for each sampled query; workers hold the sampled queries and a batch. Probes
    are doubled until they reach the recall, and only as many buckets are ever ranked.
    """
    asked = classes.where("query").orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").collect()
    if not asked:
        return 1
    dim = lsh.dim
    q = _matrix([r[0] for r in asked], dim, kind)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column("vec").slice(at, 4096).to_pylist(), dim, kind)
                score, codes = q @ x.T, lsh.codes(x)
                top = np.argsort(-score, axis=1)[:, : k + 1]
                who, near = np.repeat(np.arange(len(q), dtype=np.int32), top.shape[1]), top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(score[who, near]), pa.array(codes[near].tolist(), pa.list_(pa.int64()))], names=["q", "score", "codes"])

    found = classes.select("vec").mapInArrow(run, "q int, score double, codes array<long>")
    nearest = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n").between(2, k + 1))
    rows = nearest.select("q", "codes").collect()  # k for each sampled query
    if not rows:
        return 1
    of = np.array([r[0] for r in rows])
    codes = np.array([r[1] for r in rows])
    most = 1
    while True:
        rank = np.full(len(rows), lsh.buckets, np.int64)
        for i in range(len(q)):
            own = np.nonzero(of == i)[0]
            hit = lsh.order(q[i : i + 1], most)[0][None, :, :] == codes[own][:, :, None]
            place = np.where(hit.any(2), hit.argmax(2), lsh.buckets)
            rank[own] = place.min(1)
        least = int(np.sort(rank)[max(0, int(np.ceil(recall * len(rows))) - 1)])
        if least < most or most >= lsh.buckets:
            return min(least + 1, lsh.buckets)
        most *= 2


def _blocks(entries: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """``entries`` in their block of their bucket's ``own`` blocks, once for each of the ``other`` blocks."""
    both = entries.join(sizes, "bucket", "left")
    mine = F.pmod(F.xxhash64("key"), F.coalesce(own, F.lit(1)))
    return both.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).select(*entries.columns, "xb", "qb")


def nearest(df: DataFrame, every: int = 20, k: int = 20, tables: int = 8, hashes: int | None = None, recall: float = 0.95, sample: int = 128, block_rows: int = 8192, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each vec_id divisible by ``every``, itself left out."""
    spark = df.sparkSession
    lengths = df.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count()
    common = lengths.orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    dim = common["n"]
    kind = "<f4" if df.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = written(_vectors(df, dim, every), "vectors")
    classes = checkpoint(_classes(vectors, k))
    if hashes is None:  # about block_rows / 2 rows a bucket at most, if buckets are even, however many rows there are
        n, axes, hashes = classes.count(), 2 * (1 << max(0, dim - 1).bit_length()), 1
        while n > axes**hashes * block_rows // 2:
            hashes += 1
    lsh = CrossPolytope(dim, tables, hashes)
    m = probes or measured_probes(classes, lsh, kind, k, recall, sample)

    def entries(asking: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    x = _matrix(part.column("vec").to_pylist(), dim, kind)
                    codes = lsh.order(x, m) if asking else lsh.codes(x)[:, :, None]
                    bucket = (codes + (np.arange(tables) * lsh.buckets)[None, :, None]).reshape(len(x), -1)
                    row = pa.array(np.repeat(np.arange(len(x)), bucket.shape[1]))
                    names = ["key", "vec"] if asking else ["key", "vec", "ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), *[part.column(c).take(row) for c in names]], names=["bucket", *names])

        return run

    index = classes.select("key", "vec", "ids").mapInArrow(entries(False), "bucket long, key binary, vec binary, ids array<long>")
    asked = classes.where("query").select("key", "vec").mapInArrow(entries(True), "bucket long, key binary, vec binary")
    counts = index.groupBy("bucket").agg(F.count("*").alias("x")).join(asked.groupBy("bucket").agg(F.count("*").alias("q")), "bucket")
    crowded = counts.where((F.col("x") > block_rows) | (F.col("q") > block_rows))
    sizes = checkpoint(crowded.select("bucket", F.ceil(F.col("x") / block_rows).cast("int").alias("xb"), F.ceil(F.col("q") / block_rows).cast("int").alias("qb")))
    if sizes.isEmpty():
        index, asked = (e.withColumn("xb", F.lit(0)).withColumn("qb", F.lit(0)) for e in (index, asked))
    else:
        index, asked = _blocks(index, sizes, "xb", "qb"), _blocks(asked, sizes, "qb", "xb")

    def rerank(key, own, other):
        import pandas as pd

        out = {"key": [], "score": [], "ids": []}
        if len(own) and len(other):
            x, ids = _matrix(own["vec"], dim, kind), [list(map(int, i)) for i in own["ids"]]
            first = np.array([i[0] for i in ids])
            for at in range(0, len(other), 256):
                some = other.iloc[at : at + 256]
                q, names = _matrix(some["vec"], dim, kind), some["key"].tolist()
                score = q @ x.T
                if len(x) > k + 1:
                    floor = -np.partition(-score, k, axis=1)[:, k]
                    score = score >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None]  # and what rounding may hide
                else:
                    score = np.ones_like(score, bool)
                a, b = np.nonzero(score)
                exact = _exact(q[a], x[b])
                order = np.lexsort((first[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                for i, j, s in zip(a[nth <= k].tolist(), b[nth <= k].tolist(), exact[nth <= k].tolist()):
                    out["key"].append(names[i])
                    out["score"].append(s)
                    out["ids"].append(ids[j])
        return pd.DataFrame({"key": out["key"], "score": out["score"], "ids": pd.Series(out["ids"], dtype=object)})

    by = ["bucket", "xb", "qb"]
    met = index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(rerank, "key binary, score double, ids array<long>")
    # The k + 1 best classes of a query, from each block first and from all then; the same class met in several tables has
    # the same rank, so that no more than tables * (k + 1) entries come together, however many blocks there are.
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    met = met.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= k + 1)
    best = met.groupBy("key").agg(F.collect_set(F.struct((-F.col("score")).alias("s"), "ids")).alias("c"))
    each = F.flatten(F.transform("c", lambda c: F.transform(c["ids"], lambda i: F.struct(c["s"].alias("s"), i.alias("i")))))
    best = best.select("key", F.slice(F.array_sort(each), 1, k + 1).alias("c"))
    queries = vectors.where("query").select(F.col("vec_id").alias("query_id"), "key").distinct()
    left = queries.join(best, "key").select("query_id", F.slice(F.filter("c", lambda c: c["i"] != F.col("query_id")), 1, k).alias("c"))
    out = left.select("query_id", F.posexplode("c").alias("p", "c"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("c.i").alias("vec_id"), (-F.col("c.s")).alias("score"))


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
