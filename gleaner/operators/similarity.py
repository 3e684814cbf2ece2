"""Nearest vectors in blocks, rule-based neighbours, and diversity scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import dot, norm
from gleaner.sources.shared import Scratch, checkpoint

BLOCK = 4096


def unit(v: Column) -> Column:
    x = v.cast("array<double>")
    return F.transform(x, lambda e: e / norm(x))


def weighted_groups(v: Column, groups: list[tuple[int, int, float]]) -> Column:
    """Parts (start, width, weight) each scaled to norm sqrt(weight): the inner product of two is their weighted similarity."""

    def part(start: int, width: int, weight: float) -> Column:
        return F.transform(unit(F.slice(v, start + 1, width)), lambda e: e * F.lit(float(np.sqrt(weight))))

    return F.concat(*[part(*g) for g in groups])


def _packed(rows: DataFrame, block: str) -> DataFrame:
    n = rows.count()
    bucket = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (BLOCK // 2)))))
    return rows.groupBy(bucket.alias(block)).agg(F.collect_list(F.struct("id", "v")).alias(f"{block}_rows"))


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, rank, neighbour, score): for each query the k rows (id, v) of the largest inner product but itself, ties to smaller ids.
    Both sides are packed into blocks of about BLOCK / 2 rows; blocks meet blocks, never rows rows."""

    def run(batches):
        for batch in batches:
            for q, x in zip(batch.column("q_rows"), batch.column("x_rows")):
                qi, xi = (c.values.field("id").to_numpy(zero_copy_only=False) for c in (q, x))
                qv, xv = (np.stack(c.values.field("v").to_numpy(zero_copy_only=False)) for c in (q, x))
                score = qv @ xv.T
                score[qi[:, None] == xi[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(xi, score.shape), -score), axis=1)[:, :k]
                got = np.take_along_axis(score, top, 1)
                ok = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, ok.sum(1))), pa.array(xi[top][ok]), pa.array(got[ok])], names=["id", "neighbour", "score"])

    met = _packed(queries, "q").crossJoin(_packed(rows, "x")).mapInArrow(run, "id long, neighbour long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbour", "score")


def linked(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links that connect what all pairs of rows (id, v) with an inner product of ``least`` or more connect.
    Each pair of blocks compares all its pairs and gives spanning links of them, fewer than it has rows."""

    def run(batches):
        for batch in batches:
            for q, x in zip(batch.column("q_rows"), batch.column("x_rows")):
                qi, xi = (c.values.field("id").to_numpy(zero_copy_only=False) for c in (q, x))
                qv, xv = (np.stack(c.values.field("v").to_numpy(zero_copy_only=False)) for c in (q, x))
                near = qv @ xv.T >= least
                a, b = [], []
                new, todo = np.ones(len(xi), bool), np.ones(len(qi), bool)
                for first in range(len(qi)):
                    stack = [first] if todo[first] else []
                    todo[first] = False
                    while stack:
                        k = stack.pop()
                        for j in np.nonzero(near[k] & new)[0]:
                            new[j] = False
                            more = np.nonzero(near[:, j] & todo)[0]
                            todo[more] = False
                            stack += more.tolist()
                            a += [qi[k], *qi[more]]
                            b += [xi[j]] * (1 + len(more))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    blocks = _packed(rows, "q")
    met = blocks.join(blocks.select(F.col("q").alias("x"), F.col("q_rows").alias("x_rows")), F.col("q") <= F.col("x"))
    return met.select("q_rows", "x_rows").mapInArrow(run, "a long, b long").where("a <> b")


def rule_score(same_verb: Column, difference: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(same_verb, 0.95).otherwise(0.79) - F.least(F.lit(0.14), F.abs(difference) * 0.002))


# What the product says of a neighbour.
OTHER_STYLE = "Same annotation, different execution style"
SIMILAR_MOTION = "Visually similar motion pattern"
SAME_FAMILY = "Same action family with a related motion signature"


def stated_neighbours(selected: DataFrame, segs: DataFrame) -> DataFrame:
    """(sid, id, similarity, explanation, place): each stated neighbour that is a segment of another video, as often as it
    is stated; of segments with equal ids the last counts."""
    by_id = segs.groupBy("id").agg(F.max_by(F.struct("video_id", "verb"), "pos").alias("n"))
    each = selected.select(F.col("id").alias("sid"), F.col("video_id").alias("svideo"), F.col("verb").alias("sverb"), F.posexplode("neighbors").alias("place", "stated"))
    met = each.withColumn("id", F.col("stated.segment_id")).join(by_id, "id").where("n.video_id <> svideo")
    told = F.coalesce(F.nullif("stated.explanation", F.lit("")), F.when(F.col("n.verb") == F.col("sverb"), OTHER_STYLE).otherwise(SIMILAR_MOTION))
    return met.select("sid", "id", F.col("stated.similarity").alias("similarity"), told.alias("explanation"), F.col("place").cast("long").alias("place"))


#: Rows of a part in which the nearest percentiles are looked up.
PART = 20_000


def _firsts(segs: DataFrame, most: int, named: int) -> DataFrame:
    """The segments that can be among the first ``most`` of a selected one: of equal verb, cluster and percentile so many by
    place that ``most`` are left whichever video and ``named`` + 1 ids are passed over. What is dropped has as many before
    it in every case."""
    for more, n in ((["video_id", "id"], most), (["video_id"], most * (named + 2)), (["id"], 2 * most), ([], most * (3 * named + 5))):
        place = F.row_number().over(Window.partitionBy("verb", "cluster", "pct", *more).orderBy("pos"))
        segs = segs.withColumn("nth", place).where(F.col("nth") <= n).drop("nth")
    return segs


def _look(most: int, apart: list[str]):
    """For asked rows and segments of one part the first ``most`` found, and how far the part reaches to either side: the
    distance of its last segment of the key, or infinity where another key follows."""

    def run(q, x):
        import pandas as pd

        x = x.sort_values(["key", "pct", "pos"])
        keys, pct, pos, ids, videos = x["key"].to_numpy(), x["pct"].to_numpy(float), x["pos"].to_numpy(), x["id"].to_numpy(), x["video_id"].to_numpy()
        others = [(x[c].to_numpy(), q[c].tolist()) for c in apart]
        begins = {k: (int(i), int(i + n)) for k, i, n in zip(*np.unique(keys, return_index=True, return_counts=True))} if len(x) else {}
        out = {c: [] for c in ("nr", "found", "low", "high")}
        for row, (nr, key, p, own, video, named) in enumerate(zip(q["nr"], q["key"], q["pct"].to_numpy(float), q["id"], q["video_id"], q["named"])):
            at = int(np.searchsorted(keys, key)) if len(x) and key not in begins else 0
            lo, hi = begins.get(key, (at, at))
            at, width, not_these = lo + int(np.searchsorted(pct[lo:hi], p)), 64, {own, *named}
            while True:
                a, b = max(lo, at - width), min(hi, at + width)
                ok = videos[a:b] != video
                for values, mine in others:
                    ok &= values[a:b] != mine[row]
                i = a + np.nonzero(ok)[0]
                i = i[np.fromiter((v not in not_these for v in ids[i]), bool, len(i))]
                far = np.abs(pct[i] - p)
                first = np.lexsort((pos[i], far))[:most]
                whole = a == lo and b == hi
                beyond = min(np.inf if a == lo else p - pct[a - 1], np.inf if b == hi else pct[b] - p)
                if whole or len(first) == most and far[first[-1]] < beyond:
                    break
                width *= 4
            low, high = (p - pct[lo], pct[hi - 1] - p) if hi > lo else (0.0, 0.0)
            out["nr"].append(nr)
            out["found"].append([{"difference": d, "pos": o, "id": v} for d, o, v in zip(far[first].tolist(), pos[i[first]].tolist(), ids[i[first]])])
            out["low"].append(np.inf if lo > 0 else max(low, 0.0) if low == low else 0.0)
            out["high"].append(np.inf if hi < len(x) else max(high, 0.0) if high == high else 0.0)
        return pd.DataFrame(out, dtype=object)

    return run


def _nearest_in(asked: DataFrame, rows: DataFrame, most: int, key: list[str], apart: list[str], scratch: Scratch) -> DataFrame:
    """(nr, found): for each asked row the first ``most`` rows by difference of percentile and place, of those that share
    its ``key`` and differ from it in ``apart``, video and id. Both lie in parts by key and percentile; whoever can still
    find nearer rows beyond its part looks into the next ones, then into twice as many."""
    told = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)))
    named = F.concat(F.lit(""), *map(told, key)).alias("key")
    columns = ["pct", "id", "video_id", "verb", "cluster"]
    segs = rows.select(named, *columns, "pos", F.lit(None).cast("long").alias("nr"), F.lit(None).cast("array<string>").alias("named"))
    both = segs.unionByName(asked.select(named, *columns, F.lit(None).cast("long").alias("pos"), "nr", "named"))
    dealt = both.repartitionByRange(max(1, both.count() // PART), "key", "pct").withColumn("part", F.spark_partition_id())
    dealt = scratch.written(dealt, "parts")
    x, last = dealt.where("nr is null").select("part", "key", *columns, "pos"), dealt.agg(F.max("part")).first()[0]
    queries = dealt.where("nr is not null").select("nr", "key", *columns, "named", F.col("part").alias("home"))
    kind = "array<struct<difference: double, pos: long, id: string>>"
    looks, state, reach = scratch.written(queries.withColumn("part", F.col("home")), "looks"), None, 0
    infinite = F.lit(float("inf"))
    while True:
        # A part's asked rows are dealt out where they are many.
        crowd = F.broadcast(looks.groupBy("part").agg(F.ceil(F.count("*") / PART).cast("int").alias("salts")))
        by = looks.join(crowd, "part").withColumn("salt", F.pmod(F.xxhash64("nr"), "salts").cast("int")).drop("salts")
        some = x.join(crowd, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        got = by.groupBy("part", "salt").cogroup(some.groupBy("part", "salt")).applyInPandas(_look(most, apart), f"nr long, found {kind}, low double, high double")
        if state is not None:
            got = got.unionByName(state)
        merged = got.groupBy("nr").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, most).alias("found"), F.max("low").alias("low"), F.max("high").alias("high"))
        state = scratch.written(merged, "state")
        far = F.when(F.size("found") < most, infinite).otherwise(F.element_at("found", -1)["difference"])
        before = (F.col("low") < infinite) & (far >= F.col("low")) & (F.col("home") > reach)
        after = (F.col("high") < infinite) & (far >= F.col("high")) & (F.col("home") + reach < last)
        more = 2 * reach + 1
        none = F.array().cast("array<int>")
        left = F.when(before, F.sequence(F.greatest(F.lit(0), F.col("home") - more), F.col("home") - reach - 1)).otherwise(none)
        right = F.when(after, F.sequence(F.col("home") + reach + 1, F.least(F.lit(last), F.col("home") + more))).otherwise(none)
        looks = scratch.written(queries.join(state, "nr").select(*queries.columns, F.explode(F.concat(left, right)).alias("part")), "looks")
        if looks.isEmpty():
            return state.select("nr", "found")
        reach = more


def _candidates(selected: DataFrame, segs: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(sid, id, nth, same_verb, same_cluster, difference): the first ``most`` segments of other videos that are not stated
    for each selected one, by same verb, other cluster, nearest percentile and place. Each kind of verb and cluster is
    looked up by percentile, for those only that the kinds before left short."""
    values = "id", "video_id", "verb", "cluster", F.col("distinctiveness_percentile").cast("double").alias("pct")
    asked = scratch.written(selected.select(F.monotonically_increasing_id().alias("nr"), *values, F.transform("neighbors", lambda n: n["segment_id"]).alias("named")), "asked")
    named = asked.agg(F.max(F.size("named"))).first()[0] or 0
    rows = scratch.written(_firsts(segs.select(*values, "pos"), most, named), "firsts")
    short, out = asked.withColumn("got", F.lit(0)), []
    kinds = (["verb"], ["cluster"]), (["verb", "cluster"], []), ([], ["verb", "cluster"]), (["cluster"], ["verb"])
    for key, apart in kinds:
        near = short.join(_nearest_in(short, rows, most, key, apart, scratch), "nr")
        each = near.select(F.col("id").alias("sid"), "got", F.posexplode("found").alias("place", "f"))
        each = each.select("sid", F.col("f.id").alias("id"), (F.col("got") + F.col("place") + 1).alias("nth"), F.lit("verb" in key).alias("same_verb"), F.lit("cluster" in key).alias("same_cluster"), F.col("f.difference").alias("difference"))
        out.append(each.where(F.col("nth") <= most))
        short = scratch.written(near.withColumn("got", F.col("got") + F.size("found")).where(F.col("got") < most).drop("found"), "short")
        if short.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def similar_segments(selected: DataFrame, segs: DataFrame, limit: int = 5) -> DataFrame:
    """(segment_id, neighbour_id, similarity, explanation, source, rank): stated neighbours first, filled up to ``limit`` rows
    by candidates of other videos: same verb first, then another cluster, then the nearest percentile, then input order;
    the result is ordered by similarity. Neighbours stated twice count twice."""
    scratch = Scratch(segs.sparkSession)
    stated = stated_neighbours(selected, segs)
    kept = stated.groupBy("sid").agg(F.collect_set("id").alias("met"), F.count("*").alias("have"))
    # Stated ids that are no segment of another video stay candidates.
    named = selected.drop("neighbors").join(kept.select(F.col("sid").alias("id"), "met"), "id", "left")
    named = named.withColumn("neighbors", F.transform(F.coalesce("met", F.array().cast("array<string>")), lambda i: F.struct(i.alias("segment_id"))))
    near = _candidates(named, segs, limit, scratch).join(kept.select("sid", "have"), "sid", "left")
    near = near.where(F.col("nth") + F.coalesce("have", F.lit(0)) <= limit)
    told = F.when(F.col("same_verb") & ~F.col("same_cluster"), OTHER_STYLE).otherwise(SAME_FAMILY)
    fill = near.select("sid", "id", rule_score(F.col("same_verb"), F.col("difference")).alias("similarity"), told.alias("explanation"), F.col("nth").cast("long").alias("place"), F.lit("rule").alias("source"))
    both = stated.withColumn("source", F.lit("stated")).unionByName(fill)
    last = Window.partitionBy("sid").orderBy(F.desc("similarity"), F.desc("source"), "place")
    out = both.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit)
    out = checkpoint(out.select(F.col("sid").alias("segment_id"), F.col("id").alias("neighbour_id"), "similarity", "explanation", "source", "rank"))
    scratch.remove()  # the checkpoint has the results
    return out


def gramians(rows: DataFrame, dim: int) -> DataFrame:
    """(grp, n, k, value): sums of outer products of unit vectors (grp, v) by group, as dim * dim entries. One pass; each task
    sends one matrix a group that it has."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(float) if batch.num_rows else np.zeros((0, dim))
            for g in np.unique(groups):
                own = x[groups == g]
                n, s = total.get(g, (0, np.zeros((dim, dim))))
                total[g] = n + len(own), s + own.T @ own
        for g, (n, s) in total.items():
            k = np.arange(dim * dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g, np.int64)), pa.array(np.full(len(k), n, np.int64)), pa.array(k), pa.array(s.ravel())], names=["grp", "n", "k", "value"])

    parts = rows.select("grp", "v").mapInArrow(run, "grp long, n long, k int, value double")
    return parts.groupBy("grp", "k").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def vendi_order_two(rows: DataFrame, dim: int) -> DataFrame:
    """(grp, n, vendi): n squared over the sum of squared similarities, which is the Gramian's squared norm."""
    g = gramians(rows, dim)
    return g.groupBy("grp").agg(F.max("n").alias("n"), F.sum(F.col("value") * F.col("value")).alias("s")).select("grp", "n", (F.col("n") * F.col("n") / F.col("s")).alias("vendi"))


def _matrix_of(rows) -> tuple[int, np.ndarray]:
    """A group's number of rows and its Gramian, from (n, k, value)."""
    m = np.zeros(int(len(rows) ** 0.5) ** 2)
    m[rows["k"].to_numpy()] = rows["value"].to_numpy()
    return int(rows["n"].iloc[0]), m.reshape(int(len(m) ** 0.5), -1)


def contributions(rows: DataFrame, dim: int) -> DataFrame:
    """(grp, id, contribution): by how much a group's order-two score falls without the row (id, grp, v). Every group is
    solved where its matrix is, which is one row of dim * dim numbers; rows meet it by a join, however many groups there are."""
    g = gramians(rows, dim)
    flat = g.groupBy("grp").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda e: e["value"]).alias("m"))
    # Rows are dealt out in parts, so that a hot group is not one task.
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // 20_000))
    salted = rows.select("grp", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("salt"), "id", "v")
    some = salted.select(F.col("grp").alias("of_grp"), F.col("salt").alias("of_salt")).distinct()
    some = some.join(flat.withColumnRenamed("grp", "of_grp"), "of_grp")

    def solve(own, matrix):
        import pandas as pd

        if not len(own):
            return pd.DataFrame({"grp": [], "id": [], "contribution": []})
        n, m = int(matrix["n"].iloc[0]), np.array(matrix["m"].iloc[0], float).reshape(dim, dim)
        x = np.stack(own["v"].to_numpy()).astype(float)
        s, r, k = (m * m).sum(), np.einsum("ij,jk,ik->i", x, m, x), (x * x).sum(1)
        rest = s - 2 * r + k * k
        without = np.divide((n - 1) ** 2, rest, out=np.zeros(len(x)), where=(n > 1) & (rest > 1e-12))
        return pd.DataFrame({"grp": own["grp"], "id": own["id"], "contribution": n * n / s - without})

    return salted.groupBy("grp", "salt").cogroup(some.groupBy("of_grp", "of_salt")).applyInPandas(solve, "grp long, id long, contribution double")


def vendi_exact(rows: DataFrame, dim: int) -> DataFrame:
    """(grp, n, vendi, logdet): the exponential of the entropy of the kernel's eigenvalues, from the Gramian, which has the same
    non-zero ones; logdet is of the identity plus the Gramian over n. One group's matrix is solved in one place."""

    def solve(own):
        import pandas as pd

        n, m = _matrix_of(own)
        lam = np.clip(np.linalg.eigvalsh(m / n), 0, None)
        lam = lam[lam > 1e-15]
        return pd.DataFrame({"grp": [int(own["grp"].iloc[0])], "n": [n], "vendi": [float(np.exp(-(lam * np.log(lam)).sum()))], "logdet": [float(np.linalg.slogdet(np.eye(dim) + m / n)[1])]})

    return gramians(rows, dim).groupBy("grp").applyInPandas(solve, "grp long, n long, vendi double, logdet double")


def weighted_vendi(scores: DataFrame) -> DataFrame:
    """(n, vendi): the mean of the groups' scores (grp, n, vendi), weighted by their sizes."""
    return scores.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("vendi")) / F.sum("n")).alias("vendi"))


def greedy(rows: DataFrame, share: float, dim: int, most: int = 20_000) -> DataFrame:
    """(id, step, vendi, total): rows (id, v, hours) in the order in which they raise the order-two score of what is chosen
    the most, ties to smaller ids, while the hours stay within ``share`` of all. A row that does not fit is passed over.

    Each step depends on all before it, so the vectors come together in one place: at most ``most`` of them, else
    ValueError. Choose representatives first where there are more.
    """
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows; choose representatives first")

    def solve(own):
        import pandas as pd

        own = own.sort_values("id").reset_index(drop=True)
        x, hours = np.stack(own["v"].to_numpy()).astype(float), own["hours"].to_numpy(float)
        left, total, budget = np.ones(len(x), bool), 0.0, share * hours.sum()
        m, s, out, square = np.zeros((dim, dim)), 0.0, [], (x * x).sum(1) ** 2
        r = np.zeros(len(x))  # sums of squared similarities to what is chosen
        while True:
            fits = left & (total + hours <= budget + 1e-9)
            if not fits.any():
                break
            k = len(out) + 1
            score = np.where(fits, k * k / np.maximum(s + 2 * r + square, 1e-300), -np.inf)
            i = int(np.argmax(np.round(score, 9)))
            s += 2 * r[i] + square[i]
            total += hours[i]
            left[i] = False
            r += (x @ x[i]) ** 2
            out.append((int(own["id"][i]), k, float(k * k / s), float(total)))
        return pd.DataFrame(out, columns=["id", "step", "vendi", "total"])

    return rows.select("id", "v", "hours", F.lit(1).alias("one")).groupBy("one").applyInPandas(solve, "id long, step long, vendi double, total double")


def medoids(rows: DataFrame) -> DataFrame:
    """(grp, id, total): the row of each group with the largest sum of similarities to the others, ties to smaller ids.
    The sum over all others is one inner product with the group's sum vector."""
    sums = rows.select("grp", F.posexplode("v").alias("k", "x")).groupBy("grp", "k").agg(F.sum("x").alias("x"))
    center = sums.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("c"))
    total = rows.join(center, "grp").select("grp", "id", F.round(dot(F.col("v"), F.col("c")) - dot(F.col("v"), F.col("v")), 6).alias("total"))
    return total.groupBy("grp").agg(F.max(F.struct("total", (-F.col("id")).alias("i"))).alias("m")).select("grp", (-F.col("m.i")).alias("id"), F.col("m.total").alias("total"))


def entropy_vendi(rows: DataFrame, key: str) -> DataFrame:
    """(n, vendi): the exponential of the entropy of the key's histogram."""
    counts = rows.groupBy(key).agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s")).select("n", F.exp(F.log("n") - F.col("s") / F.col("n")).alias("vendi"))
