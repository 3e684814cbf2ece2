"""Near-duplicate passages across documents, by compact windows.

Each document is the sequence of hashes of its five-word shingles. The Cartesian tree over the hashed shingles groups
all stretches that share their minimum: a node that holds the minimum at c of the range l to r stands for every stretch
from l..c to c..r. The context of c, the shingles from c on, is a signature. Windows and contexts are so short that each
run of shingles that two passages of ``min_words`` words and ``similarity`` share without a gap (``certain_run``: 21
shingles at 50 words and 0.8) holds a whole window and the context of its minimum: such passages always have a signature
in common, by one hash function and without chance. (Text that repeats itself at an edit can lose fewer shingles to it
than assumed.)

Equal signatures make candidates; the signature's smallest row stands for the others, so that a passage of any number of
documents gives one candidate for each. A candidate is verified on the words: around the signature equal runs of both
texts are joined over gaps of at most ``min_words`` words in either, on whatever diagonal, and of the joined runs the
longest stretches of ``min_words`` words or more are kept whose five-word shingles have a Jaccard similarity of
``similarity`` or more. What a signature's smallest row does not reach is found in two more ways:

- equal passages, whole: every stretch of ``min_words`` words around a signature that is left over is a key of 128 bits.
  Rows that share one are linked through the smallest of them, so two equal passages are never lost.
- edited passages: as long as a signature has rows of several components, one of those that the first one did not reach,
  in an order by a hash, is its next leader and meets all its rows of other components, for ``rounds`` rounds or until one
  joins nothing.
- what is then left, whole (``_apart``): rows of different components that share a run of ``certain_run`` shingles around a
  signature and, beyond the end of what they have in common there, one more shingle near enough to be joined. A passage that
  is not equal throughout has both, so that every such pair of rows is verified and no two components share a passage.

Exact copies of a document are one class from the start and get its links; classes are what passages and copies connect.

Defined cases: a null, empty or shorter text has no passage; rows that repeat a doc_id, or have none, are documents of
their own, and a class is named by its smallest doc_id (null if none has one); an empty table gives an empty table; other
columns are not read. Words are split at ASCII white space, as they are written.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import map_rows, table, taken, word_count
from gleaner.operators.graph import connected_components
from gleaner.sources.shared import Scratch, checkpoint

WIDTH = 5
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    return _powers_up_to(base, 1 << max(10, n.bit_length()))[:n]


@lru_cache(maxsize=64)
def _powers_up_to(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base & (1 << 64) - 1, np.uint64)]), dtype=np.uint64)


def spans_hashed(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring values; equal values give equal hashes wherever they stand."""
    n = len(x)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(x * _powers(_B, n), dtype=np.uint64)])
    return _mix((total[width:] - total[:-width]) * _powers(_B_INVERSE, n - width + 1), width)


_SPACE = re.compile(rb"[ \t-\r]")
#: A value for each byte; white space has none.
_BYTES = np.where([bool(_SPACE.match(bytes([c]))) for c in range(256)], np.uint64(0), _mix(np.arange(256, dtype=np.uint64), 3) | np.uint64(1))
#: Bytes of a text that are hashed at once, up to the next white space.
BLOCK = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, by the bytes and their places in the word."""
    out, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + BLOCK)
        end = space.start() if space else len(text)
        x = _BYTES[np.frombuffer(text, np.uint8, end - at, at)]
        letter = np.concatenate([[False], x != 0])
        starts = np.nonzero(letter[1:] & ~letter[:-1])[0]
        if len(starts):
            sizes = np.diff(starts, append=len(x))
            place = np.arange(starts[0], len(x)) - np.repeat(starts, sizes)
            x[starts[0] :] *= _powers(_B, int(sizes.max()))[place]
            out.append(_mix(np.add.reduceat(x, starts), 7))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    return spans_hashed(_mix(words, 1), WIDTH)


def compact_windows(x: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r): nodes of the Cartesian tree over x whose range l..r has at least ``least`` values; x[c] is its minimum, the first of equals."""
    out, todo = [], [(0, len(x))]
    while todo:
        l, end = todo.pop()
        if end - l >= least:
            c = l + int(x[l:end].argmin())
            out.append((l, c, end - 1))
            todo += [(l, c), (c + 1, end)]
    return out


def certain_run(min_words: int, similarity: float) -> int:
    """Shingles in a row that two passages of ``min_words`` words and ``similarity`` share at least.

    Each of k gaps between shared runs costs one side WIDTH shingles and the other WIDTH - 1 or more (a replaced
    word, an inserted or a deleted one), so that the union bounds k by what is shared, and the k + 1 runs share that.
    """
    return max(1, min(math.ceil(shared / (k + 1) - 1e-9) for k, shared in enumerate(_shared(min_words, similarity))))


@lru_cache
def _shared(min_words: int, similarity: float) -> list[float]:
    """Shingles that two such passages share at least, by the number of gaps."""
    least, ratio = min_words - WIDTH + 1, similarity / max(1 - similarity, 1e-9)
    # Each side has at least ``least``, and both together lose no more than shared / ratio.
    return [max(2 * least / (2 + (k > 0) / ratio), ratio * (2 * WIDTH - 1) * k) for k in range(max(1, least))]


@lru_cache
def sizes(min_words: int, similarity: float) -> tuple[int, int]:
    """(window, context) in shingles: a certain run holds a whole window and the context of any minimum in it."""
    run = certain_run(min_words, similarity)
    window = (run + 1) // 2
    return window, run - window + 1


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The minimum (np.minimum) or maximum of every ``width`` neighbouring values."""
    have = 1
    while 2 * have <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def signatures(words: np.ndarray, min_words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, start): the contexts that begin at the minima of compact windows, by the shingle at which they start.

    The minima of compact windows of at least ``window`` values are those of all its stretches of just ``window``, which
    are found without the tree: a value is one if a stretch that holds it has no smaller one. Equal minima all count.
    """
    window, context = sizes(min_words, similarity)
    if len(words) < min_words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = shingles(words)
    x = _mix(s, 11)
    beside = np.zeros(window - 1, np.uint64)
    highest = _sliding(np.concatenate([beside, _sliding(x, window, np.minimum), beside]), window, np.maximum)
    key = spans_hashed(s, context)
    at = np.nonzero(highest == x)[0]
    at = at[at < len(key)]
    return key[at], at


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many values from the start are equal.

    Looks at ever longer beginnings, so that the time goes with the answer and not with the texts.
    """
    n, size = min(len(x), len(y)), 64
    while True:
        size = min(size, n)
        other = x[:size] != y[:size]
        if other.any():
            return int(other.argmax())
        if size == n:
            return n
        size *= 4


def _runs(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, gap: int, similarity: float) -> list[tuple[int, int, int]]:
    """(start in x, start in y, words): equal runs of words from the start on, joined over the nearest equal shingle (u and
    v are those of x and y) that lies at most ``gap`` words further in both, on whatever diagonal. They end where what only
    one text has outweighs what is shared, by the measure of _stretches(), by more than one such gap in both."""
    out, i, j, balance = [], 0, 0, 0.0
    while True:
        n = _reach(x[i:], y[j:])
        if n:
            out.append((i, j, n))
        balance += (1 - similarity) * max(0, n - WIDTH + 1)
        i, j = i + n, j + n
        q = v[j : j + gap + 1]
        at = np.nonzero((u[i : i + gap + 1, None] == q).ravel())[0]
        if not len(at):
            return out
        di, dj = np.divmod(at, len(q))
        best = int((di + dj).argmin())
        i, j = i + int(di[best]), j + int(dj[best])
        balance -= similarity * (int(di[best]) + int(dj[best]) + 2 * (WIDTH - 1))
        if balance < -2 * similarity * gap:
            return out


def _longest(weight: np.ndarray, cost: np.ndarray, size: np.ndarray) -> tuple[int, int] | None:
    """(first, last) of the neighbouring runs with the most words whose weights less the costs between are 0 or more."""
    # A stretch from run f to run l has the weight before[l + 1] - before[f] - (costs up to l less costs up to f).
    up = np.concatenate([[0], np.cumsum(cost)])
    low = np.cumsum(weight) - weight - up
    high = np.cumsum(weight) - up
    words = np.cumsum(size)
    firsts, best = [], None
    for f in range(len(low)):
        if not firsts or low[f] < low[firsts[-1]]:
            firsts.append(f)
    for l in range(len(high) - 1, -1, -1):
        while firsts and (firsts[-1] > l or low[firsts[-1]] <= high[l] + 1e-9):
            f = firsts.pop()
            if f <= l and (best is None or words[l] - words[f] + size[f] > words[best[1]] - words[best[0]] + size[best[0]]):
                best = (f, l)
    return best


#: Places of a signature with so many equal words on either side are tried once in a text.
BESIDE = 25


class Text:
    """A text's words (or those of a list) as hashes, its shingles, and its contexts in order of their hashes."""

    def __init__(self, text: bytes | list[bytes], min_words: int, similarity: float):
        self.words = word_hashes(text if isinstance(text, bytes) else b" ".join(text))
        self.shingles = shingles(self.words)
        self.min_words, self.similarity = min_words, similarity

    @cached_property
    def contexts(self) -> np.ndarray:
        return spans_hashed(self.shingles, sizes(self.min_words, self.similarity)[1])

    @cached_property
    def first(self) -> np.ndarray:
        """Where a shingle stands for the first time."""
        out = np.zeros(len(self.shingles), bool)
        out[self._distinct[1]] = True
        return out

    @cached_property
    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.shingles, return_index=True)

    @cached_property
    def known(self) -> np.ndarray:
        return self._distinct[0]

    @cached_property
    def around(self) -> np.ndarray:
        """For each context a hash of it and the BESIDE words on either side, also beyond the text's ends."""
        beyond = np.zeros(BESIDE, np.uint64)
        width = len(self.words) - len(self.contexts) + 1
        return spans_hashed(np.concatenate([beyond, self.words, beyond]), 2 * BESIDE + width)

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.contexts, kind="stable")

    @cached_property
    def ordered(self) -> np.ndarray:
        return self.contexts[self.order]


def _stretches(a: Text, b: Text, runs: list[tuple[int, int, int]], similarity: float) -> list[tuple[int, int, int, int]]:
    """(start, end) in a and in b of the longest stretches of neighbouring runs that reach ``similarity``."""
    out, todo = [], [(0, len(runs))]

    def long(f: int, l: int) -> bool:
        (s, t, _), (p, q, m) = runs[f], runs[l]
        return min(p + m - s, q + m - t) >= a.min_words

    def alike(f: int, l: int) -> bool:
        (s, t, _), (p, q, m) = runs[f], runs[l]
        if not long(f, l):
            return False
        if f == l:
            return True
        u, v = set(a.shingles[s : p + m - WIDTH + 1].tolist()), set(b.shingles[t : q + m - WIDTH + 1].tolist())
        return len(u & v) >= similarity * len(u | v)

    while todo:
        lo, hi = todo.pop()
        if lo >= hi or not long(lo, hi - 1):
            continue
        f, l = lo, hi - 1
        if not alike(f, l):
            # Shared shingles weigh 1 - similarity, those of one side alone cost similarity: a stretch reaches the
            # similarity where the sum is not negative, so that it begins and ends with whole runs.
            part = np.array(runs[lo:hi], np.int64)
            between = part[1:, :2] - part[:-1, :2]
            weight = (1 - similarity) * (part[:, 2] - WIDTH + 1)
            cost = similarity * (between.sum(1) - 2 * (part[:-1, 2] - WIDTH + 1))
            found = _longest(weight, cost, part[:, 2])
            f, l = lo + found[0], lo + found[1]
            while f < l and not alike(f, l):  # shingles that repeat count once
                f, l = (f + 1, l) if runs[f][2] < runs[l][2] else (f, l - 1)
        if alike(f, l):
            out.append((runs[f][0], runs[l][0] + runs[l][2], runs[f][1], runs[l][1] + runs[l][2]))
        if (f, l) != (lo, hi - 1):
            todo += [(lo, f), (l + 1, hi)]
    return out


def _hopeful(a: Text, b: Text, anchors: np.ndarray, similarity: float) -> np.ndarray:
    """Which anchors may lie in a passage, by the shingles of a that b has too.

    Runs are joined over gaps of at most ``min_words`` words, and a passage's joined runs have ``_shared`` shingles at
    least. And a passage's distinct shingles that b lacks are at most (1 - similarity) / similarity times those that it
    has; counted by their first places in a they are no more than that, and shingles that b has, by place, no fewer.
    """
    n, context = len(a.shingles), sizes(a.min_words, similarity)[1]
    if not len(b.known):
        return np.zeros(len(anchors), bool)
    has = b.known[np.minimum(np.searchsorted(b.known, a.shingles), len(b.known) - 1)] == a.shingles
    at = np.nonzero(has)[0]
    part = np.concatenate([[0], np.cumsum(np.diff(at) > a.min_words + WIDTH)])
    enough = np.bincount(part[: len(at)], minlength=1) >= min(_shared(a.min_words, similarity)) - 1e-9
    ok = enough[part[np.minimum(np.searchsorted(at, anchors), max(0, len(at) - 1))]]
    if not ok.any():
        return ok
    # Stretches s..e of a whole passage's length whose weights sum to 0 or more: for each s the last such e.
    weight = np.where(has, 1 - similarity, np.where(a.first, -similarity, 0.0))
    total = np.concatenate([[0.0], np.cumsum(weight)])
    highest = np.maximum.accumulate(total[::-1])[::-1]
    ends = np.searchsorted(-highest, -(total - 1e-9), side="right") - 1
    ends[ends - np.arange(n + 1) < a.min_words - WIDTH + 1] = 0
    return ok & (np.maximum.accumulate(ends)[anchors] >= anchors + context)


def common_passages(a: Text, b: Text, keys: list[int], similarity: float) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """(start, end) in a and in b of the verified passages around the contexts ``keys``, and the keys that stand in a
    somewhere outside of all passages."""
    x, y, u, v, min_words = a.words, b.words, a.shingles, b.shingles, a.min_words
    width = sizes(min_words, similarity)[1] + WIDTH - 1
    wanted = np.sort(np.array(keys, np.int64).view(np.uint64))
    every = np.nonzero(wanted[np.minimum(np.searchsorted(wanted, a.contexts), len(wanted) - 1)] == a.contexts)[0]
    anchors = every[_hopeful(a, b, every, similarity)]
    if not len(anchors):
        return [], keys
    # A passage has as much in common from either side, so that places of b are held to the same. Texts may repeat
    # themselves: of places with the same words around them the first is tried, each diagonal once for each of its ranges,
    # and contexts that lie in passages of both texts need no other partner.
    wanted = np.unique(a.contexts[anchors])
    lows, highs = np.searchsorted(b.ordered, wanted), np.searchsorted(b.ordered, wanted, side="right")
    counts = highs - lows
    every_place = b.order[np.repeat(lows - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    every_place = np.sort(every_place[_hopeful(b, a, every_place, similarity)])
    every_place = np.sort(every_place[np.unique(b.around[every_place], return_index=True)[1]])
    if not len(every_place):
        return [], keys
    every_place = every_place[np.argsort(b.contexts[every_place], kind="stable")]
    ordered = b.contexts[every_place]
    anchors = np.sort(anchors[np.unique(a.around[anchors], return_index=True)[1]])
    lows, highs = np.searchsorted(ordered, a.contexts[anchors]), np.searchsorted(ordered, a.contexts[anchors], side="right")
    out: list[tuple[int, int, int, int]] = []
    tried = np.zeros(len(x) + len(y) + 1, np.int64)
    covered, marked, others = np.zeros(len(x), bool), np.zeros(len(y), bool), None
    for at, lo, hi in zip(anchors.tolist(), lows.tolist(), highs.tolist()):
        if hi == lo or hi - lo == 1 and tried[every_place[lo] - at + len(x)] >= at + width:
            continue
        places = every_place[lo:hi]
        while True:
            places = places[tried[places - at + len(x)] < at + width]
            if len(places) and out and covered[at : at + width].all():
                if others is None:
                    others = np.concatenate([[0], np.cumsum(marked)])
                places = places[others[places + width] - others[places] < width]
            if not len(places):
                break
            to = int(places[0])
            before = [(at - i - n, to - j - n, n) for i, j, n in reversed(_runs(x[:at][::-1], y[:to][::-1], u[: max(0, at - WIDTH + 1)][::-1], v[: max(0, to - WIDTH + 1)][::-1], min_words, similarity))]
            runs = _runs(x[at:], y[to:], u[at:], v[to:], min_words, similarity)
            runs = before + [(at + i, to + j, n) for i, j, n in runs]
            k = len(before)
            if before and before[-1][0] + before[-1][2] == at and before[-1][1] + before[-1][2] == to:
                s, t, n = before[-1]
                runs[k - 1 : k + 1] = [(s, t, n + runs[k][2])]
            for s, t, n in runs:
                tried[t - s + len(x)] = max(tried[t - s + len(x)], s + n)
            for p in _stretches(a, b, runs, similarity):
                out.append(p)
                covered[p[0] : p[1]] = True
                marked[p[2] : p[3]] = True
                others = None
    if not out:
        return [], keys
    # A place is bare unless it, or one with the same words around it, lies in a passage.
    inside = np.concatenate([[0], np.cumsum(covered)])
    bare = inside[every + width] - inside[every] < width
    same = np.unique(a.around[every], return_inverse=True)[1]
    bare = (np.bincount(same, ~bare) == 0)[same]
    return sorted(set(out)), np.unique(a.contexts[every[bare]]).view(np.int64).tolist()


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


_SPANS = "array<struct<s: int, e: int>>"
#: Rows of one leader that are verified in one place, and words of texts that are kept there while others are read.
DEALT, KEPT = 512, 500_000


def _verified(pairs: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """(row, lead, spans, lead_spans, left) of (row, lead, keys): the passages of each pair, and the signatures of the
    row that none covers. The rows of a leader are dealt out in parts, and each part reads the leader's text once."""
    crowded = pairs.groupBy("lead").agg(F.ceil(F.count("*") / DEALT).alias("parts")).where("parts > 1")
    salt = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")
    dealt = checkpoint(pairs.join(crowded, "lead", "left").select("lead", salt, "row", "keys"))
    members = dealt.join(texts.select("row", "text"), "row").select("lead", "salt", F.lit(1).alias("tag"), "row", "keys", "text")
    leads = dealt.select(F.col("lead").alias("row"), "salt").distinct().join(texts.select("row", "text"), "row")
    leads = leads.select(F.col("row").alias("lead"), "salt", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("array<long>").alias("keys"), "text")
    both = leads.unionByName(members).repartition("lead", "salt").sortWithinPartitions("lead", "salt", "tag")

    def begin():
        known: list = [None]  # the leader whose rows follow
        kept: OrderedDict = OrderedDict()  # the texts that were met last
        total = 0  # of their words

        def read(row, x):
            nonlocal total
            if row in kept:
                kept.move_to_end(row)
                return kept[row]
            text = kept[row] = Text(_bytes(x), min_words, similarity)
            total += len(text.words)
            while len(kept) > 1 and total > KEPT:
                total -= len(kept.popitem(last=False)[1].words)
            return text

        def run(rows):
            out = {"row": [], "lead": [], "spans": [], "lead_spans": [], "left": []}
            for tag, row, lead, keys, x in zip(*(rows[c] for c in ("tag", "row", "lead", "keys", "text"))):
                text = read(lead if tag == 0 else row, x)
                if tag == 0:
                    known[0] = text
                    continue
                spans, left = common_passages(text, known[0], keys, similarity)
                values = row, lead, [{"s": p[0], "e": p[1]} for p in spans], [{"s": p[2], "e": p[3]} for p in spans], left
                for name, v in zip(out, values):
                    out[name].append(v)
            return out

        return run

    return map_rows(both, None, f"row long, lead long, spans {_SPANS}, lead_spans {_SPANS}, left array<long>", size=128, char_col="text", begin=begin)


def _equal_stretches(open_rows: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """(h1, h2, row, at): 128 bits for every stretch of ``min_words`` words that holds a signature of (row, keys)."""
    width, context = min_words - WIDTH + 1, sizes(min_words, similarity)[1]

    def run(rows):
        out = {c: [] for c in ("h1", "h2", "row", "at")}
        for row, keys, x in zip(rows["row"], rows["keys"], rows["text"]):
            sh = shingles(word_hashes(_bytes(x)))
            last = np.nonzero(np.isin(spans_hashed(sh, context), np.array(keys, np.int64).view(np.uint64)))[0]
            n, size = len(sh) - width + 1, max(1, width - context + 1)
            if n < 1:
                continue
            starts = np.unique(last[:, None] - np.arange(size)[None, :])
            starts = starts[(starts >= 0) & (starts < n)]
            for name, v in (("h1", spans_hashed(sh, width)), ("h2", spans_hashed(_mix(sh, 5), width))):
                out[name].append(v[starts].view(np.int64))
            out["row"].append(np.full(len(starts), row, np.int64))
            out["at"].append(starts.astype(np.int32))
        return {c: np.concatenate(v) if v else [] for c, v in out.items()}

    each = open_rows.join(texts.select("row", "text"), "row")
    return map_rows(each, run, "h1 long, h2 long, row long, at int", char_col="text")


#: Rows of a signature whose surroundings are compared in one place, and the most parts that more rows are dealt out in;
#: places of a text that are read at once.
CROWD, PARTS, READ = 4096, 256, 512


def _variety(sh: np.ndarray, width: int) -> np.ndarray:
    """How many different values each stretch of ``width`` has, by where it starts; the last stretches are shorter."""
    n = len(sh)
    order = np.argsort(sh, kind="stable")
    earlier = np.full(n, -1)
    again = np.nonzero(sh[order[1:]] == sh[order[:-1]])[0]
    earlier[order[again + 1]] = order[again]
    # A value counts in the stretches that hold it and start behind the one before that equals it.
    firsts = np.maximum(np.maximum(earlier + 1, np.arange(n) - width + 1), 0)
    return np.cumsum(np.bincount(firsts, minlength=n) - np.concatenate([[0], np.ones(n - 1, np.int64)]))


def _apart(left: DataFrame, roots: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """(row, lead, key): pairs of rows of (key, row) that lie in different components and may share a passage with a gap.

    It has a run of ``certain_run`` shingles or more, and fewer than ``min_words`` words, as equal stretches are linked
    before; the next run begins within a gap of its end. So both rows have a stretch of that length, whose smallest shingle
    begins a signature, and beyond a shingle in common, with different ones before it, where the next run begins. Rows that
    differ in no such place are no pair: a line that many texts have gives none.

    Of the passage's gaps, each at least 2 * WIDTH - 1 lost shingles (as for ``certain_run``), one is paid for by the
    different shingles of the two runs beside it: dealt to the gaps, half of a run to either side and all of an outer one to
    its only side, the runs must pay for all. So two such runs have ``need`` different shingles, and what repeats itself
    so much that no two stretches of a run's length around a place have them takes no part.

    What surrounds a signature in a text is one row, in which what stands there several times counts once; it meets that
    of other texts in arrays. Where a signature has more than CROWD rows they are dealt out by shingle, in at most
    PARTS parts, so that the rows made grow with the input whatever the size of a group.
    """
    window, context = sizes(min_words, similarity)
    run, longest, gap = window + context - 1, min_words - WIDTH, min_words
    need = similarity / max(1 - similarity, 1e-9) * (2 * WIDTH - 1) - 1e-6
    # A run's first shingle beyond a run that begins at the signature, and the last before one that ends with it.
    steps = np.concatenate([np.arange(context - longest - WIDTH - gap, 1 - WIDTH), np.arange(context + WIDTH - 1, longest + WIDTH + gap)])

    def read(x):
        """The shingles of a text, what the richest run around a place has, and one that begins or ends there."""
        sh = shingles(word_hashes(_bytes(x)))
        if len(sh) < run:
            return None
        begins = _variety(sh, longest)
        ends = np.concatenate([np.repeat(begins[:1], min(len(sh), longest - 1)), begins])[: len(sh)]
        around = _sliding(np.concatenate([np.zeros(longest - 1, np.int64), begins]), longest, np.maximum)
        return sh, _mix(sh, 11), around, begins, ends

    def stretches(rows):
        out = {c: [] for c in ("g", "row", "root", "key")}
        for row, root, keys, x in zip(rows["row"], rows["root"], rows["keys"], rows["text"]):
            if (text := read(x)) is None:
                continue
            sh, h, around, begins, ends = text
            contexts = spans_hashed(sh, context)
            last = np.nonzero(np.isin(contexts, np.array(keys, np.int64).view(np.uint64)))[0]
            beside = np.concatenate([np.zeros(-steps[0], np.int64), ends]), np.concatenate([begins, np.zeros(steps[-1], np.int64)])
            rich = np.maximum(*(_sliding(v, 1 + k, np.maximum) for v, k in zip(beside, (-steps[0], steps[-1]))))
            last = last[around[last] + rich[last] >= need]
            at, starts = np.repeat(last, window), (last[:, None] - np.arange(window)[None, :]).ravel()
            ok = (starts >= 0) & (starts <= len(sh) - run)
            at, starts = at[ok], starts[ok]
            ok = _sliding(h, window, np.minimum)[starts] == h[at]
            at, starts = at[ok], starts[ok]
            # A text that repeats itself has a stretch once.
            both = np.unique(np.stack([spans_hashed(sh, run)[starts], contexts[at]], 1).view(np.int64), axis=0)
            for c, v in zip(out, (both[:, 0], np.full(len(both), row), np.full(len(both), root), both[:, 1])):
                out[c].append(v)
        return {c: np.concatenate(v) if v else [] for c, v in out.items()}

    def beyond(rows):
        out = {c: [] for c in ("key", "salt", "row", "root", "items")}
        for row, root, some, x in zip(rows["row"], rows["root"], rows["some"], rows["text"]):
            sh, h, around, begins, ends = read(x)
            n, contexts = len(sh), spans_hashed(sh, context).view(np.int64)
            after, before = (_mix(sh, seed) >> np.uint64(32) for seed in (21, 22))
            parts = {p["key"]: p["parts"] for p in some}
            starts = np.nonzero(np.isin(spans_hashed(sh, run).view(np.int64), np.array([p["g"] for p in some], np.int64)))[0]
            within = starts[:, None] + np.arange(window)
            places = np.unique(within[h[within] == h[within].min(axis=1, keepdims=True)])
            places = places[np.isin(contexts[places], np.array(list(parts), np.int64))]
            places = places[np.argsort(contexts[places], kind="stable")]
            for of_key in np.split(places, np.nonzero(np.diff(contexts[places]))[0] + 1) if len(places) else []:
                items = []
                for first in range(0, len(of_key), READ):
                    at = of_key[first : first + READ, None]
                    to = at + steps
                    ok = (to >= 0) & (to < n)
                    to = np.clip(to, 0, n - 1)
                    ok &= around[at] + np.where(steps > 0, begins[to], ends[to]) >= need
                    right = np.broadcast_to(steps > 0, to.shape)[ok]
                    to = to[ok]
                    a = after[to] << np.uint64(32) | after[np.maximum(to - 1, 0)]
                    b = before[to] << np.uint64(32) | before[np.minimum(to + 1, n - 1)]
                    items.append(np.unique(np.where(right, a, b)))
                items = np.unique(np.concatenate(items)) if len(items) > 1 else items[0]
                key = int(contexts[of_key[0]])
                salts = (items >> np.uint64(32)) % np.uint64(parts[key])
                for salt in range(parts[key]):
                    mine = items if parts[key] == 1 else items[salts == salt]
                    if len(mine):
                        for c, v in zip(out, (key, salt, row, root, mine.tobytes())):
                            out[c].append(v)
        return out

    def met(table):
        """Of the rows of whole groups the shingles that several roots have, beside several others."""
        key, salt, row, root = (table.column(c).to_numpy() for c in ("key", "salt", "row", "root"))
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
        items = table.column("items").to_pylist()
        place = np.repeat(np.arange(len(key)), [len(x) // 8 for x in items])
        items = np.frombuffer(b"".join(items), np.uint64)
        h, beside = items >> np.uint64(32), items & np.uint64(0xFFFFFFFF)
        item = group[place].astype(np.uint64) << np.uint64(32) | h
        order = np.argsort(item, kind="stable")
        item = item[order]
        begins = np.nonzero(np.concatenate([item[:1] == item[:1], item[1:] != item[:-1]]))[0]
        several = np.ones(len(begins), bool)
        for v in (root[place], beside):
            if len(begins):
                several &= np.minimum.reduceat(v[order], begins) < np.maximum.reduceat(v[order], begins)
        some = order[np.repeat(several, np.diff(begins, append=len(item)))]
        at = place[some]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (key[at], h[some].astype(np.int64), beside[some].astype(np.int64), row[at], root[at])], names=["key", "h", "beside", "row", "root"])

    def meet(batches):
        kept: list = []  # batches of one group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt = (batch.column(c).to_numpy() for c in ("key", "salt"))
            whole = int(((key != key[-1]) | (salt != salt[-1])).sum())
            if kept and (kept[-1].column("key")[0].as_py(), kept[-1].column("salt")[0].as_py()) != (key[0], salt[0]):
                yield met(pa.Table.from_batches(kept))
                kept = []
            if whole:
                yield met(pa.Table.from_batches([*kept, batch.slice(0, whole)]))
                kept = []
            kept.append(batch.slice(whole))
        if kept:
            yield met(pa.Table.from_batches(kept))
        pa.default_memory_pool().release_unused()

    def of_several(rows, by):
        """Rows of (by) that has several roots."""
        several = rows.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(by)
        return rows.hint("merge").join(several, by)

    some = checkpoint(left.select("key", "row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")))
    some = of_several(some, "key").groupBy("row", "root").agg(F.collect_set("key").alias("keys"))
    each = checkpoint(map_rows(some.join(texts.select("row", "text"), "row"), stretches, "g long, row long, root long, key long", char_col="text"))
    places = checkpoint(of_several(each, "g"))
    crowds = places.select("key", "row").distinct().groupBy("key").agg(F.least(F.ceil(F.count("*") / CROWD), F.lit(PARTS)).cast("int").alias("parts")).where("parts > 1")
    some = places.join(crowds, "key", "left").groupBy("row", "root").agg(F.collect_list(F.struct("g", "key", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("some"))
    each = map_rows(some.join(texts.select("row", "text"), "row"), beyond, "key long, salt int, row long, root long, items binary", size=64, char_col="text", chars=1_000_000)
    shared = checkpoint(each.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(meet, "key long, h long, beside long, row long, root long"))
    a = shared.select("key", "h", "row", F.col("beside").alias("p"), F.col("root").alias("r"))
    b = shared.select("key", "h", F.col("row").alias("lead"), F.col("beside").alias("q"), F.col("root").alias("s"))
    pairs = a.hint("merge").join(b, ["key", "h"]).where((F.col("p") != F.col("q")) & (F.col("r") != F.col("s")) & (F.col("lead") < F.col("row")))
    return pairs.select("row", "lead", "key").distinct()


def _led(batches):
    """(key, row, lead) of (key, row) in order: those of keys with several rows, with the first of them."""
    key = lead = None  # of the last row, and of that alone while it is the first of its key
    alone = False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows = (batch.column(c).to_numpy() for c in ("key", "row"))
        if key is not None:
            keys, rows = np.concatenate([[key], keys]), np.concatenate([[lead], rows])
        begins = np.concatenate([[True], keys[1:] != keys[:-1]])
        leads = rows[np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0))]
        several = ~begins
        several[:-1] |= ~begins[1:]
        if key is not None and not alone:
            several[0] = False
        alone = bool(begins[-1]) and (len(rows) > 1 or key is None or alone)
        key, lead = keys[-1], leads[-1]
        yield pa.RecordBatch.from_arrays([pa.array(v[several]) for v in (keys, rows, leads)], names=["key", "row", "lead"])


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, rounds: int = 1) -> DataFrame:
    """(doc_id, class_id, n_words, n_repeated, spans): documents with a passage that another document has too.

    class_id is the smallest doc_id that shared passages reach; spans are ``start:end`` in words, joined by commas.
    """
    scratch = Scratch(docs.sparkSession)
    # Texts are shuffled once: copies, windows and the first side of verification find them dealt out by row.
    numbered = taken(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    texts = scratch.bucketed(numbered, "texts", "row")

    # Copies by 128 bits of their text; of those the words are counted, and of what is found in the end.
    members = scratch.written(texts.select("row", "doc_id", F.unhex(F.md5("text")).alias("key")), "members")
    classes = members.where("key is not null").groupBy("key").agg(F.min("row").alias("rep"), F.max("row").alias("other")).where("rep <> other").select("key", "rep")
    copies = members.join(classes, "key").select("row", "rep").join(texts.select("row", "text"), "row")
    copies = checkpoint(copies.select("row", "rep", word_count(F.col("text")).alias("n_words"))).where(F.col("n_words") >= min_words)
    single = texts.join(copies.where("row <> rep").select("row"), "row", "left_anti")

    def windows(rows):
        ids, keys = [], []
        for row, x in zip(rows["row"], rows["text"]):
            key = np.unique(signatures(word_hashes(_bytes(x)), min_words, similarity)[0])
            ids.append(np.full(len(key), row, np.int64))
            keys.append(key.view(np.int64))
        return {"key": np.concatenate(keys), "row": np.concatenate(ids)}

    # One row for each signature of a document, however often it repeats there. They are sorted once, and a signature's
    # first row is its leader.
    found = map_rows(single.select("row", "text"), windows, "key long, row long", char_col="text")
    met = scratch.written(found.repartition("key").sortWithinPartitions("key", "row").mapInArrow(_led, "key long, row long, lead long"), "met")

    def verified(asked, name):
        """Each pair of (row, lead, key) once, with all its signatures."""
        pairs = checkpoint(asked.groupBy("row", "lead").agg(F.sort_array(F.collect_set("key")).alias("keys")))
        return scratch.written(_verified(pairs, texts, min_words, similarity), name)

    tries = [verified(met.where("row <> lead"), "verified")]
    # The rows of signatures that a leader left over, and the equal stretches around them.
    keys = tries[0].select(F.explode("left").alias("key")).distinct()
    some = scratch.written(met.hint("merge").join(keys, "key"), "left")
    open_rows = some.groupBy("row").agg(F.collect_set("key").alias("keys"))
    stretches = scratch.written(_equal_stretches(open_rows, texts, min_words, similarity), "stretches")
    firsts = stretches.groupBy("h1", "h2").agg(F.min("row").alias("lead"), F.max("row").alias("last")).where("lead <> last").select("h1", "h2", "lead")
    firsts = scratch.written(firsts, "firsts")
    equal = scratch.written(stretches.hint("merge").join(firsts, ["h1", "h2"]).select("row", "lead", "at"), "equal")

    def passed(t):
        return t.where(F.size("spans") > 0)

    def components():
        links = [passed(t).select(F.col("row").alias("a"), F.col("lead").alias("b")) for t in tries]
        links += [x.select(F.col("row").alias("a"), F.col(b).alias("b")) for x, b in ((equal, "lead"), (copies, "rep"))]
        return connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "row")

    roots = components()
    for k in range(rounds):
        rooted = checkpoint(some.join(roots, "row", "left").select("key", "row", "lead", F.coalesce("root", "row").alias("root")))
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("row") == F.col("lead"), F.col("root"))).alias("first")).where("low < high")
        apart = checkpoint(apart.select("key", "first"))
        if apart.isEmpty():
            break
        place = F.xxhash64("row", F.lit(k))
        rest = rooted.hint("merge").join(apart, "key")
        leaders = rest.where("root <> first").groupBy("key").agg(F.min(F.struct(place.alias("h"), "row", "root")).alias("l"))
        leaders = checkpoint(leaders.select("key", F.col("l.row").alias("by"), F.col("l.root").alias("by_root")))
        asked = rest.select("key", "row", "root").hint("merge").join(leaders, "key").where("root <> by_root")
        more = verified(asked.select("key", "row", F.col("by").alias("lead")), "verified")
        if passed(more).isEmpty():
            break
        tries.append(more)
        roots = components()
    more = verified(_apart(some, roots, texts, min_words, similarity), "verified")
    if not passed(more).isEmpty():
        tries.append(more)
        roots = components()
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e")))
    # A document of many passages has as many spans as its words allow; a leader gets a span once however many share it.
    parts = [copies.select("row", F.explode(whole).alias("p")), equal.select("row", F.struct(F.col("at").alias("s"), (F.col("at") + min_words).alias("e")).alias("p"))]
    for t in map(passed, tries):
        parts += [t.select("row", F.explode("spans").alias("p")), t.select(F.col("lead").alias("row"), F.explode("lead_spans").alias("p"))]
    spans = reduce(DataFrame.unionByName, parts).distinct().groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("p"))
    first = F.get("p", F.lit(0))
    merged = F.aggregate(
        F.slice("p", 2, F.size("p")),
        F.array(first),
        lambda a, x: F.when(
            x["s"] <= F.element_at(a, -1)["e"],
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    named = roots.join(texts.select("row", "doc_id", "text"), "row")
    named = checkpoint(named.select("row", "root", "doc_id", word_count(F.col("text")).alias("n_words")))
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = checkpoint(spans.select("row", merged.alias("m")).join(named, "row").join(classes, "root").select("doc_id", "class_id", "n_words", "m"))
    scratch.remove()  # the checkpoint has the results
    return out.select(
        "doc_id",
        "class_id",
        "n_words",
        F.aggregate("m", F.lit(0), lambda a, x: a + x["e"] - x["s"]).cast("long").alias("n_repeated"),
        F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"),
    )


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
