"""Personal data by weak supervision.

Candidate spans come from the base patterns and from wider ones. Labelers vote on each candidate:
1 personal, -1 not, 0 abstains. They are patterns (format, checks), a gazetteer (top-level domains, country
and network codes, names of fields) and the context (words before, characters around). Expectation
maximisation over the counts of vote patterns, of all candidates of all documents, estimates for each
kind how often personal data occur and how reliable each labeler is; its posteriors train the final
span classifier, a logistic regression over votes and shape. A span is reported if it is a base span or
if the classifier gives it at least ``threshold``; base spans always stay.

What the driver gets is bounded: one count for each vote pattern and shape.

Defined cases: a null text is empty and has no spans; a null doc_id is carried along; repeated rows are
judged alike; an empty table gives an empty table and a model that adds nothing; other columns are not read.
Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import DOCUMENTS, map_rows, table, taken
from gleaner.sources.shared import written

#: Base kinds in their order, then the kinds that only the method reports.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
BASE = KINDS[:4]

# Runs of digits are matched once, from their start and without giving any back: the same matches in linear time.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_OBSCURED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

TLDS = frozenset("com net org edu gov mil int info biz io ai de fr es it uk us ca au jp cn br in nl se ch eu".split())
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "65", "81", "82", "86", "90", "91")
CARD_PREFIXES = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65", "2")
FIELD_NAMES = ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "credential", "auth")
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach", "@"),
    "ip": ("ip", "address", "host", "server", "client", "login", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp"),
    "secret": FIELD_NAMES,
    "ssn": ("ssn", "social security", "insurance"),
}
AGAINST = ("version", "release", "isbn", "section", "chapter", "figure", "build", "sha", "commit", "order no", "article", "doi")
#: Labelers, in the order of a vote pattern.
LABELERS = ("pattern", "check", "gazetteer", "context", "boundary", "entropy")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _wider(text: str) -> Iterable[tuple[str, int, int]]:
    """Candidates beyond the base spans."""
    yield from (("ip", *m.span()) for m in _IP.finditer(text))
    for m in _CARD.finditer(text):
        if 12 <= sum(c.isdigit() for c in m[0]) <= 19:
            yield ("card", *m.span())
    if "(" in text or "-" in text or "." in text:
        yield from (("phone", *m.span()) for m in _NATIONAL.finditer(text))
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text))
    low = text.lower() if "at" in text else ""
    if "[at]" in low or "(at)" in low:
        yield from (("email", *m.span()) for m in _OBSCURED.finditer(text))
    yield from (("secret", *m.span()) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0]))
    if "-" in text:
        yield from (("ssn", *m.span()) for m in _SSN.finditer(text))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes on a span."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = "".join(c for c in span if c.isdigit())
    pattern = 1 if base else {"secret": 1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9_+/-]{24,}={0,2}", span) else 0, "ssn": 1, "email": 1}.get(kind, 0)
    check = gazetteer = entropy = 0
    if kind == "email":
        tld = re.split(r"[^A-Za-z]+", span)[-1].lower()
        check, gazetteer = (1 if len(tld) >= 2 else -1), (1 if tld in TLDS else 0)
    elif kind == "ip":
        parts = span.split(".")
        check = 1 if all(map(_small, parts)) else -1
        gazetteer = -1 if parts[0].lstrip("0") in ("", "127") or any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    elif kind == "card":
        check, gazetteer = (1 if 13 <= len(digits) <= 19 and _luhn(digits) else -1), (1 if digits.startswith(CARD_PREFIXES) else -1)
    elif kind == "phone":
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if span[0] == "+" and digits.startswith(COUNTRY_CODES) or span[0] != "+" and digits[0] in "23456789" else -1
    elif kind == "secret":
        check = 1 if any(c.isalpha() for c in span) and digits else -1
        gazetteer = 1 if any(f"{w} =" in before or f"{w}:" in before or f"{w}=" in before or f"{w} :" in before for w in FIELD_NAMES) else -1
        entropy = 1 if _entropy(span) >= 3.2 else -1
    else:
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind in ("card", "phone", "ip", "ssn"):
        entropy = -1 if len(set(digits)) <= 2 else 0
    context = 1 if any(w in before for w in CONTEXT[kind]) else -1 if any(w in before for w in AGAINST) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    boundary = -1 if left.isalnum() or right.isalnum() or left in "./\\_" and left else 1
    return pattern, check, gazetteer, context, boundary, entropy


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, votes) of every candidate, by kind and start; base spans come first and wider
    candidates that overlap one of their kind are left out. Votes are letters: n, 0 or p for each labeler."""
    text = text or ""
    base = base_spans(text)
    out, at = [], {}
    for kind, a, b in base:
        at.setdefault(kind, []).append((a, b))
        out.append((kind, a, b, True))
    for kind, a, b in _wider(text):
        if not any(x < b and a < y for x, y in _near(at.setdefault(kind, []), a)):
            at[kind].append((a, b))
            out.append((kind, a, b, False))
    out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return [(k, a, b, is_base, "".join("n0p"[v + 1] for v in votes(text, k, a, b, is_base))) for k, a, b, is_base in out]


def _near(spans: list[tuple[int, int]], start: int) -> list[tuple[int, int]]:
    """Spans that may overlap one from ``start``: all where there are few, else by bisection over those found so far."""
    if len(spans) < 32:
        return spans
    import bisect

    spans.sort()
    k = bisect.bisect(spans, (start,))
    return spans[max(0, k - 2) : k + 2]


def shape(kind: str, start: int, end: int) -> int:
    """The class of a span's length."""
    return min(5, (end - start) // 8)


def reliabilities(kinds: np.ndarray, pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The chance that each row's span is personal, by expectation maximisation for each kind.

    Rows are distinct vote patterns (values 0, 1, 2 for -, abstain, +) with their counts. Votes are
    taken as independent given the truth; the start is the mean vote.
    """
    post = 1 / (1 + np.exp(-1.5 * (pattern - 1.0).sum(1)))
    for kind in np.unique(kinds):
        own = kinds == kind
        x, n, q = pattern[own], count[own].astype(float), post[own]
        for _ in range(rounds):
            # Laplace counts that favour labelers better than chance.
            prior = ((q * n).sum() + 1) / (n.sum() + 2)
            log = np.full(len(x), math.log(prior) - math.log(1 - prior))
            for j in range(x.shape[1]):
                yes = np.bincount(x[:, j], weights=q * n, minlength=3) + np.array([0.5, 1.0, 1.5])
                no = np.bincount(x[:, j], weights=(1 - q) * n, minlength=3) + np.array([1.5, 1.0, 0.5])
                log += (np.log(yes / yes.sum()) - np.log(no / no.sum()))[x[:, j]]
            after = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            done = np.abs(after - q).max() < 1e-9
            q = after
            if done:
                break
        post[own] = q
    return post


def _features(kinds: np.ndarray, pattern: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """One-hot kind, kind by vote, and shape."""
    k = np.eye(len(KINDS))[kinds]
    v = np.eye(3)[pattern].reshape(len(kinds), -1)
    return np.concatenate([k, (k[:, :, None] * v[:, None, :]).reshape(len(kinds), -1), np.eye(6)[shapes]], 1)


class SpanClassifier:
    """Logistic regression on posteriors; without candidates it accepts base spans only."""

    def __init__(self, rows: list[tuple[str, str, int, int]], ridge: float = 1e-3):
        """rows: (kind, votes, shape, count)."""
        self.weights = None
        if rows:
            x = self._matrix(rows)
            kinds, pattern = self._codes(rows)
            n = np.array([r[3] for r in rows], float)
            # EM runs on vote patterns, whatever the shape.
            post = reliabilities(kinds, pattern, n)
            w, share = np.zeros(x.shape[1]), n / n.sum()
            for _ in range(50):  # Newton's method
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                grad = x.T @ (share * (p - post)) + ridge * w
                hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
                step = np.linalg.solve(hess, grad)
                w -= step
                if np.abs(step).max() < 1e-8:
                    break
            self.weights = w

    @staticmethod
    def _codes(rows):
        kinds = np.array([KINDS.index(r[0]) for r in rows])
        return kinds, np.array([["n0p".index(c) for c in r[1]] for r in rows]).reshape(len(rows), len(LABELERS))

    def _matrix(self, rows):
        kinds, pattern = self._codes(rows)
        return _features(kinds, pattern, np.array([r[2] for r in rows]))

    def scores(self, rows: list[tuple[str, str, int]]) -> list[float]:
        """The chance that each (kind, votes, shape) is personal."""
        if self.weights is None or not rows:
            return [0.0] * len(rows)
        known = list(dict.fromkeys(rows))
        by = dict(zip(known, (1 / (1 + np.exp(-np.clip(self._matrix(known) @ self.weights, -30, 30)))).tolist()))
        return [by[r] for r in rows]


CANDIDATES = "doc_id long, found array<struct<kind: string, start: int, end: int, base: boolean, votes: string, shape: int>>"


def candidate_spans(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, found): the candidates of each text with their votes; ``kept`` columns of documents stay beside them."""

    def run(rows):
        found = [[{"kind": k, "start": a, "end": b, "base": s, "votes": v, "shape": shape(k, a, b)} for k, a, b, s, v in candidates(x)] for x in rows["text"]]
        return {**{c: rows[c] for c in ("doc_id", *kept)}, "found": found}

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([CANDIDATES, *[f"{c} {kinds[c]}" for c in kept]])
    return map_rows(taken(docs, *dict.fromkeys(("doc_id", "text", *kept))), run, schema, char_col="text")


def fit(found: DataFrame) -> SpanClassifier:
    """The classifier from all candidates; the driver gets a count for each vote pattern and shape."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.shape")
    return SpanClassifier(sorted(map(tuple, each.groupBy("kind", "votes", "shape").count().collect())))


def reported(found: DataFrame, model: SpanClassifier, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans): base spans and those the classifier accepts, by kind and start."""

    def run(rows):
        out = []
        for cs in rows["found"]:
            scores = model.scores([(c["kind"], c["votes"], c["shape"]) for c in cs])
            out.append([{"kind": c["kind"], "start": c["start"], "end": c["end"], "base": c["base"], "score": p} for c, p in zip(cs, scores) if c["base"] or p >= threshold])
        return {"doc_id": rows["doc_id"], "spans": out}

    return map_rows(found.select("doc_id", "found"), run, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean, score: double>>")


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans) of every document. Texts are read once: candidates and votes go to a table of their own."""
    found = written(candidate_spans(docs), "pii")
    return reported(found, fit(found), threshold)


def redacted(docs: DataFrame, model: SpanClassifier, threshold: float = 0.5) -> DataFrame:
    """The columns of documents, of rows with ``found`` from candidate_spans(): each reported span is replaced by its kind
    in brackets; overlapping spans are one. n_chars follows."""

    def run(rows):
        texts = []
        for x, cs in zip(rows["text"], rows["found"]):
            scores = model.scores([(c["kind"], c["votes"], c["shape"]) for c in cs])
            spans = sorted((c["start"], c["end"], c["kind"]) for c, p in zip(cs, scores) if c["base"] or p >= threshold)
            merged: list[list] = []
            for a, b, k in spans:
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b, k])
            parts, at = [], 0
            for a, b, k in merged:
                parts += [x[at:a], f"[{k.upper()}]"]
                at = b
            texts.append(x if not merged else "".join(parts) + x[at:])
        return {**{c: rows[c] for c in DOCUMENTS}, "text": texts, "n_chars": [len(t or "") for t in texts]}

    # Only texts with candidates go through Python.
    some = map_rows(docs.where(F.size("found") > 0), run, "doc_id long, text string, lang string, source string, n_chars long", char_col="text")
    plain = docs.where(F.size("found") == 0).select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return some.unionByName(plain)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their personal data. Candidates are found once and written beside the texts. A null text
    stays null with 0 characters; null ids and repeated rows stay; an empty table gives an empty one."""
    found = written(candidate_spans(docs, *[c for c in DOCUMENTS if c != "doc_id"]), "pii")
    return redacted(found, fit(found))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    spans = personal_data(table(spark, sf_dir, "documents"))

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, BASE)
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return spans.select("doc_id", *counts, added, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
