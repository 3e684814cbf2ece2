"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links (Song et al., 2021): where a word leaves the trie, the
link gives the node that stands for what is left once the longest pieces are split off, and with it
how many pieces those are. A count thus takes one step for each symbol and each link, and no piece
is ever built. Symbols are UTF-8 bytes; a word ends with a symbol of its own, so that pieces for
the end of a word differ from those inside.

Defined cases: a null or empty text has no words and no tokens; a word that the vocabulary can't
spell is one unknown token; a null doc_id is carried along; repeated rows are counted alike; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from gleaner.llm.common import map_rows, table, taken
from gleaner.llm.tokens import byte_characters, vocabulary

END = 256


class LongestMatch:
    """Counts the pieces of greedy longest-match-first splitting."""

    def __init__(self, pieces: Iterable[tuple[int, ...]], most: int = 400_000):
        """pieces: symbols 0 to 255, END at the end of a word; at most ``most`` words are remembered."""
        self.go: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                after = self.go[node].get(c)
                if after is None:
                    after = self.go[node][c] = len(self.go)
                    self.go.append({})
                    final.append(False)
                node = after
            final[node] = node != 0
        self.link: list[int | None] = [None] * len(self.go)
        self.popped = [0] * len(self.go)
        queue = [(0, c, v) for c, v in self.go[0].items()]
        while queue:
            following = []
            for parent, c, node in queue:
                if final[node]:
                    self.link[node], self.popped[node] = 0, 1
                else:
                    at, n = self.link[parent], self.popped[parent]
                    while at is not None and c not in self.go[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    if at is not None:
                        self.link[node], self.popped[node] = self.go[at][c], n
                following += [(node, d, v) for d, v in self.go[node].items()]
            queue = following
        self.most, self.known = most, {}

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if it can't be spelled."""
        go, link, popped = self.go, self.link, self.popped
        node = n = 0
        for c in (*word, END):
            while c not in go[node]:
                if link[node] is None:
                    return 1
                n += popped[node]
                node = link[node]
            node = go[node][c]
        while node:
            if link[node] is None:
                return 1
            n += popped[node]
            node = link[node]
        return n

    def total(self, words: list[bytes]) -> int:
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.count(w)
        return sum(map(known.__getitem__, words))


def pieces_of(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file whose word ends are marked by ``suffix``."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of, out = {c: b for b, c in byte_characters().items()}, []
    for name in vocab:
        stem = name.removesuffix(suffix)
        if all(c in of for c in stem):
            out.append((*[of[c] for c in stem], *[END] * (stem != name)))
    return out


@lru_cache(maxsize=2)
def matcher(path: str) -> LongestMatch:
    """One for each path and worker process."""
    return LongestMatch(pieces_of(path))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of lower-cased texts, words split at ASCII white space."""
    path = vocabulary("word_bpe_49k.json", path)

    def run(rows):
        words = [words_of(x) for x in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_words": list(map(len, words)), "n_tokens": [matcher(path).total(w) for w in words]}

    return map_rows(taken(docs, "doc_id", "text"), run, "doc_id long, n_words long, n_tokens long", char_col="text")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
