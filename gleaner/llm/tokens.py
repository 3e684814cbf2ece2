"""Token ids by public tokenizers, word by word and remembered.

Both tokenizers split a text into words before their merges, and the ids of a text are those of its words in
order. Words repeat, and each worker keeps the packed ids of those it has seen, up to a bounded number. Texts
of ASCII and Latin-1 letters only, where case and normal forms leave no doubt, are split here by the tokenizer's
own pattern, and only new words go to its merges. Other texts are cut before the white space of each word and
the cuts encoded by the whole tokenizer; a text with white space other than space and line feed, or with the
string of a special token, is encoded in one piece.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space, line breaks and separators besides space and line feed, as Unicode or Python sees them.
_ODD = re.compile("[^\\S \\n]|[\\x1c-\\x1f\\x85\u200b\ufeff]|<\\|")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_OTHER = re.compile(rf"[^ -~\n{_LETTERS}]")
_APOSTROPHES = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|{_APOSTROPHES}| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_SPACELESS = re.compile(rf"{_APOSTROPHES}|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts; at most about ``most`` words are remembered."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: A tokenizer that drops white space gives a word the same ids with or without it.
        self.spaceless = not self.tokenizer.encode(" \n", add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            normal = json.dumps(json.load(f)["normalizer"])
        self.lower = "Lowercase" in normal
        self.pattern = _SPACELESS if self.spaceless else _SPACED
        self.of_byte = byte_characters()
        self.most, self.words, self.cuts = most, _Known(self._merged), {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.of_byte)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text, in order; null is empty."""
        out = []
        for x in texts:
            x = x or ""
            if len(self.words) > self.most // 2:
                self.words.age()
            if not _OTHER.search(x) and "<|" not in x:
                out.append(b"".join(map(self.words.__getitem__, self.pattern.findall(x.lower() if self.lower else x))))
            elif _ODD.search(x):
                out.append(self._whole([x])[0])
            else:
                out.append(self._cut(x.replace("\n", " ").split(" ") if self.spaceless else _CHUNK.findall(x)))
        return out

    def _cut(self, parts: list[str]) -> bytes:
        if len(self.cuts) > self.most // 4:
            self.cuts.clear()
        new = list(set(parts).difference(self.cuts))
        self.cuts.update(zip(new, self._whole(new)))
        return b"".join(map(self.cuts.__getitem__, parts))


class _Known(dict):
    """Values that are made once asked for. What was not asked for between two calls of age() is forgotten."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


@lru_cache(maxsize=4)
def encoder(path: str, most: int = 300_000) -> Encoder:
    """One for each path, bound and worker process."""
    return Encoder(path, most)


def vocabulary(name: str, path: str | None = None) -> str:
    """The file ``name`` of the public tokenizers, or ``path`` if given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
