"""Byte-level BPE ids of whole texts.

The ids are those that the tokenizers library gives for a byte-level BPE file by
``encode(text, add_special_tokens=False)`` with its defaults: none are added, but the
string of an added token that stands in a text is that token. They are computed by
tiktoken over the ranks in that file, because that is ten times as fast; tests
hold both against each other. ``plain`` takes such strings as ordinary text, as the
library does with ``encode_special_tokens`` on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

# The split pattern of byte-level BPE, with quantifiers that don't give back what they took.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts are cut before a blank about so many characters apart, so that no call holds all ids of a very long text as a list.
PART = 1 << 20


def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable letters: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a tokenizers file, and its added tokens with theirs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens, letters = spec.get("added_tokens", []), byte_of_letter()
    if any(x.get(k) for x in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at their neighbours aren't known here")
    added = {x["content"]: x["id"] for x in tokens}
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}, added


class Bpe:
    """Encodes whole texts.

    A blank after a character that isn't white space always starts a new piece of
    the split pattern, so long texts can be encoded in parts between such blanks.
    Added tokens cut a text; what lies between is encoded by itself.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        import tiktoken

        found, self.added = ranks(path)
        self.core = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=found, special_tokens={})
        some = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, some)) + ")") if some and not plain else None

    def _parts(self, text: str) -> Iterator[list[int]]:
        if self.cut is None or not self.cut.search(text):
            yield from self._ordinary(text)
            return
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                yield [self.added[part]]
            else:
                yield from self._ordinary(part)

    def _ordinary(self, text: str) -> Iterator[list[int]]:
        at, n = 0, len(text)
        while at < n:
            to = n if n - at <= PART else at + PART
            while to < n and not (text[to] == " " and not text[to - 1].isspace()):
                to += 1
            yield self.core.encode_ordinary(text if to - at == n else text[at:to])
            at = to

    def ids(self, text: str) -> np.ndarray:
        """The ids of the whole text, as 32-bit unsigned integers."""
        parts = [np.array(x, dtype="<u4") for x in self._parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, dtype="<u4")])


_bpe: dict[tuple[str, bool], Bpe] = {}


def bpe(path: str, plain: bool = False) -> Bpe:
    """One encoder a worker process and file."""
    if (path, plain) not in _bpe:
        _bpe[path, plain] = Bpe(path, plain)
    return _bpe[path, plain]
