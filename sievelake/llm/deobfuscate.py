"""Noisy-channel restoration of disguised words.

A disguised word is a lattice: a sign stands for itself or for the letters it
looks like, a star for any letter, a run of equal signs for fewer of them, and a
separator for itself or for nothing. Viterbi decoding finds the path that the
character language model and the costs of the channel together like best.

A word without signs that can be read in two ways has one path, itself, so it isn't
decoded. A word with separators may be a compound of others: its parts count beside
what the whole is decoded to. Doubled letters and words split by blanks are in every
plain text; they are decoded where that can give a word that is looked for (Wanted),
which changes nothing in what is found of these.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np

# Letters that digits and signs are commonly written for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# Costs of the channel, as negative natural logarithms: a letter written as a sign, a sign that stands for itself, a separator within a word, a repeated sign, a star for a letter.
SIGN, ITSELF, SEPARATOR, REPEAT, STAR = 1.5, 3.0, 0.7, 0.4, 2.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = " .-_*~'`^#%&,/"
EDGES = ".,;:!?\"'()[]{}|<>«»“”„…-_*~`^#%&/="
#: Symbols of the language model: 0 between words, 1 to 26 for a to z, 27 for other letters.
SYMBOLS = 28


@cache
def _symbol(c: str) -> int:
    if not c.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", c)[0]
    return ord(base) - 96 if "a" <= base <= "z" else 27


_LATIN = np.array([_symbol(chr(b).lower()) for b in range(256)], dtype=np.int64)
_LATIN[ord("?")] = 0
_SEVERAL = re.compile(r"(.)\1\1")
_EDGE_RUN = re.compile(r"^([^\w\s])\1\1+|([^\w\s])\2\2+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile("[" + re.escape("".join(LOOKS)) + "]")
_BETWEEN = re.compile("[" + re.escape(SEPARATORS) + "]+")
_SEPARATED = re.compile(r"[^\W\d_][" + re.escape(SEPARATORS) + r"]+[^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_RUN = re.compile(r"(.)\1+")
#: Three or more single signs with one white-space sign between each two, and with any white space; wider gaps may be those between words, so both are read.
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
APART = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of all three consecutive symbols of a whole text, as a vector of SYMBOLS ** 3."""
    s = _LATIN[np.frombuffer((text or "").lower().encode("latin-1", "replace"), dtype=np.uint8)]
    s = np.concatenate(([0, 0], s, [0]))
    return np.bincount(s[:-2] * SYMBOLS * SYMBOLS + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | the two before it), each order smoothed by the next lower one."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


def _written(chain: tuple | None) -> str:
    """What a path wrote, from its chain of (what came before, text)."""
    out = []
    while chain:
        chain, text = chain
        out.append(text)
    return "".join(reversed(out))


class Wanted:
    """Words and word beginnings that are looked for, by what tells that a token may be read as one."""

    def __init__(self, words: Iterable[str], beginnings: Iterable[str] = ()) -> None:
        words = set(words)
        self.runs: dict[str, list[str]] = {}  # words by what they are with runs shortened
        for w in sorted(words):
            self.runs.setdefault(_RUN.sub(r"\1", w), []).append(w)
        self.prefixes = {w[:n] for w in self.runs for n in range(1, len(w))}
        self.run_beginnings = {_RUN.sub(r"\1", w) for w in beginnings}
        self.longest = max(map(len, self.run_beginnings), default=0)

    def plain(self, token: str) -> str:
        """A token with letters for signs and without runs."""
        return _RUN.sub(r"\1", token.strip(EDGES).translate(_FIRST))

    def begins(self, token: str) -> bool:
        """Whether one of the words may begin with a token and go on."""
        if token.isalpha() and (len(token) == 1 or token[0] != token[1] and token[:2] not in self.prefixes):
            return token in self.prefixes
        return self.plain(token) in self.prefixes

    def repeated(self, token: str) -> bool:
        """Whether a token, its runs shortened, may be one of the words or begin like one."""
        plain = _RUN.sub(r"\1", token)
        return plain in self.runs or any(plain[:n] in self.run_beginnings for n in range(1, min(len(plain), self.longest) + 1))

    def split(self, tokens: list[str], starts: Iterable[int]) -> Iterable[tuple[str, str]]:
        """The words that consecutive tokens may make up, from the places given, and these tokens."""
        for i in starts:
            whole = self.plain(tokens[i])
            for j in range(i + 1, len(tokens)):
                more = self.plain(tokens[j])
                whole += more[whole[-1:] == more[:1] :]
                for word in self.runs.get(whole, ()):
                    yield word, " ".join(x.strip(EDGES) for x in tokens[i : j + 1])
                if whole not in self.prefixes:
                    break


_FIRST = str.maketrans({c: x[0] for c, x in LOOKS.items()})


#: What is remembered of a token without words to give that doesn't begin a word.
_NOTHING: tuple[tuple[str, ...], bool] = ((), False)


class Restorer:
    """Restores the words of texts; remembers what it has decoded.

    The table of decoded words starts anew when it is full, so its size is bounded.
    With ``keep``, words that it is false for are left out of all results.
    """

    def __init__(self, model: np.ndarray, remember: int = 200_000, wanted: Wanted | None = None, keep: Callable[[str], bool] | None = None) -> None:
        self.model = model.tolist()
        self.known: dict[str, tuple[tuple[str, ...], bool]] = {}
        self.remember = remember
        self.wanted, self.keep = wanted, keep

    def _edges(self, s: str, i: int, end: int) -> list[tuple[int, str, float]]:
        """Where the paths at i lead to, what they write, and what the channel takes for it; the run of equal signs ends at end."""
        c, n = s[i], end - i
        out: list[tuple[int, str, float]] = []
        letters = c if c.isalpha() else LOOKS.get(c, "")
        cost = 0.0 if c.isalpha() else SIGN
        for x in letters:
            out.append((i + 1, x, cost))
            if n >= 2:
                out.append((i + n, x, cost + REPEAT))
            if n >= 3:
                out.append((i + n, x + x, cost + 2 * REPEAT))
        if c == "*":
            out += [(i + 1, x, STAR) for x in LETTERS]
        if not c.isalpha():
            out.append((i + 1, c, ITSELF))
            if c in SEPARATORS:
                out.append((i + n, "", SEPARATOR))
        return out

    def decode(self, s: str) -> str:
        """The likeliest writing of a disguised word or of a spaced-out one, however long.

        States are pairs of symbols. Paths are chains of what they wrote, which share
        their beginnings, and only places ahead are held, so long ones take memory
        and time by their length.
        """
        model = self.model
        best: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {0: {(0, 0): (0.0, None)}}
        end = 0
        for i in range(len(s)):
            if i >= end:
                end = i + 1
                while end < len(s) and s[end] == s[i]:
                    end += 1
            here = best.pop(i, None)
            if not here:
                continue
            edges = self._edges(s, i, end)
            for (a, b), (so_far, written) in here.items():
                for to, text, cost in edges:
                    p, q, total = a, b, so_far - cost
                    for x in text:
                        r = _symbol(x)
                        total += model[p][q][r]
                        p, q = q, r
                    there = best.setdefault(to, {})
                    old = there.get((p, q))
                    if old is None or total > old[0]:
                        there[p, q] = (total, (written, text) if text else written)
        last = [(total + model[p][q][0], chain) for (p, q), (total, chain) in best[len(s)].items()]
        top = max(x for x, _ in last)
        return max(_written(chain) for x, chain in last if x == top)

    def _words(self, token: str) -> list[str]:
        if token.isalpha() and not _DOUBLED.search(token):
            return [token]
        core = _EDGE_RUN.sub("", token).strip(EDGES)
        parts = _LETTERS.findall(core)
        lone = len(parts) > 2 and max(map(len, parts)) == 1
        if parts and (lone or _SEVERAL.search(core) or (len(parts[0]) != len(core) and _SUSPECT.search(core))):
            pieces = [] if lone else [x for x in _BETWEEN.split(core) if x and x != core]
            parts = _LETTERS.findall(self.decode(core))
            for x in pieces:
                parts += self._words(x)
        elif len(parts) > 1 and _SEPARATED.search(core):
            parts += _LETTERS.findall(self.decode(core))
        if self.wanted and _DOUBLED.search(core) and self.wanted.repeated(core):
            parts += _LETTERS.findall(self.decode(core))
        return parts

    def _learn(self, token: str) -> tuple[tuple[str, ...], bool]:
        if len(self.known) >= self.remember:
            self.known.clear()
        found = tuple(w for w in self._words(token) if self.keep is None or self.keep(w))
        begins = self.wanted is not None and self.wanted.begins(token)
        out = self.known[token] = (found, begins) if found or begins else _NOTHING
        return out

    def words(self, token: str) -> tuple[str, ...]:
        """The words that a token (small letters, no white space) stands for."""
        return (self.known.get(token) or self._learn(token))[0]

    def restore(self, text: str | None) -> set[str]:
        """The distinct restored words of a whole text, with what spaced-out letters spell."""
        low = (text or "").lower()
        out: set[str] = set()
        tokens = low.split()
        known, starts = self.known, set()
        for token in set(tokens):
            found = known.get(token) or self._learn(token)
            if found is not _NOTHING:
                out.update(found[0])
                if found[1]:
                    starts.add(token)
        for m in (*SPACED.finditer(low), *APART.finditer(low)):
            out.update(self.words(" ".join(m[0].split())))
        if starts:
            for word, split in self.wanted.split(tokens, [i for i, x in enumerate(tokens) if x in starts]):
                if word not in out and word in _LETTERS.findall(self.decode(split)):
                    out.add(word)
        return out
