"""Matches of regular expressions with code-point offsets, row by row, by built-in functions.

A finding is marked where it stands: regexp_replace puts a mark on both sides of it,
in one pass, and split at the mark gives what lies between findings and the findings
in turn. Their lengths, summed in order, give the offsets. So the findings of a text
are an array beside it: nothing is shuffled, rows needn't have an id, and the same
expression runs on a stream.

The sums take time by the square of their number; so long arrays are summed in slices,
each from the sum of what comes before it.
The mark is a code point that is no character; where a text has it, it is another one
of these while matches are looked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import Pattern

_MARK, _OTHER = "￿", "￾"
#: Elements that are summed or folded in one go; even, as findings are every second one.
SLICE = 128
FINDING = "struct<entity_group: string, word: string, start: int, end: int, score: double, method: string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() AS array<{kind}>)")


def in_slices(values: Column, total: Callable[[Column], Column], use: Callable[[Column, Column, Column], Column], start: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The arrays that use(slice, what the totals of all earlier slices add up to, its own sum with these) gives, one after another."""

    def sliced(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / SLICE).cast("int") - 1, F.lit(0)))
        part = lambda i: F.slice(x, i * SLICE + 1, F.lit(SLICE))
        sums = F.aggregate(F.transform(at, lambda i: total(part(i))), F.array(start), lambda acc, y: F.concat(acc, F.array(add(F.element_at(acc, -1), y))))
        return let(sums, lambda s: F.flatten(F.transform(at, lambda i: let(part(i), lambda some: use(some, F.get(s, i), F.get(s, i + 1))))))

    return let(values, sliced)


def steady(regex: str) -> str:
    """A pattern that finds the same, but repeats words without a call for each, and tries no label twice.

    Java calls itself for every repetition of a group that it may have to give back;
    a word that ends at a boundary never has to be. Labels differ in case only.
    """
    if m := re.fullmatch(r"(.*)\(\?:(\\s\+[^()]*)\)([*+])\\b", regex):
        regex = m[1] + (r"\b" if m[3] == "*" else "") + f"(?:{m[2]}\\b){m[3]}+"
    if m := re.match(r"\(\?i\)\(\?:([^)]*)\)", regex):
        regex = f"(?i)(?:{'|'.join(dict.fromkeys(x.lower() for x in m[1].split('|')))}){regex[m.end() :]}"
    return regex


def two_groups(regex: str) -> str:
    """A pattern whose first group is the end of its match, with a group for what comes before, too."""
    at, inside = 0, False
    while not (regex[at] == "(" and not inside and regex[at + 1] != "?"):
        inside = regex[at] == "[" or inside and regex[at] != "]"
        at += 2 if regex[at] == "\\" else 1
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))?", regex)[0]
    return f"{flags}({regex[len(flags) : at]}){regex[at:]}"


def _placed(parts: Column) -> Column:
    """Start, end and word of the findings among what lies between and findings in turn."""

    def placed(some: Column, base: Column, _: Column | None = None) -> Column:
        def one(lengths: Column) -> Column:
            starts = F.transform(F.sequence(F.lit(1), F.size(lengths) - 1, F.lit(2)), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), base, lambda acc, x: acc + x))
            return F.transform(starts, lambda s, k: F.struct(s.alias("start"), (s + F.get(lengths, 2 * k + 1)).alias("end"), F.get(some, 2 * k + 1).alias("word")))

        none = empty("struct<start: int, end: int, word: string>")
        return F.when(F.size(some) > 1, let(F.transform(some, F.length), one)).otherwise(none)

    total = lambda some: F.aggregate(some, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.when(F.size(parts) <= SLICE, placed(parts, F.lit(0))).otherwise(in_slices(parts, total, placed, F.lit(0)))


def _needs(p: Pattern) -> tuple[str, ...]:
    """Strings of which a text with a match has one at least, in small letters; none if nothing is known. "0" stands for any digit."""
    outside = re.sub(r"\[[^\]]*\]", "", p.regex)
    if "\\\\" in outside:
        return ("\\",)
    if p.group and (labels := re.match(r"\(\?i\)\(\?:([^)]*)\)", p.regex)):
        words = {x.split("\\s")[0].lower() for x in labels[1].split("|")}
        return tuple(sorted(w for w in words if not any(x != w and x in w for x in words)))
    for x in "@-":
        if x in outside:
            return (x,)
    return ("0",) if r"\d" in outside or re.search("[0-9]", re.sub(r"\{[^}]*\}", "", outside)) else ()


def matches(text: Column, low: Column, digit: Column, p: Pattern) -> Column:
    """What lies between the findings of a pattern and these in turn, in a text without marks; null if there are none. low is the text in small letters, digit whether it has one."""
    regex, marked = (two_groups(steady(p.regex)), f"$1{_MARK}$2{_MARK}") if p.group else (steady(p.regex), f"{_MARK}$0{_MARK}")
    found = let(F.regexp_replace(text, F.lit(regex), F.lit(marked)), lambda x: F.when(F.contains(x, F.lit(_MARK)), F.split(x, _MARK, -1)))
    needed = [digit if x == "0" else F.contains(low, F.lit(x)) for x in _needs(p)]
    some = None
    for x in needed:
        some = x if some is None else some | x
    return found if some is None else F.when(some, found)


def findings(text: Column, patterns: list[Pattern]) -> Column:
    """All findings in a text as an array (FINDING), by pattern, then place; empty for null texts.

    Patterns with the same expression are matched once.
    """
    at: dict[tuple[str, int], list[Pattern]] = {}
    for p in patterns:
        at.setdefault((p.regex, p.group), []).append(p)
    if not at:
        return empty(FINDING)
    keys = list(at)

    def labelled(p: Pattern, found: Column) -> Column:
        one = lambda m: F.struct(F.lit(p.category).alias("entity_group"), m["word"].alias("word"), m["start"].alias("start"), m["end"].alias("end"), F.lit(p.score).alias("score"), F.lit(p.method).alias("method"))
        return F.coalesce(F.transform(found, one), empty(FINDING))

    def by_key(plain: Column, low: Column, digit: Column) -> Column:
        every = F.transform(F.array(*(matches(plain, low, digit, at[key][0]) for key in keys)), lambda parts: F.when(parts.isNotNull(), _placed(parts)))
        return let(every, lambda m: F.concat(*(labelled(p, F.get(m, F.lit(keys.index((p.regex, p.group))))) for p in patterns)))

    unmarked = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    return let(unmarked, lambda plain: let(F.lower(plain), lambda low: let(F.rlike(plain, F.lit("[0-9]")), lambda digit: by_key(plain, low, digit))))
