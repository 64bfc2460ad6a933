"""Many patterns at once: which of them a text can match at all, from one pass over it.

For each pattern the strings are worked out of which a match holds one at least.  An Aho-Corasick automaton over all of
them, built once a worker, reads a text once and gives a bit for each pattern; only patterns whose bit is set are
searched, by the JVM.  So a pattern that a text can't match costs nothing, and what is found is what the searches find.

The automaton reads folded text: characters that a case-insensitive search takes for the same fold to the same.  Folding
together more than that only costs a search.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from collections.abc import Callable, Iterable
from functools import lru_cache
from math import ceil

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veridicta.functions.expressions import re_

MOST_STRINGS = 64  # of one part of a pattern
MOST_CLASS = 16  # members of a character class that are told apart
_BITS = 62  # of a word of the mask


def fold(text: str) -> str:
    """Equal for characters that (?iu) takes for equal; dotted and dotless i are the ones case folding keeps apart."""
    return text.replace("İ", "i").replace("ı", "i").casefold()


def _members(items) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value))
        elif op is K.RANGE and value[1] - value[0] < MOST_CLASS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


class _Part:
    """What is known of a part of a pattern: all strings it can be, or else strings of which it holds one (None: unknown)."""

    def __init__(self, exact: set[str] | None, needs: set[str] | None = None):
        self.exact = exact
        self.needs = (exact if exact and "" not in exact else None) if exact is not None else needs


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The one whose shortest string is longer, then the smaller."""
    known = [x for x in (a, b) if x]
    return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _sequence(items) -> _Part:
    run: set[str] = {""}
    best: set[str] | None = None
    whole = True
    for op, value in items:
        part = _part(op, value)
        if part.exact is not None and len(part.exact) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in part.exact}
            continue
        best, whole = _better(best, _Part(run).needs), False
        if part.exact is not None:  # too many together: a new run
            run = part.exact if len(part.exact) <= MOST_STRINGS else {""}
            best = _better(best, part.needs)
        else:
            run, best = {""}, _better(best, part.needs)
    return _Part(run) if whole else _Part(None, _better(best, _Part(run).needs))


def _part(op, value) -> _Part:
    if op is K.LITERAL:
        return _Part({chr(value)})
    if op is K.AT:
        return _Part({""})
    if op is K.IN:
        return _Part(_members(value))
    if op is K.SUBPATTERN:
        return _sequence(value[-1])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
            return _Part(set().union(*(p.exact for p in parts)))
        return _Part(None, set().union(*(p.needs for p in parts)) if all(p.needs for p in parts) else None)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, inner = value
        part = _sequence(inner)
        if part.exact is not None and (least, most) == (0, 1):
            return _Part(part.exact | {""})
        if part.exact is not None and (least, most) == (1, 1):
            return part
        return _Part(None, part.needs if least else None)
    return _Part(None)


@lru_cache(maxsize=4096)
def needed(pattern: str) -> frozenset[str] | None:
    """Folded strings of which every match holds one; None where there are none to be had."""
    needs = _sequence(parser.parse(pattern)).needs
    if not needs:
        return None
    folded = {fold(x) for x in needs}
    return frozenset(x for x in folded if not any(y != x and y in x for y in folded))


@lru_cache(maxsize=64)
def _automaton(strings: tuple[tuple[str, int], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for text, mask in strings:
        a.add_word(text, mask)
    a.make_automaton()
    return a


class Patterns:
    """Patterns that are looked for in the same texts."""

    def __init__(self, patterns: Iterable[str]):
        self.bit: dict[str, int] = {}
        masks: dict[str, int] = {}
        for p in dict.fromkeys(patterns):
            if strings := needed(p):
                k = self.bit[p] = len(self.bit)
                for s in strings:
                    masks[s] = masks.get(s, 0) | 1 << k
        self.strings = tuple(sorted(masks.items()))
        self.words = ceil(len(self.bit) / _BITS)

    def mask(self, text: Column) -> Column:
        """Which patterns a text can match; to be a column of its own, so that it is computed once."""
        if not self.words:
            return F.lit(None)
        return self._scanner()(F.coalesce(text, F.lit("")))

    def _scanner(self) -> Callable[[Column], Column]:
        strings, words, full = self.strings, self.words, (1 << len(self.bit)) - 1
        names = [f"w{i}" for i in range(words)]

        def scan(texts: pd.Series) -> pd.DataFrame:
            a = _automaton(strings)
            found = []
            for t in texts:
                m = 0
                for _, x in a.iter(fold(t)):
                    m |= x
                    if m == full:
                        break
                found.append(m)
            low = (1 << _BITS) - 1
            return pd.DataFrame({n: pd.Series([m >> _BITS * i & low for m in found], dtype="int64") for i, n in enumerate(names)})

        scan.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(scan, ", ".join(f"{n} long" for n in names))

    def may(self, mask: Column, pattern: str) -> Column:
        if pattern not in self.bit:
            return F.lit(True)
        word, k = divmod(self.bit[pattern], _BITS)
        return mask[f"w{word}"].bitwiseAND(F.lit(1 << k)) != 0

    def has(self, mask: Column, text: Column, pattern: str) -> Column:
        """Whether the pattern occurs in ``text``, which is, or is part of, what the mask is of."""
        found = text.rlike(re_(pattern))
        return self.may(mask, pattern) & found if pattern in self.bit else found
