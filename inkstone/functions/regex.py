"""Regular expressions as columns, in the dialect the patterns were written for.

``d`` keeps line ends to the newline, ``U`` makes classes Unicode-aware; both engines then agree on
words, digits and blanks.

Most patterns are not in most texts. ``searched`` gives a text together with its folded form, in which the words
that a pattern cannot do without are looked for as plain strings; the pattern itself runs only where one is there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_INLINE = re.compile(r"^\(\?([im]+)\)")


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The pattern with its flags in front; inline flags of the pattern itself are honoured."""
    m = _INLINE.match(pattern)
    if m:
        ignore_case, multiline, pattern = ignore_case or "i" in m[1], multiline or "m" in m[1], pattern[m.end() :]
    return f"(?dU{'iu' if ignore_case else ''}{'m' if multiline else ''})" + pattern


@dataclass(frozen=True)
class Searched:
    """A text and the folded form of it, or of a text that holds all its words."""

    text: Column
    folded: Column


def fold(text: Column) -> Column:
    """ASCII letters in lower case, with the four other characters that match one where case is ignored."""
    return F.lower(F.translate(text, "\u017f\u0131\u212a\u0130", "siki"))


def searched(text: Column, fn) -> Column:
    """``fn`` of a ``Searched`` text whose folded form is computed once."""
    both = F.transform(F.array(F.struct(text.alias("t"), fold(text).alias("f"))), lambda x: fn(Searched(x["t"], x["f"])))
    return F.get(both, F.lit(0))


#: More or shorter strings than these cost as much to look for as the pattern.
MOST_NEEDLES, LEAST_LENGTH = 8, 3
#: Words that are in most texts.
COMMON = frozenset("the this that and for with must".split())


def _product(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MOST_NEEDLES else None


def _exact(items) -> set[str] | None:
    """All strings that a parsed pattern matches, in lower case, if they are few and plain."""
    out: set[str] | None = {""}
    for op, av in items:
        if op is ops.LITERAL and av < 128:
            more: set[str] | None = {chr(av).lower()}
        elif op is ops.SUBPATTERN:
            more = _exact(av[3])
        elif op is ops.BRANCH:
            parts = [_exact(x) for x in av[1]]
            more = None if None in parts else set().union(*parts)
        elif op is ops.IN:
            more = {chr(v).lower() for k, v in av if k is ops.LITERAL and v < 128} if all(k is ops.LITERAL and v < 128 for k, v in av) else None
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and av[1] == 1:
            inner = _exact(av[2])
            more = None if inner is None else inner | ({""} if av[0] == 0 else set())
        elif op is ops.AT:
            continue
        else:
            more = None
        out = None if more is None else _product(out, more)
        if out is None:
            return None
    return out


def _required(items) -> set[str] | None:
    """Strings of which every match holds at least one, in lower case; None if no good ones are found."""
    found: list[set[str]] = []
    now = {""}

    def close() -> None:
        nonlocal now
        if min(map(len, now)) >= LEAST_LENGTH:
            found.append(now)
        now = {""}

    for item in items:
        op, av = item
        if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
            continue
        exact = _exact([item])
        longer = None if exact is None else _product(now, exact)
        if longer is not None:
            now = longer
            continue
        close()
        if exact is not None:
            now = exact
            continue
        inner = None
        if op is ops.SUBPATTERN:
            inner = _required(av[3])
        elif op is ops.BRANCH:
            parts = [_required(x) for x in av[1]]
            inner = None if None in parts else set().union(*parts)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and av[0] >= 1:
            inner = _required(av[2])
        if inner:
            found.append(inner)
    close()
    # A string that holds another is not looked for besides it.
    plain = [{s for s in x if not any(o != s and o in s for o in x)} for x in found]
    few = [x for x in plain if len(x) <= MOST_NEEDLES]
    # Few, long and rare strings are the best ones.
    cost = lambda x: sum(0.01 + (0.3 if s.strip() in COMMON else 0.5 ** len(s)) for s in x)
    return min(few, key=cost) if few else None


@lru_cache(None)
def needles(pattern: str) -> tuple[str, ...]:
    """Strings of which the folded form of a text must hold one for the pattern to be in the text; none if that is not known."""
    m = _INLINE.match(pattern)
    try:
        parsed = parser.parse(pattern[m.end() :] if m else pattern)
    except re.error:
        return ()
    return tuple(sorted(_required(parsed) or ()))


def _guarded(text: Searched | Column, pattern: str, of, otherwise) -> Column:
    if not isinstance(text, Searched):
        return of(text)
    wanted = [F.contains(text.folded, F.lit(n)) for n in needles(pattern)]
    return F.when(reduce(lambda a, b: a | b, wanted), of(text.text)).otherwise(F.lit(otherwise)) if wanted else of(text.text)


def count(text: Searched | Column, pattern: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    return _guarded(text, pattern, lambda t: F.regexp_count(t, F.lit(java(pattern, ignore_case, multiline))), 0)


def has(text: Searched | Column, pattern: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    return _guarded(text, pattern, lambda t: t.rlike(java(pattern, ignore_case, multiline)), False)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def count_all(text: Searched | Column, patterns: list[str], ignore_case: bool = True, multiline: bool = False) -> Column:
    """Hits of all patterns together."""
    return total([count(text, p, ignore_case, multiline) for p in patterns])


def any_word(words: list[str]) -> str:
    """One alternation for a list of literal words."""
    return r"\b(?:" + "|".join(re.escape(w).replace(r"\-", "-").replace(r"\ ", " ") for w in words) + r")\b"


def ladder(value: Column, steps: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """The amount of the first threshold that the value reaches."""
    out = None
    for threshold, amount in steps:
        out = F.when(value >= threshold, F.lit(amount)) if out is None else out.when(value >= threshold, F.lit(amount))
    return out.otherwise(F.lit(otherwise))
