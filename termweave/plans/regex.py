"""Regular expressions that must match a whole term, in the dialect of automata.

Besides the usual operators: ``@`` any string, ``#`` the empty language, ``"..."`` a literal, ``<n-m>`` a number from n to m
(with as many digits as both have, or with any zeros before it), ``A&B`` both, ``~A`` not A. The last two become Boolean
Columns, which they can where they reach from end to end of the term: at the top, in alternatives and in parentheses
around these, ``~`` before one unit. Elsewhere, as in ``a~(b)c``, they are errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVAL = re.compile(r"<([0-9]+)-([0-9]+)>")


def _between(a: str, b: str) -> str:
    """Digits from ``a`` to ``b``, which have the same length."""
    if a == b:
        return a
    if len(a) == 1:
        return f"[{a}-{b}]"
    if a[0] == b[0]:
        return a[0] + _between(a[1:], b[1:])
    rest, low, high, out = len(a) - 1, int(a[0]), int(b[0]), []
    if a[1:] != "0" * rest:
        out.append(a[0] + _between(a[1:], "9" * rest))
        low += 1
    if b[1:] != "9" * rest:
        out.append(b[0] + _between("0" * rest, b[1:]))
        high -= 1
    if low <= high:
        out.append(f"[{low}-{high}][0-9]{{{rest}}}")
    return f"(?:{'|'.join(out)})"


def interval(n: str, m: str) -> str:
    low, high = sorted((int(n), int(m)))
    if len(n) == len(m):
        return _between(str(low).zfill(len(n)), str(high).zfill(len(n)))
    sizes = range(len(str(low)), len(str(high)) + 1)
    return "0*(?:" + "|".join(_between(str(max(low, 10 ** (k - 1) if k > 1 else 0)), str(min(high, 10**k - 1))) for k in sizes) + ")"


def _units(regex: str) -> list[str]:
    """Escapes, brackets, quotes, intervals, whole groups and single characters, in order."""
    out, i = [], 0
    while i < len(regex):
        c, end = regex[i], i + 1
        if c == "\\":
            if end == len(regex):
                raise ValueError("the expression ends after a backslash")
            end += 1
        elif c == "[":
            while end < len(regex) and regex[end] != "]":
                end += 2 if regex[end] == "\\" else 1
            end += 1
            if end > len(regex):
                raise ValueError("a bracket isn't closed")
        elif c == '"':
            end = regex.find('"', i + 1) + 1
            if not end:
                raise ValueError("a quote isn't closed")
        elif c == "<":
            m = INTERVAL.match(regex, i)
            if not m:
                raise ValueError("< needs a number interval; escape it to mean the character")
            end = m.end()
        elif c == "(":
            inner = _units_until(regex, end)
            end = inner + 1
        elif c == ")":
            raise ValueError("a parenthesis isn't opened")
        out.append(regex[i:end])
        i = end
    return out


def _units_until(regex: str, i: int) -> int:
    """Where the parenthesis that is open at ``i`` closes."""
    depth = 1
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i += 1
            while i < len(regex) and regex[i] != "]":
                i += 2 if regex[i] == "\\" else 1
        elif c == '"':
            i = regex.find('"', i + 1)
            if i < 0:
                raise ValueError("a quote isn't closed")
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
        i += 1
    raise ValueError("a parenthesis isn't closed")


def _java(unit: str) -> str:
    """One unit for the JVM's engine, in which ^ and $ are ordinary characters."""
    c = unit[0]
    if c == "\\":
        return re.escape(unit[1])
    if c == "[":
        body, out, i = unit[1:-1], [], 0
        while i < len(body):
            if body[i] == "\\":
                out.append(re.escape(body[i + 1]))
                i += 1
            else:
                out.append("\\" + body[i] if body[i] in "[&" else body[i])
            i += 1
        return f"[{''.join(out)}]"
    if c == '"' and len(unit) > 1:
        return f"(?:{re.escape(unit[1:-1])})"
    if c == "<":
        return f"(?:{interval(*INTERVAL.fullmatch(unit).groups())})"
    if c == "(":
        return f"({_plain(_units(unit[1:-1]))})"
    if c in "~&":
        raise ValueError(f"{c} must reach from end to end of the term; escape it to mean the character")
    return {"@": "(?:.*)", "#": "(?!)", "^": "\\^", "$": "\\$"}.get(c, c)


def _plain(units: list[str]) -> str:
    return "".join(map(_java, units))


def _split(units: list[str], by: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for u in units:
        if u == by:
            out.append([])
        else:
            out[-1].append(u)
    return out


def _special(regex: str) -> bool:
    return any(u in ("~", "&") or u[0] == "(" and _special(u[1:-1]) for u in _units(regex))


def translate(regex: str) -> str:
    """The expression for the JVM's engine. Complements and intersections are errors here."""
    return f"(?s)\\A(?:{_plain(_units(regex))})\\z"


def _test(units: list[str]) -> Callable[[Column], Column]:
    if not _special("".join(units)):
        java = translate("".join(units))
        return lambda t: t.rlike(java)
    for by, join in (("|", or_), ("&", and_)):
        parts = _split(units, by)
        if len(parts) > 1:
            tests = [_test(p) for p in parts]
            return lambda t: reduce(join, (test(t) for test in tests))
    if units[0] == "~" and len(units) > 1:
        inner = _test(units[1:])
        if units[1] != "~" and len(units) > 2:
            raise ValueError("~ stands before one unit; use parentheses")
        return lambda t: ~inner(t)
    if len(units) == 1 and units[0][0] == "(":
        return _test(_units(units[0][1:-1]))
    raise ValueError("~ and & must reach from end to end of the term; escape them to mean the characters")


def full_match(regex: str) -> Callable[[Column], Column]:
    return _test(_units(regex))


def matches(column: Column, regex: str) -> Column:
    return F.coalesce(full_match(regex)(column), F.lit(False))
