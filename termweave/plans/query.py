"""Boolean queries over fields: an immutable tree that compiles to one Boolean Column, and a text form of it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import Fields

#: The number ranges that queries and literals use.
INT_MAX, LONG_MAX = 2**31 - 1, 2**63 - 1


@dataclass(frozen=True)
class Term:
    """Documents that have the term, an int or a str, in the field."""

    field: str
    value: int | str


@dataclass(frozen=True)
class Range:
    """Integer bounds apply to the field's metric (0 if missing), string bounds to its terms.

    Two string bounds that are whole numbers from 0 to 2**31 - 1 compare numerically with the terms that are.
    """

    field: str
    low: int | str
    high: int | str
    inclusive: bool = True

    def __post_init__(self):
        if isinstance(self.low, str) != isinstance(self.high, str):
            raise ValueError("both ends of a range must be of one type")
        if not isinstance(self.low, str) and self.high < self.low:
            raise ValueError("a range must not end before it starts")


@dataclass(frozen=True, init=False)
class And:
    parts: tuple

    def __init__(self, *parts):
        object.__setattr__(self, "parts", tuple(parts))


@dataclass(frozen=True, init=False)
class Or:
    parts: tuple

    def __init__(self, *parts):
        object.__setattr__(self, "parts", tuple(parts))


@dataclass(frozen=True, init=False)
class Not:
    """Documents that match none of the parts. A Not directly in a Not is an error."""

    parts: tuple

    def __init__(self, *parts):
        if any(isinstance(p, Not) for p in parts):
            raise ValueError("a negation can't be negated directly")
        object.__setattr__(self, "parts", tuple(parts))


def _small(s: str) -> int | None:
    return int(s) if re.fullmatch(r"\+?[0-9]+", s) and int(s) <= INT_MAX else None


def _range(q: Range, fields: Fields) -> Column:
    if not isinstance(q.low, str):
        v = fields.ints(q.field).value()
        return (v >= q.low) & ((v <= q.high) if q.inclusive else (v < q.high))
    low, high = _small(q.low), _small(q.high)
    if low is None or high is None:
        return fields.strings(q.field).some(lambda t: (t >= q.low) & ((t <= q.high) if q.inclusive else (t < q.high)))
    number = lambda t: t.try_cast("int")
    return fields.strings(q.field).some(lambda t: (number(t) >= low) & ((number(t) <= high) if q.inclusive else (number(t) < high)))


def compile_query(q, fields: Fields) -> Column:
    """A Boolean Column, never null. Terms of one field in an Or become one membership test."""
    if isinstance(q, Term):
        return fields.of_kind(q.field, not isinstance(q.value, str)).equals(q.value)
    if isinstance(q, Range):
        return _range(q, fields)
    if isinstance(q, And):
        out = F.lit(True)
        for p in q.parts:
            out = out & compile_query(p, fields)
        return out
    if isinstance(q, Or):
        sets: dict[tuple[str, bool], list] = {}
        out = F.lit(False)
        for p in q.parts:
            if isinstance(p, Term):
                sets.setdefault((p.field, not isinstance(p.value, str)), []).append(p.value)
            else:
                out = out | compile_query(p, fields)
        for (name, is_int), terms in sets.items():
            out = out | fields.of_kind(name, is_int).among(terms)
        return out
    if isinstance(q, Not):
        return ~compile_query(Or(*q.parts), fields)
    raise TypeError(f"not a query: {q!r}")


# the text form ---------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<word>AND|OR|NOT)(?=[\s(]|$)|(?P<sign>[+\-])(?=\S)|(?P<field>[^\s:()+\-"\[{][^\s:()"]*):|(?P<range>[\[{][^\]}]*[\]}])|(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<bare>[^\s()]+))""")


def parse(text: str, int_fields=(), default: str | None = None):
    """A query from text: ``field:term``, ``field:pre*``, ``field:[a TO b]``, ``field:{a TO b}``, ``field:"two terms"``
    (both), parentheses, AND, OR, NOT, and the signs + (must) and - (must not). What has no sign should match; it counts
    only if nothing must. Terms of ``int_fields`` are integers.
    """
    int_fields, tokens, at = set(int_fields), [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read the query at {text[at:]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()

    def one(s: str, field: str):
        return int(s) if field in int_fields else s

    def value(field: str | None):
        kind, s = tokens.pop(0) if tokens else (None, "")
        field = field or default
        if field is None:
            raise ValueError(f"no field for {s!r}")
        if kind == "range":
            ends = re.fullmatch(r"[\[{]\s*(\S+)\s+TO\s+(\S+)\s*[\]}]", s)
            if not ends:
                raise ValueError(f"not a range: {s!r}")
            return Range(field, one(ends[1], field), one(ends[2], field), s[-1] == "]")
        if kind == "quoted":
            terms = re.sub(r"\\(.)", r"\1", s[1:-1]).split()
            return Term(field, one(terms[0], field)) if len(terms) == 1 else And(*(Term(field, one(t, field)) for t in terms))
        if kind != "bare" and kind != "word":
            raise ValueError(f"a term is missing after {field}:")
        if s.endswith("*") and len(s) > 1:
            if field in int_fields:
                return Range(field, int(s[:-1]), LONG_MAX)
            return Range(field, s[:-1], s[:-2] + chr(ord(s[-2]) + 1), False)
        return Term(field, one(s, field))

    def clause():
        kind, s = tokens[0]
        if kind == "open":
            tokens.pop(0)
            out = clauses()
            if not tokens or tokens.pop(0)[0] != "close":
                raise ValueError("a parenthesis isn't closed")
            return out
        if kind == "field":
            tokens.pop(0)
            if tokens and tokens[0][0] == "open":
                raise ValueError("a field is followed by one term")
            return value(s)
        return value(None)

    def clauses():
        must, should, never = [], [], []
        joined = None
        while tokens and tokens[0][0] != "close":
            sign = ""
            if tokens[0][0] == "word" and tokens[0][1] in ("AND", "OR"):
                joined = tokens.pop(0)[1]
                if joined == "AND" and should:  # both sides must match
                    must.append(should.pop())
                continue
            while tokens and (tokens[0][0] == "sign" or tokens[0] == ("word", "NOT")):
                sign = {"+": "+", "-": "-", "NOT": "-"}[tokens.pop(0)[1]]
            if not tokens:
                raise ValueError("the query ends after a sign")
            part = clause()
            (never if sign == "-" else must if sign == "+" or joined == "AND" else should).append(part)
            joined = None
        main = must or should
        if not main and not never:
            raise ValueError("an empty query")
        body = None if not main else main[0] if len(main) == 1 else And(*main) if must else Or(*main)
        return body if not never else Not(*never) if body is None else And(body, Not(*never))

    out = clauses()
    if tokens:
        raise ValueError("a parenthesis isn't open")
    return out
