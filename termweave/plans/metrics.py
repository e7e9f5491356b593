"""The metric language: a postfix stack of per-document integers, each push a string, each metric one Column of longs.

Sums, differences and products that leave 64 bits are errors, whatever the session's ANSI setting is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import INT_MAX, INT_MIN, divide, log, log1pexp, long_, remainder, to_long, wrap_int
from .fields import Fields
from .query import compile_query, parse
from .regex import full_match

#: The most metrics on a stack, the most terms that a term count tells, the pattern of floatscale.
MAX_METRICS = 64
MAX_TERM_COUNT = 255
FLOATSCALE = re.compile(r"floatscale\s+(\w+)\s*\*\s*(-?[0-9]*\.?[0-9]+)\s*\+\s*(-?[0-9]*\.?[0-9]+)")


def _exact(name: str, a: Column, b: Column) -> Column:
    out = F.call_function(f"try_{name}", a, b)
    return F.when(out.isNull(), F.raise_error(F.lit(f"a metric leaves the range of 64 bits: {name}")).cast("long")).otherwise(out)


def _shift_divide(a: Column, b: Column, n: int) -> Column:
    return divide(F.shiftleft(a, n), b)


#: Two operands: the one below the top, then the top.
BINARY = {
    "+": lambda a, b: _exact("add", a, b),
    "-": lambda a, b: _exact("subtract", a, b),
    "*": lambda a, b: _exact("multiply", a, b),
    "/": divide,
    "%": remainder,
    "min()": F.least,
    "max()": F.greatest,
    "=": lambda a, b: (a == b).cast("long"),
    "!=": lambda a, b: (a != b).cast("long"),
    "<": lambda a, b: (a < b).cast("long"),
    "<=": lambda a, b: (a <= b).cast("long"),
    ">": lambda a, b: (a > b).cast("long"),
    ">=": lambda a, b: (a >= b).cast("long"),
}


def _scaled(f, x: Column, n: int) -> Column:
    return to_long(f(x.cast("double") / float(n)) * float(n))


UNARY_SCALED = {
    "exp": lambda x, n: _scaled(F.exp, x, n),
    "log": lambda x, n: to_long((log(x.cast("double")) - log(F.lit(float(n)))) * float(n)),
    "log1pexp": lambda x, n: _scaled(log1pexp, x, n),
}


def float_scaled(fields: Fields, name: str, scale: float, offset: float) -> Column:
    """The field's last term as a number, times ``scale``, plus ``offset``, rounded; 0 if it is missing or no number.

    Of a result beyond 32 bits the low ones are left.
    """
    x = fields.strings(name).text().try_cast("double")
    return F.coalesce(F.when(x.isNotNull(), wrap_int(to_long(F.floor(x * scale + offset + 0.5).cast("double")))), long_(0))


@dataclass(frozen=True)
class Stack:
    """Metrics in the order they were pushed. Every push gives a new stack.

    ``scale``: of documents that stand for so many each; ``counts`` and fields (but ``time``) are multiplied by it.
    """

    fields: Fields
    dynamics: tuple[str, ...] = ()
    metrics: tuple[Column, ...] = field(default=())
    scale: Column | None = None

    def __len__(self) -> int:
        return len(self.metrics)

    def __getitem__(self, i: int) -> Column:
        if not 0 <= i < len(self.metrics):
            raise ValueError(f"no metric {i}: {len(self.metrics)} are pushed")
        return self.metrics[i]

    def _with(self, c: Column, pops: int = 0) -> Stack:
        if len(self.metrics) < pops:
            raise ValueError(f"{pops} metrics are needed, {len(self.metrics)} are pushed")
        return replace(self, metrics=(*self.metrics[: len(self.metrics) - pops], c.cast("long")))

    def pop(self) -> Stack:
        if not self.metrics:
            raise ValueError("no metric to pop")
        return replace(self, metrics=self.metrics[:-1])

    def push_all(self, texts) -> Stack:
        out = self
        for t in texts:
            out = out.push(t)
        return out

    def push_query(self, query) -> Stack:
        """1 for the documents that match a boolean query, 0 for the others."""
        return self._room()._with(compile_query(query, self.fields).cast("long"))

    def _room(self) -> Stack:
        if len(self.metrics) == MAX_METRICS:
            raise ValueError(f"at most {MAX_METRICS} metrics")
        return self

    def push(self, text: str) -> Stack:
        self._room()
        text = text.strip()
        if text in BINARY:
            if len(self.metrics) < 2:
                raise ValueError(f"{text} needs two metrics")
            return self._with(BINARY[text](*self.metrics[-2:]), 2)
        name, _, rest = text.partition(" ")
        rest = rest.strip()
        if text == "count()":
            return self._with(long_(1))
        if text == "counts":
            return self._with(self._scaled(long_(1)))
        if text == "abs()":
            return self._with(F.abs(self[len(self) - 1]), 1)
        if text == "cached()":
            return self._with(self[len(self) - 1], 1)  # `Session.push` freezes it
        if re.fullmatch(r"[+-]?[0-9]+", text):
            if not INT_MIN <= int(text) <= INT_MAX:
                raise ValueError(f"a literal has 32 bits: {text}")
            return self._with(long_(int(text)))
        if rest or name == "regex":
            got = self._named(name, rest)
            if got is not None:
                return got
        value = self.fields.metric(text).value()
        return self._with(value if text in ("time", "unixtime") else self._scaled(value))

    def _scaled(self, metric: Column) -> Column:
        return metric if self.scale is None else _exact("multiply", metric, self.scale)

    def top(self, text: str) -> int:
        """How many metrics on top a push of ``text`` freezes."""
        name, _, rest = text.strip().partition(" ")
        return 1 if text.strip() == "cached()" else _whole(rest.strip()) if name == "interleave" and rest else 0

    def replaced(self, metrics: tuple[Column, ...]) -> Stack:
        """With these in place of as many metrics on top."""
        return replace(self, metrics=(*self.metrics[: len(self.metrics) - len(metrics)], *metrics))

    def _named(self, name: str, rest: str) -> Stack | None:
        top = len(self) - 1
        if name in UNARY_SCALED:
            return self._with(UNARY_SCALED[name](self[top], _whole(rest)), 1)
        if name == "logistic":
            down, _, up = rest.partition(" ")
            down, up = float(down), float(up)
            return self._with(to_long(F.lit(up) / (1 + F.exp(-self[top].cast("double") / down))), 1)
        if name in ("mulshr", "shldiv"):
            n = _whole(rest)
            if not 0 <= n <= 31:
                raise ValueError(f"a shift from 0 to 31 is needed: {rest}")
            if len(self) < 2:
                raise ValueError(f"{name} needs two metrics")
            a, b = self.metrics[-2:]
            return self._with(F.shiftright(_exact("multiply", a, b), n) if name == "mulshr" else _shift_divide(a, b, n), 2)
        if name == "hasint":
            f, t = _field_term(rest)
            return self._with(self.fields.ints(f).equals(int(t)).cast("long"))
        if name == "hasstr":
            f, t = _field_term(rest)
            return self._with(self.fields.strings(f).equals(t).cast("long"))
        if name == "regex":
            f, t = _field_term(rest)
            return self._with(self._matches(f, t).cast("long"))
        if name == "inttermcount":
            return self._with(F.least(self.fields.ints(rest).count(), long_(MAX_TERM_COUNT)))
        if name == "strtermcount":
            return self._with(F.least(self.fields.strings(rest).count(), long_(MAX_TERM_COUNT)))
        if name == "floatscale":
            m = FLOATSCALE.fullmatch(f"floatscale {rest}")
            if not m:
                raise ValueError(f"floatscale needs field*scale+offset: {rest}")
            return self._with(float_scaled(self.fields, m[1], float(m[2]), float(m[3])))
        if name == "dynamic":
            if rest not in self.dynamics:
                raise ValueError(f"no dynamic metric {rest}")
            return self._with(F.col(dynamic_column(rest)).cast("long"))
        if name == "ref":
            return self._with(self[top - _whole(rest)])
        if name == "interleave":
            if not 0 < _whole(rest) <= len(self):
                raise ValueError(f"{rest} metrics are needed, {len(self)} are pushed")
            return self  # `Session.push` freezes them
        if name == "lucene":
            return self.push_query(parse(rest, self.fields.names("int")))
        return None

    def _matches(self, name: str, regex: str) -> Column:
        test = full_match(regex)
        f = self.fields.get(name)
        return F.lit(False) if f is None else f.some(lambda t: test(t.cast("string")))


def dynamic_column(name: str) -> str:
    return f"_dyn_{name}"


def _whole(s: str) -> int:
    if not re.fullmatch(r"-?[0-9]+", s):
        raise ValueError(f"a whole number is needed: {s!r}")
    return int(s)


def _field_term(s: str) -> tuple[str, str]:
    f, colon, t = s.partition(":")
    if not colon:
        raise ValueError(f"field:term is needed: {s!r}")
    return f, t
