"""Fields of documents: sets of integer or string terms, held in a scalar or an array column.

A scalar column is a set of at most one term (null: none), so that flat tables need neither arrays nor explode. Every
predicate is a Column that is never null, and every metric one that is never null either.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, STRING = "int", "string"
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Field:
    """``column`` is of type long or string, or an array of these if ``multi``; an array's null elements aren't terms."""

    name: str
    kind: str
    column: Column
    multi: bool = False

    @property
    def is_int(self) -> bool:
        return self.kind == INT

    def equals(self, term) -> Column:
        return _sure(F.array_contains(self.column, term) if self.multi else self.column == F.lit(term))

    def at_most(self, term) -> Column:
        """Whether some term is <= ``term``."""
        return _sure((F.array_min(self.column) if self.multi else self.column) <= F.lit(term))

    def among(self, terms: Iterable) -> Column:
        terms = list(dict.fromkeys(terms))
        if not terms:
            return F.lit(False)
        if self.multi:
            return _sure(F.exists(self.column, lambda t: t.isin(terms)))
        return _sure(self.column.isin(terms))

    def some(self, test) -> Column:
        """Whether ``test``, from a term's Column to a Boolean one, holds for some term."""
        return _sure(F.exists(self.column, test) if self.multi else test(self.column))

    def value(self) -> Column:
        """The metric of the field: the largest term, 0 without one."""
        if not self.is_int:
            return self.as_int().value()
        return F.coalesce(F.array_max(self.column) if self.multi else self.column, F.lit(0).cast("long"))

    def text(self) -> Column:
        """The string lookup of the field: the last term in order, empty without one."""
        return F.coalesce(F.array_max(self.column) if self.multi else self.column, F.lit("")).cast("string")

    def count(self) -> Column:
        """How many terms the document has in the field."""
        if self.multi:
            return F.coalesce(F.size(F.filter(self.column, lambda t: t.isNotNull())), F.lit(0)).cast("long")
        return self.column.isNotNull().cast("long")

    def present(self) -> Column:
        return self.count() > 0

    def terms(self) -> Column:
        """The terms as an array, for explode."""
        if self.multi:
            return F.filter(self.column, lambda t: t.isNotNull())
        return F.when(self.column.isNotNull(), F.array(self.column))

    def as_int(self) -> Field:
        """A string field read for integer terms: each term parsed, what isn't a number is 0."""
        if self.is_int:
            return self
        # a term that isn't there stays so
        number = lambda t: F.coalesce(t.try_cast("long"), F.when(t.isNotNull(), F.lit(0).cast("long")))
        return Field(self.name, INT, F.array_distinct(F.transform(self.column, number)) if self.multi else number(self.column), self.multi)


def nothing(name: str, kind: str) -> Field:
    """A field that no document has: names may be missing in some shards, so asking for one is no error."""
    return Field(name, kind, F.lit(None).cast("long" if kind == INT else "string"))


class Fields(Mapping):
    """The fields of a dataset by name."""

    def __init__(self, fields: Iterable[Field]):
        self._by = {f.name: f for f in fields}

    def __getitem__(self, name: str) -> Field:
        return self._by[name]

    def __iter__(self):
        return iter(self._by)

    def __len__(self) -> int:
        return len(self._by)

    def ints(self, name: str) -> Field:
        """The field, for integer terms."""
        return self._by[name].as_int() if name in self._by else nothing(name, INT)

    def strings(self, name: str) -> Field:
        """The field, for string terms; an integer field has none."""
        f = self._by.get(name)
        return f if f is not None and not f.is_int else nothing(name, STRING)

    def of_kind(self, name: str, is_int: bool) -> Field:
        return self.ints(name) if is_int else self.strings(name)

    def names(self, kind: str) -> list[str]:
        return [n for n, f in self._by.items() if f.kind == kind]

    def metric(self, name: str) -> Field:
        """The field as a metric; ``time`` and ``unixtime`` stand for each other."""
        other = {"time": "unixtime", "unixtime": "time"}.get(name)
        if other in self._by and name not in self._by:
            name = other
        return self.ints(name)

    def with_(self, field: Field) -> Fields:
        return Fields([*(f for f in self._by.values() if f.name != field.name), field])

    def only(self, names: Iterable[str]) -> Fields:
        keep = set(names)
        return Fields(f for f in self._by.values() if f.name in keep)


def infer(df: DataFrame, ints: Iterable[str] | None = None, strings: Iterable[str] | None = None) -> Fields:
    """Fields of the integer, Boolean and string columns of ``df`` and of arrays of these; names narrow the choice.

    Arrays lose repeated terms. A column of another type (a decimal, a double that holds whole numbers) becomes a field
    by being named.
    """
    ints, strings = None if ints is None else set(ints), None if strings is None else set(strings)
    named = None if ints is None and strings is None else (ints or set()) | (strings or set())
    out = []
    for column in df.schema.fields:
        kind, multi = column.dataType, False
        if isinstance(kind, T.ArrayType):
            kind, multi = kind.elementType, True
        name, c = column.name, F.col(f"`{column.name}`")
        if column.name.startswith("_") or named is not None and name not in named:
            continue
        if isinstance(kind, T.StringType) and not (ints and name in ints) or strings and name in strings:
            c = c.cast("array<string>" if multi else "string")
            out.append(Field(name, STRING, F.array_distinct(c) if multi else c, multi))
        elif isinstance(kind, _INTS) or ints and name in ints:
            c = c.cast("array<bigint>" if multi else "bigint")
            out.append(Field(name, INT, F.array_distinct(c) if multi else c, multi))
    return Fields(out)
