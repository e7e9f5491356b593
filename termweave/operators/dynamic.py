"""Dynamic metrics: named 32-bit numbers of each document that updates add to, stopping at the ends of their range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clamp_int
from ..plans.fields import Fields
from ..plans.rules import Condition
from .regroup import GROUP


def _check(conditions: Sequence[Condition], deltas: Sequence[int]) -> None:
    if len(conditions) != len(deltas):
        raise ValueError("as many deltas as conditions are needed")
    if any(c.inequality for c in conditions):
        raise ValueError("only equality conditions update a metric")


def _moved(value: Column, delta: Column) -> Column:
    # the value stands here once, so that a chain of updates stays a chain
    return clamp_int(value.cast("long") + F.coalesce(delta, F.lit(0).cast("long")))


def _fold(value: Column, steps: Sequence[tuple[Column, int]]) -> Column:
    for hit, delta in steps:
        value = _moved(value, F.when(hit, F.lit(delta).cast("long")))
    return value


def by_group(value: Column, deltas: Sequence[int]) -> Column:
    """Add deltas[group]; groups beyond the list keep their value."""
    if not deltas:
        return value
    listed = F.array(*(F.lit(int(d)).cast("long") for d in deltas))
    return _moved(value, F.get(listed, F.col(GROUP)))


def by_conditions(value: Column, fields: Fields, conditions: Sequence[Condition], deltas: Sequence[int]) -> Column:
    """Add the delta of each condition that the document meets, one after the other, whatever its group."""
    _check(conditions, deltas)
    return _fold(value, [(c.column(fields), int(d)) for c, d in zip(conditions, deltas)])


def by_group_conditions(value: Column, fields: Fields, groups: Sequence[int], conditions: Sequence[Condition], deltas: Sequence[int]) -> Column:
    """The same in the condition's group only; of several for one group, field and term the last counts."""
    if len(groups) != len(conditions):
        raise ValueError("as many groups as conditions are needed")
    _check(conditions, deltas)
    last = {(g, c.field, c.is_int, c.term): (c, int(d)) for g, c, d in zip(groups, conditions, deltas)}
    return _fold(value, [((F.col(GROUP) == g) & c.column(fields), d) for (g, *_), (c, d) in last.items()])
