"""Rules that send the documents of a group to other groups, and their validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import Fields


@dataclass(frozen=True)
class Condition:
    """Some term of ``field`` equals ``term``, or is at most ``term`` if ``inequality``. An int is an integer term."""

    field: str
    term: int | str
    inequality: bool = False

    @property
    def is_int(self) -> bool:
        return not isinstance(self.term, str)

    def column(self, fields: Fields) -> Column:
        f = fields.of_kind(self.field, self.is_int)
        return f.at_most(self.term) if self.inequality else f.equals(self.term)


@dataclass(frozen=True)
class Rule:
    """Documents of group ``target`` go to ``positive`` if they satisfy the condition, else to ``negative``; without one, to the latter."""

    target: int
    condition: Condition | None
    negative: int
    positive: int


@dataclass(frozen=True)
class MultiRule:
    """Documents of group ``target`` go to the positive group of the first condition they satisfy, else to ``negative``."""

    target: int
    negative: int
    positives: Sequence[int]
    conditions: Sequence[Condition]

    def __post_init__(self):
        object.__setattr__(self, "positives", tuple(self.positives))
        object.__setattr__(self, "conditions", tuple(self.conditions))
        if len(self.positives) != len(self.conditions):
            raise ValueError("as many positive groups as conditions are needed")


@dataclass(frozen=True)
class QueryRule:
    """Documents of group ``target`` go to ``positive`` if they match the query, else to ``negative``."""

    target: int
    query: object
    negative: int
    positive: int


def check_multi(rules: Sequence[MultiRule]) -> None:
    """Targets are positive and differ; in a rule no equality is repeated, and a field's inequalities grow."""
    targets = [r.target for r in rules]
    if any(t < 1 for t in targets):
        raise ValueError("a rule's target must be at least 1")
    if len(set(targets)) < len(targets):
        raise ValueError("two rules have one target")
    for r in rules:
        equal: set = set()
        last: dict = {}
        for c in r.conditions:
            key = c.field, c.is_int
            if c.inequality:
                if key in last and c.term <= last[key]:
                    raise ValueError(f"thresholds of {c.field} must grow: {c.term} after {last[key]}")
                last[key] = c.term
            elif (*key, c.term) in equal:
                raise ValueError(f"two conditions ask for {c.term} in {c.field}")
            else:
                equal.add((*key, c.term))


def first_of(rules: Sequence[Rule]) -> dict[int, Rule]:
    """Rules by target; of several with one target the first counts."""
    out: dict[int, Rule] = {}
    for r in rules:
        out.setdefault(r.target, r)
    return out


def outcome(rule: MultiRule, fields: Fields) -> Column:
    """The group that the rule sends a document of its target to."""
    chain = None
    for c, g in zip(rule.conditions, rule.positives):
        hit = c.column(fields)
        chain = F.when(hit, F.lit(g)) if chain is None else chain.when(hit, F.lit(g))
    return F.lit(rule.negative) if chain is None else chain.otherwise(F.lit(rule.negative))


def equalities_met(rules: Sequence[MultiRule], fields: Fields, group: Column) -> Column:
    """How many equality conditions of its group's rule a document meets."""
    out = F.lit(0)
    for r in rules:
        some = F.lit(0)
        for c in r.conditions:
            if not c.inequality:
                some = some + c.column(fields).cast("int")
        out = F.when(group == r.target, some).otherwise(out)
    return out
