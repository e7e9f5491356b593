"""Transitions of the group column. Each function gives the new group of a document as one Column of int.

Group 0 holds documents that are filtered out. What a rule doesn't address goes to 0; what a query, a term list, a
regular expression or a random choice doesn't address stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chooser import uniform
from ..plans import rules as R
from ..plans.fields import Field, Fields
from ..plans.query import compile_query
from ..plans.regex import full_match

GROUP = "_grp"
#: More rules than this are joined as a table; more than MAX_BROADCAST_RULES of these by a shuffle.
INLINE_RULES, MAX_BROADCAST_RULES = 50, 100_000


def _int(n: int) -> Column:
    return F.lit(n).cast("int")


def by_rules(df: DataFrame, fields: Fields, rules: Sequence[R.Rule]) -> DataFrame:
    """Groups after single-condition rules; the first rule of a target counts, groups without a rule go to 0."""
    by = R.first_of(rules)
    if len(by) > INLINE_RULES:
        return _by_rule_table(df, fields, list(by.values()))
    group, out = F.col(GROUP), None
    for r in by.values():
        hit = F.lit(False) if r.condition is None else r.condition.column(fields)
        new = F.when(hit, _int(r.positive)).otherwise(_int(r.negative))
        out = F.when(group == r.target, new) if out is None else out.when(group == r.target, new)
    return df.withColumn(GROUP, _int(0) if out is None else out.otherwise(_int(0)))


def _by_rule_table(df: DataFrame, fields: Fields, rules: list[R.Rule]) -> DataFrame:
    """The same by a join on the group: a row a rule, and a predicate for each kind of condition there is."""
    kinds = list(dict.fromkeys((r.condition.field, r.condition.is_int, r.condition.inequality) for r in rules if r.condition))
    rows = []
    for r in rules:
        c = r.condition
        kind = -1 if c is None else kinds.index((c.field, c.is_int, c.inequality))
        rows.append((r.target, kind, c.term if c and c.is_int else None, c.term if c and not c.is_int else None, r.negative, r.positive))
    table = df.sparkSession.createDataFrame(rows, "_target int, _kind int, _int long, _str string, _neg int, _pos int")
    table = F.broadcast(table) if len(rows) <= MAX_BROADCAST_RULES else table
    hit = F.lit(False)
    for k, (name, is_int, inequality) in enumerate(kinds):
        f, term = fields.of_kind(name, is_int), F.col("_int" if is_int else "_str")
        if inequality:
            test = F.coalesce((F.array_min(f.column) if f.multi else f.column) <= term, F.lit(False))
        else:
            test = F.coalesce(F.array_contains(f.column, term) if f.multi else f.column == term, F.lit(False))
        hit = F.when(F.col("_kind") == k, test).otherwise(hit)
    joined = df.join(table, F.col(GROUP) == F.col("_target"), "left")
    new = F.when(F.col("_target").isNull(), _int(0)).when(hit, F.col("_pos")).otherwise(F.col("_neg"))
    return joined.withColumn(GROUP, new).drop("_target", "_kind", "_int", "_str", "_neg", "_pos")


def by_multi_rules(fields: Fields, rules: Sequence[R.MultiRule], error_on_collisions: bool = False) -> Column:
    R.check_multi(rules)
    group, out = F.col(GROUP), None
    for r in rules:
        new = R.outcome(r, fields).cast("int")
        out = F.when(group == r.target, new) if out is None else out.when(group == r.target, new)
    out = _int(0) if out is None else out.otherwise(_int(0))
    if error_on_collisions:
        more = R.equalities_met(rules, fields, group) > 1
        out = F.when(more, F.raise_error(F.lit("a document meets several conditions of its rule")).cast("int")).otherwise(out)
    return out


def split(target: int, hit: Column, negative: int, positive: int) -> Column:
    """Documents of the target go to one of two groups, all others stay."""
    return F.when(F.col(GROUP) == target, F.when(hit, _int(positive)).otherwise(_int(negative))).otherwise(F.col(GROUP))


def by_query(fields: Fields, rule: R.QueryRule) -> Column:
    return split(rule.target, compile_query(rule.query, fields), rule.negative, rule.positive)


def by_terms(fields: Fields, field: str, terms: Sequence, target: int, negative: int, positive: int, is_int: bool) -> Column:
    return split(target, fields.of_kind(field, is_int).among(terms), negative, positive)


def by_regex(fields: Fields, field: str, regex: str, target: int, negative: int, positive: int) -> Column:
    return split(target, fields.strings(field).some(full_match(regex)), negative, positive)


def _each_term(f: Field, new, target: int) -> Column:
    """The group that the first ascending term moves the document to that moves it out of the target."""
    if not f.multi:
        return F.when(f.column.isNull(), _int(target)).otherwise(new(f.column))
    moved = F.filter(F.transform(F.sort_array(f.terms()), new), lambda g: g != target)
    return F.coalesce(F.get(moved, 0), _int(target))


def by_chance(fields: Fields, field: str, is_int: bool, salt: str, p: float, target: int, negative: int, positive: int) -> Column:
    """Terms hash to a number from 0 to 1: from ``p`` on to the positive group, else to the negative. Documents without a term stay."""
    f = fields.of_kind(field, is_int)
    new = lambda t: F.when(uniform(t, salt) >= p, _int(positive)).otherwise(_int(negative))
    return F.when(F.col(GROUP) == target, _each_term(f, new, target)).otherwise(F.col(GROUP))


def by_chances(fields: Fields, field: str, is_int: bool, salt: str, target: int, percentages: Sequence[float], groups: Sequence[int]) -> Column:
    """To groups[i] of the first percentage above the term's number, else to the last group."""
    if len(groups) != len(percentages) + 1:
        raise ValueError("one more group than percentages is needed")
    if any(not 0 <= p <= 1 for p in percentages) or any(a > b for a, b in zip(percentages, percentages[1:])):
        raise ValueError("percentages must ascend from 0 to 1")
    f = fields.of_kind(field, is_int)

    def new(t: Column) -> Column:
        out, u = None, uniform(t, salt)
        for p, g in zip(percentages, groups):
            out = F.when(u < p, _int(g)) if out is None else out.when(u < p, _int(g))
        return _int(groups[-1]) if out is None else out.otherwise(_int(groups[-1]))

    return F.when(F.col(GROUP) == target, _each_term(f, new, target)).otherwise(F.col(GROUP))


def bucket_count(low: int, high: int, interval: int) -> int:
    if interval <= 0 or high <= low:
        raise ValueError("a range that isn't empty and an interval above 0 are needed")
    return (high - 1 - low) // interval + 1


def by_metric(metric: Column, low: int, high: int, interval: int, gutters: bool = True) -> Column:
    """Buckets of the metric from ``low`` to below ``high``, for each group a run of them.

    With gutters, one for what lies below and one for what lies above follow the buckets; without, that goes to 0.
    """
    n = bucket_count(low, high, interval)
    inside = F.call_function("div", metric - F.lit(low).cast("long"), F.lit(interval).cast("long")) + 1
    if gutters:
        bucket, width = F.when(metric < low, n + 1).when(metric >= high, n + 2).otherwise(inside), n + 2
        new = (F.col(GROUP) - 1) * width + bucket
    else:
        out = (metric < low) | (metric >= high)
        new = F.when(out, 0).otherwise((F.col(GROUP) - 1) * n + inside)
    return F.when(F.col(GROUP) == 0, _int(0)).otherwise(new.cast("int"))


def by_two_metrics(x: Column, x_low: int, x_high: int, x_interval: int, y: Column, y_low: int, y_high: int, y_interval: int) -> tuple[Column, int]:
    """Cells of a grid with gutters on all four sides, row by row from 1; and how many there are. All groups but 0 merge."""
    nx, ny = bucket_count(x_low, x_high, x_interval) + 2, bucket_count(y_low, y_high, y_interval) + 2

    def place(v: Column, low: int, high: int, interval: int, n: int) -> Column:
        return F.when(v < low, 0).when(v >= high, n - 1).otherwise(F.call_function("div", v - F.lit(low).cast("long"), F.lit(interval).cast("long")) + 1)

    cell = place(y, y_low, y_high, y_interval, ny) * nx + place(x, x_low, x_high, x_interval, nx) + 1
    return F.when(F.col(GROUP) == 0, _int(0)).otherwise(cell.cast("int")), nx * ny


def by_filter(metric: Column, low: int, high: int, negate: bool = False) -> Column:
    """Documents whose metric is in [low, high] stay, all others go to 0; the other way round if ``negate``."""
    inside = metric.between(F.lit(low).cast("long"), F.lit(high).cast("long"))
    return F.when(~inside if negate else inside, F.col(GROUP)).otherwise(_int(0))


class BucketStats:
    """A statistic by group, read as cells of the grid of a two-metric regroup. Missing groups are 0."""

    def __init__(self, by_group: dict[int, int] | Sequence[int], x_buckets: int, y_buckets: int):
        self._by = dict(by_group) if isinstance(by_group, dict) else dict(enumerate(by_group))
        self.nx, self.ny = x_buckets, y_buckets

    def _at(self, x: int, y: int) -> int:
        return self._by.get(y * self.nx + x + 1, 0)

    def get(self, x: int, y: int) -> int:
        return self._at(x + 1, y + 1)

    def x_underflow(self, y: int) -> int:
        return self._at(0, y + 1)

    def x_overflow(self, y: int) -> int:
        return self._at(self.nx - 1, y + 1)

    def y_underflow(self, x: int) -> int:
        return self._at(x + 1, 0)

    def y_overflow(self, x: int) -> int:
        return self._at(x + 1, self.ny - 1)

    def corner(self, x_over: bool, y_over: bool) -> int:
        return self._at(self.nx - 1 if x_over else 0, self.ny - 1 if y_over else 0)

    def as_list(self) -> list[int]:
        return [self._by.get(g, 0) for g in range(self.nx * self.ny + 1)]
