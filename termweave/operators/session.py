"""A session: documents, each in one group, and a stack of metrics. Every operation gives a new session; reads give DataFrames.

Regroups and pushes only extend the logical plan; a read is one job. After CHECKPOINT_EVERY transitions the plan is cut by
a reliable checkpoint, in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import fields as P
from ..plans import rules as R
from ..plans.metrics import Stack, dynamic_column
from . import dynamic, regroup, terms
from .regroup import GROUP

CHECKPOINT_EVERY = 32
SCALE, FROZEN = "_scale", "_cached_"


def _checkpointed(df: DataFrame, eager: bool) -> DataFrame:
    context, path = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not path:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path)
    return df.checkpoint(eager=eager)


@dataclass(frozen=True)
class Session:
    df: DataFrame
    fields: P.Fields
    stack: Stack
    groups_at_most: int | None = 2  # number of groups, as far as it is known without a job
    steps: int = 0
    base: Session | None = None  # before documents were dropped

    @staticmethod
    def open(df: DataFrame, ints: Iterable[str] | None = None, strings: Iterable[str] | None = None, fields: P.Fields | None = None, scale: int | Column | None = None) -> Session:
        """All documents in group 1. Fields are inferred from the columns unless they are given.

        ``scale``: how many documents each one stands for, where shards hold a sample; a Column if shards differ in it.
        """
        fields = P.infer(df, ints, strings) if fields is None else fields
        if scale is not None:
            df = df.withColumn(SCALE, (scale if isinstance(scale, Column) else F.lit(scale)).cast("long"))
        return Session(df.withColumn(GROUP, F.lit(1).cast("int")), fields, Stack(fields, scale=None if scale is None else F.col(SCALE)))

    # groups ------------------------------------------------------------------------------------------------------------

    def _to(self, group: Column | DataFrame, at_most: int | None) -> Session:
        df = group if isinstance(group, DataFrame) else self.df.withColumn(GROUP, group)
        df, steps = self._cut(df)
        return replace(self, df=df, groups_at_most=at_most, steps=steps)

    def _cut(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` after one more step, its plan cut if there were many."""
        steps = self.steps + 1
        if steps >= CHECKPOINT_EVERY and df.sparkSession.conf.get("spark.checkpoint.dir", None):
            return _checkpointed(df, False), 0
        return df, steps

    def _grown(self, *targets: int) -> int | None:
        return None if self.groups_at_most is None else max(self.groups_at_most, 1 + max(targets, default=0))

    def reset_groups(self) -> Session:
        """All documents in group 1, those that were dropped included. Dynamic metrics keep their values."""
        if self.base is not None:
            lost = self.base
            back = lost.df
            # what survived brings back its values of dynamic and frozen metrics; those that came later are 0 for the rest
            values = {f.name: f.dataType for f in self.df.schema.fields if f.name.startswith(FROZEN) or f.name in map(dynamic_column, self.stack.dynamics)}
            back = back.withColumns({c: F.lit(0).cast(kind) for c, kind in values.items() if c not in back.columns})
            if values:
                kept = self.df.select("_doc", *(F.col(v).alias(f"{v}_kept") for v in values))
                back = back.join(kept, "_doc", "left").withColumns({v: F.coalesce(f"{v}_kept", v) for v in values}).drop(*(f"{v}_kept" for v in values))
            return Session(back.withColumn(GROUP, F.lit(1).cast("int")), lost.fields, replace(self.stack, fields=lost.fields))
        return self._to(F.lit(1).cast("int"), 2)

    def regroup(self, rules: Iterable[R.Rule], count: int | None = None) -> Session:
        """Single-condition rules. ``rules`` may be an iterator, of which ``count`` are taken."""
        rules = list(rules) if count is None else [r for _, r in zip(range(count), rules)]
        if count is not None and len(rules) < count:
            raise ValueError(f"{count} rules are announced, {len(rules)} came")
        return self._to(regroup.by_rules(self.df, self.fields, rules), 1 + max((g for r in rules for g in (r.negative, r.positive)), default=0))

    def regroup_multi(self, rules: Sequence[R.MultiRule], error_on_collisions: bool = False) -> Session:
        at_most = 1 + max((g for r in rules for g in (r.negative, *r.positives)), default=0)
        return self._to(regroup.by_multi_rules(self.fields, rules, error_on_collisions), at_most)

    def regroup_query(self, rule: R.QueryRule) -> Session:
        return self._to(regroup.by_query(self.fields, rule), self._grown(rule.negative, rule.positive))

    def int_or_regroup(self, field: str, terms_: Sequence[int], target: int, negative: int, positive: int) -> Session:
        return self._to(regroup.by_terms(self.fields, field, terms_, target, negative, positive, True), self._grown(negative, positive))

    def string_or_regroup(self, field: str, terms_: Sequence[str], target: int, negative: int, positive: int) -> Session:
        return self._to(regroup.by_terms(self.fields, field, terms_, target, negative, positive, False), self._grown(negative, positive))

    def regex_regroup(self, field: str, regex: str, target: int, negative: int, positive: int) -> Session:
        """Only while there are no groups but 0 and 1."""
        if self.groups_at_most is None or self.groups_at_most > 2:
            if self.num_groups().first()[0] > 2:
                raise ValueError("a regular expression can only split group 1 while there is no other")
        return self._to(regroup.by_regex(self.fields, field, regex, target, negative, positive), self._grown(negative, positive))

    def random_regroup(self, field: str, is_int: bool, salt: str, p: float, target: int, negative: int, positive: int) -> Session:
        return self._to(regroup.by_chance(self.fields, field, is_int, salt, p, target, negative, positive), self._grown(negative, positive))

    def random_multi_regroup(self, field: str, is_int: bool, salt: str, target: int, percentages: Sequence[float], groups: Sequence[int]) -> Session:
        return self._to(regroup.by_chances(self.fields, field, is_int, salt, target, percentages, groups), self._grown(*groups))

    def metric_regroup(self, stat: int, low: int, high: int, interval: int, gutters: bool = True) -> Session:
        width = regroup.bucket_count(low, high, interval) + 2 * gutters
        at_most = None if self.groups_at_most is None else (self.groups_at_most - 1) * width + 1
        return self._to(regroup.by_metric(self.stack[stat], low, high, interval, gutters), at_most)

    def metric_regroup_2d(self, x: int, x_low: int, x_high: int, x_interval: int, y: int, y_low: int, y_high: int, y_interval: int) -> tuple[Session, int]:
        """The session and the number of cells."""
        group, cells = regroup.by_two_metrics(self.stack[x], x_low, x_high, x_interval, self.stack[y], y_low, y_high, y_interval)
        return self._to(group, cells + 1), cells

    def metric_filter(self, stat: int, low: int, high: int, negate: bool = False) -> Session:
        return self._to(regroup.by_filter(self.stack[stat], low, high, negate), self.groups_at_most)

    def num_groups(self) -> DataFrame:
        return terms.num_groups(self.df)

    def doc_groups(self, key: str = "_doc") -> DataFrame:
        """(key, grp) of every document."""
        return self.df.select(key, F.col(GROUP).alias("grp"))

    def rebuild(self, ints: Sequence[str], strings: Sequence[str], written: bool = False) -> Session:
        """Only documents outside group 0 and only the named fields; `reset_groups` brings the rest back.

        ``written``: as a checkpoint, which pays if much was dropped and much will be read. The reset of dynamic metrics
        needs a ``_doc`` column, as `sources.dataset` gives it.
        """
        keep = self.fields.only([*ints, *strings])
        named = {c for c in self.df.columns if c.startswith("_") or c in keep}
        df = self.df.where(F.col(GROUP) != 0).select(*(f"`{c}`" for c in self.df.columns if c in named))
        if written:
            df = _checkpointed(df, True)
        return replace(self, df=df, fields=keep, stack=replace(self.stack, fields=keep), base=self.base or self)

    # metrics -----------------------------------------------------------------------------------------------------------

    def push(self, *texts: str) -> Session:
        out = self
        for text in texts:
            out = replace(out, stack=out.stack.push(text))
            n = out.stack.top(text)
            out = out._frozen(n) if n else out
        return out

    def _frozen(self, n: int) -> Session:
        """The ``n`` metrics on top as columns, which later changes of what they are made of don't reach."""
        at = sum(c.startswith(FROZEN) for c in self.df.columns)
        names = [f"{FROZEN}{at + i}" for i in range(n)]
        df = self.df.withColumns(dict(zip(names, self.stack.metrics[-n:])))
        return replace(self, df=df, stack=self.stack.replaced(tuple(F.col(c) for c in names)))

    def push_query(self, query) -> Session:
        return replace(self, stack=self.stack.push_query(query))

    def pop(self) -> Session:
        return replace(self, stack=self.stack.pop())

    def num_stats(self) -> int:
        return len(self.stack)

    def _dynamic(self, name: str, change) -> Session:
        if name not in self.stack.dynamics:
            raise ValueError(f"no dynamic metric {name}")
        c = dynamic_column(name)
        df, steps = self._cut(self.df.withColumn(c, change(F.col(c))))
        return replace(self, df=df, steps=steps)

    def create_dynamic_metric(self, name: str) -> Session:
        if name in self.stack.dynamics:
            raise ValueError(f"there is a dynamic metric {name}")
        return replace(self, df=self.df.withColumn(dynamic_column(name), F.lit(0).cast("int")), stack=replace(self.stack, dynamics=(*self.stack.dynamics, name)))

    def update_dynamic_metric(self, name: str, deltas: Sequence[int]) -> Session:
        return self._dynamic(name, lambda v: dynamic.by_group(v, deltas))

    def conditional_update_dynamic_metric(self, name: str, conditions: Sequence[R.Condition], deltas: Sequence[int]) -> Session:
        return self._dynamic(name, lambda v: dynamic.by_conditions(v, self.fields, conditions, deltas))

    def group_conditional_update_dynamic_metric(self, name: str, groups: Sequence[int], conditions: Sequence[R.Condition], deltas: Sequence[int]) -> Session:
        return self._dynamic(name, lambda v: dynamic.by_group_conditions(v, self.fields, groups, conditions, deltas))

    # reads -------------------------------------------------------------------------------------------------------------

    def group_stats(self, with_zero: bool = False) -> DataFrame:
        return terms.group_stats(self.df, self.stack.metrics, with_zero)

    def _fields(self, ints: Sequence[str], strings: Sequence[str]) -> list[P.Field]:
        return [*(self.fields.ints(n) for n in ints), *(self.fields.strings(n) for n in strings)]

    def ftgs(self, ints: Sequence[str] = (), strings: Sequence[str] = (), doc_freq: bool = False) -> DataFrame:
        """Sums of all metrics for each field, term and group."""
        return terms.term_stats(self.df, self._fields(ints, strings), self.stack.metrics, None, doc_freq)

    def subset_ftgs(self, ints: Mapping[str, Sequence[int]] | None = None, strings: Mapping[str, Sequence[str]] | None = None, doc_freq: bool = False) -> DataFrame:
        """The same for the given terms of each field only."""
        ints, strings = ints or {}, strings or {}
        subsets = {(n, True): t for n, t in ints.items()} | {(n, False): t for n, t in strings.items()}
        return terms.term_stats(self.df, self._fields(list(ints), list(strings)), self.stack.metrics, subsets, doc_freq)

    def ftgs_splits(self, ints: Sequence[str] = (), strings: Sequence[str] = (), splits: int = 16) -> DataFrame:
        """`ftgs` dealt out by term to so many partitions, each in ascending order of terms."""
        out = self.ftgs(ints, strings)
        order = ["field", "is_int", "int_term", "str_term"]
        return out.repartition(splits, *order).sortWithinPartitions(*order, "grp")

    def doc_rows(self, ints: Sequence[str] = (), strings: Sequence[str] = ()) -> DataFrame:
        return terms.doc_rows(self.df, [self.fields.ints(n) for n in ints], [self.fields.strings(n) for n in strings])

    def total_doc_freq(self, ints: Sequence[str] = (), strings: Sequence[str] = ()) -> DataFrame:
        return terms.total_doc_freq(self.df, self._fields(ints, strings))

    def top_terms(self, field: str, is_int: bool, k: int) -> DataFrame:
        return terms.top_terms(self.df, self.fields.of_kind(field, is_int), k)

    def top(self, k: int, ints: Sequence[str] = (), strings: Sequence[str] = ()) -> DataFrame:
        return terms.top_by_metric(self.ftgs(ints, strings), k, len(self.stack))
