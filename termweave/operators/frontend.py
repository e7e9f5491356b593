"""Top terms as a front end asks for them: chosen and ordered by a statistic or by the ratio of two, from one dataset or
from two that are joined on a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import And, Range
from ..plans.rules import QueryRule
from .session import Session

TERM = ["field", "is_int", "int_term", "str_term"]


def ratio_order(stat: int, divide_by: int | None) -> Column:
    """The statistic, or its ratio to another, as a double; a ratio to 0 comes last when the largest are first."""
    s = F.col(f"s{stat}").cast("double")
    return s if divide_by is None else F.when(F.col(f"s{divide_by}") != 0, s / F.col(f"s{divide_by}")).otherwise(F.lit(float("-inf")))


def _ordered(df: DataFrame, by: Column, reverse: bool) -> list[Column]:
    return [by.asc() if reverse else by.desc(), F.asc("field"), F.asc("int_term"), F.asc("str_term")]


def with_substrings(df: DataFrame, substrings: Sequence[str], match: Sequence[bool]) -> DataFrame:
    """Terms that contain each substring, or don't where ``match`` is false. Integer terms count as decimal text."""
    if len(substrings) != len(match):
        raise ValueError("as many flags as substrings are needed")
    text = F.coalesce(F.col("str_term"), F.col("int_term").cast("string"))
    for s, m in zip(substrings, match):
        df = df.where(text.contains(s) if m else ~text.contains(s))
    return df


def top_terms(
    session: Session,
    ints: Sequence[str] = (),
    strings: Sequence[str] = (),
    k: int = 10,
    sort: int = 0,
    divide_by: int | None = None,
    reverse: bool = False,
    query=None,
    time_field: str = "time",
    times: tuple[int, int] | None = None,
    substrings: Sequence[str] = (),
    match: Sequence[bool] = (),
    final_sort: int | None = None,
    final_divide_by: int | None = None,
    final_reverse: bool = False,
) -> DataFrame:
    """(field, is_int, int_term, str_term, s0 ..., rank): the ``k`` first terms, then put in the final order.

    ``times``: only documents whose time field is in [start, end).
    """
    parts = [*([Range(time_field, *times, inclusive=False)] if times else []), *([query] if query is not None else [])]
    if parts:
        session = session.regroup_query(QueryRule(1, And(*parts), 0, 1))
    n = len(session.stack)
    sums = session.ftgs(ints, strings).groupBy(*TERM).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n)))
    found = with_substrings(sums, substrings, match).orderBy(*_ordered(sums, ratio_order(sort, divide_by), reverse)).limit(k)
    final = ratio_order(sort if final_sort is None else final_sort, divide_by if final_sort is None else final_divide_by)
    order = _ordered(found, final, reverse if final_sort is None else final_reverse)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def joined_terms(first: Session, second: Session, key: str, second_key: str, is_int: bool = False) -> DataFrame:
    """(term, s0 ... of the first, t0 ... of the second): statistics by the key's terms that both datasets have."""

    def by_term(s: Session, name: str, prefix: str) -> DataFrame:
        stats = s.ftgs([name] if is_int else [], [] if is_int else [name])
        term = F.col("int_term" if is_int else "str_term").alias("term")
        return stats.groupBy(term).agg(*(F.sum(f"s{i}").alias(f"{prefix}{i}") for i in range(len(s.stack))))

    return by_term(first, key, "s").join(by_term(second, second_key, "t"), "term")
