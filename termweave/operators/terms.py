"""What is read from grouped documents: sums, term statistics, top terms, rows. One job and one exchange each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fields import Field, Fields
from .regroup import GROUP

#: Fixed value: the most terms that a top list holds.
MAX_TOP_TERMS = 1000


def group_stats(df: DataFrame, metrics: Sequence[Column], with_zero: bool = False) -> DataFrame:
    """(grp, s0, s1 ...): sums of the metrics for each group that has a document; group 0 only on request."""
    rows = df.select(F.col(GROUP).alias("grp"), *(m.alias(f"s{i}") for i, m in enumerate(metrics)))
    rows = rows if with_zero else rows.where("grp <> 0")
    return rows.groupBy("grp").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(metrics)))) if metrics else rows.distinct()


def num_groups(df: DataFrame) -> DataFrame:
    """(num_groups): one more than the largest group; 1 for a table without rows."""
    return df.agg((F.coalesce(F.max(GROUP), F.lit(0)) + 1).cast("int").alias("num_groups"))


def _entry(f: Field, term: Column) -> Column:
    none_int, none_str = F.lit(None).cast("long"), F.lit(None).cast("string")
    return F.struct(F.lit(f.name).alias("field"), F.lit(f.is_int).alias("is_int"), (term if f.is_int else none_int).alias("int_term"), (none_str if f.is_int else term).alias("str_term"))


def _entries(f: Field, terms: Column) -> Column:
    none = F.slice(F.array(_entry(f, F.lit(None).cast("long" if f.is_int else "string"))), 1, 0)
    return F.coalesce(F.transform(terms, lambda t: _entry(f, t)), none)


def _among(terms: Column, some: list) -> Column:
    return F.filter(terms, lambda t: t.isin(some)) if some else F.slice(terms, 1, 0)


def occurrences(df: DataFrame, fields: Sequence[Field], subsets: Mapping[tuple[str, bool], Sequence] | None, keep: Mapping[str, Column]) -> DataFrame:
    """(field, is_int, int_term, str_term, the kept columns): a row for each document, field and term.

    All fields come from one scan and one explode. Terms outside a field's subset go before that.
    """
    subset = lambda f: None if subsets is None else list(subsets[f.name, f.is_int])
    kept = [c.alias(n) for n, c in keep.items()]
    here = [F.when(f.column.isNotNull() if subset(f) is None else f.among(subset(f)), _entry(f, f.column)) for f in fields if not f.multi]
    lists = [F.array(*here)] if here else []
    for f in fields:
        if f.multi:
            terms = f.terms() if subset(f) is None else _among(f.terms(), subset(f))
            if len(fields) == 1:  # no entries have to be made before the explode
                return df.select(F.explode(terms).alias("_t"), *kept).select(_entry(f, F.col("_t")).alias("_e"), *keep).select("_e.*", *keep)
            lists.append(_entries(f, terms))
    each = df.select(F.explode(F.concat(*lists) if len(lists) > 1 else lists[0]).alias("_e"), *kept).where("_e is not null")
    return each.select("_e.*", *keep)


def term_stats(df: DataFrame, fields: Sequence[Field], metrics: Sequence[Column], subsets: Mapping[tuple[str, bool], Sequence] | None = None, doc_freq: bool = False) -> DataFrame:
    """(field, is_int, int_term, str_term, grp, s0 ...): sums for each term of each field and each group but 0.

    With ``doc_freq`` also term_doc_freq, the documents of all groups that have the term, which takes a second exchange of
    the sums by term. All fields share the exchanges.
    """
    stats = [f"s{i}" for i in range(len(metrics))]
    if not fields:
        return df.sparkSession.createDataFrame([], ", ".join(["field string, is_int boolean, int_term long, str_term string, grp int", *(["term_doc_freq long"] if doc_freq else []), *(f"{s} long" for s in stats)]))
    base = df if doc_freq else df.where(F.col(GROUP) != 0)
    rows = occurrences(base, fields, subsets, {"grp": F.col(GROUP), **dict(zip(stats, metrics))})
    keys = ["field", "is_int", "int_term", "str_term"]
    sums = [F.sum(s).alias(s) for s in stats]
    if not doc_freq:
        return rows.groupBy(*keys, "grp").agg(*sums) if sums else rows.select(*keys, "grp").distinct()
    counted = rows.groupBy(*keys, "grp").agg(F.count("*").alias("_n"), *sums)
    counted = counted.withColumn("term_doc_freq", F.sum("_n").over(Window.partitionBy(*keys)))  # a row a group and term
    return counted.where("grp <> 0").select(*keys, "grp", "term_doc_freq", *stats)


def doc_rows(df: DataFrame, ints: Sequence[Field], strings: Sequence[Field]) -> DataFrame:
    """(grp, the fields' values ...) for every document that isn't in group 0."""
    columns = [F.col(GROUP).alias("grp"), *(f.value().alias(f.name) for f in ints), *(f.text().alias(f.name) for f in strings)]
    return df.where(F.col(GROUP) != 0).select(*columns)


def total_doc_freq(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(total_doc_freq): how many pairs of a document and a term there are in the fields, whatever the group."""
    each = reduce(lambda a, b: a + b, (f.count() for f in fields), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(each), F.lit(0)).cast("long").alias("total_doc_freq"))


def top_terms(df: DataFrame, f: Field, k: int) -> DataFrame:
    """(term, n): the ``k`` terms that most documents have, whatever the group; of equal ones the larger term first."""
    if not 0 <= k <= MAX_TOP_TERMS:
        raise ValueError(f"at most {MAX_TOP_TERMS} terms")
    rows = df.where(f.column.isNotNull()).select(f.column.alias("term")) if not f.multi else df.select(F.explode(f.terms()).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("term")).limit(k)


def top_by_metric(stats: DataFrame, k: int, metrics: int) -> DataFrame:
    """(stat, rank, field, is_int, int_term, str_term, value): for each metric the ``k`` terms with the largest sums over groups.

    Ties go to the field that sorts first, then to the larger term.
    """
    keys = ["field", "is_int", "int_term", "str_term"]
    sums = stats.groupBy(*keys).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(metrics)))
    order = lambda c: [F.desc(c), F.asc("field"), F.desc("int_term"), F.desc("str_term")]
    parts = []
    for i in range(metrics):
        top = sums.select(*keys, F.col(f"s{i}").alias("value")).orderBy(*order("value")).limit(k)
        parts.append(top.select(F.lit(i).alias("stat"), F.row_number().over(Window.orderBy(*order("value"))).alias("rank"), *keys, "value"))  # k rows
    return reduce(DataFrame.unionAll, parts)
