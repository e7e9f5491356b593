"""The library's queries, each with the SQL that gives the same rows. All run over whole tables.

Sessions on four datasets: line items (scalar fields), orders with the set of their parts (a multi-valued integer field),
documents with the set of their lower-case words (a multi-valued string field) and events (a time field).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import frontend
from .operators.regroup import BucketStats
from .operators.session import Session
from .plans.query import And, Not, Or, Range, Term, parse
from .plans.rules import Condition, MultiRule, QueryRule, Rule
from .sources import catalog, dataset

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key], _SQL[key] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> Session:
    return Session.open(_table(spark, d, "lineitem"), ints=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], strings=["l_returnflag", "l_linestatus", "l_discount"])


def orders(spark: SparkSession, d: str) -> Session:
    parts = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("partkeys"))
    o = _table(spark, d, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "partkeys")
    return Session.open(o)


def words(spark: SparkSession, d: str) -> Session:
    docs = _table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.array_distinct(F.split(F.lower("text"), "[^a-z]+")).alias("tokens"))
    return Session.open(docs)


def events(spark: SparkSession, d: str) -> Session:
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("unixtime")
    return Session.open(_table(spark, d, "events").select("event_id", "user_id", "event_type", seconds))


L = "(SELECT *, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS ln FROM lineitem)"
O = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, list_distinct(list(l_partkey)) AS pk FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"
D = "(SELECT doc_id, lang, source, n_chars, list_distinct(string_split_regex(lower(text), '[^a-z]+')) AS toks FROM documents)"
E = "(SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)"
COUNT = "count(*)::BIGINT AS s0"


def _grouped(case: str, source: str = L, stats: str = COUNT) -> str:
    return f"SELECT * FROM (SELECT ({case})::INT AS grp, {stats} FROM {source} GROUP BY 1) WHERE grp <> 0"


# regroups ---------------------------------------------------------------------------------------------------------------

FLAG_A = Rule(1, Condition("l_returnflag", "A"), 1, 2)


@query(_grouped("CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END", stats=COUNT + ", sum(q)::BIGINT AS s1"))
def q01_group_stats_after_regroup(spark, d):
    return lines(spark, d).regroup([FLAG_A]).push("count()", "l_quantity").group_stats()


@query(
    f"""WITH d AS (SELECT *, (CASE WHEN q <= 25 THEN 1 ELSE 2 END)::INT AS grp FROM {L})
SELECT 'l_linenumber' AS field, true AS is_int, ln AS int_term, NULL::VARCHAR AS str_term, grp, count(*)::BIGINT AS s0, sum(q)::BIGINT AS s1 FROM d GROUP BY ALL
UNION ALL SELECT 'l_returnflag', false, NULL, l_returnflag, grp, count(*)::BIGINT, sum(q)::BIGINT FROM d GROUP BY ALL"""
)
def q02_ftgs_int_string(spark, d):
    s = lines(spark, d).regroup([Rule(1, Condition("l_quantity", 25, True), 2, 1)])
    return s.push("count()", "l_quantity").ftgs(["l_linenumber"], ["l_returnflag"])


@query(f"SELECT term, 1::INT AS grp, count(*)::BIGINT AS s0, sum(n_chars)::BIGINT AS s1 FROM (SELECT unnest(toks) AS term, n_chars FROM {D} WHERE lang = 'en') GROUP BY term")
def q03_ftgs_multivalued(spark, d):
    s = words(spark, d).regroup([Rule(1, Condition("lang", "en"), 0, 1)]).push("count()", "n_chars")
    return s.ftgs([], ["tokens"]).select(F.col("str_term").alias("term"), "grp", "s0", "s1")


@query(_grouped("CASE WHEN q < 10 THEN 6 WHEN q >= 40 THEN 7 ELSE (q - 10) // 7 + 1 END"))
def q04_metric_regroup_gutters(spark, d):
    return lines(spark, d).push("l_quantity").metric_regroup(0, 10, 40, 7).pop().push("count()").group_stats()


@query(_grouped("CASE WHEN q < 9 OR q >= 17 THEN 0 ELSE (CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) * 2 + (q - 9) // 4 + 1 END"))
def metric_regroup_no_gutters(spark, d):
    return lines(spark, d).regroup([FLAG_A]).push("l_quantity").metric_regroup(0, 9, 17, 4, gutters=False).pop().push("count()").group_stats()


@query(
    f"""WITH i AS (SELECT CASE WHEN q < 10 THEN 0 WHEN q >= 40 THEN 4 ELSE (q - 10) // 10 + 1 END AS xi, CASE WHEN ln < 2 THEN 0 WHEN ln >= 6 THEN 3 ELSE (ln - 2) // 2 + 1 END AS yi FROM {L})
SELECT (yi * 5 + xi + 1)::INT AS grp, count(*)::BIGINT AS s0 FROM i GROUP BY 1"""
)
def q05_metric_regroup_2d(spark, d):
    s = lines(spark, d).push("l_quantity", "l_linenumber")
    return s.metric_regroup_2d(0, 10, 40, 10, 1, 2, 6, 2)[0].pop().pop().push("count()").group_stats()


CHANCE = """(SELECT *, abs(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616::HUGEINT ELSE u END)::DOUBLE / 9223372036854775807::DOUBLE AS r
FROM (SELECT *, ('0x' || substr(md5({term} || '|{salt}'), 1, 16))::UBIGINT::HUGEINT AS u FROM {source}))"""


@query(_grouped("CASE WHEN r >= 0.5 THEN 2 ELSE 1 END", CHANCE.format(term="l_returnflag", salt="salt", source="lineitem")))
def q06_random_regroup(spark, d):
    return lines(spark, d).random_regroup("l_returnflag", False, "salt", 0.5, 1, 1, 2).push("count()").group_stats()


@query(_grouped("CASE WHEN r >= 0.3 THEN 2 ELSE 1 END", CHANCE.format(term="l_partkey::VARCHAR", salt="x7", source="lineitem")))
def random_regroup_int(spark, d):
    return lines(spark, d).random_regroup("l_partkey", True, "x7", 0.3, 1, 1, 2).push("count()").group_stats()


@query(_grouped("CASE WHEN r < 0.1 THEN 5 WHEN r < 0.5 THEN 6 ELSE 7 END", CHANCE.format(term="l_orderkey::VARCHAR", salt="salt", source="lineitem")))
def random_multi_regroup(spark, d):
    return lines(spark, d).random_multi_regroup("l_orderkey", True, "salt", 1, [0.1, 0.5], [5, 6, 7]).push("count()").group_stats()


@query(
    f"""WITH t AS (SELECT o_orderkey, unnest(pk) AS term FROM {O}), v AS (SELECT o_orderkey, term, r FROM {CHANCE.format(term="term::VARCHAR", salt="s", source="t")}),
f AS (SELECT o_orderkey, min(term) FILTER (WHERE r >= 0.9) AS first_out FROM v GROUP BY 1)
SELECT (CASE WHEN first_out IS NULL THEN 1 ELSE 2 END)::INT AS grp, count(*)::BIGINT AS s0 FROM f GROUP BY 1"""
)
def random_regroup_multivalued(spark, d):
    return orders(spark, d).random_regroup("partkeys", True, "s", 0.9, 1, 1, 2).push("count()").group_stats()


@query(_grouped("CASE WHEN (l_returnflag = 'A' OR l_linestatus = 'O') AND NOT (q >= 10 AND q < 20) THEN 1 ELSE 0 END"))
def q07_boolean_query(spark, d):
    q = And(Or(Term("l_returnflag", "A"), Term("l_linestatus", "O")), Not(Range("l_quantity", 10, 20, inclusive=False)))
    return lines(spark, d).regroup_query(QueryRule(1, q, 0, 1)).push("count()").group_stats()


@query(_grouped("CASE WHEN l_returnflag IN ('A', 'R') AND ln BETWEEN 2 AND 4 AND NOT (l_linestatus = 'F' OR q = 7) THEN 3 ELSE 1 END"))
def query_text(spark, d):
    q = parse("+(l_returnflag:A l_returnflag:R) +l_linenumber:[2 TO 4] -l_linestatus:F -l_quantity:7", ["l_linenumber", "l_quantity"])
    return lines(spark, d).regroup_query(QueryRule(1, q, 1, 3)).push("count()").group_stats()


@query(_grouped("CASE WHEN list_contains(toks, 'the') AND len(list_filter(toks, lambda t: t >= 'er' AND t < 'es')) > 0 THEN 1 ELSE 0 END", D))
def query_prefix_phrase(spark, d):
    return words(spark, d).regroup_query(QueryRule(1, parse('+tokens:"the" +tokens:er*'), 0, 1)).push("count()").group_stats()


@query(_grouped("CASE WHEN l_returnflag = 'A' THEN 3 WHEN q <= 10 THEN 4 WHEN q <= 30 THEN 5 ELSE 2 END"))
def q08_multi_split(spark, d):
    rule = MultiRule(1, 2, [3, 4, 5], [Condition("l_returnflag", "A"), Condition("l_quantity", 10, True), Condition("l_quantity", 30, True)])
    return lines(spark, d).regroup_multi([rule]).push("count()").group_stats()


@query(_grouped("CASE WHEN l_returnflag = 'A' THEN CASE WHEN ln = 1 THEN 4 WHEN ln = 2 THEN 5 ELSE 6 END ELSE CASE WHEN q <= 25 THEN 2 ELSE 3 END END"))
def multi_split_two_targets(spark, d):
    rules = [MultiRule(1, 3, [2], [Condition("l_quantity", 25, True)]), MultiRule(2, 6, [4, 5], [Condition("l_linenumber", 1), Condition("l_linenumber", 2)])]
    return lines(spark, d).regroup([FLAG_A]).regroup_multi(rules, error_on_collisions=True).push("count()").group_stats()


@query(_grouped("CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END"))
def multi_split_untargeted(spark, d):
    return lines(spark, d).regroup([FLAG_A]).regroup_multi([MultiRule(2, 2, [], [])]).push("count()").group_stats()


@query("SELECT 0::INT AS grp, count(*)::BIGINT AS s0 FROM lineitem")
def regroup_empty(spark, d):
    return lines(spark, d).regroup_multi([]).push("count()").group_stats(with_zero=True)


@query("SELECT (CASE WHEN l_returnflag = 'A' THEN 0 WHEN ln <= 3 THEN 4 ELSE 3 END)::INT AS grp, count(*)::BIGINT AS s0 FROM " + L + " GROUP BY 1")
def regroup_multi_target(spark, d):
    rules = [Rule(1, Condition("l_linenumber", 3, True), 3, 4), Rule(1, None, 9, 9), Rule(7, None, 8, 8)]
    return lines(spark, d).regroup([FLAG_A]).regroup(rules).push("count()").group_stats(with_zero=True)


@query(_grouped("CASE WHEN l_returnflag <= 'N' THEN 2 ELSE 3 END"))
def regroup_string_le(spark, d):
    return lines(spark, d).regroup([Rule(1, Condition("l_returnflag", "N", True), 3, 2)]).push("count()").group_stats()


@query(_grouped("CASE WHEN list_min(pk) <= 40 THEN 2 ELSE 1 END", O))
def regroup_multivalued_le(spark, d):
    return orders(spark, d).regroup([Rule(1, Condition("partkeys", 40, True), 1, 2)]).push("count()").group_stats()


@query(_grouped("1"))
def regroup_null_condition_reset(spark, d):
    return lines(spark, d).regroup([Rule(1, None, 0, 5)]).reset_groups().push("count()").group_stats()


@query(_grouped("CASE WHEN o_custkey % 100 = q THEN q + 100 ELSE q END", "(SELECT *, (o_custkey % 60) + 1 AS q FROM orders)"))
def regroup_many_rules(spark, d):
    o = _table(spark, d, "orders").select("o_custkey", (F.col("o_custkey") % 60 + 1).alias("q"), (F.col("o_custkey") % 100).alias("r"))
    s = Session.open(o).push("q").metric_regroup(0, 1, 61, 1).pop()
    return s.regroup(iter([Rule(g, Condition("r", g), g, g + 100) for g in range(1, 61)]), count=60).push("count()").group_stats()


@query(_grouped("CASE WHEN l_partkey IN (5, 1, 9, 33, 2) THEN 1 ELSE 0 END"))
def int_or_regroup(spark, d):
    return lines(spark, d).int_or_regroup("l_partkey", [5, 1, 9, 33, 2], 1, 0, 1).push("count()").group_stats()


@query(_grouped("CASE WHEN list_has_any(pk, [1, 2, 3]) THEN 1 ELSE 2 END", O, COUNT + ", sum(least(len(pk), 255))::BIGINT AS s1"))
def q13_multi_valued_int(spark, d):
    return orders(spark, d).int_or_regroup("partkeys", [1, 2, 3], 1, 2, 1).push("count()", "inttermcount partkeys").group_stats()


@query(_grouped("CASE WHEN l_returnflag IN ('R', 'A') THEN 4 ELSE 1 END"))
def string_or_regroup(spark, d):
    return lines(spark, d).string_or_regroup("l_returnflag", ["R", "A", "Q"], 1, 1, 4).push("count()").group_stats()


@query(_grouped("CASE WHEN len(list_filter(toks, lambda t: regexp_full_match(t, 'th[a-e]+n?'))) > 0 THEN 2 ELSE 1 END", D))
def regex_regroup(spark, d):
    return words(spark, d).regex_regroup("tokens", "th[a-e]+n?", 1, 1, 2).push("count()").group_stats()


@query(_grouped("CASE WHEN q BETWEEN 10 AND 20 THEN 1 ELSE 0 END"))
def metric_filter(spark, d):
    return lines(spark, d).push("l_quantity").metric_filter(0, 10, 20).pop().push("count()").group_stats()


@query(_grouped("CASE WHEN q BETWEEN 10 AND 20 THEN 0 ELSE 1 END"))
def metric_filter_negate(spark, d):
    return lines(spark, d).push("l_quantity").metric_filter(0, 10, 20, negate=True).pop().push("count()").group_stats()


@query("SELECT 8::INT AS num_groups")
def num_groups(spark, d):
    return lines(spark, d).push("l_linenumber").metric_regroup(0, 1, 8, 1, gutters=False).num_groups()


@query("SELECT doc_id, (CASE WHEN lang = 'de' THEN 3 ELSE 0 END)::INT AS grp FROM documents")
def doc_groups(spark, d):
    return words(spark, d).regroup([Rule(1, Condition("lang", "de"), 0, 3)]).doc_groups("doc_id")


@query(f"SELECT 'l_returnflag' AS field, l_returnflag AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0 FROM {L} WHERE q > 25 GROUP BY ALL")
def rebuild_filtered(spark, d):
    s = lines(spark, d).regroup([Rule(1, Condition("l_quantity", 25, True), 1, 0)]).rebuild([], ["l_returnflag"]).push("count()")
    return s.ftgs(["l_linenumber"], ["l_returnflag"]).select("field", "str_term", "grp", "s0")


@query("SELECT 1::INT AS grp, count(*)::BIGINT AS s0, sum(l_linenumber)::BIGINT AS s1 FROM lineitem")
def rebuild_then_reset(spark, d):
    s = lines(spark, d).regroup([Rule(1, Condition("l_quantity", 25, True), 1, 0)]).rebuild([], ["l_returnflag"])
    return s.reset_groups().push("count()", "l_linenumber").group_stats()


# boolean queries --------------------------------------------------------------------------------------------------------

BY_QUERY = {
    "string_range": (lines, Range("l_returnflag", "B", "R", inclusive=False), "l_returnflag >= 'B' AND l_returnflag < 'R'", L),
    "string_range_inclusive": (words, Range("tokens", "the", "theb"), "len(list_filter(toks, lambda t: t >= 'the' AND t <= 'theb')) > 0", D),
    "string_range_numeric": (lambda s, d: Session.open(_table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("supp"))), Range("supp", "5", "12"), "l_suppkey BETWEEN 5 AND 12", "lineitem"),
    "int_range_missing_is_zero": (lambda s, d: Session.open(_table(s, d, "lineitem").select(F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("n"))), Range("n", -1, 3), "l_linenumber <= 3", "lineitem"),
    "int_range_multivalued": (orders, Range("partkeys", 0, 1500), "list_max(pk) BETWEEN 0 AND 1500", O),
    "query_not_many": (lines, Not(Term("l_linenumber", 1), Term("l_linenumber", 2), Term("l_returnflag", "N")), "NOT (ln IN (1, 2) OR l_returnflag = 'N')", L),
    "query_missing_field": (lines, Or(Term("nowhere", 3), Term("l_linenumber", 5)), "ln = 5", L),
}
for _name, (_open, _q, _sql, _source) in BY_QUERY.items():
    query(_grouped(f"CASE WHEN {_sql} THEN 2 ELSE 1 END", _source), _name)(lambda spark, d, o=_open, q=_q: o(spark, d).regroup_query(QueryRule(1, q, 1, 2)).push("count()").group_stats())


# metrics ----------------------------------------------------------------------------------------------------------------

Q, N = "q", "ln"
BY_METRIC = {
    "m_count": (lines, ["count()"], "1"),
    "m_constant": (lines, ["-17"], "-17"),
    "m_field": (lines, ["l_partkey"], "l_partkey"),
    "m_add": (lines, ["l_quantity", "l_linenumber", "+"], "q + ln"),
    "m_subtract": (lines, ["l_linenumber", "l_quantity", "-"], "ln - q"),
    "m_multiply": (lines, ["l_quantity", "l_linenumber", "*"], "q * ln"),
    "m_divide": (lines, ["l_quantity", "l_linenumber", "4", "-", "/"], "CASE WHEN ln = 4 THEN 0 ELSE q // (ln - 4) END"),
    "m_modulus": (lines, ["l_linenumber", "l_quantity", "-", "7", "%"], "(ln - q) % 7"),
    "m_abs": (lines, ["l_linenumber", "l_quantity", "-", "abs()"], "abs(ln - q)"),
    "m_min": (lines, ["l_quantity", "20", "min()"], "least(q, 20)"),
    "m_max": (lines, ["l_quantity", "20", "max()"], "greatest(q, 20)"),
    "m_eq": (lines, ["l_quantity", "20", "="], "(q = 20)::BIGINT"),
    "m_neq": (lines, ["l_quantity", "20", "!="], "(q <> 20)::BIGINT"),
    "m_lt": (lines, ["l_quantity", "20", "<"], "(q < 20)::BIGINT"),
    "m_lte": (lines, ["l_quantity", "20", "<="], "(q <= 20)::BIGINT"),
    "m_gt": (lines, ["l_quantity", "20", ">"], "(q > 20)::BIGINT"),
    "m_gte": (lines, ["l_quantity", "20", ">="], "(q >= 20)::BIGINT"),
    "m_log": (lines, ["l_quantity", "log 100"], "trunc((ln(q) - ln(100)) * 100)::BIGINT"),
    "m_mulshr": (lines, ["l_quantity", "l_linenumber", "mulshr 3"], "(q * ln) >> 3"),
    "m_shldiv": (lines, ["l_quantity", "l_linenumber", "3", "-", "shldiv 4"], "CASE WHEN ln = 3 THEN 0 ELSE (q << 4) // (ln - 3) END"),
    "m_hasint": (lines, ["hasint l_linenumber:3"], "(ln = 3)::BIGINT"),
    "m_hasstr": (lines, ["hasstr l_returnflag:R"], "(l_returnflag = 'R')::BIGINT"),
    "m_regex": (lines, ["regex l_returnflag:[AN]"], "(l_returnflag IN ('A', 'N'))::BIGINT"),
    "m_regex_int": (lines, ["regex l_partkey:1.*9"], "regexp_full_match(l_partkey::VARCHAR, '1.*9')::BIGINT"),
    "m_regex_automaton": (lines, ["regex l_partkey:<90-250>&~(@7)|#|5."], "((l_partkey BETWEEN 90 AND 250 AND l_partkey % 10 <> 7) OR l_partkey BETWEEN 50 AND 59)::BIGINT"),
    "m_strtermcount": (lines, ["strtermcount l_returnflag", "inttermcount l_partkey", "+"], "2"),
    "m_ref": (lines, ["l_quantity", "l_linenumber", "ref 1", "*", "-"], "q - ln * q"),
    "m_cached_interleave": (lines, ["l_quantity", "cached()", "l_linenumber", "interleave 2", "+"], "q + ln"),
    "m_query": (lines, ["lucene +l_linenumber:2 -l_returnflag:A", "l_quantity", "*"], "CASE WHEN ln = 2 AND l_returnflag <> 'A' THEN q ELSE 0 END"),
    "m_multivalued": (orders, ["partkeys", "hasint partkeys:12", "+"], "list_max(pk) + list_contains(pk, 12)::BIGINT"),
    "m_words": (words, ["strtermcount tokens", "hasstr tokens:the", "regex tokens:an.*", "+", "+"], "least(len(toks), 255) + list_contains(toks, 'the')::BIGINT + (len(list_filter(toks, lambda t: starts_with(t, 'an'))) > 0)::BIGINT"),
    "m_string_as_int": (lambda s, d: Session.open(_table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("c"), F.col("o_orderstatus").alias("o"))), ["c", "o", "+"], "o_custkey"),
    "m_time_alias": (events, ["time", "86400", "/"], "t // 86400"),
    "q09_floatscale": (lines, ["floatscale l_discount*100+7"], "coalesce(floor(try_cast(l_discount::VARCHAR AS DOUBLE) * 100 + 7 + 0.5), 0)::BIGINT"),
}
_SOURCES = {"m_multivalued": O, "m_words": D, "m_string_as_int": "orders", "m_time_alias": E}
for _name, (_open, _push, _sql) in BY_METRIC.items():
    query(f"SELECT 1::INT AS grp, sum({_sql})::BIGINT AS s0 FROM {_SOURCES.get(_name, L)}", _name)(
        lambda spark, d, o=_open, p=tuple(_push): (lambda s: s.group_stats().select("grp", F.col(f"s{len(s.stack) - 1}").alias("s0")))(o(spark, d).push(*p))
    )


@query(
    f"""WITH p AS (SELECT q - 25 AS v FROM {L})
SELECT 1::INT AS grp, sum(trunc(exp(v / 10.0::DOUBLE) * 10)::BIGINT)::BIGINT AS s0,
 sum(trunc((CASE WHEN v > 0 THEN v / 10.0::DOUBLE + ln(1 + exp(-v / 10.0::DOUBLE)) ELSE ln(1 + exp(v / 10.0::DOUBLE)) END) * 10)::BIGINT)::BIGINT AS s1,
 sum(trunc(100 / (1 + exp(-v / 10.0::DOUBLE)))::BIGINT)::BIGINT AS s2 FROM p"""
)
def q10_fixed_point(spark, d):
    v = ["l_quantity", "25", "-"]
    return lines(spark, d).push(*v, "exp 10", *v, "log1pexp 10", *v, "logistic 10 100").group_stats()


@query(f"SELECT 1::INT AS grp, sum(16)::BIGINT AS s0, sum(q * 16)::BIGINT AS s1, count(*)::BIGINT AS s2 FROM {L}")
def m_counts_scaled(spark, d):
    """Documents that stand for 16 each."""
    s = Session.open(_table(spark, d, "lineitem"), ints=["l_quantity"], strings=[], scale=16)
    return s.push("counts", "l_quantity", "count()").group_stats()


@query(f"SELECT 1::INT AS grp, sum((v + 2147483648) % 4294967296 - 2147483648)::BIGINT AS s0 FROM (SELECT coalesce(floor(try_cast(l_discount::VARCHAR AS DOUBLE) * 123456789012 + 7 + 0.5), 0)::BIGINT AS v FROM {L})")
def m_floatscale_wide(spark, d):
    """Numbers beyond 32 bits."""
    return lines(spark, d).push("floatscale l_discount*123456789012+7").group_stats()


@query(f"SELECT 1::INT AS grp, sum(5)::BIGINT AS s0, sum(5 + q)::BIGINT AS s1, sum(2 * q)::BIGINT AS s2, sum(6)::BIGINT AS s3 FROM {L}")
def m_cached_dynamic(spark, d):
    """What is cached or interleaved keeps its values when a dynamic metric changes."""
    s = lines(spark, d).create_dynamic_metric("foo").update_dynamic_metric("foo", [0, 5])
    s = s.push("dynamic foo", "cached()", "dynamic foo", "l_quantity", "+", "l_quantity", "2", "*", "interleave 2", "dynamic foo")
    return s.update_dynamic_metric("foo", [0, 1]).group_stats()


# dynamic metrics --------------------------------------------------------------------------------------------------------


@query(_grouped("CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END", stats="sum(CASE WHEN l_returnflag = 'A' THEN -3 ELSE 5 END)::BIGINT AS s0"))
def q14_dynamic(spark, d):
    s = lines(spark, d).create_dynamic_metric("foo").regroup([FLAG_A])
    return s.update_dynamic_metric("foo", [0, 5, -3]).push("dynamic foo").group_stats()


@query("SELECT 1::INT AS grp, sum(least(2147483647, CASE WHEN l_returnflag = 'A' THEN 2147483647::BIGINT ELSE 0 END + 10) - 5)::BIGINT AS s0 FROM lineitem")
def dyn_saturating(spark, d):
    s = lines(spark, d).create_dynamic_metric("foo").conditional_update_dynamic_metric("foo", [Condition("l_returnflag", "A")], [2147483647])
    return s.update_dynamic_metric("foo", [0, 10]).update_dynamic_metric("foo", [0, -5]).push("dynamic foo").group_stats()


@query("SELECT 1::INT AS grp, sum(CASE WHEN l_returnflag = 'A' THEN 100 ELSE 0 END + CASE WHEN l_linenumber = 2 THEN -7 ELSE 0 END)::BIGINT AS s0 FROM lineitem")
def dyn_conditional(spark, d):
    s = lines(spark, d).create_dynamic_metric("foo")
    return s.conditional_update_dynamic_metric("foo", [Condition("l_returnflag", "A"), Condition("l_linenumber", 2)], [100, -7]).push("dynamic foo").group_stats()


@query(_grouped("CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END", stats="sum(CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 4 WHEN l_returnflag <> 'A' AND l_linenumber = 2 THEN 9 ELSE 0 END)::BIGINT AS s0"))
def dyn_group_conditional(spark, d):
    s = lines(spark, d).create_dynamic_metric("foo").regroup([FLAG_A])
    one, two = Condition("l_linenumber", 1), Condition("l_linenumber", 2)
    return s.group_conditional_update_dynamic_metric("foo", [2, 2, 1, 8], [one, one, two, one], [3, 4, 9, 50]).push("dynamic foo").group_stats()


# reads ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT l_partkey AS term, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, term DESC LIMIT 20")
def q11_top_terms(spark, d):
    return lines(spark, d).top_terms("l_partkey", True, 20)


@query(f"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(toks) AS term FROM {D}) GROUP BY 1 ORDER BY n DESC, term DESC LIMIT 50")
def top_terms_multivalued(spark, d):
    return words(spark, d).top_terms("tokens", False, 50)


@query(_grouped("CASE WHEN t >= 1704067200 AND t < 1704067200 + 30 * 86400 THEN (t - 1704067200) // 86400 + 1 ELSE 0 END", E))
def q12_time_buckets(spark, d):
    return events(spark, d).push("time").metric_regroup(0, 1704067200, 1704067200 + 30 * 86400, 86400, gutters=False).pop().push("count()").group_stats()


@query(
    f"""WITH d AS (SELECT *, (CASE WHEN q <= 25 THEN 2 ELSE 0 END)::INT AS grp FROM {L}), f AS (SELECT ln, count(*)::BIGINT AS f FROM d GROUP BY 1)
SELECT d.ln AS int_term, grp, f AS term_doc_freq, sum(q)::BIGINT AS s0 FROM d JOIN f ON d.ln = f.ln WHERE grp <> 0 GROUP BY ALL"""
)
def term_doc_freq(spark, d):
    s = lines(spark, d).regroup([Rule(1, Condition("l_quantity", 25, True), 0, 2)]).push("l_quantity")
    return s.ftgs(["l_linenumber"], doc_freq=True).select("int_term", "grp", "term_doc_freq", "s0")


@query(f"SELECT (sum(len(pk)) + count(*))::BIGINT AS total_doc_freq FROM {O}")
def total_doc_freq(spark, d):
    return orders(spark, d).regroup_multi([]).total_doc_freq(["partkeys", "nowhere"], ["o_orderstatus"])


@query(
    f"""SELECT 'l_linenumber' AS field, ln AS int_term, NULL::VARCHAR AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0 FROM {L} WHERE ln IN (2, 5) GROUP BY ALL
UNION ALL SELECT 'l_returnflag', NULL, l_returnflag, 1::INT, count(*)::BIGINT FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL"""
)
def subset_ftgs(spark, d):
    return lines(spark, d).push("count()").subset_ftgs({"l_linenumber": [2, 5, 99]}, {"l_returnflag": ["R", "Z"]}).select("field", "int_term", "str_term", "grp", "s0")


@query(f"SELECT term AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0 FROM (SELECT unnest(toks) AS term FROM {D}) WHERE term IN ('the', 'and', 'zzz') GROUP BY ALL")
def subset_ftgs_multivalued(spark, d):
    return words(spark, d).push("count()").subset_ftgs({}, {"tokens": ["the", "and", "zzz"]}).select("str_term", "grp", "s0")


@query(f"SELECT DISTINCT 'l_linenumber' AS field, ln AS int_term, (CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END)::INT AS grp FROM {L}")
def ftgs_zero_stats(spark, d):
    return lines(spark, d).regroup([FLAG_A]).ftgs(["l_linenumber"]).select("field", "int_term", "grp")


@query(f"SELECT l_suppkey AS int_term, count(*)::BIGINT AS s0, sum(q)::BIGINT AS s1 FROM {L} GROUP BY 1")
def ftgs_splits(spark, d):
    return lines(spark, d).push("count()", "l_quantity").ftgs_splits(["l_suppkey"]).select("int_term", "s0", "s1")


@query("SELECT 2::INT AS grp, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'A'")
def doc_rows(spark, d):
    return lines(spark, d).regroup([Rule(1, Condition("l_returnflag", "A"), 0, 2)]).doc_rows(["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query(
    f"""WITH s AS (SELECT l_suppkey AS int_term, count(*)::BIGINT AS s0, sum(q)::BIGINT AS s1 FROM {L} GROUP BY 1),
r AS (SELECT 0::INT AS stat, row_number() OVER (ORDER BY s0 DESC, int_term DESC)::INT AS rank, int_term, s0 AS value FROM s
UNION ALL SELECT 1::INT, row_number() OVER (ORDER BY s1 DESC, int_term DESC)::INT, int_term, s1 FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def shell_topk(spark, d):
    return lines(spark, d).push("count()", "l_quantity").top(10, ["l_suppkey"]).select("stat", "rank", "int_term", "value")


@query(f"SELECT count(DISTINCT term)::BIGINT AS n_terms FROM (SELECT unnest(toks) AS term FROM {D} WHERE lang = 'fr')")
def distinct_terms(spark, d):
    s = words(spark, d).regroup([Rule(1, Condition("lang", "fr"), 0, 1)])
    return s.ftgs([], ["tokens"]).agg(F.count_distinct("str_term").alias("n_terms"))


# front end --------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT l_partkey AS int_term, sum(q)::BIGINT AS s0, count(*)::BIGINT AS s1 FROM {L} WHERE l_partkey::VARCHAR LIKE '%1%' AND l_partkey::VARCHAR NOT LIKE '%0%' GROUP BY 1),
f AS (SELECT * FROM s ORDER BY s0::DOUBLE / s1 DESC, int_term LIMIT 15) SELECT *, row_number() OVER (ORDER BY s1 ASC, int_term)::INT AS rank FROM f"""
)
def frontend_topterms_ratio(spark, d):
    s = lines(spark, d).push("l_quantity", "count()")
    out = frontend.top_terms(s, ["l_partkey"], k=15, sort=0, divide_by=1, substrings=["1", "0"], match=[True, False], final_sort=1, final_reverse=True)
    return out.select("int_term", "s0", "s1", "rank")


@query(
    f"""WITH s AS (SELECT user_id AS int_term, count(*)::BIGINT AS s0 FROM {E} WHERE t >= 1704326400 AND t < 1705536000 AND event_type <> 'view' GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY s0 ASC, int_term)::INT AS rank FROM (SELECT * FROM s ORDER BY s0 ASC, int_term LIMIT 7)"""
)
def frontend_topterms_time(spark, d):
    s = events(spark, d).push("count()")
    return frontend.top_terms(s, ["user_id"], k=7, reverse=True, query=Not(Term("event_type", "view")), time_field="unixtime", times=(1704326400, 1705536000)).select("int_term", "s0", "rank")


@query(
    f"""WITH a AS (SELECT l_partkey AS term, count(*)::BIGINT AS s0, sum(q)::BIGINT AS s1 FROM {L} GROUP BY 1), b AS (SELECT p_partkey AS term, sum(p_size)::BIGINT AS t0 FROM part GROUP BY 1)
SELECT * FROM a JOIN b USING (term)"""
)
def frontend_key_join(spark, d):
    parts = Session.open(_table(spark, d, "part").select("p_partkey", "p_size")).push("p_size")
    return frontend.joined_terms(lines(spark, d).push("count()", "l_quantity"), parts, "l_partkey", "p_partkey", is_int=True)


@query(f"SELECT (q - 10) // 10 AS x, (ln - 2) // 2 AS y, count(*)::BIGINT AS n FROM {L} WHERE q >= 10 AND q < 40 AND ln >= 2 AND ln < 6 GROUP BY 1, 2")
def bucket_stats(spark, d):
    s = lines(spark, d).push("l_quantity", "l_linenumber").metric_regroup_2d(0, 10, 40, 10, 1, 2, 6, 2)[0]
    cells = BucketStats({r.grp: r.s0 for r in s.pop().pop().push("count()").group_stats().collect()}, 5, 4)  # 20 cells
    return spark.createDataFrame([(x, y, n) for x in range(3) for y in range(2) if (n := cells.get(x, y))], "x long, y long, n long")


@query("SELECT l_returnflag AS str_term, 1::INT AS grp, count(*)::BIGINT AS term_doc_freq, count(*)::BIGINT AS s0 FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1")
def groupless_terms(spark, d):
    """A term whose documents are all in group 0 isn't told."""
    s = lines(spark, d).regroup([Rule(1, Condition("l_returnflag", "A"), 1, 0)]).push("count()")
    return s.ftgs([], ["l_returnflag"], doc_freq=True).select("str_term", "grp", "term_doc_freq", "s0")


# shards -----------------------------------------------------------------------------------------------------------------

#: Shards of five days, the first at the day of the first event, in the zone of shard names.
SHARD_DAYS, SHARDS = 5, 6
SHARD_OF = "(date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // 5)"
SHARD_NAME = "'index' || strftime((SELECT min(ts)::DATE FROM events) + (i * 5)::INT, '%Y%m%d') || '.00-' || strftime((SELECT min(ts)::DATE FROM events) + (i * 5 + 5)::INT, '%Y%m%d') || '.00'"


def _at(first: datetime, i: int) -> datetime:
    return datetime(first.year, first.month, first.day, tzinfo=catalog.ZONE) + timedelta(days=SHARD_DAYS * i)


def _folder(spark: SparkSession) -> str:
    """A new folder on the storage that all executors share; below the machine's own only with a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="suite-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"{path.rstrip('/')}/suite-{uuid.uuid4().hex}"


def event_shards(spark, d) -> tuple[catalog.Catalog, datetime]:
    """The events as shards of one dataset, one of them also in an older version, and of another's first day an older shard."""
    root, e = _folder(spark), _table(spark, d, "events")
    first = e.agg(F.min("ts")).first()[0]
    e = e.select("event_id", "user_id", "event_type", F.floor(F.datediff(F.col("ts").cast("date"), F.lit(first.date())) / SHARD_DAYS).alias("shard"))
    for i in range(SHARDS):
        part = e.where(F.col("shard") == i).drop("shard").coalesce(1)
        dataset.write_shard(part, f"{root}/events/{_shard_id(first, i)}.20240201000000")
        if i == 1:  # superseded
            dataset.write_shard(part.where("event_id % 2 = 0"), f"{root}/events/{_shard_id(first, i)}.20240131000000")
        if i == 3:  # it overlaps one that is newer
            dataset.write_shard(part.where("event_id % 3 = 0"), f"{root}/events/index{_at(first, i):%Y%m%d}.20240101000000")
    return catalog.Catalog(spark, root), first


def _shard_id(first: datetime, i: int) -> str:
    return f"index{_at(first, i):%Y%m%d}.00-{_at(first, i + 1):%Y%m%d}.00"


def _built(spark, d, i: int, j: int) -> catalog.SessionBuilder:
    c, first = event_shards(spark, d)
    return catalog.SessionBuilder(c, "events", _at(first, i), _at(first, j))


@query(f"SELECT event_type AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0, sum(user_id)::BIGINT AS s1 FROM events WHERE {SHARD_OF} IN (1, 2) GROUP BY 1")
def builder_session(spark, d):
    s = _built(spark, d, 1, 3).open(ints=["user_id"], strings=["event_type"])
    return s.push("count()", "user_id").ftgs([], ["event_type"]).select("str_term", "grp", "s0", "s1")


@query("SELECT 1::INT AS grp, count(*)::BIGINT AS s0, sum(user_id)::BIGINT AS s1 FROM events")
def builder_each(spark, d):
    """Sessions on batches of shards; what each gives is summed."""
    most = _table(spark, d, "events").count() // 2
    parts = _built(spark, d, 0, SHARDS).each(most, lambda s: s.push("count()", "user_id").group_stats())
    return reduce(DataFrame.unionAll, parts).groupBy("grp").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))


@query(
    f"""SELECT {SHARD_NAME} AS shard, 20240201000000::BIGINT AS version, epoch((SELECT min(ts)::DATE FROM events) + (i * 5)::INT)::BIGINT + 21600 AS start_s, count(*)::BIGINT AS n
FROM (SELECT {SHARD_OF} AS i FROM events) WHERE i BETWEEN 0 AND 5 GROUP BY i"""
)
def shard_overlap(spark, d):
    """The chosen shards and their documents."""
    b = _built(spark, d, 0, SHARDS)
    chosen = spark.createDataFrame([(s.folder, s.shard_id, s.version, int(s.times[0].timestamp())) for s in b.shards()], "_shard string, shard string, version long, start_s long")
    return b.read().groupBy("_shard").agg(F.count("*").alias("n")).join(chosen, "_shard").drop("_shard")


@query("SELECT epoch((SELECT min(ts)::DATE FROM events) + (i * 5)::INT)::BIGINT + 21600 AS start_s, epoch((SELECT min(ts)::DATE FROM events) + (i * 5 + 5)::INT)::BIGINT + 21600 AS end_s FROM (VALUES (2), (5)) AS t(i)")
def shard_gaps(spark, d):
    """Of shards that were deleted."""
    c, first = event_shards(spark, d)
    for i in (2, 5):
        dataset.delete(spark, c.path("events", next(s for s in c.shards("events") if s.shard_id == _shard_id(first, i))))
    b = catalog.SessionBuilder(c, "events", _at(first, 0), _at(first, SHARDS))
    return spark.createDataFrame([(int(x.timestamp()), int(y.timestamp())) for x, y in b.missing()], "start_s long, end_s long")


@query(
    f"""WITH s AS (SELECT DISTINCT {SHARD_NAME} AS shard, 20240201000000::BIGINT AS version FROM (SELECT {SHARD_OF} AS i FROM events) WHERE i BETWEEN 0 AND 5
UNION ALL SELECT 'index' || strftime((SELECT min(ts)::DATE FROM events) + 15, '%Y%m%d'), 20240101000000)
SELECT 'events' AS dataset, shard, version, 'event_id,event_type,user_id' AS fields, (SELECT count(*) FROM s)::INT AS shards FROM s"""
)
def catalog_shards(spark, d):
    """Datasets, shards in their newest versions and fields, and what the status tells."""
    c, _ = event_shards(spark, d)
    listed = c.describe().select("dataset", "shard", "version", F.array_join(F.array_sort("columns"), ",").alias("fields"))
    return listed.join(c.status().select("dataset", "shards"), "dataset")


@query(f"SELECT event_type AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0 FROM events WHERE {SHARD_OF} IN (2, 4) GROUP BY 1")
def copied_shards(spark, d):
    """Copies of a time range's shards, without one of them, below another root."""
    c, first = event_shards(spark, d)
    target = _folder(spark)
    dataset.copy_time_range(c, "events", target, _at(first, 2), _at(first, 3))
    dataset.copy_shards(c, "events", target, lambda s: s.shard_id == _shard_id(first, 4))
    b = catalog.SessionBuilder(catalog.Catalog(spark, target), "events", _at(first, 0), _at(first, SHARDS))
    return b.open(strings=["event_type"]).push("count()").ftgs([], ["event_type"]).select("str_term", "grp", "s0")


@query("SELECT n_regionkey::BIGINT AS int_term, 1::INT AS grp, count(*)::BIGINT AS s0, sum(n_nationkey)::BIGINT AS s1 FROM nation GROUP BY 1")
def document_writer(spark, d):
    """Documents added one by one, in segments, compacted to one shard."""
    path = _folder(spark)
    with dataset.DocumentWriter(spark, path, buffer=10) as w:
        for r in _table(spark, d, "nation").toLocalIterator():
            w.add({"name": [r.n_name], "region": [r.n_regionkey], "key": [r.n_nationkey]})
    return Session.open(dataset.open_index(spark, path)).push("count()", "key").ftgs(["region"]).select("int_term", "grp", "s0", "s1")


@query("SELECT n_name AS str_term, 1::INT AS grp, n_nationkey::BIGINT AS s0 FROM nation")
def in_memory(spark, d):
    """An index from documents in memory and one from terms with their documents, merged."""
    rows = _table(spark, d, "nation").collect()  # 25
    half = dataset.from_documents(spark, [{"name": r.n_name, "key": r.n_nationkey} for r in rows[:12]])
    terms = {"name": {r.n_name: [i] for i, r in enumerate(rows[12:])}, "key": {r.n_nationkey: [i] for i, r in enumerate(rows[12:])}}
    return Session.open(dataset.merge([half, dataset.from_terms(spark, len(rows) - 12, terms)])).push("key").ftgs([], ["name"]).select("str_term", "grp", "s0")


@query("SELECT o_orderstatus AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0, sum(o_custkey)::BIGINT AS s1 FROM orders GROUP BY 1")
def copied_index(spark, d):
    """Some fields of an index, copied, the copy in the order of a field."""
    first, second = _folder(spark), _folder(spark)
    dataset.copy_index(spark, f"{d}/orders.parquet", first, ["o_custkey", "o_orderstatus"])
    dataset.write_shard(dataset.sort_index(spark.read.parquet(first), "o_custkey"), second, sort_by=["o_custkey"])
    return Session.open(dataset.open_index(spark, second)).push("count()", "o_custkey").ftgs([], ["o_orderstatus"]).select("str_term", "grp", "s0", "s1")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name)::INT AS place FROM nation")
def sorted_index(spark, d):
    docs = dataset.sort_index(_table(spark, d, "nation").select("n_name"), "n_name")
    return docs.select("n_name", F.row_number().over(Window.orderBy("_doc")).alias("place"))  # 25 rows


@query("SELECT k AS kind, 1::INT AS grp, count(*)::BIGINT AS s0, sum(n_regionkey)::BIGINT AS s1 FROM nation, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) AS t(k) GROUP BY 1")
def open_formats(spark, d):
    """The formats of an index, told by its files."""
    out, n = [], _table(spark, d, "nation").select("n_name", "n_regionkey")
    for kind in ("parquet", "orc", "json", "csv"):
        path = _folder(spark)
        (n.write.option("header", "true") if kind == "csv" else n.write).format(kind).save(path)
        out.append(Session.open(dataset.open_index(spark, path)).push("count()", "n_regionkey").group_stats().withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out)


@query("SELECT l_returnflag AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0 FROM lineitem GROUP BY 1")
def term_stats_files(spark, d):
    """Statistics of two halves of the documents, written, read back and merged."""
    paths = [_folder(spark), _folder(spark)]
    for i, path in enumerate(paths):
        half = lines(spark, d).regroup([Rule(1, Condition("l_linenumber", 3, True), 1 - i, i)]).push("count()")
        dataset.write_term_stats(half.ftgs([], ["l_returnflag"]), path)
    return dataset.merge_term_stats([dataset.read_term_stats(spark, p) for p in paths]).select("str_term", "grp", "s0")


@query("SELECT 1::INT AS grp, ((SELECT count(*) FROM orders) + (SELECT count(*) FROM customer))::BIGINT AS s0, (SELECT sum(o_custkey) FROM orders)::BIGINT AS s1")
def index_merge(spark, d):
    both = dataset.merge([_table(spark, d, "orders").select("o_custkey", "o_orderstatus"), _table(spark, d, "customer").select("c_name")])
    return Session.open(both).push("count()", "o_custkey").group_stats()


@query(f"SELECT (q // 10)::BIGINT AS int_term, 1::INT AS grp, count(*)::BIGINT AS s0 FROM {L} GROUP BY 1")
def add_field(spark, d):
    df = dataset.add_field(_table(spark, d, "lineitem").select("l_quantity"), "tens", F.floor(F.col("l_quantity") / 10).cast("long"))
    return Session.open(df).push("count()").ftgs(["tens"]).select("int_term", "grp", "s0")


@query("SELECT l_returnflag AS str_term, 1::INT AS grp, count(*)::BIGINT AS s0 FROM lineitem GROUP BY 1")
def term_stats_merge(spark, d):
    first = lines(spark, d).regroup([Rule(1, Condition("l_linenumber", 3, True), 0, 1)]).push("count()").ftgs([], ["l_returnflag"])
    rest = lines(spark, d).regroup([Rule(1, Condition("l_linenumber", 3, True), 1, 0)]).push("count()").ftgs([], ["l_returnflag"])
    return dataset.merge_term_stats([first, rest]).select("str_term", "grp", "s0")
