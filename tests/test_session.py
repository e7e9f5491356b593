"""Expected values of small indexes, operator by operator."""

import re

import pytest
from pyspark.sql import functions as F

from termweave.operators.regroup import BucketStats
from termweave.operators.session import Session
from termweave.plans.query import And, Not, Or, Range, Term, compile_query, parse
from termweave.plans.regex import full_match, interval, translate
from termweave.plans.rules import Condition, MultiRule, QueryRule, Rule
from termweave.sources.dataset import from_documents, from_terms

#: This small index, and below the sums and groups that operations on it must give, are given ones.
TWENTY = {
    "if1": {1: [0, 5, 7, 8], 13: [1, 9, 11, 13, 14, 15, 16, 17, 18], 9000: [3, 12, 19], 2147483647: [2, 4, 6, 10]},
    "if2": {0: [11, 13, 15, 17, 19], 5: [1, 4, 9, 16], 23: [0, 1, 13, 18]},
    "if3": {5: range(5), 19: range(5, 10), 9999: range(10, 15), 10000: range(15, 20)},
    "sf1": {"": [0, 5], "a": [1, 6, 8, 19], "hello world": [3, 9, 16]},
    "sf2": {"b": [6, 9, 12, 15]},
    "sf3": {"hmmmm": [0, 3, 18], "some string": [9]},
    "sf4": {"asdf": [2, 6, 19], "bcde": [3, 7, 15, 18], "cdef": [4, 5, 6, 7]},
    "floatfield": {"1.5": range(5), "2.5": range(5, 10), "0": range(10, 15), "18000": range(15, 20)},
}


@pytest.fixture(scope="module")
def twenty(spark):
    return Session.open(from_terms(spark, 20, TWENTY).cache())


def sums(s, i=0, zero=False):
    return {r.grp: r[f"s{i}"] for r in s.group_stats(zero).collect()}


def groups(s):
    return [r.grp for r in s.doc_groups().orderBy("_doc").collect()]


def test_stack(twenty):
    s = twenty.push("count()", "if3", "+")
    assert s.num_stats() == 1 and s.pop().num_stats() == 0
    with pytest.raises(ValueError):
        twenty.push("+")
    with pytest.raises(ValueError):
        twenty.pop()
    with pytest.raises(ValueError):
        twenty.push(*["1"] * 65)
    assert twenty.push(*["1"] * 64).num_stats() == 64
    with pytest.raises(ValueError):
        twenty.push("3000000000")
    with pytest.raises(ValueError):
        twenty.metric_filter(0, 1, 2)


def test_string_or(twenty):
    assert sums(twenty.string_or_regroup("sf4", ["asdf", "cdef"], 1, 0, 1).push("count()")) == {1: 6}


def test_rules(twenty):
    s = twenty.regroup([Rule(1, Condition("if3", 9999), 1, 2)]).regroup([Rule(1, Condition("if3", 19), 1, 2), Rule(2, Condition("sf2", "b"), 3, 4)])
    assert sums(s.push("count()")) == {1: 10, 2: 5, 3: 4, 4: 1}
    assert s.num_groups().first().num_groups == 5


def test_dynamic(twenty):
    s = twenty.create_dynamic_metric("foo").update_dynamic_metric("foo", [0, 1])
    assert sums(s.push("dynamic foo")) == {1: 20}
    s = s.regroup([Rule(1, Condition("if2", 0), 1, 2)])
    assert sums(s.push("dynamic foo")) == {1: 15, 2: 5}
    s = s.update_dynamic_metric("foo", [0, 0, -2])
    assert sums(s.push("dynamic foo")) == {1: 15, 2: -5}
    assert sums(s.reset_groups().push("dynamic foo")) == {1: 10}
    with pytest.raises(ValueError):
        s.create_dynamic_metric("foo")
    with pytest.raises(ValueError):
        s.update_dynamic_metric("bar", [1])
    with pytest.raises(ValueError):
        s.conditional_update_dynamic_metric("foo", [Condition("if2", 0, True)], [1])
    with pytest.raises(ValueError):
        s.conditional_update_dynamic_metric("foo", [Condition("if2", 0)], [])


def test_conditional_dynamic(spark):
    s = Session.open(from_documents(spark, [{"if1": i % 2, "sf1": "odd" if i % 2 else "even"} for i in range(10)])).create_dynamic_metric("foo")
    s = s.conditional_update_dynamic_metric("foo", [Condition("if1", 0), Condition("sf1", "even")], [100, -100]).push("dynamic foo")
    assert [r._dyn_foo for r in s.df.orderBy("_doc").collect()] == [0] * 10
    s = s.conditional_update_dynamic_metric("foo", [Condition("if1", 1)], [10])
    assert [r._dyn_foo for r in s.df.orderBy("_doc").collect()] == [0, 10] * 5
    s = s.conditional_update_dynamic_metric("foo", [Condition("if1", 1), Condition("if1", 1), Condition("if1", 1)], [2147483647, 5, -7])
    assert [r._dyn_foo for r in s.df.orderBy("_doc").collect()] == [0, 2147483640] * 5


def test_floatscale_and_regex(twenty):
    assert sums(twenty.push("floatscale floatfield*100+9000")) == {1: 5 * ((150 + 9000) + (250 + 9000) + 9000 + (1800000 + 9000))}
    expected = {"if1:9000": 3, "if3:.*9": 10, "if3:notaninteger": 0, "sf1:": 2, "sf2:b": 4, r"floatfield:[0-9]*\.[0-9]*": 10, "nonexistent:anything": 0}
    s = twenty.push(*(f"regex {x}" for x in expected))
    row = s.group_stats().first()
    assert [row[f"s{i}"] for i in range(len(expected))] == list(expected.values())
    assert sums(twenty.push("floatscale sf1*3+4")) == {1: 0}


def test_random_multi(twenty):
    got = groups(twenty.random_multi_regroup("sf1", False, "salt", 1, [0.10, 0.50], [5, 6, 7]))
    want = {i: g for t, g in (("", 6), ("a", 6), ("hello world", 7)) for i in TWENTY["sf1"][t]}
    assert got == [want.get(i, 1) for i in range(20)]
    for bad in ([0.5, 0.1], [0.1, 1.5], [0.1]):
        with pytest.raises(ValueError):
            twenty.random_multi_regroup("sf1", False, "salt", 1, bad, [5, 6, 7])


def test_group_zero_and_rebuild(twenty):
    s = twenty.regroup([Rule(1, Condition("if3", 9999), 1, 2)]).regroup([Rule(1, Condition("if3", 19), 0, 2), Rule(2, Condition("sf2", "b"), 3, 4)])
    assert sums(s.push("count()"), zero=True) == {0: 10, 2: 5, 3: 4, 4: 1}
    small = s.create_dynamic_metric("m").update_dynamic_metric("m", [7, 0, 1, 1, 1]).rebuild(["if3"], ["sf2"])
    assert small.df.count() == 10 and sums(small.push("count()")) == {2: 5, 3: 4, 4: 1}
    assert small.ftgs(["if1"]).count() == 0
    back = small.reset_groups()
    assert sums(back.push("count()")) == {1: 20}
    assert back.push("count()").ftgs(["if1"]).count() == 4
    assert sums(back.push("dynamic m")) == {1: 80}  # the ten that were dropped, in group 0, had got 7 each, those kept 1


def test_cached_metrics_keep_their_values(twenty):
    s = twenty.create_dynamic_metric("foo").update_dynamic_metric("foo", [0, 5]).push("dynamic foo", "cached()", "dynamic foo")
    later = s.update_dynamic_metric("foo", [0, 1])
    assert (sums(later, 0), sums(later, 1)) == ({1: 100}, {1: 120})
    both = twenty.create_dynamic_metric("foo").push("dynamic foo", "if3", "interleave 2").update_dynamic_metric("foo", [0, 3]).push("dynamic foo")
    assert [sums(both, i)[1] for i in range(3)] == [0, sums(twenty.push("if3"))[1], 60]
    # over a rebuild and a reset, and pushed after the rebuild
    kept = later.regroup([Rule(1, Condition("if3", 9999), 0, 1)]).rebuild(["if3"], []).push("dynamic foo", "2", "*", "cached()").update_dynamic_metric("foo", [0, 9])
    assert [sums(kept, i)[1] for i in (0, 1, 2)] == [25, 75, 60]
    back = kept.reset_groups()
    assert [sums(back, i)[1] for i in (0, 1, 2)] == [100, 165, 60]
    with pytest.raises(ValueError):
        twenty.push("interleave 1")


def test_array_and_scalar_fields_share_one_scan(spark):
    rows = [(1, [3, 4], "x", ["a"]), (2, None, None, ["a", "b"]), (None, [], "y", None), (5, [4], "x", [])]
    s = Session.open(spark.createDataFrame(rows, "n long, many array<long>, t string, words array<string>")).push("count()")
    got = s.ftgs(["n", "many"], ["t", "words"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    want = [("many", 3, None, 1), ("many", 4, None, 2), ("n", 1, None, 1), ("n", 2, None, 1), ("n", 5, None, 1), ("t", None, "x", 2), ("t", None, "y", 1), ("words", None, "a", 2), ("words", None, "b", 1)]
    assert sorted(((r.field, r.int_term, r.str_term, r.s0) for r in got.collect()), key=str) == sorted(want, key=str)
    some = s.subset_ftgs({"many": [4], "n": [1]}, {"words": ["b"]})
    assert sorted((r.field, r.s0) for r in some.collect()) == [("many", 2), ("n", 1), ("words", 1)]


def test_float_scaling_keeps_32_bits(spark):
    s = Session.open(from_documents(spark, [{"f": ["30000000000"]}, {"f": ["-1.5"]}, {"f": ["x"]}, {}]))
    assert [r[0] for r in s.push("floatscale f*1+0").df.select(s.push("floatscale f*1+0").stack[0]).collect()] == [30000000000 - 7 * 2**32, -1, 0, 0]


def test_documents_that_stand_for_more(spark):
    s = Session.open(from_documents(spark, [{"a": [3], "time": [7], "w": [2]}, {"a": [4], "time": [8], "w": [5]}]), scale=F.array_max("w"))
    assert [sums(s.push("counts", "count()", "a", "time"), i)[1] for i in range(4)] == [7, 2, 26, 15]


def test_long_chains_of_updates_are_cut(spark):
    s = Session.open(from_documents(spark, [{"a": [1]}])).create_dynamic_metric("m")
    for _ in range(40):
        s = s.update_dynamic_metric("m", [0, 1])
    assert s.steps == 8 and sums(s.push("dynamic m")) == {1: 40}
    assert s.rebuild(["a"], [], written=True).df.count() == 1


def test_queries(twenty):
    def docs(q):
        return [r._doc for r in twenty.df.where(compile_query(q, twenty.fields)).orderBy("_doc").collect()]

    assert docs(And(Term("if3", 9999), Not(Term("if3", 999999)))) == [10, 11, 12, 13, 14]
    assert docs(Or(Term("sf2", "b"), Term("sf2", "x"), Range("if3", 10000, 10000))) == [6, 9, 12, 15, 16, 17, 18, 19]
    assert docs(Range("sf4", "asdf", "cdef", inclusive=False)) == [2, 3, 6, 7, 15, 18, 19]
    assert docs(Range("sf4", "asdf", "cdef")) == [2, 3, 4, 5, 6, 7, 15, 18, 19]
    assert docs(Range("floatfield", "0", "20000")) == list(range(10, 20))  # numbers, of which decimals are none
    assert docs(Range("if2", -5, 1)) == sorted(set(range(20)) - {1, 4, 9, 16, 0, 13, 18})  # missing is 0
    assert docs(Not(Term("nowhere", "x"))) == list(range(20))
    for bad in (lambda: Not(Not(Term("a", 1))), lambda: Range("a", 5, 4), lambda: Range("a", 5, "6")):
        with pytest.raises(ValueError):
            bad()
    Range("a", "b", "a")  # string bounds aren't compared


def test_query_text():
    assert parse("a:b") == Term("a", "b")
    assert parse("a:3", ["a"]) == Term("a", 3)
    assert parse("a:b c:d") == Or(Term("a", "b"), Term("c", "d"))
    assert parse("+a:b c:d") == And(Term("a", "b")) or parse("+a:b c:d") == Term("a", "b")
    assert parse("a:b AND c:d") == And(Term("a", "b"), Term("c", "d"))
    assert parse("+a:b -c:d") == And(Term("a", "b"), Not(Term("c", "d")))
    assert parse("NOT c:d") == Not(Term("c", "d"))
    assert parse('a:"x y"') == And(Term("a", "x"), Term("a", "y"))
    assert parse("a:[1 TO 5]", ["a"]) == Range("a", 1, 5, True) and parse("a:{b TO c}") == Range("a", "b", "c", False)
    assert parse("a:pre*") == Range("a", "pre", "prf", False) and parse("a:7*", ["a"]) == Range("a", 7, 2**63 - 1, True)
    assert parse("+(a:b a:c) +d:e") == And(Or(Term("a", "b"), Term("a", "c")), Term("d", "e"))
    for bad in ("", "a:", "(a:b", "a:b)", "a:[1 5]", "word"):
        with pytest.raises(ValueError):
            parse(bad)
    assert parse("word", default="t") == Term("t", "word")


def test_regex_dialect():
    assert translate("a.b") == "(?s)\\A(?:a.b)\\z" and translate("^a$") == "(?s)\\A(?:\\^a\\$)\\z"
    for bad in ("a~b", "x(a&b)y", "~ab", "<a-b>", "<", "[a", "a\\", '"a', "(a", "a)", "~", "(a&b)*"):
        with pytest.raises(ValueError):
            full_match(bad)
    for bad in ("~a", "a&b"):
        with pytest.raises(ValueError):
            translate(bad)
    translate("[~&@#<]\\~")


AUTOMATA = {  # terms that match, terms that don't
    "~(ab.*)": (["", "a", "b"], ["ab", "abc"]),
    "~a": (["", "b", "aa"], ["a"]),
    "~~a": (["a"], ["b"]),
    "a.*&.*b": (["ab", "axb"], ["a", "b", "ba"]),
    "a.*&~(.*b.*)|z": (["a", "ac", "z"], ["ab", "acb", "zz"]),
    "(x|(a.&.b))": (["x", "ab"], ["ac", "xb"]),
    "a@": (["a", "a\nb"], ["", "ba"]),
    "a#|b": (["b"], ["a", ""]),
    "a#*": (["a"], ["ab", ""]),
    "<8-112>": (["8", "9", "10", "99", "100", "112", "007" + "0", "0112"], ["7", "113", "1000", "", "x"]),
    "v<05-12>": (["v05", "v10", "v12"], ["v5", "v13", "v005", "v04"]),
    "<0-0>": (["0"], ["1", "00"]),
    '"a.b"+': (["a.b", "a.ba.b"], ["axb"]),
}


def test_automaton_operators(spark):
    rows = [(k, t, hit) for k, (yes, no) in AUTOMATA.items() for t, hit in [*((t, True) for t in yes), *((t, False) for t in no)]]
    df = spark.createDataFrame(rows, "k string, t string, hit boolean")
    for k in AUTOMATA:
        assert df.where((F.col("k") == k) & (full_match(k)(F.col("t")) != F.col("hit"))).collect() == [], k


@pytest.mark.parametrize("low,high", [(0, 999), (7, 7), (13, 987), (90, 110), (1, 1000), (100, 200)])
def test_number_intervals(low, high):
    test = re.compile(interval(str(low), str(high))).fullmatch
    assert [n for n in range(1200) if test(str(n))] == list(range(low, high + 1))


METRIC_DOCS = [{"if1": v, "sf1": "☃" if i in (3, 4, 8) else "x"} for i, v in enumerate([5, 10, 5, 15, 5, 15, 5, 10, 5, 20])]


def test_metric_regroup(spark):
    s = Session.open(from_documents(spark, METRIC_DOCS)).push("if1")
    got = s.metric_regroup(0, 0, 20, 5)
    assert groups(got) == [2, 3, 2, 4, 2, 4, 2, 3, 2, 6] and got.num_groups().first()[0] == 7
    got = s.regroup([Rule(1, Condition("sf1", "☃"), 1, 0)]).metric_regroup(0, 9, 17, 4)
    assert groups(got) == [3, 1, 3, 0, 0, 2, 3, 1, 0, 4] and got.num_groups().first()[0] == 5
    with pytest.raises(ValueError):
        s.metric_regroup(0, 5, 5, 1)
    with pytest.raises(ValueError):
        s.metric_regroup(0, 0, 5, 0)
    assert groups(s.metric_filter(0, 10, 15)) == [0, 1, 0, 1, 0, 1, 0, 1, 0, 0]
    assert groups(s.metric_filter(0, 10, 15, negate=True)) == [1, 0, 1, 0, 1, 0, 1, 0, 1, 1]
    assert groups(s.metric_regroup(0, 4, 12, 5, gutters=False)) == [1, 2, 1, 0, 1, 0, 1, 2, 1, 0]


def test_metric_regroup_2d(spark):
    docs = [{"if1": i, "if2": (i // 2 + 1) * 2, "if3": (i + 1) ** 2, "sf1": "☃" if i in (1, 4, 5, 6, 7) else "x"} for i in range(10)]
    s = Session.open(from_documents(spark, docs)).push("if1", "if2")
    got, cells = s.metric_regroup_2d(0, 1, 8, 3, 1, 4, 12, 2)
    assert groups(got) == [1, 2, 7, 7, 13, 13, 18, 19, 25, 25] and cells == 30
    by = sums(got.pop().pop().push("if3"))
    assert by == {1: 1, 2: 4, 7: 25, 13: 61, 18: 49, 19: 64, 25: 181}
    b = BucketStats(by, 5, 6)
    assert (b.corner(False, False), b.y_underflow(0), b.get(0, 0), b.get(1, 1), b.get(1, 2), b.get(2, 2), b.x_overflow(3)) == (1, 4, 25, 61, 49, 64, 181)
    assert sum(b.as_list()) == 385 and b.corner(True, True) == 0 and b.x_underflow(2) == 0 and b.y_overflow(1) == 0
    assert groups(s.metric_regroup_2d(0, 4, 8, 2, 1, 2, 4, 2)[0]) == [5, 5, 9, 9, 10, 10, 11, 11, 12, 12]
    kept = s.regroup([Rule(1, Condition("sf1", "☃"), 1, 0)])
    assert groups(kept.metric_regroup_2d(0, 0, 1, 90000, 1, 8, 10, 2)[0]) == [2, 0, 3, 3, 0, 0, 0, 0, 9, 9]


def test_term_iteration(spark):
    index = {
        "n": {-2147483648: [5, 7, 8], -1: [1, 2, 3], 0: [4, 8, 9], 1: [0, 1, 2], 2147483647: [5, 7, 8]},
        "t": {"": [1, 4, 9], "english": [1, 2, 3], "日本語": [4, 5, 6]},
        "m": {0: [4, 7, 8, 9], 1: [2, 5, 6], 5: [0, 1, 3]},
        "id": {i: [i] for i in range(10)},
    }
    s = Session.open(from_terms(spark, 10, index)).regroup([Rule(1, Condition("id", 4, True), 2, 1)]).push("m")
    got = [(r.int_term, r.str_term, r.grp, r.s0) for r in s.ftgs(["n"], ["t"]).orderBy("is_int", "int_term", "str_term", "grp").collect()]
    assert got[:5] == [(None, "", 1, 5), (None, "", 2, 0), (None, "english", 1, 11), (None, "日本語", 1, 0), (None, "日本語", 2, 2)]
    assert got[5:] == [(-2147483648, None, 2, 1), (-1, None, 1, 11), (0, None, 1, 0), (0, None, 2, 0), (1, None, 1, 11), (2147483647, None, 2, 1)]
    assert {(r.int_term, r.term_doc_freq) for r in s.ftgs(["n"], doc_freq=True).collect()} == {(-2147483648, 3), (-1, 3), (0, 3), (1, 3), (2147483647, 3)}
    assert s.total_doc_freq(["n"], ["t"]).first()[0] == 24
    assert s.subset_ftgs({"n": [1, 77]}, {"t": []}).collect()[0].int_term == 1
    assert s.ftgs().count() == 0 and s.ftgs(["nowhere"], ["n"]).count() == 0


def test_multi_split_on_bits(spark):
    docs = [{"if1": [b for b in (1, 2, 4, 8) if i & b]} for i in range(16)]
    s = Session.open(from_documents(spark, docs))
    rule = MultiRule(1, 0, [1] * 4, [Condition("if1", b) for b in (1, 2, 4, 8)])
    assert groups(s.regroup_multi([rule])) == [0] + [1] * 15
    with pytest.raises(Exception, match="several conditions"):
        s.regroup_multi([rule], error_on_collisions=True).num_groups().collect()
    rule = MultiRule(1, 9, [2, 3, 4], [Condition("if1", 8), Condition("if1", 1, True), Condition("if1", 4, True)])
    assert groups(s.regroup_multi([rule])) == [9, 3, 4, 3, 4, 3, 4, 3] + [2] * 8


def test_multi_split_validation(spark):
    s = Session.open(from_documents(spark, [{"if1": i} for i in range(10)]))
    c = Condition
    assert groups(s.regroup_multi([])) == [0] * 10 and groups(s.regroup_multi([MultiRule(2, 3, [], [])])) == [0] * 10
    assert groups(s.regroup([])) == [0] * 10
    assert groups(s.regroup([Rule(5, c("if1", 3), 1, 2), Rule(1, c("if1", 3), 1, 2), Rule(1, c("if1", 4), 7, 7)])) == [1, 1, 1, 2] + [1] * 6
    for rules in (
        [MultiRule(0, 1, [], [])],
        [MultiRule(1, 1, [], []), MultiRule(1, 2, [], [])],
        [MultiRule(1, 0, [1, 2], [c("if1", 3), c("if1", 3)])],
        [MultiRule(1, 0, [1, 2], [c("if1", 5, True), c("if1", 3, True)])],
        [MultiRule(1, 0, [1, 2], [c("s", "b", True), c("s", "b", True)])],
    ):
        with pytest.raises(ValueError):
            s.regroup_multi(rules)
    with pytest.raises(ValueError):
        MultiRule(1, 0, [1], [])
    with pytest.raises(ValueError):
        s.regroup(iter([Rule(1, None, 1, 1)]), count=2)
    # equal terms may stand in different fields, and an equality beside an inequality
    s.regroup_multi([MultiRule(1, 0, [1, 2, 3], [c("a", 1), c("b", 1), c("a", 1, True)])])


def test_many_rules_agree_with_few(spark, monkeypatch):
    from termweave.operators import regroup

    docs = [{"n": [i % 7, i % 11], "t": ["abc"[i % 3]], "g": i % 9} for i in range(200)]
    s = Session.open(from_documents(spark, docs)).push("g").metric_regroup(0, 0, 9, 1, gutters=False)
    rules = [Rule(g, [Condition("n", g), Condition("t", "b"), Condition("n", 3, True), None, Condition("t", "b", True)][g % 5], g + 10, g + 20) for g in range(1, 9)]
    few = groups(s.regroup(rules))
    monkeypatch.setattr(regroup, "INLINE_RULES", 2)
    assert groups(s.regroup(rules)) == few and 0 in few
    monkeypatch.setattr(regroup, "MAX_BROADCAST_RULES", 2)
    assert groups(s.regroup(rules)) == few


def test_regex_regroup_guard(twenty):
    s = twenty.regex_regroup("sf4", "[ab].*", 1, 1, 2)
    assert sums(s.push("count()")) == {1: 13, 2: 7}
    with pytest.raises(ValueError):
        s.regex_regroup("sf4", "a.*", 1, 1, 2)
    assert groups(twenty.regex_regroup("if1", ".*", 1, 1, 0)) == [1] * 20  # an integer field has no string terms


def test_shards_merge(spark):
    one, two = from_documents(spark, [{"f": ["foo", "bar", "baz"]}]), from_documents(spark, [{}, {"g": 3}], start=1)
    from termweave.sources.dataset import merge

    s = Session.open(merge([one, two.limit(1)]))
    s = s.regroup([Rule(1, Condition("f", "baz"), 2, 3)])
    assert sums(s.push("count()")) == {2: 1, 3: 1}
    assert sums(s.regroup([Rule(3, Condition("f", "foo"), 4, 5)]).push("count()")) == {5: 1}


def test_metric_edges(spark):
    top = 2**63 - 1
    s = Session.open(from_documents(spark, [{"a": 7, "b": 0, "big": top, "low": -(2**63)}]))
    one = lambda *p: s.push(*p).group_stats().select(f"s{len(s.push(*p).stack) - 1}").first()[0]
    assert one("a", "b", "/") == 0 and one("a", "0", "3", "-", "/") == -2 and one("0", "7", "-", "3", "%") == -1
    assert one("low", "0", "1", "-", "/") == -(2**63) and one("big", "2", "/") == top // 2 and one("big", "10", "%") == top % 10
    assert one("b", "log 5") == -(2**63) and one("0", "5", "-", "log 5") == 0
    assert one("big", "exp 1") == top and one("a", "b", "shldiv 3") == 0 and one("a", "2", "shldiv 3") == 28
    assert one("a", "6", "mulshr 2") == 10 and one("missing") == 0 and one("inttermcount missing") == 0
    for bad in (["big", "big", "*"], ["big", "1", "+"], ["low", "1", "-"], ["a", "b", "%"]):
        with pytest.raises(Exception, match="64 bits|division by 0"):
            one(*bad)
    for bad in ("mulshr 32", "shldiv -1", "hasint a", "dynamic x", "ref 5", "floatscale a*b"):
        with pytest.raises(ValueError):
            s.push("1", "1", bad)
    wide = Session.open(from_documents(spark, [{"w": list(range(300))}]))
    assert wide.push("inttermcount w").group_stats().first().s0 == 255


def test_regroup_chain_is_cut(spark):
    from termweave.operators import session

    s = Session.open(from_documents(spark, [{"a": i} for i in range(50)])).push("a")
    for k in range(session.CHECKPOINT_EVERY + 3):
        s = s.regroup_query(QueryRule(1, Term("a", k), 1, 0))
    assert s.steps < session.CHECKPOINT_EVERY and sums(s.push("count()")) == {1: sum(range(35, 50))} or sums(s.push("count()"), 1) == {1: 15}
