"""Random operations on random documents against a plain model of a session."""

import random

import pytest

from termweave.operators.session import Session
from termweave.plans.rules import Condition, MultiRule, Rule
from termweave.sources.dataset import from_documents


class Model:
    def __init__(self, docs):
        self.docs, self.grp = docs, [1] * len(docs)

    def terms(self, i, field, is_int):
        t = self.docs[i].get(field, [])
        return t if field.startswith("i") == is_int else []

    def hit(self, i, c):
        return any(t <= c.term if c.inequality else t == c.term for t in self.terms(i, c.field, c.is_int))

    def regroup(self, rules):
        by = {}
        for r in rules:
            by.setdefault(r.target, r)
        self.grp = [0 if g not in by else by[g].positive if by[g].condition and self.hit(i, by[g].condition) else by[g].negative for i, g in enumerate(self.grp)]

    def multi(self, rules):
        by = {r.target: r for r in rules}

        def new(i, g):
            if g not in by:
                return 0
            return next((p for p, c in zip(by[g].positives, by[g].conditions) if self.hit(i, c)), by[g].negative)

        self.grp = [new(i, g) for i, g in enumerate(self.grp)]

    def one_of(self, field, terms, is_int, target, neg, pos):
        self.grp = [g if g != target else pos if set(self.terms(i, field, is_int)) & set(terms) else neg for i, g in enumerate(self.grp)]

    def value(self, i, field):
        return max(self.docs[i].get(field, []), default=0)

    def bucket(self, field, low, high, step, gutters):
        n = (high - 1 - low) // step + 1

        def new(i, g):
            v = self.value(i, field)
            if not g:
                return 0
            if low <= v < high:
                return (g - 1) * (n + 2 * gutters) + (v - low) // step + 1
            return (g - 1) * (n + 2) + (n + 1 if v < low else n + 2) if gutters else 0

        self.grp = [new(i, g) for i, g in enumerate(self.grp)]

    def keep(self, field, low, high, negate):
        self.grp = [g if (low <= self.value(i, field) <= high) != negate else 0 for i, g in enumerate(self.grp)]

    def ftgs(self, field, metric):
        out = {}
        for i, g in enumerate(self.grp):
            for t in self.docs[i].get(field, []) if g else []:
                out[t, g] = out.get((t, g), 0) + self.value(i, metric)
        return out


@pytest.mark.parametrize("seed", range(4))
def test_random_operations(spark, seed):
    rnd = random.Random(seed)
    fields = ["i0", "i1", "s0", "s1"]
    some = lambda f, n: sorted({rnd.randrange(0, 12) if f[0] == "i" else rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(n)})
    docs = [{f: some(f, rnd.randrange(0, 4)) for f in fields} for _ in range(80)]
    model, s = Model(docs), Session.open(from_documents(spark, docs).cache())

    def condition():
        f = rnd.choice(fields)
        return Condition(f, some(f, 1)[0], rnd.random() < 0.4)

    for _ in range(7):
        live = sorted({g for g in model.grp if g}) or [1]
        kind = rnd.randrange(5)
        if kind == 0:
            rules = [Rule(rnd.choice(live), condition(), rnd.randrange(0, 4), rnd.randrange(1, 5)) for _ in range(3)]
            model.regroup(rules)
            s = s.regroup(rules)
        elif kind == 1:
            rules = []
            for g in rnd.sample(live, min(2, len(live))):
                cs = list({(c.field, c.is_int, c.inequality): c for c in (condition() for _ in range(3))}.values())
                rules.append(MultiRule(g, rnd.randrange(0, 3), [rnd.randrange(0, 5) for _ in cs], cs))
            model.multi(rules)
            s = s.regroup_multi(rules)
        elif kind == 2:
            f = rnd.choice(fields)
            args = (rnd.choice(live), rnd.randrange(0, 3), rnd.randrange(1, 4))
            terms = some(f, 4)
            model.one_of(f, terms, f[0] == "i", *args)
            s = s.int_or_regroup(f, terms, *args) if f[0] == "i" else s.string_or_regroup(f, terms, *args)
        elif kind == 3 and max(model.grp) < 20:
            f, gutters = rnd.choice(["i0", "i1"]), rnd.random() < 0.5
            model.bucket(f, 2, 9, 3, gutters)
            s = s.push(f).metric_regroup(0, 2, 9, 3, gutters).pop()
        else:
            f, negate = rnd.choice(["i0", "i1"]), rnd.random() < 0.5
            model.keep(f, 3, 8, negate)
            s = s.push(f).metric_filter(0, 3, 8, negate).pop()
    assert [r.grp for r in s.doc_groups().orderBy("_doc").collect()] == model.grp
    for f in fields:
        got = s.push("i1").ftgs(*([[f], []] if f[0] == "i" else [[], [f]]))
        assert {(r.int_term if f[0] == "i" else r.str_term, r.grp): r.s0 for r in got.collect()} == model.ftgs(f, "i1")
