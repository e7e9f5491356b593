import zlib

import numpy as np
import pandas as pd
import pytest

from termweave.llm import langid, queries, toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_language_of_held_out_documents(spark, medium):
    d = pd.read_parquet(f"{medium}/documents.parquet").set_index("doc_id")
    got = queries.op2_language_id(spark, medium).collect()
    assert len(got) == len(d) and all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 for r in got)
    held = [(r.lang_pred, d.lang[r.doc_id]) for r in got if r.held_out and d.lang[r.doc_id]]
    assert np.mean([a == b for a, b in held]) > 0.97 and len(held) > 100


def viterbi_by_hand(s, penalty):
    best = s[0].copy()
    back = []
    for row in s[1:]:
        step = best[:, None] - penalty * (1 - np.eye(len(best)))
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def gain(s, path, penalty):
    return sum(s[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_finds_the_best_path(seed):
    g = np.random.default_rng(seed)
    lengths = g.integers(0, 40, 30)
    scores = -g.random((lengths.sum(), 4)) * 6
    labels, at = langid.viterbi(scores, lengths, 3.0), 0
    for n in lengths:
        if n:
            s = scores[at : at + n]
            assert gain(s, labels[at : at + n].tolist(), 3.0) == pytest.approx(gain(s, viterbi_by_hand(s, 3.0), 3.0))
            one = langid.one_label(s, 3.0)
            if one is not None:
                assert gain(s, [one] * n, 3.0) == pytest.approx(gain(s, viterbi_by_hand(s, 3.0), 3.0))
        at += n


def test_two_other_languages_may_share_a_switch():
    """Language 0 is the best of all that are kept throughout, but half 1 and half 2 is better."""
    s = np.full((12, 3), -1.0)
    s[:, 1], s[:, 2] = [0] * 6 + [-7] * 6, [-7] * 6 + [0] * 6
    assert langid.one_label(s, 9.0) is None
    assert langid.viterbi(s, np.array([12]), 9.0).tolist() == [1] * 6 + [2] * 6
    assert langid.one_label(s, 13.0) == 0 and set(langid.viterbi(s, np.array([12]), 13.0).tolist()) == {0}


@pytest.mark.parametrize("seed", range(40))
def test_a_kept_label_is_the_best_path(seed):
    g = np.random.default_rng(seed)
    sure = 0
    for _ in range(50):
        n, k, penalty = g.integers(1, 25), g.integers(1, 5), g.uniform(0.5, 12)
        s = np.repeat(-g.random((n, k)) * g.choice([1, 7], (n, k)), g.integers(1, 5), 0)
        one = langid.one_label(s, penalty)
        if one is not None:
            sure += 1
            assert gain(s, [one] * len(s), penalty) == pytest.approx(gain(s, viterbi_by_hand(s, penalty), penalty))
    assert sure


def test_words_are_letters_with_their_marks():
    assert langid.words_of("² ½ ① _ 7 Ⅷ") == []
    assert langid.words_of("हिन्दी a²b l'été e\u0301t x_y 𐌰𐌱7𐌲 日本") == ["हिन्दी", "a", "b", "l", "été", "e\u0301t", "x", "y", "𐌰𐌱", "𐌲", "日本"]


def labels_by_hand(texts, model):
    """(language, score) of texts, word by word and with the plain dynamic program."""
    out = []
    for t in texts:
        words = langid.words_of((t or "").lower())
        if not words:
            out.append(("und", 0.0))
            continue
        path = viterbi_by_hand(np.concatenate([model.scores([w]) for w in words]).astype(float), langid.SWITCH_PENALTY)
        weight = np.bincount(path, [len(w) for w in words], len(model.langs))
        out.append((model.langs[int(weight.argmax())], weight.max() / weight.sum()))
    return out


def test_language_of_a_whole_table_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.where(queries.fold(queries.F.col("doc_id")) != 0))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op2_language_id(spark, small).collect()}
    for i, want in zip(texts, labels_by_hand(texts.values(), model)):
        assert got[i] == (want[0], pytest.approx(want[1])), i


def test_a_very_long_text_of_two_languages(spark):
    en, de = "the cat sat on the mat and it was good there ", "der hund lief über die straße und das war nicht gut "
    model = langid.train(spark.createDataFrame([(1, en, "en"), (2, de, "de")], "doc_id long, text string, lang string"))
    r = langid.identify(spark.createDataFrame([(en * 20_000 + de * 5_000,)], "text string"), model, spans=True).first()
    assert r.lang_pred == "en" and 0.7 < r.score < 0.9 and len(r.spans) == 2 and r.spans[0].end_word == 220_000


def test_mixed_texts_and_odd_rows(spark):
    en, ru = "the cat sat on the mat and it was good there ", "это был хороший день и мы шли домой "
    de = "der hund lief über die straße und das war nicht gut "
    rows = [(i, t * 5, l) for i, (t, l) in enumerate([(en, "en"), (ru, "ru"), (de, "de")] * 10)] + [(None, en, None), (99, None, "en"), (100, "", "de"), (101, "12 34 !", "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.train(df)
    assert model.langs == ["de", "en", "ru"]
    test = spark.createDataFrame([(1, en * 3 + ru * 3 + de * 3, 1), (2, None, 2), (3, "", 3), (4, "42 -- 7", 4), (5, de, 5), (5, de, 5), (None, "слово", 6)], "doc_id long, text string, score int")
    out = langid.identify(test, model, spans=True)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "spans"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    mixed = got[1, en * 3 + ru * 3 + de * 3]
    assert [s.lang for s in mixed.spans] == ["en", "ru", "de"] and mixed.spans[0].end_word == 33
    assert [(got[i, t].lang_pred, got[i, t].score) for i, t in ((2, None), (3, ""), (4, "42 -- 7"))] == [("und", 0.0)] * 3
    assert got[5, de].lang_pred == "de" and got[None, "слово"].lang_pred == "ru"
    assert langid.train(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(test, None).collect()} == {"und"}
    assert langid.identify(test.limit(0), model).collect() == []


def test_a_sample_bounds_training(spark, medium):
    d = spark.read.parquet(f"{medium}/documents.parquet")
    assert langid.train(d, rows=200).words.shape == (langid.WORD_SLOTS, 4)


def test_toxicity_of_held_out_documents(spark):
    """Almost all toxic documents that show it: those with a word that toxic training documents share and ordinary ones don't have.

    In this table a little less than half of the documents labelled toxic have no such word.
    """
    sf = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{sf}/labels.parquet").groupby("doc_id").toxic.max()
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    got = queries.op5_toxicity(spark, sf).collect()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 and r.held_out == (fold(r.doc_id) == 0) for r in got)
    assert len(got) == len(docs)
    words = {i: set(t.lower().split()) for i, t in docs.text.items() if i in labels.index and t}
    counts = {y: pd.Series([w for i in words if fold(i) and labels[i] == y for w in words[i]]).value_counts() for y in (0, 1)}
    marks = {w for w, n in counts[1].items() if n >= 30 and counts[0].get(w, 0) == 0}
    held = [(r.predicted, labels[r.doc_id], bool(words.get(r.doc_id, set()) & marks)) for r in got if r.held_out and r.doc_id in labels.index]
    assert np.mean([p for p, y, _ in held if not y]) <= 0.01
    shown = [p for p, y, m in held if y and m]
    assert np.mean(shown) >= 0.9 and len(shown) > 40
    assert np.mean([p for p, y, _ in held if y]) >= 0.6


def test_dictionaries_are_trained_apart():
    g = np.random.default_rng(4)
    word = lambda: "".join(g.choice(list("abcdefgh"), g.integers(3, 8)))
    ordinary = [" ".join(word() for _ in range(60)).encode() for _ in range(200)]
    toxic = [b + b" you utter clown " + b[:40] for b in ordinary[:60]]
    grams = toxicity.seeds(toxic, ordinary[60:])
    assert b"r clown" in {int(x).to_bytes(toxicity.GRAM, "little") for x in grams}
    cut = [toxicity.stretches(b, grams) for b in toxic]
    assert all(b"you utter clown" in c for c in cut) and max(map(len, cut)) < 40
    made = toxicity.dictionary(cut, toxicity.TOXIC_BYTES)
    assert b"clown" in made and b"clown" not in toxicity.dictionary([w for b in ordinary for w in toxicity.windows(b)], 4096)
    assert toxicity.dictionary([], 1024) == b"" and toxicity.dictionary([b"x"], 1024) == b""


def test_toxicity_odd_rows(spark):
    g = np.random.default_rng(2)
    word = lambda: "".join(g.choice(list("abcdefghijklm"), g.integers(3, 8)))
    rows, labels = [], []
    for i in range(120):
        w = [word() for _ in range(80)]
        if i % 3 == 0:
            w[40:40] = ["you", "worthless", "clown", "shut", "up"]
        rows.append((i, " ".join(w), 1.0))
        labels.append((i, int(i % 3 == 0)))
    df = spark.createDataFrame([*rows, (None, None, 1.0), (500, "", 1.0), (500, "", 1.0)], "doc_id long, text string, toxicity double")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = [(r.doc_id, r.toxicity) for r in toxicity.score(df, model).collect()]
    assert len(got) == 123 and toxicity.score(df.limit(0), model).collect() == []
    by = dict(got)
    assert np.mean([by[i] >= 0.5 for i in range(0, 120, 3)]) > 0.9 and np.mean([by[i] >= 0.5 for i in range(120) if i % 3]) < 0.05
    assert by[None] == by[500] < 0.5
    none = toxicity.train(df, lab.limit(0))
    assert {r.toxicity for r in toxicity.score(df, none).collect()} == {0.0}
