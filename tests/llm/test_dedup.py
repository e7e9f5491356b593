import hashlib
from fractions import Fraction

import brute
import numpy as np
import pandas as pd
import pytest

from termweave.llm import decontam, embedding_dedup, line_dedup, near_dedup, queries, substring_dedup

FIELDS = "doc_id long, text string"


def texts_of(sf):
    d = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    return list(zip(d.doc_id, d.text))


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_passages_of_a_whole_table(spark, medium):
    want = brute.passages(texts_of(medium))
    got = queries.op4_substring_dedup(spark, medium).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, g, sha(k)) for i, (n, g, k) in want.items()}
    assert sum(r.n_removed for r in got) > 1000


def test_passages_odd_rows(spark):
    run = [f"w{i}" for i in range(30)]
    rows = [(None, " ".join(run)), (3, None), (4, ""), (5, "  \t "), (6, " ".join(run[5:28])), (7, "x " * 50), (8, " ".join(run[:19])), (9, "a\x0bb\x0cc" + " ".join(run[2:25])), (9, "other text"), (10, " ".join(run[3:]) + "\n" + " ".join(run)), (10, " ".join(run[3:]) + "\n" + " ".join(run))]
    df = spark.createDataFrame([(*r, "n") for r in rows], FIELDS + ", n_words string")
    got = {(r.doc_id, r.text): (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_passages(df).collect()}
    want = brute.passages([((i, t), t) for i, t in dict.fromkeys(rows)])
    assert got == want
    assert substring_dedup.dedup_passages(df.limit(0)).collect() == []


def test_automata_find_what_was_not_told(spark, medium, monkeypatch):
    """A block tells one place for each phrase; all other places come from the automata, by shards of a few phrases too."""
    want = {r.doc_id: r.n_removed for r in queries.op4_substring_dedup(spark, medium).collect()}
    rows = pd.read_parquet(f"{medium}/documents.parquet").sort_values("doc_id")
    import pyarrow as pa

    t = substring_dedup.Texts(pa.array(rows.text[:64], pa.string()), 2)
    at, p = substring_dedup.chosen(t, 20, 10)
    known = np.sort(at[np.unique(p, return_index=True)[1]])
    runs, whole = substring_dedup.words.runs(t.h[0], 10), t.whole(10)
    every = np.flatnonzero(np.isin(runs, p) & whole)
    monkeypatch.setattr(substring_dedup, "SHARD", 100)
    found = substring_dedup.located(t, known, 10)
    assert found.tolist() == every.tolist() and len(found) > len(known)
    monkeypatch.setattr(substring_dedup, "SHARD", 1 << 15)

    df = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(substring_dedup, "around", lambda places, n, window, phrase: np.zeros(n, bool))
    none = substring_dedup.hints(*hints_of(df))
    assert none.count() == 0
    monkeypatch.undo()
    assert substring_dedup.hints(*hints_of(df)).count() > 0 and sum(want.values()) > 1000


def hints_of(df):
    docs, m = line_dedup.numbered(df, "doc_id", "text", queries.F.octet_length("text") / 2 + 2)
    prints = substring_dedup.fingerprints(docs, m, 20, 10)
    return docs, prints.where("again").select("block", "place"), m, 20, 10


def test_passages_over_blocks_and_long_texts(spark, monkeypatch):
    """Blocks of two documents and of one long text; a passage stands often in one, and in others."""
    monkeypatch.setattr(substring_dedup, "BLOCK_DOCS", 2)
    monkeypatch.setattr(substring_dedup, "LARGE", 20_000)
    g = np.random.default_rng(5)
    passage = [" ".join(f"p{k}w{i}" for i in range(45)) for k in range(4)]
    noise = lambda n: " ".join(f"n{x}" for x in g.integers(0, 400, n))
    rows = [(i, " ".join(x for k in g.integers(0, 4, 3) for x in (noise(g.integers(0, 60)), passage[k]))) for i in range(40)]
    rows[7] = (7, noise(9000) + " " + passage[0] + " " + noise(200) + " " + passage[0])
    rows[20] = (20, rows[7][1])
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_passages(df).collect()}
    assert got == brute.passages(rows)


def test_lines_of_a_whole_table(spark, small):
    want = brute.lines(texts_of(small))
    got = queries.op8_line_dedup(spark, small).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in got} == {i: (n, g, sha(k)) for i, (n, g, k) in want.items()}
    assert sum(r.n_removed for r in got) > 50


def near_lines(seed, n):
    g = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(40)]
    out = []
    for i in range(n):
        w = list(base)
        for k in g.choice(40, g.integers(0, 9), replace=False):
            w[k] = f"n{g.integers(0, 60)}"
        out.append((i, " ".join(w) + "\nthe of\nof the the\n\n" + " ".join(g.choice(base, g.integers(1, 8)))))
    return out


@pytest.mark.parametrize("seed,small", [(1, 64), (2, 4), (4, 1)])
def test_lines_of_near_copies(spark, monkeypatch, seed, small):
    """Many lines around the threshold, so that pairing with the earliest or the central ones alone isn't enough."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rows = near_lines(seed, 120)
    want = brute.lines(rows)
    df = spark.createDataFrame(rows, FIELDS)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == want


def test_lines_of_few_words(spark):
    """Short lines of a small vocabulary: every key leads somewhere else."""
    g = np.random.default_rng(6)
    rows = [(i, "\n".join(" ".join(f"v{k}" for k in g.choice(12, g.integers(1, 11), replace=False)) for _ in range(6))) for i in range(60)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == brute.lines(rows)


@pytest.mark.parametrize("words", [30, 3000])
def test_lines_with_runs_of_two_three_and_four(spark, monkeypatch, words):
    """Words of very different frequencies; few words, so that long runs are needed, and lines that differ from others in a few."""
    g = np.random.default_rng(words)
    monkeypatch.setattr(line_dedup, "NEAR_BITS", 1.0)
    share = 1 / np.arange(1, words + 1)
    line = lambda n: g.choice(words, n, replace=False, p=share / share.sum()).tolist()
    rows, known = [], []
    for i in range(150):
        lines = []
        for _ in range(4):
            w = line(g.integers(1, 28))
            if known and g.random() < 0.6:
                w = list(known[g.integers(0, len(known))])
                for k in g.choice(len(w), min(len(w), g.integers(0, 1 + len(w) // 4)), replace=False):
                    w[k] = int(g.integers(0, words))
                w = w[g.integers(0, 2) :] + [int(x) for x in g.integers(0, words, g.integers(0, 3))]
            known.append(w)
            lines.append(" ".join(f"v{x}" for x in w))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == brute.lines(rows)


@pytest.mark.parametrize("threshold", ["0.6", "0.7", "0.75", "0.9"])
def test_lines_at_other_thresholds(spark, threshold):
    rows = near_lines(9, 60)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, FIELDS), threshold=float(threshold)).collect()}
    assert got == brute.lines(rows, Fraction(threshold))


def test_lines_of_a_very_long_text(spark):
    rows = [(1, "\n".join(f"a{i} b{i % 977} c{i % 31} d e f" for i in range(20_000))), (2, "x " * 100_000 + "\n" + "a5 b5 c5 d e f")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got[1].n_removed == 0 and got[2].text == rows[1][1].split("\n")[0] and got[2].n_removed == 1


def test_lines_hot_tokens_are_salted(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 0)
    rows = near_lines(3, 80)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == brute.lines(rows)


def test_lines_are_cut_into_words_once(spark):
    """A filter on the tokens, or the one that Spark adds to an inner explode, made them twice for the keys."""
    df = spark.createDataFrame([(1, "a b c d e f\n\n g"), (2, None)], FIELDS)
    docs, m = line_dedup.numbered(df, "doc_id", "text", queries.F.octet_length("text") + 2)
    r = line_dedup.rarity(docs)
    keys = line_dedup.keys_of(line_dedup.token_lines(docs, m, r.table), r, Fraction(4, 5))
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1
    assert {x.lid % m for x in keys.select("lid").distinct().collect()} == {0, 2}


def test_lines_fetched_once_and_rarity_of_a_sample(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "ALL_OF", 5)
    monkeypatch.setattr(line_dedup, "SMALL", 8)
    made, word_sets = [], line_dedup.word_sets
    monkeypatch.setattr(line_dedup, "word_sets", lambda *a: made.append(1) or word_sets(*a))
    rows = near_lines(5, 80)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == brute.lines(rows) and len(made) == 1


def test_lines_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, "\n \n\t\n"), (1 << 62, "a b c d e f\nq"), (-(1 << 62), "x y\ny  x\nz"), (5, "A b c d e"), (5, "y x\nnew"), (5, "y x\nnew")]
    df = spark.createDataFrame([(*r, 1) for r in rows], FIELDS + ", n_lines int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.text, r.n_removed) for r in got.collect() if r.text is not None)
    least = -(1 << 63)
    assert got == sorted([(least, "a b c d e f", 0), (2, "", 0), (3, "\n \n\t\n", 0), (1 << 62, "q", 1), (-(1 << 62), "x y\nz", 1), (5, "A b c d e", 0), (5, "new", 1), (5, "new", 1)])
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_near_duplicates_of_a_whole_table(spark, small):
    want, links = brute.near_classes(texts_of(small))
    got = queries.op9_near_dedup(spark, small).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got) and links > 5


def test_frequent_shingles_weigh_less(spark):
    """A passage that all documents share counts less than what they don't share."""
    same = " ".join(f"s{i}" for i in range(40))
    rows = [(i, same + " " + " ".join(f"d{i}w{k}" for k in range(8))) for i in range(30)] + [(100 + i, f"{same} tail of {i}") for i in range(6)]
    want, links = brute.near_classes(rows)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, FIELDS)).collect()} == want and links
    idf = near_dedup.frequencies(spark.createDataFrame([(t, 1) for _, t in rows], "text string, copies long"))
    h = near_dedup.shingles(same)
    assert set(idf.levels(h).tolist()) == {round(np.log2((36 * 36 + 30 * 8 + 6 * 3) / 36))} and set(idf.levels(near_dedup.shingles("never seen in any document")).tolist()) == {16}


def test_near_duplicates_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 9973}x{i % 31}" for i in range(60_000))
    rows = [(1, long), (2, long + " and a few more words"), (3, "short " * 9), (4, long[: len(long) // 2])]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("most", [4, 9, 12])
def test_near_duplicates_of_a_large_group(spark, most):
    """Near copies on both sides of the threshold: no link between classes may be lost."""
    g = np.random.default_rng(most)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in g.choice(300, g.integers(0, most), replace=False):
            w[k] = f"n{i}x{k}"
        rows.append((i + 10, " ".join(w)))
    rows += [(500 + i, " ".join(f"c{i}w{k}" for k in range(60))) for i in range(50)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == brute.near_classes(rows)[0]


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (7, "other words here"), (1, None), (2, ""), (3, " \n"), (4, ""), (9, "One two"), (8, "one two"), (None, "alone it is"), (12, "same"), (12, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], FIELDS + ", root int")
    got = [(r.doc_id, r.text, r.class_id, r.kept) for r in near_dedup.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    by = {}
    for i, t, c, k in got:
        by.setdefault((i, t), set()).add((c, k))
    assert by[None, "a b c d e f g"] == {(7, False)} and by[7, "a b c d e f g"] == {(7, True)} and by[7, "other words here"] == {(7, True)}
    assert by[1, None] == {(1, True)} and by[2, ""] == {(2, True)} and by[4, ""] == {(4, True)}
    assert by[9, "One two"] == {(8, False)} and by[8, "one two"] == {(8, True)} and by[None, "alone it is"] == {(None, True)}
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_items_of_a_whole_table(spark, medium):
    items = pd.read_parquet(f"{medium}/benchmark.parquet")
    want = brute.containment(texts_of(medium), list(zip(items.item_id, items.text)))
    got = queries.op3_decontamination(spark, medium).collect()
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got} == want and want


def test_items_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 2)
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"z{i}" for i in range(30000))
    docs = [(1, long + " " + item + " " + long), (2, None), (3, ""), (None, item.upper()), (4, " ".join(item.split()[:27]) + " and so on"), (5, " ".join(item.split()[:20])), (6, "short one"), (1, "tiny five word item here")]
    items = [(1, item), (2, None), (3, ""), (4, "short one"), (5, item), (None, "Tiny five word item HERE")]
    df = spark.createDataFrame([(*d, 1) for d in docs], FIELDS + ", item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0) for r in decontam.find_items(df, it).collect()))
    assert got == sorted([(1, 1), (1, 5), (0, 1), (0, 5), (4, 1), (4, 5), (1, 0)])
    assert sorted(r.doc_id for r in decontam.clean(df, it).collect()) == [2, 3, 5, 6]
    assert decontam.find_items(df, it.limit(0)).collect() == [] and decontam.clean(df, it.limit(0)).count() == len(docs)
    assert decontam.find_items(df.limit(0), it).collect() == []


def test_items_in_blocks_and_unsearched(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 1)
    words = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcd"]
    df = spark.createDataFrame([(i, f"x {w} y") for i, w in enumerate(words)], FIELDS)
    items = spark.createDataFrame([(1, words[0]), (2, words[2]), (3, "too short an item"), (4, None), (5, " "), (6, words[0])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_items(df, items).collect()) == [(0, 1), (0, 6), (2, 2)]
    assert sorted(r.doc_id for r in decontam.clean(df, items).collect()) == [1, 3]
    assert [r.item_id for r in decontam.unsearched(items).collect()] == [3]


def cosine_links(v, labels, t=0.93):
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (x @ x.T >= t) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("bucket,chunk", [(256, 1024), (8, 32)])
def test_vectors_against_all_pairs(spark, monkeypatch, bucket, chunk):
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "MISS", 1e-6)
    g = np.random.default_rng(1)
    base = g.normal(size=(60, 64))
    v = np.concatenate([base[g.integers(0, 60, 500)] + g.normal(size=(500, 64)) * g.choice([0, 0.2, 0.26, 0.3], (500, 1)), np.tile(base[:1], (90, 1))]).astype(np.float32)
    labels = g.integers(0, 2, len(v))
    s = cosine_links(v.astype(float), labels)
    df = spark.createDataFrame([(i, x.tolist(), int(l)) for i, (x, l) in enumerate(zip(v, labels))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    root = brute.connected(range(len(v)), zip(*np.nonzero(s)))
    assert got == {i: (int(s[i].sum()), root[i], root[i] == i) for i in range(len(v))}


def test_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 4)
    monkeypatch.setattr(embedding_dedup, "MISS", 1e-6)
    g = np.random.default_rng(8)
    base = g.normal(size=(10, 1536))
    v = base[g.integers(0, 10, 60)] + g.normal(size=(60, 1536)) * g.choice([0.1, 0.25, 0.3], (60, 1))
    s = cosine_links(v, np.zeros(60))
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    root = brute.connected(range(60), zip(*np.nonzero(s)))
    assert got == {i: (int(s[i].sum()), root[i]) for i in range(60)} and s.any()


def test_vectors_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    a = [1.0, 0.0, 2.0]
    rows = [(5, a, 1), (3, [2.0, 0.0, 4.0], 1), (3, [2.0, -0.0, 4.0], 1), (9, a, 2), (8, a, None), (1, None, 1), (2, [], 1), (4, [0.0, 0.0, 0.0], 1), (6, [1.0, nan, 2.0], 1), (7, [1.0, inf, 2.0], 1), (10, [1.0, None, 2.0], 1), (11, [1.0, 0.0], 1), (None, a, 1), (12, [1e300, 0.0, 2e300], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect())
    alone = lambda i: (i, 0, i, True)
    assert got == sorted([(5, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (0, 4, 3, False), (12, 4, 3, False), *map(alone, (9, 8, 1, 2, 4, 6, 7, 10, 11))])
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []
