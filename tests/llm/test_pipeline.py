import hashlib

import brute
import numpy as np
import pytest
from test_models import labels_by_hand
from tokenizers import Tokenizer

import corpus_pipeline as P
from termweave.llm import bpe, common, decontam, langid, line_dedup, near_dedup



@pytest.fixture(scope="module")
def stages(spark, medium):
    docs, out = spark.read.parquet(f"{medium}/documents.parquet"), []
    for name, f in P.STAGES:
        docs = common.scratch(f(spark, docs, medium), "stage")
        out.append(docs)
    return out


def test_each_stage_does_its_operators_work(spark, medium, stages):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    for s in stages[:-1]:
        assert s.columns == docs.columns
    model = langid.train(docs)
    lang = {r.doc_id for r in langid.identify(docs, model).collect() if not (r.lang_pred == "und" or r.score < 0.3)}
    assert {r.doc_id for r in stages[0].collect()} == lang
    lines = {r.doc_id: r.text for r in line_dedup.dedup_lines(stages[0].select("doc_id", "text")).collect() if r.n_removed == 0 or r.text.strip()}
    assert {r.doc_id: r.text for r in stages[1].collect()} == lines and all(r.n_chars == len(r.text) for r in stages[1].collect())
    kept = {r.doc_id for r in near_dedup.near_duplicates(stages[1].select("doc_id", "text")).collect() if r.kept}
    assert {r.doc_id for r in stages[2].collect()} == kept <= lines.keys()
    bad = {r.doc_id for r in decontam.find_items(stages[2], spark.read.parquet(f"{medium}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in stages[3].collect()} == kept - bad and bad
    want = {r.doc_id: len(bpe.encoder(common.TOKENIZER).encode(r.text)) // 4 for r in stages[3].collect()}
    assert {r.doc_id: r.n_tokens for r in stages[4].collect()} == want
    assert {r.doc_id: r.n_tokens for r in P.run(spark, medium).collect()} == want


def test_the_whole_by_hand(spark, small):
    """Every stage done by brute force: words labelled one by one, all pairs of lines and of documents, all items in all documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    model = langid.train(spark.read.parquet(f"{small}/documents.parquet"))
    rows = [(r.doc_id, r.text) for r, (lang, score) in zip(docs, labels_by_hand([r.text for r in docs], model)) if lang != "und" and score >= 0.3]
    lines = brute.lines(rows)
    rows = [(i, lines[i][2]) for i, _ in rows if lines[i][1] == 0 or lines[i][2].strip(" \t\n\x0b\x0c\r")]
    classes, _ = brute.near_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    bad = {d for d, _ in brute.containment(rows, [(r.item_id, r.text) for r in items])}
    tok = Tokenizer.from_file(bpe.resolve(common.TOKENIZER))
    tok.no_truncation()
    tok.no_padding()
    want = {}
    for i, t in rows:
        if i not in bad:
            ids = tok.encode(t, add_special_tokens=False).ids
            want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, small).collect()} == want
    assert 0 < len(want) < len(docs)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "der die das und nicht", "de", None, 5, 3), (2, "der die das und nicht", "de", None, 5, 3), (3, "the cat is on the mat", "en", "s", 21, 4), (4, "the cat is on the mat\nmore of it here", "en", "s", 21, 4), (None, "the dog is in the house", None, "s", 21, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "the dog is in the house")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    seen = []
    for name, f in P.STAGES[:-1]:
        now = common.scratch(f(spark, now, str(tmp_path)), "odd")
        assert now.columns == docs.columns
        seen.append(sorted((str(r.doc_id), r.text) for r in now.collect()))
    assert seen[0] == [("2", "der die das und nicht")] * 2 + [("3", "the cat is on the mat"), ("4", "the cat is on the mat\nmore of it here"), ("None", "the dog is in the house")]
    assert ("4", "more of it here") in seen[1] and len(seen[1]) == 5
    assert ("None", "the dog is in the house") not in seen[3]
    for name, f in P.STAGES:
        assert f(spark, docs.limit(0), str(tmp_path)).collect() == []
