import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termweave.llm import bpe, queries, shards, token_files
from termweave.llm.common import TOKENIZER, new_path


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", " ", "\n\n", "a" * 5000, " \t\r\n x", "it's we'll I'M", "x  y z　 ", "日本語 テキスト\n中文", "🙂 🙃️", "<|endoftext|>a <|endoftext|> ", "a  b   c", "\u0085  line", "9 99 999,9", "é é", "\x00\x01 \x7f", "trailing  "]


def ids_of(plain, text):
    return plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ranked", [True, False])
@pytest.mark.parametrize("chunk", [3, 1 << 15])
def test_encoder_on_odd_texts(plain, monkeypatch, ranked, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "FRAGMENT", chunk % 1000)
    e = bpe.Encoder(bpe.resolve(TOKENIZER))
    if not ranked:
        e.ranked = None
    for t in ODD + [" ".join(ODD * 3)]:
        ids = np.frombuffer(e.encode(t), "<u4").tolist()
        assert e.encode(t, long=True) == e.encode(t), repr(t)
        assert ids == ids_of(plain, t), repr(t)
        assert e.decode(e.encode(t)) == plain.decode(ids, skip_special_tokens=False) == t


def test_every_text_is_cut_into_fragments(plain, monkeypatch):
    e = bpe.Encoder(bpe.resolve(TOKENIZER))
    asked = []
    e.known.encode = lambda f: asked.append(f) or e._ids(f)
    text = "Of the cat, the dog\n and the cat."
    e.encode(text)
    assert asked == ["Of", " the", " cat,", " dog", "\n and", " cat."]
    pairs = bpe.inner_pairs([t for i, t in enumerate(e.bytes_of) if i not in {0, 1, 2}])
    for a, b in zip(e.frag(text), e.frag(text)[1:]):
        assert not pairs[a.encode()[-1], b.encode()[0]]


def test_ranks_must_explain_every_token(plain):
    import json

    spec = json.loads(plain.to_str())
    made = bpe.Encoder(bpe.resolve(TOKENIZER))
    added = {t["id"] for t in spec["added_tokens"]}
    assert bpe.ranked_encoder(spec, made.bytes_of, added)
    spec["model"]["vocab"]["qqqqzzzz"] = len(made.bytes_of)
    assert bpe.ranked_encoder(spec, [*made.bytes_of, b"qqqqzzzz"], added) is None


def test_a_text_beyond_one_batch(spark, plain):
    """A very long text, a null id and repeated rows."""
    long = "Some wörds of it, again\n" * 60_000
    rows = [(None, long), (3, "x y"), (3, "x y"), (4, None)]
    want = {i: (ids_of(plain, t or "")) for i, t in rows}
    got = bpe.digests(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")).collect()
    assert len(got) == 4 and all(r.n_tokens == len(want[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest() for r in got)
    path = new_path(spark, "long")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, partitions=2)
    assert [(r.doc_id, r.n_tokens) for r in token_files.read_digests(spark, path).orderBy("start").collect()] == [(i, len(want[i]) + 1) for i in (None, 3, 3, 4)]


def test_many_texts_of_one_key_make_several_files(spark, plain):
    rows = [(None, f"text number {i}") for i in range(400)] + [(1, "one")]
    path = new_path(spark, "hot")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, partitions=8)
    parts = token_files.read_tokens(spark, path, ["part", "doc_id"]).where("doc_id is null").groupBy("part").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 150
    got = token_files.read_digests(spark, path).orderBy("start").collect()
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[-1].doc_id == 1


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab Z9é  \n\t'sß中🙂.,- "), max_size=60))
def test_encoder_on_any_text(text):
    e = bpe.encoder(TOKENIZER)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tok.encode(text, add_special_tokens=False).ids


def test_digests_of_a_whole_table(spark, medium, plain):
    d = pd.read_parquet(f"{medium}/documents.parquet")
    want = {}
    for i, t in zip(d.doc_id, d.text):
        ids = ids_of(plain, t or "")
        want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, medium).collect()} == want


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "one two", 7), (None, None, 8), (1, "one two", None)], "doc_id long, text string, token_ids int")
    out = bpe.decode(bpe.encode(df)).collect()
    assert [r.decoded for r in out] == ["one two", "", "one two"] and [len(r.token_ids) for r in out] == [2, 0, 2]
    assert bpe.encode(df.limit(0)).collect() == [] and bpe.digests(df.limit(0)).collect() == []
    nothing = bpe.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).first()
    assert nothing.decoded is None


def files_by_hand(rows, plain):
    out, start = [], 0
    for i, t in rows:
        ids = [*ids_of(plain, t or ""), 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_a_whole_table(spark, medium, plain):
    d = pd.read_parquet(f"{medium}/documents.parquet").sort_values("doc_id")
    got = queries.op10_token_files(spark, medium).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == files_by_hand(zip(d.doc_id, d.text), plain)


def test_token_files_odd_rows(spark, plain):
    rows = [(None, "null first"), (3, None), (3, "x"), (5, ""), (-7, "low"), (3, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(df, path, partitions=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(spark, path).collect())
    tie = lambda t: 42 if t is None else int.from_bytes(xxhash.xxh64(t, seed=42).digest(), "big", signed=True)
    order = [(None, "null first"), (-7, "low"), *sorted([(3, None), (3, "x"), (3, "x")], key=lambda r: tie(r[1])), (5, "")]
    assert [(i, s, n, c) for s, i, n, c in got] == files_by_hand(order, plain)
    some = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"], (3, 5))
    assert sorted(r.doc_id for r in some.collect()) == [3, 3, 3, 5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,3)" in plan
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(df.limit(0), empty)
    assert token_files.read_digests(spark, empty).collect() == []


def test_token_files_are_encoded_as_told(spark, medium, tmp_path):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/t"
    token_files.write_tokens(spark.read.parquet(f"{medium}/documents.parquet"), path, partitions=1)
    f = pq.ParquetFile(next((tmp_path / "t").glob("part-*")))
    column = {f.metadata.row_group(0).column(i).path_in_schema: f.metadata.row_group(0).column(i) for i in range(f.metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and "DELTA_BINARY_PACKED" in column["local_start"].encodings
    ids = next(v for k, v in column.items() if k.startswith("token_ids"))
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index and ids.has_column_index


def shards_by_hand(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, out, slots = sum(r[1] for r in rows), 0, [], {}
    for i, size, crc in rows:
        s = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((i, size, crc, s, slots.setdefault(s, 0)))
        slots[s] += 1
        before += size
    return out


def test_shards_of_a_whole_table(spark, medium):
    d = pd.read_parquet(f"{medium}/documents.parquet")
    rows = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(d.doc_id.tolist(), d.text)]
    got = queries.op7_sharding(spark, medium).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == sorted(shards_by_hand(rows, 16))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    sums = pd.Series([r["size"] for r in got]).groupby([r.shard for r in got]).sum()
    assert len(sums) == 16 and sums.max() - sums.min() <= 2 * max(r[1] for r in rows)


def test_shards_odd_rows(spark):
    rows = [(None, None), (4, ""), (4, "x" * 90), (2, "é"), (2, "é"), (9, "y" * 40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    sized = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in shards.balanced_shards(df, 3).collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=str) == sorted(shards_by_hand(sized, 3), key=str) and sorted(got, key=lambda r: str(key(r)))
    assert shards.balanced_shards(df.limit(0), 3).collect() == []
