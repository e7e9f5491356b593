"""Operator 4: removal of repeated passages with automata of recurring phrases.

A window is `window` consecutive words (runs of characters other than space, tab to carriage return) of one document.
Each word that a window covers whose word sequence also starts earlier, in a document with a smaller doc_id or earlier
in the same one, is removed; windows are judged on the input, not on what is left.

* Fingerprints: of the phrases of PHRASE words in each window the one with the smallest hash is chosen, so equal windows
  choose equal phrases, and few are chosen twice. Documents are dealt to blocks of BLOCK_DOCS numbers (a text of more than
  LARGE bytes is a block of its own), and a block tells each phrase chosen in it once, with one place where it stands.
  Phrases told by two blocks, or chosen twice in one, are confirmed as recurring.
* Automata: each block compiles the recurring phrases told by it into Aho-Corasick automata of SHARD phrases at most, over
  words as symbols of 20 bits, and all its documents are streamed through each of them. That locates every occurrence,
  verified by 64 bits of hash; where else than at the one place it told a phrase stands, no one knows before.
* Windows around an occurrence are compared by 128 bits of hash: of each group only the place of the first comes back
  to its document. All other windows around an occurrence are repeats; the words they cover go.

Order: doc_id ascending, null first; rows with one doc_id in the order of a hash of their text; rows that repeat both are
one document and give the same result. A null text has no words. Documents shorter than a window lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .bpe import slices
from .common import drop, scratch
from .line_dedup import numbered

WINDOW, PHRASE = 20, 10
BLOCK_DOCS, LARGE = 64, 256 << 10
SHARD = 1 << 15
SLICE = 64
FIRST, RANGE = 0, 1


class Texts:
    """Texts of a batch laid end to end: their words' places, hashes and text numbers."""

    def __init__(self, column: pa.Array, k: int = 1):
        self.data, self.begin = words.column_bytes(column)
        self.starts, self.ends = words.find(self.data, self.begin[:-1])
        self.h = words.hashes(self.data, self.starts, self.ends, k)
        self.first = np.searchsorted(self.starts, self.begin)  # each text's first word, and the number of all words
        self.sizes = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def whole(self, n: int) -> np.ndarray:
        """Whether the run of ``n`` words from each word on stays in one text."""
        size = max(0, len(self.text) - n + 1)
        return self.text[:size] == self.text[n - 1 : n - 1 + size]


def chosen(t: Texts, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases with the smallest hash of each window (the first of equal ones), once each: their places and hashes."""
    p, span = words.runs(t.h[0], phrase), window - phrase + 1
    n = len(p) - span + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best = np.arange(n) + np.lib.stride_tricks.sliding_window_view(p, span).argmin(1)
    best = best[t.whole(window)]
    best = best[np.diff(best, prepend=-1) != 0]  # it never moves back
    return best, p[best]


def block_of() -> Column:
    return F.when(F.octet_length("_text") > LARGE, -F.col("_doc") - 1).otherwise(F.expr(f"_doc div {BLOCK_DOCS}"))


def by_block(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other and are of one block (the first column)."""
    block = b.column(0).to_numpy()
    cuts = np.flatnonzero(np.diff(block)) + 1
    if len(cuts) > 2 * len(np.unique(block)):  # not in the order of documents
        order = np.argsort(block, kind="stable")
        b, block = b.take(pa.array(order)), block[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
    for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
        if i < j:
            yield b.slice(i, j - i)


def fingerprints(docs: DataFrame, m: int, window: int, phrase: int) -> DataFrame:
    """(phrase, block, place, again): the chosen phrases of each block, each with one place, which is doc * m + the number of
    its first word, and whether it was chosen more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_block(whole):
                t = Texts(b.column(2))
                at, p = chosen(t, window, phrase)
                order = np.argsort(p, kind="stable")
                at, p = at[order], p[order]
                new = np.diff(p, prepend=~p[:1]) != 0
                again = np.diff(np.flatnonzero(new), append=len(p)) > 1
                at, p = at[new], p[new]
                text = t.text[at]
                place = b.column(1).to_numpy()[text] * m + at - t.first[text]
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(b.column(0).to_numpy()[text]), pa.array(place), pa.array(again)], names=["phrase", "block", "place", "again"])

    return docs.select(block_of(), "_doc", "_text").mapInArrow(run, "phrase long, block long, place long, again boolean")


def located(t: Texts, known: np.ndarray, phrase: int) -> np.ndarray:
    """Where in a block's words one of the phrases occurs that stand at the ``known`` places, by automata of SHARD phrases."""
    body = ((t.h[0] >> np.uint64(44)).astype("<u4") + np.uint32(0x10000)).tobytes().decode("utf-32-le")
    p, whole = words.runs(t.h[0], phrase), t.whole(phrase)
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(known), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in known[i : i + SHARD].tolist():
            automaton.add_word(body[k : k + phrase], k)
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(body)), np.int64).reshape(-1, 2)
        at = hits[:, 0] - phrase + 1
        found.append(at[whole[at] & (p[at] == p[hits[:, 1]])])  # a symbol may stand for two words
    return np.unique(np.concatenate(found))


def around(places: np.ndarray, n: int, window: int, phrase: int) -> np.ndarray:
    """Whether each of the ``n`` windows holds a phrase at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(places - (window - phrase), 0, n), 1)
    np.add.at(edge, np.clip(places + 1, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block as one batch; they follow each other, but may lie in several batches."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(i) for h in held]) for i in range(held[0].num_columns)], names=held[0].schema.names)

    for batch in batches:
        for b in by_block(batch):
            if held and held[0].column(0)[0] != b.column(0)[0]:
                yield joined()
                held = []
            held.append(b)
    if held:
        yield joined()


def hints(docs: DataFrame, recurring: DataFrame, m: int, window: int, phrase: int) -> DataFrame:
    """(doc, first, ranges): the windows around occurrences, as starts and ends, and those of them that no earlier one equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_blocks(batches):
            place = b.column(2).to_numpy()
            n = int((b.column(1).to_numpy() == 0).sum())  # places first, then documents
            known, doc = place[:n], place[n:]
            if not n or not len(doc):
                continue
            t = Texts(b.column(3).slice(n), 2)
            at = located(t, t.first[np.searchsorted(doc, known // m)] + known % m, phrase)
            some = np.zeros(len(t.text), bool)
            for i in np.unique(t.text[at]):
                size = t.sizes[i] - window + 1
                own = at[(at >= t.first[i]) & (at < t.first[i + 1])] - t.first[i]
                if size > 0:
                    some[t.first[i] : t.first[i] + size] = around(own, size, window, phrase)
            at = np.flatnonzero(some)
            text = t.text[at]
            whole = doc[text] * m + at - t.first[text]
            h = np.stack([words.runs(t.h[q], window, q)[at] for q in (0, 1)]).view(np.int64)
            # within a block only the first of equal windows has to be told
            order = np.lexsort((whole, h[1], h[0]))
            h, first = h[:, order], whole[order]
            new = np.ones(len(first), bool)
            new[1:] = (h[:, 1:] != h[:, :-1]).any(0)
            yield told(FIRST, h[0, new], h[1, new], first[new])
            # no window of a document follows the last one of the document before, so a gap in the places ends a range
            cut = np.flatnonzero(np.diff(whole, prepend=-2) != 1)
            start, end = whole[cut], whole[np.append(cut[1:], len(whole)) - 1] + 1 if len(cut) else whole[:0]
            yield told(RANGE, start // m, start % m, end - start + start % m)

    def told(kind: int, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(at)], names=["kind", "a", "b", "at"])

    texts = docs.select(block_of().alias("block"), F.lit(1).alias("kind"), F.col("_doc").alias("place"), F.col("_text").alias("text"))
    rows = recurring.select("block", F.lit(0).alias("kind"), "place", F.lit(None).cast("string").alias("text")).union(texts)
    rows = rows.repartition(F.col("block")).sortWithinPartitions("block", "kind", "place")
    found = rows.mapInArrow(run, "kind int, a long, b long, at long").groupBy("kind", "a", "b").agg(F.min("at").alias("at"))
    is_first = F.col("kind") == FIRST
    doc = F.when(is_first, F.expr(f"at div {m}")).otherwise(F.col("a"))
    return found.groupBy(doc.alias("doc")).agg(F.collect_list(F.when(is_first, (F.col("at") % m).cast("int"))).alias("first"), F.collect_list(F.when(~is_first, F.col("b").cast("int"))).alias("starts"), F.collect_list(F.when(~is_first, F.col("at").cast("int"))).alias("ends"))


def lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column; a null is empty."""
    return [np.array(x if x is not None else [], np.int64) for x in column.to_pylist()]


def without(t: Texts, gone: np.ndarray) -> pa.Array:
    """The texts' words that aren't gone, joined by one space."""
    data, keep = t.data.copy(), np.zeros(len(t.data) + 1, np.int32)
    a, b = t.starts[~gone], t.ends[~gone]
    text = t.text[~gone]
    more = np.append(text[1:] == text[:-1], False)[: len(text)]  # a word follows, so white space does
    np.add.at(keep, a, 1)
    np.add.at(keep, b + more, -1)
    data[b[more]] = 32
    held = np.cumsum(keep[:-1]) > 0
    lengths = np.concatenate([[0], np.cumsum(held)])[t.begin]
    body = data[held].tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(t.sizes), [None, pa.py_buffer(lengths.astype(np.int64).tobytes()), pa.py_buffer(body)]).cast(pa.string())


def dedup_passages(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, out: str = "kept_text", columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``df`` (all), n_words, n_removed and the kept words joined by a space, which replace such columns."""
    phrase = max(1, min(PHRASE, window // 2))
    docs, m = numbered(df, key, text, F.octet_length(text) / 2 + 2)
    prints = fingerprints(docs, m, window, phrase)
    own = Window.partitionBy("phrase")
    recurring = prints.select("block", "place", (F.max("again").over(own) | (F.count("*").over(own) > 1)).alias("more")).where("more").select("block", "place")
    recurring = scratch(recurring, "recurring")
    found = scratch(hints(docs, recurring, m, window, phrase), "window-hints")
    drop(recurring)

    names = ["n_words", "n_removed", out]
    rest = [c for c in columns or df.columns if c not in names]
    rows = docs.select(F.col("_doc").alias("doc"), F.struct(*(F.col("_row")[c].alias(c) for c in rest)).alias("row"), F.col("_text").alias("text")).join(found, "doc", "left").select("row", "text", "first", "starts", "ends")
    schema = T.StructType([rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("gone", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            t = Texts(b.column(1))
            change = np.zeros(len(t.text) + 1, np.int64)
            for i, (first, starts, ends) in enumerate(zip(*(lists(b.column(k)) for k in (2, 3, 4)))):
                if len(starts):
                    edge = np.zeros(t.sizes[i] + 1, np.int64)
                    edge[starts] += 1
                    edge[ends] -= 1
                    again = np.cumsum(edge) > 0
                    again[first] = False
                    s = t.first[i] + np.flatnonzero(again)
                    np.add.at(change, s, 1)
                    np.add.at(change, s + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.bincount(t.text[gone], minlength=len(t.sizes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.sizes), pa.array(removed.astype(np.int64)), without(t, gone)], names=["row", "n", "gone", "kept"])

    got = rows.mapInArrow(run, schema)
    return got.select(*(F.col("row")[c].alias(c) for c in rest), F.col("n").alias(names[0]), F.col("gone").alias(names[1]), F.col("kept").alias(out))
