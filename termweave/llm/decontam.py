"""Operator 3: benchmark items inside documents, by MinHash containment search in windows.

An item is in a document if at least the threshold of its distinct shingles of five lower-cased words are among the
document's. Items of fewer than five words have no shingle and are never found; `unsearched` names them.

A long document shares so little of its shingles with a short item that their MinHashes wouldn't meet. So items are
partitioned by size, classes of a factor of two, and for each class a document is cut into windows of two blocks, each
as long as the class's largest item and each block in two windows: an item that stands in one piece lies whole in a
window at most four times its size. Of each window and item HASHES minima are taken; block minima of a class are minima
of two blocks of the class below. A pair that shares a minimum is a candidate (an item that stands complete in one piece
is missed with a probability below 1e-7, one that stands there at the threshold below 1e-5), and candidates are verified
exactly on the shingles of the whole document.

Documents are read once for each ITEMS items, which with their shingles and minima go to all workers (a documented
bound); a larger benchmark is searched in blocks of that many, one after the other, each of whose results is written before
the next block is read. There is no shuffle.

Null and empty texts and items find nothing. Repeated rows are found as often as they stand there; a null doc_id or
item_id is carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import drop, scratch
from .near_dedup import WORDS, shingles

HASHES = 64
ITEMS = 50_000
ITEM_WORDS = 2_000_000
BITMAP = 1 << 20
CHUNK = 1 << 15


words_of = re.compile(r"[^ \t-\r]+").findall


def item_shingles(text: str | None) -> np.ndarray:
    return np.unique(shingles(text)) if len(words_of(text or "")) >= WORDS else np.zeros(0, np.uint64)


class Index:
    """Items by size class, with the minima of each."""

    def __init__(self, ids: list, texts: list[str | None], threshold: Fraction):
        g = np.random.Generator(np.random.PCG64(3))
        self.t = threshold
        self.odd = g.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        kept = [(i, h) for i, h in zip(ids, map(item_shingles, texts)) if len(h)]
        self.ids, self.sets = [k[0] for k in kept], [k[1] for k in kept]
        sizes = np.array([len(h) for h in self.sets], np.int64)
        self.klass = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) if len(sizes) else sizes
        self.classes = sorted(set(self.klass.tolist()))
        self.tables = {}
        for c in self.classes:
            members = np.flatnonzero(self.klass == c)
            minima = np.stack([self.ranks(self.sets[i]).min(1) for i in members])  # [item, hash]
            keys = (minima + np.arange(HASHES, dtype=np.uint64)).ravel()
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(BITMAP, bool)
            bits[self.slot(keys)] = True
            self.tables[c] = keys[order], np.repeat(members, HASHES)[order], bits

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """[hash, shingle]: values whose smallest is the sample; the low bits make room for the hash's number."""
        return (h[None, :] * self.odd[:, None]) & np.uint64(0xFFFFFFFFFFFFFF00)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the shingles ``h``."""
        found: set[int] = set()
        if not len(h) or not self.classes:
            return found
        low = self.classes[0]
        size = 1 << low
        n = -(-len(h) // size)
        minima = np.full((HASHES, n), np.iinfo(np.uint64).max, np.uint64)
        step = max(size, CHUNK // size * size)
        for i in range(0, len(h), step):
            part = self.ranks(h[i : i + step])
            minima[:, i // size : i // size + -(-part.shape[1] // size)] = np.minimum.reduceat(part, np.arange(0, part.shape[1], size), 1)
        for c in range(low, self.classes[-1] + 1):
            if c in self.tables:
                windows = np.minimum(minima[:, :-1], minima[:, 1:]) if minima.shape[1] > 1 else minima
                keys = (windows + np.arange(HASHES, dtype=np.uint64)[:, None]).ravel()
                table, item, bits = self.tables[c]
                keys = np.unique(keys[bits[self.slot(keys)]])
                lo, hi = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
                for a, b in zip(lo[hi > lo], hi[hi > lo]):
                    found.update(item[a:b].tolist())
            if minima.shape[1] > 1:
                minima = np.minimum.reduceat(minima, np.arange(0, minima.shape[1], 2), 1)
        return found

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item, how many of its shingles the text has) for the items that the text contains."""
        h = shingles(text)
        out = []
        own = None
        for i in sorted(self.candidates(h)):
            own = np.unique(h) if own is None else own
            s = self.sets[i]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            n = int((own[at] == s).sum())
            if n * self.t.denominator >= self.t.numerator * len(s):
                out.append((i, n))
        return out


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list]]:
    """Items in blocks of at most ITEMS rows and about ITEM_WORDS words."""
    ids, texts, words = [], [], 0
    for r in items.select(F.col(key).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(r.t or "") // 4
        if ids and (len(ids) >= ITEMS or words + n > ITEM_WORDS):
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        words += n
    if ids:
        yield ids, texts


def find_items(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc key, item key, n_shingles of the item, n_found of them in the document): a row for each pair found."""
    spark = df.sparkSession
    key_type, item_type = df.schema[key].dataType, items.schema[item_key].dataType
    names = ["_doc", "_item", "n_shingles", "n_found"]
    schema = f"_doc {key_type.simpleString()}, _item {item_type.simpleString()}, n_shingles long, n_found long"
    def part(block: tuple[list, list]) -> tuple[DataFrame, object]:
        held = spark.sparkContext.broadcast(Index(*block, Fraction(str(threshold))))  # ITEMS items at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in slices(batches):
                found = [(row, *x) for row, t in enumerate(b.column(1).to_pylist()) for x in index.search(t)]
                rows = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                own = pa.array([index.ids[f[1]] for f in found], to_arrow(item_type))
                yield pa.RecordBatch.from_arrays([rows, own, pa.array([len(index.sets[f[1]]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=names)

        return df.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).mapInArrow(run, schema), held

    parts, last = [], None
    for block in item_blocks(items, item_key, item_text):
        if last:
            parts.append(scratch(last[0], "found-items"))
            last[1].destroy()
        last = part(block)
    parts += [last[0]] if last else []
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("_doc").alias(key), F.col("_item").alias(item_key), "n_shingles", "n_found")


def to_arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` that contain no item. They are judged one by one, so that null or repeated keys do no harm."""
    keep, schema, spark = df.columns, df.schema, df.sparkSession

    def without(rows: DataFrame, block: tuple[list, list]) -> tuple[DataFrame, object]:
        held = spark.sparkContext.broadcast(Index(*block, Fraction(str(threshold))))  # ITEMS items at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in slices(batches):
                yield b.filter(pa.array([not index.search(t) for t in b.column(keep.index(text)).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, schema), held

    out, held, before = df, None, None
    for block in item_blocks(items, item_key, item_text):
        if held:  # the block before is done with before this one is made
            out = scratch(out, "clean")
            held.destroy()
            if before:
                drop(before)
            before = out
        out, held = without(out, block)
    return out


def unsearched(items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``items`` that have words, but too few for a shingle; a rule of their own has to guard these."""
    n = F.size(F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""))
    return items.where((n > 0) & (n < WORDS))
