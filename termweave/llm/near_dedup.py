"""Operator 9: near-duplicate documents by improved consistent weighted sampling.

A text's features are its shingles of five lower-cased words (a text of one to four words has one shingle of them all),
weighted by how often they occur in it times a smoothed idf between 1 and 2, in sixteenths: one more than a sixteenth of
the binary logarithm of its share of all documents' shingles, rounded, so 2 from a share of 2**-16 down. Shares are exact: a
sketch over all documents tells the hash slots that hold so large a share, whose shingles are then counted one by one, and
at most 2**16 of them can have it. Two texts are linked if their
weighted Jaccard similarity, the sum of the smaller over the sum of the larger weights, is at least the threshold;
weights are integers, so that the comparison is exact. A class is what links connect, with all copies of its texts.

Improved consistent weighted sampling draws BANDS * ROWS samples (shingle, level) from each distinct text, which two
texts share with a probability of their similarity. A shingle's random gamma and uniform variates come from a table that
its hash indexes, so a sample's logarithm is one lookup for each of the few usual weights. Texts whose samples agree in
all of a band's ROWS are candidates (at similarity 0.8 a pair is missed with a probability below 3e-5).

A bucket, however large, isn't expanded into pairs: its texts are compared with the one of them that meets most others, the
rest of a bucket of which some are in another class again with one of them. Only texts of a bucket that are in different
classes even then are compared with each other, and only if a link is possible: their similarities to those leaders are
close enough (1 - weighted Jaccard similarity is a metric), and enough of their weight is in shingles that another of these
texts has. Both bounds are exact.

Cases: null texts and those without a word are alone in their class. Rows without a doc_id are compared like all others;
a class is named by the smallest doc_id in it, null if it has none. Rows with one doc_id are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .bpe import slices
from .common import cleared, components, drop, scratch, text_key
from .words import mixed

WORDS = 5
BANDS, ROWS = 20, 4
SLOTS = 1 << 16
LEVELS = 17
SKETCH = 1 << 18
BLOCK = 2048
LEADERS = 2


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The hash of each run of ``n`` lower-cased words, in order; of all words if there are fewer; none without a word."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = words.find(data)
    h = words.hashes(data, starts, ends)[0]
    return words.runs(h, min(n, len(h))) if len(h) else h


class Idf:
    """Levels of the shingles that are frequent enough for less than the highest: idf is 1 + level / 16."""

    def __init__(self, total: int = 0, hot: np.ndarray | None = None, shingles_: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.hot = np.zeros(SKETCH, bool) if hot is None else hot
        order = np.argsort(shingles_) if shingles_ is not None else slice(0)
        self.shingles = np.zeros(0, np.uint64) if shingles_ is None else shingles_[order]
        self.own = np.zeros(0, np.int64) if counts is None else self.level(counts[order], total)

    @staticmethod
    def level(counts: np.ndarray, total: int) -> np.ndarray:
        return np.clip(np.round(-np.log2(counts / max(1, total))), 0, LEVELS - 1).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), LEVELS - 1, np.int64)
        if len(self.shingles):
            some = np.flatnonzero(self.hot[(h & np.uint64(SKETCH - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.shingles, h[some]), len(self.shingles) - 1)
            same = self.shingles[at] == h[some]
            out[some[same]] = self.own[at[same]]
        return out


def weighted(text: str | None, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and their weights in sixteenths."""
    h, tf = np.unique(shingles(text), return_counts=True)
    return h, tf * (16 + idf.levels(h))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of the smaller and of the larger weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low, int(a[1].sum()) + int(b[1].sum()) - low


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], t: Fraction) -> bool:
    low, high = overlap(a, b)
    return low > 0 and low * t.denominator >= t.numerator * high


class Sampler:
    def __init__(self, k: int = BANDS * ROWS, seed: int = 20):
        g = np.random.Generator(np.random.PCG64(seed))
        self.r, c, self.beta = g.gamma(2, 1, SLOTS), g.gamma(2, 1, SLOTS), g.random(SLOTS)
        self.log_c = np.log(c)
        self.odd = g.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.usual = np.stack([self.place(np.full(SLOTS, 16 + q), np.arange(SLOTS))[0] for q in range(LEVELS)]).astype(np.float32).ravel()

    def place(self, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of the sample's rank and its level, for weights in sixteenths and places of the table."""
        r, beta = self.r[at], self.beta[at]
        level = np.floor(np.log(weight / 16) / r + beta)
        return self.log_c[at] - r * (level - beta + 1), level

    def bands(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A hash for each band of the samples from shingles ``h``."""
        k = len(self.odd)
        best, who = np.full(k, np.inf, np.float32), np.zeros(k, np.int64)
        for i in range(0, len(h), BLOCK):
            hi, wi = h[i : i + BLOCK], weight[i : i + BLOCK]
            at = ((hi[None, :] * self.odd[:, None]) >> np.uint64(48)).astype(np.int32)
            usual = wi < 16 + LEVELS
            rank = self.usual.take(at + ((np.where(usual, wi, 16) - 16).astype(np.int32) << 16)[None, :])
            if not usual.all():
                rank[:, ~usual] = self.place(wi[~usual][None, :], at[:, ~usual])[0]
            first = rank.argmin(1)
            low = rank[np.arange(k), first]
            better = low < best
            best[better], who[better] = low[better], first[better] + i
        at = ((h[who] * self.odd) >> np.uint64(48)).astype(np.int64)
        level = self.place(weight[who], at)[1].astype(np.int64).astype(np.uint64)
        one = mixed(mixed(h[who]) + level * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            out = mixed(out + one[:, j])
        return out.view(np.int64)


def frequencies(texts: DataFrame) -> Idf:
    """From the shingles of all documents; a text counts once for each of its copies."""

    def each(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield np.unique(shingles(t)), n

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in slices(batches):
            for h, n in each(b):
                np.add.at(total, (h & np.uint64(SKETCH - 1)).astype(np.int64), n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    slots = texts.select("text", "copies").mapInArrow(sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    slots = scratch(slots, "near-slots")  # SKETCH rows at most
    total = slots.agg(F.sum("n")).first()[0] or 0
    least = max(2, total >> 16)
    hot = np.zeros(SKETCH, bool)
    hot[[r.slot for r in slots.where(F.col("n") >= least).select("slot").collect()]] = True  # 2**16 at most
    drop(slots)
    held = texts.sparkSession.sparkContext.broadcast(hot)  # SKETCH bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(h[held.value[(h & np.uint64(SKETCH - 1)).astype(np.int64)]], n) for h, n in each(b)]
            h = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.uint64)
            n = np.repeat([n for _, n in found], [len(f) for f, _ in found])
            one, at = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.bincount(at, n, len(one)).astype(np.int64))], names=["h", "n"])

    own = texts.select("text", "copies").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()  # 2**16 at most
    held.unpersist()
    return Idf(total, hot, np.array([r.h for r in own], np.int64).view(np.uint64), np.array([r.n for r in own], np.int64))


def compared(pairs: DataFrame, texts: DataFrame, idf: Idf, t: Fraction) -> DataFrame:
    """``pairs`` (a, b) with their similarity and whether they are linked."""
    held = pairs.sparkSession.sparkContext.broadcast(idf)  # SKETCH bytes and 2**16 shingles at most

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in slices(batches):
            sim, linked = [], []
            for a, u, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if last != a:
                    last, own = a, weighted(u, held.value)
                low, high = overlap(own, weighted(v, held.value))
                sim.append(low / max(1, high))
                linked.append(low > 0 and low * t.denominator >= t.numerator * high)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "sim", "linked"])

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("v")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("u")), "a")
    return both.select("a", "b", "u", "v").mapInArrow(check, "a long, b long, sim double, linked boolean")


def weights(texts: DataFrame, idf: Idf) -> DataFrame:
    """(node, total, own): a text's weight, and that of the shingles which no other of the texts has."""
    held = texts.sparkSession.sparkContext.broadcast(idf)  # SKETCH bytes and 2**16 shingles at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, w = weighted(t, held.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(h.view(np.int64)), pa.array(w)], names=["node", "h", "w"])

    rows = scratch(texts.select("node", "text").mapInArrow(each, "node long, h long, w long"), "near-weights")
    alone = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("w").alias("w")).where("n = 1")
    own = alone.groupBy("node").agg(F.sum("w").alias("own"))
    return rows.groupBy("node").agg(F.sum("w").alias("total")).join(own, "node", "left").select("node", "total", F.coalesce("own", F.lit(0)).alias("own"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(k, root, class_id): for each distinct text with a word, by its key, the class it belongs to and its smallest doc_id."""
    with cleared() as keep:
        out = _classes(df, key, text, threshold)
        keep(out)
    return out


def _classes(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    t = Fraction(str(threshold))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), text_key(F.col(text)).alias("k")).where(F.col("text").rlike(r"[^ \t-\r]"))
    texts = rows.groupBy("k").agg(F.first("text").alias("text"), F.min("id").alias("id"), F.count("*").alias("copies"))
    texts = scratch(texts.select(F.monotonically_increasing_id().alias("node"), "*"), "near-texts")
    idf = frequencies(texts)
    held = df.sparkSession.sparkContext.broadcast(idf)  # SKETCH bytes and 2**16 shingles at most

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler()
        for b in slices(batches):
            found = [s.bands(*weighted(x, held.value)) for x in b.column(1).to_pylist()]
            nodes = np.repeat(b.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["node", "bucket"])

    dealt = scratch(texts.select("node", "text").mapInArrow(sample, "node long, bucket long"), "near-buckets")
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch(dealt.join(shared, "bucket"), "near-members")
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    placed = members.join(met, "node").select("bucket", "node", "met", F.col("node").alias("root"))
    # by a shuffle at every size: a broadcast would only hold while few texts meet
    bodies = scratch(texts.select("node", "text").hint("merge").join(met.select("node"), "node"), "near-bodies")
    tried, room = None, float(1 - t) + 1e-9
    possible = F.lit(True)
    for turn in range(LEADERS):
        # the text that meets most others leads: what is central lies close to all
        leads = placed.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"))).alias("lead"))
        placed = scratch(placed.join(leads.select("bucket", (-F.col("lead.minus")).alias("lead")), "bucket").where("node <> lead"), "near-led")
        ends = F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")
        pairs = placed.select(*ends).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        found = scratch(compared(scratch(pairs, "near-pairs"), bodies, idf, t), "near-tried")
        tried = found if tried is None else tried.union(found)
        roots = components(tried.where("linked"), "a", "b", "near")
        placed = placed.drop("root").select("*", *ends).join(tried.select("a", "b", F.col("sim").alias(f"sim{turn}")), ["a", "b"]).drop("a", "b", "lead")
        placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        possible &= F.abs(F.col(f"sim{turn}") - F.col(f"sim{turn}_")) <= room
        # a shingle that no other of these texts has is in no other; a text with too many can't have a link, and goes
        split = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        placed = scratch(placed.join(split, "bucket").drop("total", "own"), "near-split")
        placed = placed.join(weights(placed.select("node").distinct().join(bodies, "node"), idf), "node")
        placed = scratch(placed.where((F.col("total") - F.col("own")) * t.denominator >= F.col("total") * t.numerator), "near-split")
    placed = placed.join(placed.groupBy("node").agg(F.collect_list("bucket").alias("all")), "node")  # BANDS at most
    other = placed.select("bucket", *(F.col(c).alias(f"{c}_") for c in placed.columns if c != "bucket"))
    most = F.least(F.col("total") - F.col("own"), F.col("total_") - F.col("own_"))
    possible &= most * (t.numerator + t.denominator) >= (F.col("total") + F.col("total_")) * t.numerator
    pairs = placed.join(other, "bucket").where((F.col("root") != F.col("root_")) & (F.col("node") < F.col("node_")) & possible & (F.col("bucket") == F.array_min(F.array_intersect("all", "all_"))))
    pairs = pairs.select(F.col("node").alias("a"), F.col("node_").alias("b")).join(tried, ["a", "b"], "left_anti")
    pairs = scratch(pairs, "near-pairs")
    if not pairs.isEmpty():
        more = scratch(compared(pairs, bodies, idf, t), "near-tried")
        roots = components(tried.union(more).where("linked"), "a", "b", "near")
    named = texts.select("k", "node", "id").join(roots, "node", "left").select("k", "id", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("class_id"))
    return scratch(named.join(names, "root").select("k", "root", "class_id"), "near-classes")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Every column of ``df``, class_id (the smallest key of its class) and kept (whether this row stays for its class).

    Of the rows with the smallest key those stay whose text comes first by its hash: one, or repeats of one row. Columns
    of these names are replaced.
    """
    found = classes(df, key, text, threshold)
    names = [c for c in df.columns if c not in ("class_id", "kept")]
    rows = df.select(F.struct(*names).alias("_row"), F.col(key).cast("long").alias("_id"), text_key(F.col(text)).alias("_k"), F.col(text).rlike(r"[^ \t-\r]").alias("_any"))
    out = rows.join(found.select(F.col("k").alias("_k"), "root", "class_id"), "_k", "left")
    head = rows.where("_any").select("_id", "_k").join(found.select(F.col("k").alias("_k"), "root", "class_id"), "_k").where(F.col("_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("_k").alias("_head"))
    out = out.join(head, "root", "left")
    alone = F.col("root").isNull()
    return out.select(*(F.col("_row")[c].alias(c) for c in names), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("_id").eqNullSafe(F.col("class_id")) & (F.col("_k") == F.col("_head")))).alias("kept"))
