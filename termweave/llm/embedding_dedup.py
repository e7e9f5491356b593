"""Operator 6: near-duplicate embeddings by rotated binary codes with correction factors.

Vectors are compared only if their labels are equal and not null, and their lengths are equal. Two are linked if the
cosine of their angle, in double precision, is at least the threshold. Equal vectors form one class, whose members link
with each other and with all that a member links with; only classes are compared.

* A random rotation turns each unit vector; the signs of the result are its code, and the inner product of vector and
  code, its correction factor, is stored with it. For a vector x and the code c of y, <x, c> / factor(y) is an unbiased
  estimate of <x, y>, with an error of about sqrt((1 - f^2) / f^2 / (d - 1)); pairs whose estimate plus SIGMAS of these
  reaches the threshold are computed exactly, all others can't be linked but with a probability below 1e-6.
* Candidates meet in buckets: TABLES bands of code bits from further rotations, as many bits as leave about BUCKET
  classes of the largest label to a bucket, and as many bands as leave a linked pair unseen with a probability below
  MISS. The two numbers follow from the count of rows, so the work grows in proportion to rows times bands.
* Buckets are found by (band, code) alone; the vectors, in the precision they came in, are shuffled once to where they are
  compared. A large bucket is cut into chunks of CHUNK rows, and each pair of chunks is a unit of work, so no task holds
  an unbounded group. What comes back is, for each vector, the number of its links, and edges that connect what is linked:
  at most one for each vector and unit. A pair that meets in more than one bucket counts in the first only.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
nothing. Repeated rows are vectors of their own: n_links counts rows, with the id's own repeats. A component is named by
its smallest id, null ids aside.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleared, components, scratch

BUCKET, CHUNK = 256, 1024
MISS = 0.002
SIGMAS = 5.0


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@functools.lru_cache(64)
def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, d])).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for a largest group of so many classes."""
    bits = max(0, min(60, math.ceil(math.log2(max(1, largest) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - agree))


def band_codes(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """[vector, band]: the bits of each band as a number. A rotation gives as many bands as fit in its dimensions."""
    out = np.zeros((len(x), bands), np.int64)
    d = x.shape[1]
    each = max(1, d // max(1, bits))
    for b in range(bands if bits else 0):
        if b % each == 0:
            turned = [x @ rotation(d, 100 + b * 8 + k) > 0 for k in range(-(-bits // d))]
            signs = np.concatenate(turned, 1)
        own = signs[:, (b % each) * bits : (b % each) * bits + bits]
        out[:, b] = own @ (1 << np.arange(own.shape[1], dtype=np.int64))
    return out


def linked(x: np.ndarray, y: np.ndarray, signs: np.ndarray, factor: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit vectors x[i], y[j] with a cosine of at least the threshold. signs, factor: the codes of y."""
    d = x.shape[1]
    estimate = (x @ turn).astype(np.float32) @ signs.T / (factor * math.sqrt(d))[None, :]
    error = np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1))
    i, j = np.nonzero(estimate + SIGMAS * error[None, :] + 1e-4 >= threshold)
    if len(i):
        keep = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        i, j = i[keep], j[keep]
    return i, j


def components_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def unit_links(frame: dict[str, np.ndarray], d: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Links within one unit: ids and counts, and edges. ``frame``: node, side, copies, x (unit vectors), codes, band."""
    turn = rotation(d, 7)
    unit = frame["x"]
    left, right = np.flatnonzero(frame["side"] != 1), np.flatnonzero(frame["side"] != 0)
    turned = unit[right] @ turn
    signs = np.where(turned > 0, 1, -1).astype(np.float32)
    factor = np.abs(turned).sum(1) / math.sqrt(d)
    found = []
    for at in range(0, len(left), CHUNK):
        a = left[at : at + CHUNK]
        i, j = linked(unit[a], unit[right], signs, factor, turn, threshold)
        found.append((a[i], right[j]))
    i, j = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    node, codes, band = frame["node"], frame["codes"], frame["band"]
    ok = (node[i] < node[j]) | ((frame["side"][i] == 0) & (node[i] != node[j]))
    # only in the first band in which both agree
    ok[ok] &= (codes[i[ok]] == codes[j[ok]]).argmax(1) == band if codes.shape[1] else True
    i, j = i[ok], j[ok]
    links = np.zeros(len(node), np.int64)
    np.add.at(links, i, frame["copies"][j])
    np.add.at(links, j, frame["copies"][i])
    root = components_of(len(node), i, j)
    some, edge = links > 0, root != np.arange(len(node))
    return node[some], links[some], node[root[edge]], node[edge]


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """Every column of ``df``, n_links, component_id and kept (key = component_id), which replace such columns."""
    names = [c for c in df.columns if c not in ("n_links", "component_id", "kept")]
    kind = df.schema[vector].dataType
    given = "float" if kind.simpleString() == "array<float>" else "double"
    v = F.col(vector).cast("array<double>")
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.struct(*names).alias("_row"), F.col(key).cast("long").alias("_id"), F.col(label).alias("_label"), v.alias("_v"))
    fit = F.col("_label").isNotNull() & F.col("_v").isNotNull() & ~bad & F.exists("_v", lambda c: c != 0)
    # -0.0 and 0.0 are one value in a group's key
    body = F.sha2(F.to_json(F.struct(F.col("_label").alias("l"), F.transform("_v", lambda c: c + F.lit(0.0)).alias("v"))).cast("binary"), 256)
    rows = rows.withColumn("_k", F.when(fit, F.unhex(body)))
    with cleared() as keep:
        named = _names(rows, given, threshold)
        keep(named)
    out = rows.join(named, "_k", "left")
    component = F.when(F.col("n_links").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(*(F.col("_row")[c].alias(c) for c in names), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def _names(rows: DataFrame, given: str, threshold: float) -> DataFrame:
    """(_k, n_links, component_id) of each distinct vector of ``rows`` (_k, _id, _label, _v)."""
    groups = rows.where("_k is not null").groupBy("_k").agg(F.first("_label").alias("label"), F.first(F.col("_v").cast(f"array<{given}>")).alias("v"), F.min("_id").alias("id"), F.count("*").alias("copies"))
    groups = scratch(groups.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("label", F.size("v")).alias("part"), "*"), "vectors")
    largest = groups.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan(largest, threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(np.asarray(b.column(2).offsets))
            flat = np.asarray(b.column(2).flatten(), np.float64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                rows_ = np.flatnonzero(sizes == d)
                codes = band_codes(unit_vectors(np.stack([flat[begin[i] : begin[i + 1]] for i in rows_])), bits, bands)
                coded = pa.ListArray.from_arrays(pa.array(np.arange(len(rows_) + 1, dtype=np.int32) * bands), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(rows_)) for k in range(2)), coded], names=["node", "part", "codes"])

    coded = scratch(groups.select("node", "part", "v").mapInArrow(code, "node long, part long, codes array<long>"), "vector-codes")
    dealt = coded.select("node", "part", F.posexplode("codes").alias("band", "code"))
    big = dealt.groupBy("part", "band", "code").agg(F.count("*").alias("n")).where("n > 1").select("part", "band", "code", F.expr(f"cast(ceil(n / {CHUNK}) as int)").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = dealt.join(big, ["part", "band", "code"]).withColumn("own", own)
    # a row goes to all units of its chunk: (own, other) for others above, as the left side, and (other, own) as the right one
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.xxhash64("part", "band", "code", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    units = placed.select(unit.alias("unit"), side.alias("side"), "part", "node", "band").join(groups.select("node", "copies", "v").join(coded.select("node", "codes"), "node"), "node")
    units = units.select("unit", "side", "part", "node", "band", "copies", "v", "codes").repartition(F.col("unit")).sortWithinPartitions("unit", "part", "band", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in whole_units(batches):
            d = f["x"].shape[1]
            ids, n, lo, hi = unit_links({**f, "x": unit_vectors(f["x"]), "band": int(f["band"][0])}, d, threshold)
            a = np.concatenate([ids, lo])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate([n, np.zeros(len(lo), np.int64)])), pa.array(np.concatenate([np.full(len(ids), -1), hi]))], names=["node", "n", "other"])

    found = scratch(units.mapInArrow(run, "node long, n long, other long"), "vector-links")
    roots = components(found.where("other >= 0").select("node", "other"), "node", "other", "vector")
    counts = found.where("other < 0").groupBy("node").agg(F.sum("n").alias("n"))
    named = groups.select("_k", "node", "id", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names_ = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return scratch(named.join(names_, "root").select("_k", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-names")


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Columns of each unit, whose rows follow each other but may lie in several batches."""
    held: list[pa.RecordBatch] = []

    def columns(parts: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(parts)
        flat = lambda c, kind: np.concatenate([np.asarray(p.column(c).flatten(), kind) for p in parts]).reshape(t.num_rows, -1)
        return {c: t[c].to_numpy() for c in ("side", "node", "copies", "band")} | {"x": flat("v", np.float64), "codes": flat("codes", np.int64)}

    last = None
    for b in batches:
        unit = np.stack([b.column("unit").to_numpy(), b.column("part").to_numpy(), b.column("band").to_numpy()])
        cuts = np.flatnonzero((np.diff(unit, axis=1) != 0).any(0)) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            if i == j:
                continue
            own = tuple(unit[:, i])
            if held and own != last:
                yield columns(held)
                held = []
            last = own
            held.append(b.slice(i, j - i))
    if held:
        yield columns(held)
