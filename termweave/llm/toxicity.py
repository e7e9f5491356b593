"""Operator 5: toxicity by compression distance.

Texts (lower case, white space collapsed) are cut into overlapping windows of WINDOW bytes. Each window is compressed
twice with zstandard: with a dictionary trained on ordinary text, and with that one and, nearest to the window, a
dictionary trained on toxic text; how many bytes the second saves is the window's distance. (With the toxic dictionary
alone a window's harmless words compress worse by more than its toxic word saves: of some 20 settings tried none found more
than 0.4 of the toxic texts, and that one marked a tenth of the ordinary ones.)

Both dictionaries come from zstandard's trainer. Labels belong to whole texts, in which most windows are harmless, so the
toxic one is trained on what sets toxic texts apart: the stretches of toxic training texts that consist of byte 7-grams
which recur in toxic texts and hardly in ordinary ones (`seeds`, `stretches`). How many windows reach which distance, and
the largest, give the text's score by a logistic curve fitted on training texts that the dictionaries haven't seen; so its
0.5 is a calibrated threshold.

Fitting uses a bounded sample: at most TOXIC_ROWS and ORDINARY_ROWS labelled keys in the order of a hash of the id, of each
the text that comes first by its hash, and of a text at most TRAIN_BYTES in evenly spaced blocks. Scoring reads whole texts
in one pass without a shuffle; the model has a fixed size bound (ORDINARY_BYTES, TOXIC_BYTES and a few weights).

Null and empty texts have no windows and get the score of distance 0. Without labelled rows of both classes, or if the
trainer finds nothing that sets toxic texts apart, every score is the share of toxic rows (0 if there is none at all). A
row labelled twice counts as toxic if one label says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices

TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
TRAIN_BYTES, BLOCKS = 16 << 10, 8
WINDOW, STRIDE = 64, 48
LEVEL, MIN_MATCH = 5, 5
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 1 << 10
SEGMENT, SUBSTRING = 24, 8
SAMPLES = 40_000
GRAM = 7
REACHED = (1, 2, 3, 4, 5)


def normal(text: str | None) -> bytes:
    return f" {' '.join(text.lower().split())} ".encode("utf-8", "replace") if text and not text.isspace() else b""


def windows(b: bytes) -> list[bytes]:
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - (WINDOW - STRIDE)), STRIDE)] if b else []


def excerpt(b: bytes) -> bytes:
    """At most TRAIN_BYTES of a training text."""
    if len(b) <= TRAIN_BYTES:
        return b
    size = TRAIN_BYTES // BLOCKS
    return b" ".join(b[int(i) : int(i) + size] for i in np.linspace(0, len(b) - size, BLOCKS))


def _grams(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).astype(np.uint64)
    n = len(x) - GRAM + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        h |= x[k : k + n] << np.uint64(8 * k)
    return h


def seeds(toxic: list[bytes], ordinary: list[bytes], least: float = 0.02, contrast: float = 0.1) -> np.ndarray:
    """Byte 7-grams in at least ``least`` of the toxic texts and, relative to that, in under ``contrast`` as many ordinary ones."""
    if not toxic:
        return np.zeros(0, np.uint64)
    grams, n = np.unique(np.concatenate([np.unique(_grams(b)) for b in toxic]), return_counts=True)
    some = n >= max(5, least * len(toxic))
    grams, n = grams[some], n[some]
    others = np.zeros(len(grams), np.int64)
    for b in ordinary:
        others[np.isin(grams, _grams(b))] += 1
    return grams[(others + 0.5) / max(1, len(ordinary)) < contrast * n / len(toxic)]


def stretches(b: bytes, grams: np.ndarray) -> bytes:
    """The bytes of a text that one of the grams covers, in their order."""
    at = np.flatnonzero(np.isin(_grams(b), grams))
    held = np.zeros(len(b), bool)
    for k in range(GRAM):
        held[at + k] = True
    return np.frombuffer(b, np.uint8)[held].tobytes()


def dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of the samples; nothing if they are too few or too small for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:
        return b""


class Model:
    """Two dictionaries and the weights of a logistic curve over `features`; only bytes and floats, to be shipped."""

    def __init__(self, ordinary: bytes, toxic: bytes, prior: float):
        self.ordinary, self.toxic, self.prior = ordinary, toxic, prior
        self.weights: np.ndarray | None = None
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def compressors(self):
        if self._pair is None:
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(self.ordinary) + len(self.toxic), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            made = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
            self._pair = made
        return self._pair

    def distances(self, b: bytes) -> np.ndarray:
        ordinary, toxic = self.compressors()
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(b)], np.int32)

    def features(self, b: bytes) -> list[float]:
        d = self.distances(b)
        top = max(0, int(d.max())) if len(d) else 0
        return [1.0, *(float(np.log1p((d >= k).sum())) for k in REACHED), min(top, 10) / 5.0, float(np.log1p(len(d))) / 5.0]

    def fit(self, texts: list[bytes], labels: list[int], ridge: float = 0.3, rounds: int = 30) -> None:
        """Newton's method for the logistic curve, on texts that gave nothing to the dictionaries."""
        x, y = np.array([self.features(b) for b in texts]), np.array(labels, float)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + ridge * w * (np.arange(len(w)) > 0)
            hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w -= np.linalg.solve(hess, grad)
        self.weights = w

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(normal(text)), self.weights), -30, 30))))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of the rows of ``df`` that ``labels`` (key, label) marks."""
    once = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    mixed = F.xxhash64(F.col(key).cast("string"))
    chosen = once.where("_label = 1").orderBy(mixed, key).limit(TOXIC_ROWS).unionByName(once.where("_label = 0").orderBy(mixed, key).limit(ORDINARY_ROWS))

    def excerpts(batches):
        for b in slices(batches):
            got = [excerpt(normal(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array(got, pa.binary())], names=["k", "label", "body"])

    picked = df.select(key, text).join(F.broadcast(chosen), key).select(F.xxhash64(F.col(key).cast("string")).alias("k"), text, F.col("_label").cast("int").alias("label"))
    bodies = picked.mapInArrow(excerpts, "k long, label int, body binary")
    once = bodies.groupBy("k", "label").agg(F.min(F.struct(F.xxhash64("body"), "body")).alias("b"))  # so at most TOXIC_ROWS + ORDINARY_ROWS rows
    rows = sorted((r.k, bytes(r.body), r.label) for r in once.select("k", "label", "b.body").toLocalIterator())
    toxic, ordinary = [b for _, b, y in rows if y == 1], [b for _, b, y in rows if y == 0]
    prior = len(toxic) / max(1, len(rows))
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", prior)
    t, o = len(toxic) // 2, len(ordinary) // 2
    pool = [w for b in ordinary[:o] for w in windows(b)]
    grams = seeds(toxic[:t], ordinary[:o])
    model = Model(dictionary(pool[:: max(1, len(pool) // SAMPLES)], ORDINARY_BYTES), dictionary([s for b in toxic[:t] if (s := stretches(b, grams))], TOXIC_BYTES), prior)
    if model.toxic:
        model.fit(toxic[t:] + ordinary[o:], [1] * (len(toxic) - t) + [0] * (len(ordinary) - o))
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Every column of ``df`` and its text's score from 0 to 1; a column of that name is replaced."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    held = df.sparkSession.sparkContext.broadcast(model)  # a few dozen KB

    def run(batches):
        own = held.value
        for b in slices(batches):
            got = [own.score(t) for t in b.column(keep.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*keep, out])

    return df.select(*(df[c] for c in keep)).mapInArrow(run, schema)
