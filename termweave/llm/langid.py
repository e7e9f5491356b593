"""Operator 2: language identification of words, spans and texts.

Words are runs of letters (Unicode categories L) with the marks (M) that follow them, lower-cased. A word's script (by code-point ranges) narrows the candidates to languages in
which that script was seen in training. Candidates are scored with hashed word and character 3-gram frequencies as log
likelihoods, clipped so that no single word decides alone; Viterbi over the word scores with a penalty for each switch
of language labels every word, and runs of a label are the spans. A text's language is the one that most of its letters
are labelled with, its score that share of the letters.

Training counts come from a hash-ordered sample of about TRAIN_ROWS labelled rows (a documented bound; fewer rows are all
used) and fill tables of fixed size, so the model has a proven bound of (WORD_SLOTS + GRAM_SLOTS) floats a language.

Null texts and texts without a letter: `und`, score 0, no spans. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices

TRAIN_ROWS = 12_000
WORD_SLOTS, GRAM_BITS = 1 << 17, 15
GRAM_SLOTS = 1 << GRAM_BITS
SWITCH_PENALTY = 9.0
CLIP = 7.0
KNOWN_WORDS = 1 << 18
BATCH_WORDS = 400_000

#: Upper ends of code-point ranges and the script up to there.
SCRIPTS = [(0x2B0, "latin"), (0x370, "other"), (0x400, "greek"), (0x530, "cyrillic"), (0x590, "armenian"), (0x600, "hebrew"), (0x780, "arabic"), (0x900, "other"), (0x980, "devanagari"), (0xE00, "indic"), (0xE80, "thai"), (0x10A0, "other"), (0x1100, "georgian"), (0x1200, "hangul"), (0x1E00, "other"), (0x1F00, "latin"), (0x2000, "greek"), (0x3040, "other"), (0x3100, "kana"), (0x3400, "other"), (0xA000, "han"), (0xAC00, "other"), (0xD7B0, "hangul"), (0xF900, "other"), (0xFB00, "han"), (0x20000, "other"), (0x32000, "han"), (0x110000, "other")]
_ENDS = np.array([e for e, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
_CODE = np.array([NAMES.index(s) for _, s in SCRIPTS])


def _spans(kinds: str, lo: int, hi: int) -> str:
    """A character class's body: the code points from lo to hi whose category begins with one of ``kinds``."""
    held = [c for c in range(lo, hi) if unicodedata.category(chr(c))[0] in kinds]
    cuts = [i for i in range(len(held)) if not i or held[i] != held[i - 1] + 1] + [len(held)]
    return "".join(f"{re.escape(chr(held[a]))}-{re.escape(chr(held[b - 1]))}" for a, b in zip(cuts, cuts[1:]))


#: The second form, for letters beyond the basic plane, is only tried where such a character stands.
words_of = re.compile(f"[{_spans('L', 0, 1 << 16)}][{_spans('LM', 0, 1 << 16)}]*|(?=[\U00010000-\U0010ffff])[{_spans('L', 1 << 16, 0x110000)}][{_spans('LM', 0, 0x110000)}]*").findall


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its script and slot; of all words the slots of their 3-grams, borders included; where each word's begin."""
    body = "".join(f"<{w}>" for w in words)
    x = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    h = np.zeros(len(x), np.uint64)
    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        h[: len(x) - k] = (h[: len(x) - k] ^ x[k:]) * np.uint64(odd)
    inside = np.ones(len(x), bool)
    inside[np.concatenate([begin + lengths, begin + lengths + 1])] = False  # 3-grams that would cross into the next word
    slot = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & (WORD_SLOTS - 1) for w in words), np.int64, len(words))
    return _CODE[np.searchsorted(_ENDS, x[begin + 1], "right")], slot, (h[inside] >> np.uint64(64 - GRAM_BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]])


class Model:
    """langs, word and gram log frequencies [slot, language], and [script, language]: whether a script is a candidate."""

    def __init__(self, langs: list[str], words: np.ndarray, grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.seen = words.sum(1)
        self.words = np.log((words + 0.05) / (words.sum(0) + 0.05 * WORD_SLOTS)).astype(np.float32)
        self.grams = np.log((grams + 0.2) / (grams.sum(0) + 0.2 * GRAM_SLOTS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.candidate = share > 0.01
        self.candidate[~self.candidate.any(1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: clipped log likelihoods, 0 for the best candidate of each word."""
        script, slot, grams, begin = features(words)
        s = np.add.reduceat(self.grams[grams], begin) / np.diff(begin, append=len(grams))[:, None] * 2.0
        s += np.where(self.seen[slot] >= 3, 1, 0)[:, None] * self.words[slot]
        s -= s.max(1, keepdims=True)
        return np.where(self.candidate[script], np.maximum(s, -CLIP), -2 * CLIP).astype(np.float32)


class Scorer(dict):
    """word -> row of `rows`; emptied when full (between texts)."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((KNOWN_WORDS, len(model.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self) > KNOWN_WORDS // 2:
            self.clear()
            self.rows = self.rows[:KNOWN_WORDS]
        ids = list(map(self.get, words))
        if None in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids) if i is None))
            at = len(self)
            self.update(zip(new, range(at, at + len(new))))
            if len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(self), self.rows.shape[1]), np.float32)])
            self.rows[at : at + len(new)] = self.model.scores(new)
            ids = list(map(self.__getitem__, words))
        return self.rows[np.array(ids, np.int64)] if ids else self.rows[:0]


def one_label(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> int | None:
    """The label that the best path keeps throughout, if that is sure.

    Of a path's stretches each other label's gains at most the most that any stretch gains. If the best label has a
    stretch too, there is a switch for each of the others, so none may gain the penalty. If it has none, there is a switch
    less than stretches, but the first is a prefix and the last a suffix (alone it is the whole text, which gains
    nothing): so together these two may not gain the penalty either.
    """
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], 0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, 0), 0)
    low[1:] = low[:-1].copy()
    low[0] = 0
    others = np.arange(scores.shape[1]) != best
    if not others.any():
        return best
    prefix = gain[:, others].max()
    suffix = (gain[-1] - np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]))[:, others].max()
    return best if (gain - low).max() < penalty and prefix + suffix < penalty else None


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word of texts laid end to end. All texts advance together, the longest first."""
    out = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    most = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(most), "left")  # texts with more than t words
    if not most:
        return out
    back = np.zeros(scores.shape, out.dtype)
    v = scores[starts].copy()
    for t in range(1, most):
        n = active[t]
        w = v[:n]
        top = w.argmax(1)
        rest = w[np.arange(n), top] - penalty
        stay = w >= rest[:, None]
        at = starts[:n] + t
        back[at] = np.where(stay, np.arange(w.shape[1]), top[:, None])
        v[:n] = np.where(stay, w, rest[:, None]) + scores[at]
    state = v.argmax(1)
    for t in range(most - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on a sample of about ``rows`` rows of ``df`` with a language. None if there is no such row."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = labelled.count()
    if not n:
        return None
    share = min(1.0, rows / n)
    chosen = labelled.where(F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        size = WORD_SLOTS + GRAM_SLOTS + len(NAMES)
        for b in slices(batches):
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = sums.setdefault(l, np.zeros(size, np.int64))
                words = words_of(t.lower())
                if words:
                    own, slot, grams, _ = features(words)
                    a += np.bincount(np.concatenate([slot, WORD_SLOTS + grams, WORD_SLOTS + GRAM_SLOTS + own]), minlength=size)
        for l, a in sums.items():
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at), pa.array(a[at])], names=["lang", "slot", "n"])

    counted = chosen.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most (WORD_SLOTS + GRAM_SLOTS + scripts) rows a language
    langs = sorted(got["lang"].unique())
    a = np.zeros((WORD_SLOTS + GRAM_SLOTS + len(NAMES), len(langs)))
    a[got["slot"].to_numpy(), got["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy()] = got["n"].to_numpy()
    if not langs:
        return None
    return Model(langs, a[:WORD_SLOTS], a[WORD_SLOTS : WORD_SLOTS + GRAM_SLOTS], a[WORD_SLOTS + GRAM_SLOTS :])


class Labeller:
    def __init__(self, model: Model):
        self.model, self.scorer = model, Scorer(model)

    def label(self, texts: list[str | None], spans: bool) -> list[tuple[str, float, list]]:
        """(language, score, spans) of each text, in order."""
        got: list = [None] * len(texts)
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size = 0
        for i, t in enumerate(texts):
            words = words_of((t or "").lower())
            if not words:
                got[i] = ("und", 0.0, [])
                continue
            scores = self.scorer.scores(words)
            one = one_label(scores)
            if one is not None:
                got[i] = (self.model.langs[one], 1.0, [(self.model.langs[one], 0, len(words))] if spans else [])
                continue
            held.append((i, len(words), np.fromiter(map(len, words), np.int64, len(words)), scores))
            size += len(words)
            if size > BATCH_WORDS:
                self._flush(held, got, spans)
                held, size = [], 0
        self._flush(held, got, spans)
        return got

    def _flush(self, held: list, got: list, spans: bool) -> None:
        if not held:
            return
        lengths = np.array([h[1] for h in held])
        labels = viterbi(np.concatenate([h[3] for h in held]), lengths)
        at = 0
        for i, n, chars, _ in held:
            own = labels[at : at + n]
            at += n
            weight = np.bincount(own, chars, len(self.model.langs))
            best = int(weight.argmax())
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if spans else []
            got[i] = (self.model.langs[best], float(weight[best] / weight.sum()), [(self.model.langs[own[a]], int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])])


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())]))


def identify(df: DataFrame, model: Model | None, text: str = "text", spans: bool = False, prefix: str = "") -> DataFrame:
    """Every column of ``df``, lang_pred, score and, if asked for, spans of words [first_word, end_word).

    Columns of ``df`` with those names (after ``prefix``) are replaced. Without a model all texts are `und`.
    """
    names = [f"{prefix}lang_pred", f"{prefix}score", *([f"{prefix}spans"] if spans else [])]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), *([T.StructField(names[2], SPANS)] if spans else [])])
    held = df.sparkSession.sparkContext.broadcast(model)  # of fixed size a language

    def run(batches):
        own = held.value
        labeller = Labeller(own) if own else None
        for b in slices(batches, 1024):
            texts = b.column(keep.index(text)).to_pylist()
            got = labeller.label(texts, spans) if labeller else [("und", 0.0, [])] * len(texts)
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]))
                cols.append(pa.array([[dict(zip(("lang", "first_word", "end_word"), s)) for s in g[2]] for g in got], kind))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*keep, *names])

    return df.select(*(df[c] for c in keep)).mapInArrow(run, schema)


def rejected(lang_pred: Column, score: Column, min_score: float = 0.3) -> Column:
    """Texts without a language, or of which no language has at least ``min_score`` of the letters."""
    return (lang_pred == "und") | (score < min_score)
