"""Operator 1: byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that no vocabulary token holds can't lie inside any merge result, so a cut between the two
is certain: what stands left and right of it is encoded independently and concatenated. The pre-tokenizer sees whole
texts, so of the certain cuts only those are used at which it can't tell the difference: between a byte outside and a
byte inside S, the set of space and newline. A run of white space that the cut divides gives the same pieces either way,
because its last character is split off on the right of the cut and no merge crosses the cut. Where the vocabulary does
hold a pair (here: the last byte of a no-break space before a space), `fragment_pattern` leaves the text in one piece.

A text is cut at every certain cut, and each worker keeps a bounded table of the fragments it has encoded. Fragments that
aren't in it are encoded by rank where the vocabulary's ids are merge ranks, which gives the same ids several times
faster, else by the tokenizers library. Texts are read in pieces of about CHUNK characters, which also end at a certain
cut, so memory is constant for texts of any length. There is no shuffle: one pass over the text.

Null text: as the empty text (no ids). The special token's literal in a text becomes its id, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import TOKENIZER

#: How byte-level BPE splits texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 1 << 18
CACHED_LENGTH = 48
CHUNK = 1 << 15
FRAGMENT = 256

_encoders: dict[str, "Encoder"] = {}


def resolve(vocab: str) -> str:
    """A path as it is; a bare name by way of the installed package of public vocabularies."""
    if "/" in vocab:
        return vocab
    import public_tokenizers

    return str(public_tokenizers.path(vocab))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """[a, b]: whether some token holds byte a directly before byte b."""
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        if len(t) > 1:
            x = np.frombuffer(t, np.uint8)
            inside[x[:-1], x[1:]] = True
    return inside


CUT_BEFORE = " \n"


def fragment_pattern(inside: np.ndarray) -> tuple[str, str]:
    """Patterns of a fragment and of a character after which a cut is certain.

    Characters whose last byte stands before a byte of CUT_BEFORE in some token are held to what follows them; beyond the
    basic plane all characters are, if any is.
    """
    s = re.escape(CUT_BEFORE)
    bad = {a for a in range(256) if chr(a) not in CUT_BEFORE and any(inside[a, ord(c)] for c in CUT_BEFORE)}
    held = "".join(re.escape(chr(a)) for a in sorted(bad) if a < 0x80)
    held += "".join(chr(c) for c in range(0x80, 0x10000) if 0x80 | c & 0x3F in bad and not 0xD800 <= c < 0xE000)
    if any(a >= 0x80 for a in bad):
        held += "\U00010000-\U0010ffff"
    if not held:
        return f"[{s}]*[^{s}]+|[{s}]+", f"[^{s}](?=[{s}])"
    return f"[{s}]*[^{s}]+(?:(?<=[{held}])[{s}]+[^{s}]*)*|[{s}]+", f"[^{s}{held}](?=[{s}])"


def ranked_encoder(spec: dict, bytes_of: list[bytes], added: set[int]):
    """An encoder of fragments by merge ranks, which gives the same ids several times faster, or None if it may not.

    It may if the vocabulary is plain byte-level BPE with the usual split, every merge makes a higher id than the last and
    every token is a byte or made by a merge.
    """
    vocab, model = spec["model"]["vocab"], spec["model"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    plain = all(a < b for a, b in zip(made, made[1:])) and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    plain = plain and set(made) | added | {i for i, t in enumerate(bytes_of) if len(t) == 1} >= set(vocab.values())
    kinds = spec.get("pre_tokenizer") or {}
    if not plain or kinds.get("type") != "ByteLevel" or kinds.get("add_prefix_space") or not kinds.get("use_regex", True):
        return None
    import tiktoken

    ranks = {t: i for i, t in enumerate(bytes_of) if t and i not in added}
    return tiktoken.Encoding("fragments", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Fragments(dict):
    """The ids of fragments, as far as they were asked for lately: about CACHE_ENTRIES of up to CACHED_LENGTH characters."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, fragment: str) -> bytes:
        p = self.old.get(fragment) or self.encode(fragment)
        if len(fragment) <= CACHED_LENGTH:
            self[fragment] = p
        return p

    def age(self) -> None:
        if len(self) > CACHE_ENTRIES:  # the last generation stays readable, what is used of it moves on
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in vocab.items():
            if t not in added:
                self.bytes_of[i] = bytes(alphabet[c] for c in t)
        inside = inner_pairs(self.bytes_of)
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        fragment, cut = fragment_pattern(inside)
        self.frag = re.compile(fragment).findall
        self.cut = re.compile(cut)
        self.long = re.compile(f"(?s).{{{FRAGMENT},}}?{cut}|.+").findall
        # a plain text can be cut anywhere; one that holds an added token is cut around it first, as the library does
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else re.compile("((?!))")
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.marks = [t for t in added]
        self.known = Fragments(self._ids)
        ranks = ranked_encoder(spec, self.bytes_of, set(added.values()))
        self.ranked = ranks and ranks._core_bpe.encode_ordinary

    def _ids(self, fragment: str) -> bytes:
        return array("I", self.ranked(fragment) if self.ranked else self.tok.encode(fragment, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str, long: bool = False) -> bytes:
        if long and self.ranked:
            return b"".join(map(self._ids, self.long(text)))
        out = b"".join(map(self.known.__getitem__, self.frag(text)))
        self.known.age()
        return out

    def chunks(self, text: str, long: bool = False) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in pieces of about CHUNK characters.

        ``long``: only the first certain cut after each FRAGMENT characters is used, and no table, where ranks encode.
        """
        whole = self.special.split(text) if any(m in text for m in self.marks) else [text]
        for piece in whole:
            if piece in self.added:
                yield self.added[piece]
                continue
            at = 0
            while len(piece) - at > 2 * CHUNK and (m := self.cut.search(piece, at + CHUNK)):
                yield self._plain(piece[at : m.end()], long)
                at = m.end()
            if at < len(piece):
                yield self._plain(piece[at:] if at else piece, long)

    def encode(self, text: str | None, long: bool = False) -> bytes:
        return b"".join(self.chunks(text or "", long))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encoder(vocab: str) -> Encoder:
    if vocab not in _encoders:
        _encoders[vocab] = Encoder(resolve(vocab))
    return _encoders[vocab]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that few texts are Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", vocab: str = TOKENIZER) -> DataFrame:
    """Every column of ``df`` and the ids of its text as array<int>; an ``ids`` column of that name is replaced."""
    keep = [c for c in df.columns if c != ids]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        e = encoder(vocab)
        for b in slices(batches):
            made = [e.encode(t) for t in b.column(keep.index(text)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*keep, ids])

    return df.select(*(df[c] for c in keep)).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", vocab: str = TOKENIZER) -> DataFrame:
    """Every column of ``df`` and the text of its ids; null ids give null, an id outside the vocabulary an error."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches):
        e = encoder(vocab)
        for b in slices(batches):
            made = [None if x is None else e.decode(np.array(x, "<u4").tobytes()) for x in b.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*keep, text])

    return df.select(*(df[c] for c in keep)).mapInArrow(run, schema)


def digests(df: DataFrame, vocab: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding and decoding each text gives, without shipping the ids.

    A null doc_id stays null; repeated rows each give a row.
    """

    def run(batches):
        e = encoder(vocab)
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in e.chunks(t or ""):
                    n += len(part) // 4
                    ids.update(part)
                    back.update(e.decode_bytes(part))
                out.append((n, ids.hexdigest(), back.hexdigest()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
