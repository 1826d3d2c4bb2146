"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no vocabulary token can never lie inside a
token of any encoding: between its two bytes there is a certain cut.  A text
is cut at all such pairs, each fragment is encoded on its own (and remembered,
as fragments repeat), and the fragments' ids are concatenated.  The result
equals that of encoding the whole text.

Cuts are only used where the pre-tokenizer (the word pattern below) also gives
the same pieces on both sides: before white space, and between two visible
characters of which the left is ASCII, the right starts a character and is no
apostrophe (contractions look back).  After such a cut the pattern matches the
rest as it would have in the whole text, or splits a piece exactly at a pair
that no merge can cross.

Edge cases: null text counts as empty; an empty text has no ids; a special
token's string in a text becomes its id; null ids decode to the empty text;
repeated rows, ties and clashing extra columns do not matter, as every row is
worked on by itself and only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim

#: Pre-tokenizer of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO = 100_000          # fragments remembered per worker; more only cost time
FLUSH_IDS = 1_000_000   # ids per Arrow batch handed back


def byte_chars() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def speller():
    """Text of the vocabulary file -> the bytes it stands for."""
    chars = byte_chars()
    return lambda t: bytes(chars[c] for c in t)


def special_tokens(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}


def enumerate_tokens(path: str):
    """(id, bytes) of all tokens but special ones."""
    spell, special = speller(), special_tokens(path)
    for t, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items():
        if t not in special:
            yield i, spell(t)


class Codec:
    """Encoder and decoder of one vocabulary file, built once per worker."""

    def __init__(self, path: str):
        import regex
        self.path = path
        self.special = special_tokens(path)
        self.cut = cut_table(self.token.values())
        self.quick = self.native_pieces()
        if self.quick:
            del self.token, self.id_of, self.rank       # read again if asked for
        self.pieces = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.memo = Memo(self)

    @cached_property
    def token(self) -> dict[int, bytes]:
        return dict(enumerate_tokens(self.path))

    @cached_property
    def id_of(self) -> dict[bytes, int]:
        return {b: i for i, b in self.token.items()}

    @cached_property
    def rank(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank, id of both together)."""
        spell = speller()
        merges = (m.split(" ") if isinstance(m, str) else m for m in json.load(open(self.path, encoding="utf-8"))["model"]["merges"])
        return {(self.id_of[spell(x)], self.id_of[spell(y)]): (r, self.id_of[spell(x + y)]) for r, (x, y) in enumerate(merges)}

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at its forced boundaries."""
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        at = at.tolist()
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]

    def native_pieces(self):
        """Where a token's id is also its merge rank, tiktoken's compiled loop
        encodes a fragment; else ``merge`` does.  Both give the same ids."""
        merged = [new for _, new in self.rank.values()]
        if any(a >= b for a, b in zip(merged, merged[1:])) or set(self.token) != {*range(256), *merged}:
            return None
        import tiktoken
        return tiktoken.Encoding("fragments", pat_str=PATTERN, special_tokens={},
                                 mergeable_ranks=self.id_of).encode_ordinary

    def encode_fragment(self, frag: bytes) -> tuple[int, ...]:
        if self.quick:
            return tuple(self.quick(frag.decode("utf-8")))
        return tuple(chain.from_iterable(map(self.merge, self.pieces(frag.decode("utf-8")))))

    def merge(self, piece: str) -> list[int]:
        """Lowest rank first, leftmost first, over a linked list with a heap."""
        ids = [self.id_of[bytes((b,))] for b in piece.encode("utf-8")]
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue            # one of the two has been merged since
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := rank.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (r[0], p, r[1], ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        out = []
        for k, part in enumerate(self.split(text) if self.split else [text]):
            if k % 2:
                out.append((self.special[part],))
            elif part:
                out.extend(map(self.memo.__getitem__, self.fragments(part.encode("utf-8"))))
        return np.fromiter(chain.from_iterable(out), np.int32)


class Memo(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, frag: bytes) -> tuple[int, ...]:
        ids = self[frag] = self.codec.encode_fragment(frag)
        return ids


def cut_table(tokens) -> np.ndarray:
    """For each byte pair (left * 256 + right): is a cut between them certain
    and usable."""
    free = np.ones((256, 256), bool)
    for t in tokens:
        if len(t) > 1:
            b = np.frombuffer(t, np.uint8)
            free[b[:-1], b[1:]] = False
    usable = np.zeros((256, 256), bool)
    space = [9, 10, 11, 12, 13, 32]
    usable[:, space] = True
    right = [b for b in [*range(0x21, 0x7F), *range(0xC2, 0xF5)] if b != ord("'")]
    usable[np.ix_(range(0x21, 0x7F), right)] = True
    return (free & usable).ravel()


def decoder(path: str):
    """ids -> text, from the vocabulary alone."""
    entries = dict(enumerate_tokens(path)) | {i: t.encode() for t, i in special_tokens(path).items()}
    out = [entries.get(i, b"") for i in range(max(entries) + 1)]
    return lambda ids: b"".join(map(out.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    claim("bpe", _CODECS)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the ids (array<int>) of every row's whole text."""
    src = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            got, first, n = [], 0, 0
            texts = batch.column(batch.num_columns - 1)
            for k in range(batch.num_rows):
                got.append(c.encode(texts[k].as_py()))
                n += len(got[-1])
                if n >= FLUSH_IDS or k == batch.num_rows - 1:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                    kept = batch.slice(first, len(got))
                    yield pa.RecordBatch.from_arrays([*kept.columns[:-1], col], names=[*batch.schema.names[:-1], ids])
                    got, first, n = [], k + 1, 0

    schema = T.StructType([*src.drop("__text").schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep``, the ids of every whole text, and the text decoded from
    these ids: ``encode`` and ``decode`` in one pass and one Python worker."""
    src = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches):
        c, text_of = codec(vocabulary), decoder(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got, back, first, size = [], [], 0, 0
            for k in range(batch.num_rows):
                got.append(c.encode(texts[k].as_py()))
                back.append(text_of(got[-1].tolist()))
                size += len(got[-1])
                if size >= FLUSH_IDS or k == batch.num_rows - 1:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                    kept = batch.slice(first, len(got))
                    yield pa.RecordBatch.from_arrays([*kept.columns[:-1], col, pa.array(back, pa.string())],
                                                     names=[*batch.schema.names[:-1], "ids", "text"])
                    got, back, first, size = [], [], k + 1, 0

    return src.mapInArrow(run, T.StructType([*src.drop("__text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                                             T.StructField("text", T.StringType())]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep``, the ids and the text they stand for."""
    src = df.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(ids))

    def run(batches):
        text_of = decoder(vocabulary)
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            flat, off = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
            texts = [text_of(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(text, T.StringType())]))


def digests(decoded: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Token counts and digests of a frame that ``decode`` gave."""
    return decoded.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"))
