"""Token files with directly addressable codes.

A token id is split into chunks of eight bits, lowest first.  Level 0 holds
every id's first chunk; a bitmap beside it says which ids go on, and those
ids' next chunks stand, in order, in level 1, and so on.  A rank directory
(ones before each run of 512 bits) turns a position in one level into the
position in the next, so any single token is read with one byte, one bit and
one directory entry per level, without decoding a block.

File (little-endian)::

    "DACF" | u32 levels | u64 tokens | u64 documents
    per level: u64 entries
    per level: entries bytes | bitmap, u64 words | directory, u64 entries
    documents: i64 id each | u8 is-null each | u64 first token each

Documents are written in ascending doc_id order over the files, which are
named by partition and number.  Files are limited by tokens, so a task never
holds more than one file.  A file is written under another name and renamed,
so a task that is run again leaves the same file.

Edge cases: null text counts as empty, and an empty document has only its end
id; a null doc_id comes first; equal doc_ids stand in order of their texts;
repeated rows are documents like any other; an empty table gives no file and
no row; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_cuts import byte_chars
from .common import claim, shared_path, staged

MAGIC = b"DACF"
RUN = 512                   # bits per directory entry
FILE_TOKENS = 4_000_000     # a file is closed once it holds as many
READ_TOKENS = 1_000_000     # read back at a time


def filesystem(uri: str):
    """The file system and path of a URI, for Python on any machine."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data) -> None:
    """Write a file under another name, then rename it."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{os.urandom(6).hex()}.part"
    with system.open_output_stream(part) as f:
        for x in data if isinstance(data, list) else [data]:
            f.write(x)
    system.move(part, path)


def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks, bitmap words, directory."""
    out, rest = [], np.asarray(ids, np.uint32)
    while True:
        on = rest > 0xFF
        words = np.zeros(-(-len(rest) // 64) * 8, np.uint8)
        bits = np.packbits(on, bitorder="little")
        words[:len(bits)] = bits
        words = words.view("<u8")
        ones = np.bitwise_count(words).astype(np.uint64)
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        out.append(((rest & 0xFF).astype(np.uint8), words, before[:-1][:: RUN // 64] if len(words) else before[:0]))
        rest = rest[on] >> 8
        if not len(rest):
            return out


def build(docs: list, ids: list[np.ndarray]) -> list[bytes]:
    """The parts of one file."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    parts = levels(flat)
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).astype("<u8") if ids else np.empty(0, "<u8")
    out = [MAGIC, np.uint32(len(parts)).tobytes(), np.array([len(flat), len(docs)], "<u8").tobytes(),
           np.array([len(c) for c, *_ in parts], "<u8").tobytes()]
    for chunk, words, directory in parts:
        out += [chunk.tobytes(), words.tobytes(), directory.astype("<u8").tobytes()]
    return [*out, np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is None for d in docs], np.uint8).tobytes(), first.tobytes()]


class Reader:
    """Random access to one file; only what is asked for is read."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.f = system.open_input_file(path)
        head = self._at(0, 24)
        if head[:4] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        count = int(np.frombuffer(head, "<u4", 1, 4)[0])
        self.tokens, self.documents = (int(x) for x in np.frombuffer(head, "<u8", 2, 8))
        at = 24 + 8 * count
        self.level = []
        for n in np.frombuffer(self._at(24, 8 * count), "<u8").astype(int).tolist():
            words = -(-n // 64)
            runs = -(-words // (RUN // 64))
            self.level.append((n, at, at + n, at + n + 8 * words))
            at += n + 8 * words + 8 * runs
        self.tail = at

    def _at(self, offset: int, size: int) -> bytes:
        return self.f.read_at(size, offset)

    def directory(self) -> tuple[list, np.ndarray]:
        """Document ids and the first token of each, with the end appended."""
        n = self.documents
        raw = self._at(self.tail, 17 * n)
        ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        first = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        return [None if x else int(i) for i, x in zip(ids, null)], np.append(first, self.tokens)

    def rank(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        n, _, words, directory = self.level[level]
        if i <= 0:
            return 0
        run = min(i, n - 1) // RUN
        before = int(np.frombuffer(self._at(directory + 8 * run, 8), "<u8")[0])
        k = i - run * RUN
        raw = np.frombuffer(self._at(words + run * RUN // 8, 8 * -(-k // 64)), np.uint8)
        return before + int(np.unpackbits(raw, bitorder="little", count=k).sum())

    def read(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """Tokens ``start`` to ``stop``."""
        if stop <= start:
            return np.empty(0, np.uint32)
        _, chunks, words, _ = self.level[level]
        out = np.frombuffer(self._at(chunks + start, stop - start), np.uint8).astype(np.uint32)
        word = start // 64
        raw = np.frombuffer(self._at(words + 8 * word, 8 * (-(-stop // 64) - word)), np.uint8)
        on = np.unpackbits(raw, bitorder="little")[start - 64 * word:stop - 64 * word].astype(bool)
        if on.any():
            r = self.rank(level, start)
            out[on] |= self.read(r, r + int(on.sum()), level + 1) << 8
        return out

    def token(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


_TOKENIZERS: dict = {}


class WordEncoder:
    """The tokenizers library over a text's words.  The vocabulary drops white
    space and never joins over it, so each piece between white space is
    encoded by itself and remembered.  New words go through the library in one
    call, with a special token between them, whose id tells them apart."""

    MEMO = 1_000_000
    # letters whose lower case and composed form are single letters of the same range
    plain = staticmethod(re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,!?;:]?)").fullmatch)
    odd = staticmethod(re.compile("[\x1c-\x1f]").search)     # white space to str.split() alone

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content for t in self.tok.get_added_tokens_decoder().values() if t.special and not t.normalized}
        self.mark = min(self.special, default=None)
        self.memo: dict[str, bytes] = {}
        chars = {b: c for c, b in byte_chars().items()}
        self.spell = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}
        self.marks = {m: np.array(self.tok.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ["", *".,!?;:"]}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words, as bytes.  Words of Latin letters, with a
        mark behind them or without, are lower-cased and spelled in bytes here
        and go to the library's BPE model; all others through its pipeline."""
        others, model, memo, marks = [], self.tok.model.tokenize, self.memo, self.marks
        for w in words:
            m = self.plain(w)
            if m is None:
                others.append(w)
            else:
                low = m[1].lower()
                ids = [t.id for t in model(low if low.isascii() else low.translate(self.spell))]
                memo[w] = array("I", ids).tobytes() + marks[m[2]]
        alone = [w for w in others if self.mark is None or any(t in w for t in self.special)]
        for w, e in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False)):
            memo[w] = np.array(e.ids, "<u4").tobytes()
        rest = [w for w in others if w not in memo]
        if rest:
            ids = np.array(self.tok.encode(self.mark.join(rest), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.tok.token_to_id(self.mark)), len(ids))
            raw, at = ids.tobytes(), 0
            for w, end in zip(rest, (4 * ends).tolist()):
                memo[w] = raw[at:end]
                at = end + 4

    def encode(self, texts: list[str], end: int | None) -> list[np.ndarray]:
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        split = [re.split(r"[\t-\r ]+", t) if self.odd(t) else t.split() for t in texts]
        self.learn(list(set().union(*split).difference(self.memo)))
        last = b"" if end is None else np.array([end], "<u4").tobytes()
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + last, "<u4") for words in split]


def word_encoder(path: str) -> WordEncoder:
    claim("dac", _TOKENIZERS)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordEncoder(path)
    return _TOKENIZERS[path]


def write(docs: DataFrame, vocabulary: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode and write all documents; returns the files: uri, partition,
    number, tokens, documents."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = (src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
           .select(F.col("doc_id").cast("string").alias("doc_id"), "text"))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = word_encoder(vocabulary)
        ids, coded, held, number = [], [], 0, 0

        def close():
            uri = f"{folder}/part-{part:06d}-{number:06d}.dac"
            put(uri, build(ids, coded))
            return pd.DataFrame([(uri, part, number, held, len(ids))], columns=["uri", "part", "number", "tokens", "documents"])

        for b in batches:
            texts = b["text"].tolist()
            keys = [None if i is None else int(i) for i in b["doc_id"]]
            for k in range(0, len(texts), 256):
                for key, x in zip(keys[k:k + 256], enc.encode(texts[k:k + 256], end_id)):
                    ids.append(key)
                    coded.append(x)
                    held += len(x)
                    if held >= FILE_TOKENS:
                        yield close()
                        ids, coded, held, number = [], [], 0, number + 1
        if ids:
            yield close()

    return staged(src.mapInPandas(run, "uri string, part int, number int, tokens long, documents long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all read back
    from the files.  Only the sums per partition are put in order in one task;
    within a partition the files' places follow from a window over them."""
    per = files.groupBy("part").agg(F.sum("tokens").alias("t"))
    per = per.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    own = Window.partitionBy("part").orderBy("number")
    placed = (files.join(per, "part")
              .select("uri", (F.col("base") + F.sum("tokens").over(own) - F.col("tokens")).alias("base")))

    def run(batches):
        for b in batches:
            for uri, base in zip(b["uri"], b["base"]):
                r = Reader(uri)
                ids, first = r.directory()
                a = 0
                while a < len(ids):
                    z = max(a + 1, int(np.searchsorted(first, first[a] + READ_TOKENS, "right")) - 1)
                    z = min(z, len(ids))
                    flat = r.read(int(first[a]), int(first[z]))
                    at = first[a:z + 1] - first[a]
                    crc = [zlib.crc32(flat[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1], at[1:])]
                    yield pd.DataFrame({"doc_id": pd.Series(ids[a:z], dtype="Int64"), "start": base + first[a:z],
                                        "n_tokens": np.diff(at), "ids_crc32": crc})
                    a = z

    n = files.count()
    return (placed.repartition(max(1, min(n, 100_000)), "uri")
            .mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
