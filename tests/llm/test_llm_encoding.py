"""op2 and op7: exact against the tokenizers library, round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from llm_helpers import ODD, docs_frame  # noqa: E402

from panelcast.llm import bpe_cuts, dac_files, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary(name))


@pytest.fixture(scope="module")
def codec():
    return bpe_cuts.Codec(queries.vocabulary("byte_bpe_50k.json"))


def test_forced_pairs_lie_in_no_token(codec):
    cut = codec.cut.reshape(256, 256)
    assert cut.sum() > 1000
    assert not any(cut[a, b] for t in codec.token.values() for a, b in zip(t, t[1:]))


def test_fragments_encode_as_the_whole(codec):
    tok = library("byte_bpe_50k.json")
    r = random.Random(3)
    some = [*" \n\t\r'sStreldvm.,!ab9é中ßİ😀​ 　\u0085\x1c\x1f\x00\x7f́", "<|endoftext|>", "  ", "\n\n", "'re", " '"]
    for _ in range(4000):
        s = "".join(r.choice(some) for _ in range(r.randrange(16)))
        assert codec.encode(s).tolist() == tok.encode(s, add_special_tokens=False).ids, repr(s)


def test_own_merge_equals_the_compiled_loop(codec):
    for piece in (" the", "antidisestablishmentarianism", "ababababab", "ß中文", "!!!!!!!", "x", "a" * 3000):
        assert codec.merge(piece) == list(codec.quick(piece))


def test_op2_rows(spark):
    tok = library("byte_bpe_50k.json")
    path = queries.vocabulary("byte_bpe_50k.json")
    docs = docs_frame(spark, ODD)
    got = bpe_cuts.digests(bpe_cuts.decode(bpe_cuts.encode(docs, path), path)).collect()
    want = []
    for i, t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    one_pass = bpe_cuts.digests(bpe_cuts.round_trip(docs, path)).collect()
    assert sorted(map(str, map(tuple, one_pass))) == sorted(map(str, want))
    assert bpe_cuts.round_trip(docs.limit(0), path).count() == 0
    assert bpe_cuts.encode(docs.limit(0), path).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe_cuts.decode(none, path).first()["text"] == ""


def check_tokens(spark, docs, rows):
    tok = library("word_bpe_49k.json")
    files = dac_files.write(docs, queries.vocabulary("word_bpe_49k.json"), end_id=2)
    got = [tuple(r) for r in dac_files.read(files).collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    return files


def test_words_encode_as_the_library_does():
    tok, enc = library("word_bpe_49k.json"), dac_files.word_encoder(queries.vocabulary("word_bpe_49k.json"))
    r = random.Random(5)
    some = [*"aAbßéÉÖüÿŸİıſŒĳΣσς中.,!'-:; \n\t\x1c\x85\u00a0\u0301\u00d7\u00f7ª", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "The", "ch"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(4000)]
    for t, ids in zip(texts, enc.encode(texts, 2)):
        assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_op7_rows(spark, monkeypatch):
    check_tokens(spark, docs_frame(spark, ODD), ODD)
    assert dac_files.read(dac_files.write(docs_frame(spark, []), queries.vocabulary("word_bpe_49k.json"), end_id=2)).count() == 0


def test_op7_whole_table(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_tokens(spark, d, [(r.doc_id, r.text) for r in d.collect()])


def test_directly_addressable_codes(tmp_path):
    r = np.random.default_rng(1)
    ids = [r.integers(0, 1 << int(b), int(n)).astype(np.uint32) for b, n in zip((8, 16, 24, 31, 9, 1), (700, 0, 1500, 513, 64, 1))]
    uri = f"file://{tmp_path}/one.dac"
    dac_files.put(uri, dac_files.build([5, None, 7, 8, 9, 10], ids))
    f = dac_files.Reader(uri)
    names, first = f.directory()
    assert names == [5, None, 7, 8, 9, 10]
    flat = np.concatenate(ids)
    assert f.tokens == len(flat) and (f.read(0, len(flat)) == flat).all()
    for i in r.integers(0, len(flat), 200):
        assert f.token(int(i)) == flat[i]
    for a, b in zip(first, first[1:]):
        assert (f.read(int(a), int(b)) == flat[a:b]).all()
