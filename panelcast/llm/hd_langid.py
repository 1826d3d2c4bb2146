"""Language ID by hyperdimensional profiles.

Each letter has a random +-1 vector, drawn from its code point.  A trigram's
vector binds (multiplies) its letters' vectors, each permuted (rotated) by its
place; a text's vector bundles (adds) those of its trigrams, and a language's
prototype bundles the unit vectors of its learning texts.  The prediction is
the language of largest cosine; the score is that cosine, cut to 0..1.

Texts are lower-cased; every run of characters that are no letters counts as
one blank, with a blank at both ends.

Edge cases: a null text or one without letters is ``und`` with score 0; with no
language learned every text is ``und``; equal cosines go to the language first
in the alphabet; learning rows with null lang, null text or no letter are left
out; a null id counts as not held out.  Prototypes are summed as integers, so
neither row order nor partitioning changes them.

Learning reads at most about ``max_train`` texts of each language, chosen by a
hash of the id after the languages' rows are counted, so a rare language keeps
its rows at any size; prediction reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, fresh, held_out, maybe_broadcast

DIM = 512
MAX_TRAIN = 5_000       # of each language
MIN_SCORE = 0.05        # below, a text is in no learned language (the noise of DIM is 0.04)
UNIT = 1 << 20          # prototypes are sums of unit vectors in this fixed point
CELLS = 4_000_000       # of the table letters x letter pairs held at a time

_LETTER = None
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def letter_vector(code: int, dim: int) -> np.ndarray:
    key = (code, dim)
    if key not in _VECTORS:
        if len(_VECTORS) > 20_000:
            _VECTORS.clear()
        bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, dim)
        _VECTORS[key] = (2 * bits - 1).astype(np.float32)
    return _VECTORS[key]


def symbols(text: str | None) -> np.ndarray:
    """Code points of the letters, with one blank (0) for all between them and
    at both ends; empty without letters."""
    if not text:
        return np.empty(0, np.int64)
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    a = np.where(letters()[a], a, 0)
    keep = a != 0
    if not keep.any():
        return np.empty(0, np.int64)
    keep[1:] |= a[:-1] != 0
    a = a[keep]
    return np.concatenate([[0], a, [0]] if a[0] and a[-1] else [[0], a] if a[0] else [a, [0]] if a[-1] else [a])


def profile(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """The text's bundled trigram vector; None without letters."""
    s = symbols(text)
    if len(s) < 3:
        return None
    names, s = _number(s)
    k = len(names)
    grams, count = np.unique((s[1:-1] * k + s[2:]) * k + s[:-2], return_counts=True)
    pair, first = grams // k, grams % k
    new = np.empty(len(pair), bool)
    new[:1], new[1:] = True, pair[1:] != pair[:-1]
    row, pairs = np.cumsum(new) - 1, pair[new]
    twice = np.roll(_matrix(names, dim), 2, axis=1)
    out = np.zeros(dim, np.float64)
    step = max(1, CELLS // max(k, dim))
    for a in range(0, len(pairs), step):
        p = pairs[a:a + step]
        here = (row >= a) & (row < a + step) if len(pairs) > step else slice(None)
        table = np.zeros((k, len(p)), np.float32)
        table[first[here], row[here] - a] = count[here]
        out += (twice * (table @ _pair_vectors(names, p // k, p % k, dim))).sum(axis=0)
    return out


def _number(s: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
    """The letters that occur, and each symbol as its place among them."""
    top = int(s.max()) + 1
    if top > 0x3000:
        names, s = np.unique(s, return_inverse=True)
        return tuple(names.tolist()), s
    seen = np.zeros(top, np.int64)
    seen[s] = 1
    names = np.flatnonzero(seen)
    seen[names] = np.arange(len(names))
    return tuple(names.tolist()), seen[s]


def _matrix(names, dim: int) -> np.ndarray:
    return np.stack([letter_vector(c, dim) for c in names])


_PAIRS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SMALL = 0x250          # pairs of letters below this code point are kept bound


def _pair_vectors(names, middle, last, dim: int) -> np.ndarray:
    """The middle letter's vector, rotated by one, times the last letter's."""
    names = np.asarray(names)
    mid, end = names[middle], names[last]
    if names[-1] >= _SMALL:
        base = _matrix(names, dim)
        return np.roll(base, 1, axis=1)[middle] * base[last]
    if dim not in _PAIRS:
        _PAIRS[dim] = (np.full(_SMALL * _SMALL, -1, np.int32), np.empty((0, dim), np.float32))
    place, rows = _PAIRS[dim]
    code = mid * _SMALL + end
    todo = code[place[code] < 0]
    if len(todo):
        if len(rows) > 20_000:
            place[:], rows, todo = -1, rows[:0], code
        place[todo] = len(rows) + np.arange(len(todo))
        more = np.stack([np.roll(letter_vector(int(c) // _SMALL, dim), 1) * letter_vector(int(c) % _SMALL, dim) for c in todo])
        rows = np.concatenate([rows, more])
        _PAIRS[dim] = (place, rows)
    return rows[place[code]]


def sample_languages(rows: DataFrame, bound: int) -> DataFrame:
    """All rows of a language that has at most ``bound``, else those whose id
    hashes below bound / count: the same rows however the input is partitioned."""
    share = rows.groupBy("lang").agg(F.floor(F.lit(bound) / F.count("*") * (1 << 30)).alias("share"))
    share = share.select(F.col("lang").alias("known"), "share")
    return (rows.join(maybe_broadcast(share, share.count()), F.col("lang") == F.col("known"))
            .where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share")))


def learn(docs: DataFrame, dim: int = DIM, max_train: int = MAX_TRAIN,
          modulus: int = 4, rest: int = 2) -> dict[str, np.ndarray]:
    """Prototype of each language in the rows that are not held out.  Only sums
    per task and language (``dim`` numbers each) are shuffled and collected."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(modulus, rest))
    rows = sample_languages(rows, max_train).select("lang", "text")

    def bundle(batches):
        claim("langid", _PAIRS, _VECTORS)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                v = profile(text, dim)
                n = 0 if v is None else np.linalg.norm(v)
                if n:
                    sums.setdefault(lang, np.zeros(dim, np.int64))
                    sums[lang] += np.rint(v * (UNIT / n)).astype(np.int64)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "i": np.arange(dim), "x": v})

    total = (rows.mapInPandas(bundle, "lang string, i int, x long")
             .groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas())
    out = {}
    for lang, part in total.groupby("lang"):
        v = np.zeros(dim)
        v[part["i"].to_numpy()] = part["x"].to_numpy()
        if np.linalg.norm(v):
            out[lang] = v / np.linalg.norm(v)
    return out


def predictor(prototypes: dict[str, np.ndarray], dim: int = DIM):
    """A vectorised function text -> struct(lang_pred, score)."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dim))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        claim("langid", _PAIRS, _VECTORS)
        langs, scores = [], []
        for t in texts:
            v = profile(t, dim) if names else None
            n = 0 if v is None else np.linalg.norm(v)
            if not n:
                langs.append("und")
                scores.append(0.0)
                continue
            cos = matrix @ v / n
            k = int(np.argmax(cos))
            langs.append(names[k])
            scores.append(float(min(1.0, max(0.0, cos[k]))))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM,
             modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    src = docs.select("doc_id", "text")
    return (src.withColumn("__p", predictor(prototypes, dim)("text"))
            .select("doc_id", held_out(modulus, rest).alias("held_out"), "__p.lang_pred", "__p.score"))


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, in a learned language; where none is
    learned, those with a letter."""
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    p = fresh(docs, "language")
    return docs.withColumn(p, predictor(prototypes)("text")).where((F.col(p)["lang_pred"] != "und") & (F.col(p)["score"] >= least)).drop(p)
