"""Secrets in whole texts: fixed patterns, and strings that are too random to be
text.

Base spans are the leftmost, non-overlapping matches of three patterns (see
``ASSIGN``, ``ACCESS``, ``HEX``); matches that are too short are dropped.

The battery looks at every maximal run of ``[A-Za-z0-9+/_-]`` with ``SHORTEST``
or more characters (trailing ``=`` padding aside) and infers its encoding: the
smallest alphabet that holds its characters.

* Alphabet uniformity: Pearson's chi-squared over the alphabet, a linear form of
  Y, the ordered pairs of equal symbols.  Y has exact mean and variance under
  both the uniform law and the text law (symbols drawn by their frequencies in
  all documents); tails by a gamma law of these two moments.
* Runs above and below the middle of the alphabet (Wald-Wolfowitz).
* Serial correlation of neighbouring symbols.

A string is *random* if none of the three rejects uniform, independent symbols
at ``RANDOM_LEVEL``.  Its *text* p-value is the chance that text of its length
is that uniform; short strings cannot reach small ones.  A span is added for a
random string whose text p-value passes the Benjamini-Hochberg step at
``FALSE_DISCOVERY`` within its length class, over all strings of all documents
(a histogram per class that Spark sums).  It is not added where it overlaps a
base span.

Edge cases: null text is empty; texts without a match give zeros, the digest of
the empty string and '' as spans; rows are kept one to one, whatever their ids;
an empty table gives no row; extra columns are not read.  Text that is itself
uniform over an alphabet (the corpus' own digits) gives no small p-value, so
plain numbers are no secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

# Fixed values of the contract.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
NAMES = (b"passw", b"secret", b"token", b"api")     # one of them is in every ASSIGN match

SHORTEST = 16
RANDOM_LEVEL = 0.001
FALSE_DISCOVERY = 0.01
CLASSES = (16, 24, 32, 48, 64, 96, 128)             # lengths at which a class begins
BINS_PER_TEN, MOST_BINS = 20, 1000                  # histogram of -log10 p

_DIGIT, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets in the order of their symbols' values, the smaller first.
ENCODINGS = (
    ("decimal", _DIGIT), ("hex", _DIGIT + b"abcdef"), ("HEX", _DIGIT + b"ABCDEF"), ("lower", _LOWER), ("upper", _UPPER),
    ("base32", _UPPER + b"234567"), ("lower36", _DIGIT + _LOWER), ("upper36", _DIGIT + _UPPER), ("letters", _UPPER + _LOWER),
    ("base62", _UPPER + _LOWER + _DIGIT), ("base64", _UPPER + _LOWER + _DIGIT + b"+/"), ("base64url", _UPPER + _LOWER + _DIGIT + b"-_"),
    ("any", _UPPER + _LOWER + _DIGIT + b"+/-_"),
)
_RUN = bytes(120 if bytes([c]) in ENCODINGS[-1][1] else 32 for c in range(256))
_HEX = bytes(120 if bytes([c]) in ENCODINGS[1][1] else 32 for c in range(256))


def runs_of(raw: bytes, table: bytes, shortest: int):
    """(start, end) of the maximal runs of a table's bytes."""
    mask, want, at = raw.translate(table), b"x" * shortest, 0
    while (at := mask.find(want, at)) >= 0:
        end = mask.find(b" ", at)
        end = len(mask) if end < 0 else end
        yield at, end
        at = end


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) in bytes, sorted."""
    found, low = [], raw.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[2]) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if len(m[0]) >= ACCESS_LENGTH]
    found += [(s, e, 2) for s, e in runs_of(raw, _HEX, HEX_LENGTH)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def encoding(run: bytes) -> int:
    return next(i for i, (_, alphabet) in enumerate(ENCODINGS) if not run.translate(None, alphabet))


def _normal_log10(z: float) -> float:
    """log10 of the lower normal tail."""
    p = 0.5 * math.erfc(-z / math.sqrt(2))
    return math.log10(p) if p > 1e-300 else -300.0


def _tail(y: float, mean: float, var: float) -> float:
    """Normal deviate of y under a gamma law of that mean and variance."""
    if mean <= 0 or var <= 0:
        return 0.0
    shape = mean * mean / var
    return 3 * math.sqrt(shape) * ((max(y, 0.0) / mean) ** (1 / 3) - 1 + 1 / (9 * shape))


def _moments(n: int, s2: float, s3: float) -> tuple[float, float]:
    """Mean and variance of the ordered equal pairs among n drawn symbols."""
    return n * (n - 1) * s2, 2 * n * (n - 1) * (s2 - s2 * s2) + 4 * n * (n - 1) * (n - 2) * max(0.0, s3 - s2 * s2)


class Battery:
    """``law``: how often each byte value occurs in all documents."""

    def __init__(self, law):
        self.law = []
        for _, alphabet in ENCODINGS:
            q = np.array([law[c] + 1.0 for c in alphabet])
            q /= q.sum()
            self.law.append((float((q ** 2).sum()), float((q ** 3).sum())))
        self.text = lru_cache(100_000)(self._text)

    def _text(self, kind: int, n: int, y: int) -> float:
        """log10 of the chance that text of n symbols has at most y equal pairs
        (y is even, so y + 1 is the middle of its step)."""
        return _normal_log10(_tail(y + 1, *_moments(n, *self.law[kind])))

    @staticmethod
    def random(run: bytes, kind: int, y: int) -> bool:
        """Whether no test rejects uniform, independent symbols."""
        alphabet, n = ENCODINGS[kind][1], len(run)
        k = len(alphabet)
        level = math.log10(RANDOM_LEVEL)
        if _normal_log10(-_tail(y - 1, *_moments(n, 1 / k, 1 / k ** 2))) < level:
            return False
        x = np.array([alphabet.index(c) for c in run], dtype=float)
        up = x >= k / 2
        high = int(up.sum())
        mean = 2 * high * (n - high) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        if var <= 0 or _normal_log10(-abs(1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(var)) < level - math.log10(2):
            return False
        x -= x.mean()
        square = float(x @ x)
        return square > 0 and _normal_log10(-abs(float(x[1:] @ x[:-1]) / square + 1 / n) * math.sqrt(n)) >= level - math.log10(2)

    def candidates(self, raw: bytes):
        """start, end in bytes, length class and bin of -log10 of the text
        p-value (-1: not random) of every string that is tested."""
        for s, e in runs_of(raw, _RUN, SHORTEST):
            run = raw[s:e]
            kind = encoding(run)
            counts = np.bincount(np.frombuffer(run, np.uint8), minlength=1) if e - s > 256 else [run.count(c) for c in set(run)]
            y = int(sum(int(c) * (int(c) - 1) for c in counts))
            p = self.text(kind, e - s, y)
            place = min(MOST_BINS, int(-p * BINS_PER_TEN))
            yield s, e, length_class(e - s), place if place >= BINS_PER_TEN and self.random(run, kind, y) else -1


def byte_law(docs: DataFrame) -> list[int]:
    """How often each byte value occurs in all texts."""
    def run(batches):
        for batch in batches:
            total = np.zeros(256, np.int64)
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    total += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
            seen = np.flatnonzero(total)
            yield pa.record_batch({"byte": pa.array(seen, pa.int32()), "n": pa.array(total[seen])})
    rows = docs.select("text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    law = [0] * 256
    for r in rows:
        law[r.byte] = r.n
    return law


def _places(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    out, at, points = {}, 0, 0
    for o in sorted(set(offsets)):
        points += len(raw[at:o].decode("utf-8", "surrogatepass"))
        out[o], at = points, o
    return out


SCANNED = "doc_id long, starts array<int>, ends array<int>, kinds array<int>, classes array<int>, places array<int>"


def scan(docs: DataFrame, law: list[int]) -> DataFrame:
    """doc_id and spans in code points: base ones (class -1), then every tested
    string with its length class and place in the histogram."""
    shared = docs.sparkSession.sparkContext.broadcast(law)

    def run(batches):
        battery = Battery(shared.value)
        for batch in batches:
            columns = [[], [], [], [], []]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                raw = text or b""
                rows = [(s, e, k, -1, 0) for s, e, k in base_spans(raw)]
                rows += [(s, e, 3, c, place) for s, e, c, place in battery.candidates(raw)]
                at = _places(raw, [o for r in rows for o in r[:2]])
                for i, column in enumerate(columns):
                    column.append([at[r[i]] if i < 2 else r[i] for r in rows])
            lists = pa.list_(pa.int32())
            yield pa.record_batch({"doc_id": batch.column(0), **{name: pa.array(c, lists) for name, c in zip(("starts", "ends", "kinds", "classes", "places"), columns)}})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)


def cuts(scanned: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Benjamini-Hochberg per length class: the smallest passing place of the
    histogram; a class in which none passes is absent."""
    each = scanned.select(F.inline(F.arrays_zip("classes", "places"))).where("classes >= 0")
    found = each.groupBy("classes", "places").count().collect()         # classes x bins at most
    out = {}
    for c in {r.classes for r in found}:
        at = {r.places: r["count"] for r in found if r.classes == c}
        tested, passed = sum(at.values()), 0
        for place in sorted((p for p in at if p >= 0), reverse=True):
            passed += at[place]
            if tested * 10 ** (-place / BINS_PER_TEN) <= rate * passed:
                out[c] = place
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    scanned = staged(scan(docs, byte_law(docs)), "secrets")
    least = scanned.sparkSession.sparkContext.broadcast(cuts(scanned))

    def run(batches):
        least_place = least.value
        for batch in batches:
            out = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
            for row in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "kinds", "classes", "places"))):
                every = list(zip(*row))
                base = [(s, e, k) for s, e, k, c, _ in every if c < 0]
                more = [(s, e, k) for s, e, k, c, place in every if c in least_place and place >= least_place[c]
                        and not any(s < f and b < e for b, f, _ in base)]
                text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))
                for i in range(3):
                    out[f"n_{KINDS[i]}"].append(sum(k == i for *_, k in base))
                out["base_sha256"].append(hashlib.sha256(text(base).encode()).hexdigest())
                out["spans"].append(text(base + more))
                out["n_random"].append(len(more))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **{k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()}})

    return scanned.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
