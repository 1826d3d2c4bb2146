"""How far the sources of each language differ in their use of terms.

Terms are runs of characters other than ASCII non-letters, with A-Z (only)
lower-cased.  Null text, lang and source count as the empty string.  A language
keeps the terms that occur in at least ``MIN_DOCS`` of its documents.

1. All terms of all documents are counted once per (lang, source): inside each
   Arrow batch, where the terms that a group has n times in d documents are one
   bag, then by Spark's aggregate over groups and terms, so a source with a third
   of all rows costs no task more than another.  A term is tagged with its
   language, so that frequencies and vocabularies of the languages stay apart.
2. Spark's ``CountVectorizer`` (minDF = ``MIN_DOCS``, the largest integer as
   vocabSize) learns the vocabulary of every language in one fit: it gets every
   term in as many rows as documents have it (up to ``MIN_DOCS``, which decides as
   all of them would).  A group's term is kept if the model's vector of it is not
   empty.  A vocabulary above ``MAX_VOCABULARY`` terms (estimated from a 64th of
   the terms over all documents) is dealt by a hash of the term into as many
   slices as needed, each with a fit of its own: neither driver nor executors
   hold more than about one slice.
3. Smoothed shares p = 1 + floor(SCALE * (count + 5) / (N + 5 V)) differ from a
   group's constant p0 (count 0) on its own terms only.  So the distance of two
   groups g and s over all V terms is
   ``V |p0g - p0s| + A(g, s) + A(s, g) + C(g, s)``, where A sums
   ``|p - p0s| - |p0g - p0s|`` over g's own terms (from how many of them have
   which count) and C corrects the terms that both have.  C comes from sparse
   rows, one per term with the groups that have it; tasks add it up per pair
   with NumPy and emit sums, never pairs per term.

All numbers are integers.  Edge cases: an empty table gives no row; a group
without kept terms has N = 0 and takes part in every pair; a language with no
kept term gives value 0 to each pair; repeated rows count as rows; ties go to
the smaller item in UTF-8 order; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_path, staged

MIN_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP = 50
MAX_VOCABULARY = 2_000_000
MAX_INT = 2**31 - 1
SIZING = 64             # one in so many terms is counted to size the slices
PAIRS = 2_000_000       # pairs of entries that a task holds at a time
TAG = b":"              # between the language (in hex) and the term; never part of either


#: Bytes of terms (A-Z lower-cased) stay; all others become spaces.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every term of every text, in order: its row and its number among the
    batch's distinct terms; and those."""
    if not len(texts):
        return np.empty(0, np.int32), np.empty(0, np.int32), pa.array([], pa.binary())
    texts = texts.cast(pa.binary())
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = _BYTES[np.frombuffer(values, np.uint8)[at[0]:at[-1]]] if values else np.empty(0, np.uint8)
    at -= at[0]
    inside = data != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = at[at < len(data)], at[at > 0] - 1          # a term ends where its text does
    first[starts], last[ends] = inside[starts], inside[ends]
    first, size = np.flatnonzero(first), np.flatnonzero(last)
    del last
    size += 1
    size -= first
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(first, at)))
    bounds = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=bounds[1:])
    data = data[inside]
    del first, size, inside
    found = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return row, np.asarray(found.indices), found.dictionary


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and how often each occurs.  Sorts the
    given array."""
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.diff(first, append=len(key))


def _lists(langs: pa.Array, lang: np.ndarray, terms: pa.Array, term: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Lists (by their bounds) of terms, each behind its language's tag."""
    tags = pa.array([x.encode().hex().encode() + TAG for x in langs.to_pylist()], pa.binary())
    flat = pc.binary_join_element_wise(tags.take(pa.array(lang)), terms.take(pa.array(term)), b"")
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.cast(pa.string()))


def plain(docs: DataFrame) -> DataFrame:
    """lang, source and text, nulls as empty strings."""
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _document_frequencies(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """A batch's tagged terms, and how many of its documents have each."""
    row, code, terms = split(batch.column("text"))
    langs = batch.column("lang").dictionary_encode()
    key, _ = _counted((row.astype(np.int64) << 32) | code)
    key, n = _counted((np.asarray(langs.indices).astype(np.int64)[key >> 32] << 32) | (key & MAX_INT))
    return _lists(langs.dictionary, key >> 32, terms, key & MAX_INT, np.array([0, len(key)])).flatten(), n


def frequencies(min_docs: int):
    """Of every batch rows whose j-th holds the terms that j or more documents
    have.  A term is in as many rows as documents, which is what the fit counts;
    rows past ``min_docs`` could not change whether it is kept.  A batch holds
    documents, or tagged terms and how many documents have each (docs)."""
    def run(batches):
        for batch in batches:
            terms, n = (batch.column("tagged"), np.asarray(batch.column("docs"))) if "docs" in batch.schema.names else _document_frequencies(batch)
            order, n = np.argsort(-n, kind="stable"), np.minimum(n, min_docs)
            size = [int((n > j).sum()) for j in range(n.max(initial=0))]
            at = np.concatenate([order[:k] for k in size]) if size else order
            yield pa.record_batch({"terms": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), terms.take(pa.array(at)))})

    return run


def bags(batches):
    """lang, source, n, docs and the terms that a batch's documents of that
    group have n times together, in docs of them.  Every term of every document
    is counted."""
    for batch in batches:
        row, code, terms = split(batch.column("text"))
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
        _, group = np.unique(group, return_inverse=True)       # at most as many as rows
        few, most = max(1, len(terms)), max(1, batch.num_rows)
        key = group[row]                                       # one array, changed in place: it is as long as all terms
        for by, more in ((few, code), (most, row)):
            key *= by
            key += more
        del row, code, more
        key, times = _counted(key)
        row, key = key % most, key // most
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        n, docs = np.add.reduceat(times, first) if len(key) else times, np.diff(first, append=len(key))
        row, code, group = row[first], key[first] % few, key[first] // few
        order = np.lexsort((docs, n, group))
        row, code, group, n, docs = (x[order] for x in (row, code, group, n, docs))
        new = (group[1:] != group[:-1]) | (n[1:] != n[:-1]) | (docs[1:] != docs[:-1])
        first = np.flatnonzero(np.r_[True, new]) if len(code) else np.empty(0, np.int64)
        one = pa.array(row[first])                             # a document of the group
        yield pa.record_batch({"lang": batch.column("lang").take(one), "source": batch.column("source").take(one),
                               "n": pa.array(n[first], pa.int64()), "docs": pa.array(docs[first], pa.int64()),
                               "terms": _lists(langs.dictionary, np.asarray(langs.indices)[row], terms, code, np.append(first, len(code)))})


def tally(docs: DataFrame) -> DataFrame:
    """source, tagged, count and docs of every term of every (lang, source):
    its occurrences there, and how many documents have it."""
    rows = plain(docs).mapInArrow(bags, "lang string, source string, n long, docs long, terms array<string>")
    each = rows.select("source", "n", "docs", F.explode("terms").alias("tagged"))
    # Counted inside batches already, so summed behind the shuffle only.
    return each.repartition("source", "tagged").groupBy("source", "tagged").agg(F.sum("n").alias("count"), F.sum("docs").alias("docs"))


def slices(docs: DataFrame, min_docs: int, most: int, counted: DataFrame | None = None) -> int:
    """Number of vocabulary slices of at most about ``most`` terms: kept terms
    are counted among one in ``SIZING`` of all terms, over all documents.
    ``counted``: the documents' ``tally``, if at hand."""
    few = (tally(docs) if counted is None else counted).where(F.crc32(F.col("tagged").cast("binary")) % SIZING == 0)
    kept = few.groupBy("tagged").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).count()
    return max(1, -(-kept * SIZING // most))


def count_terms(docs: DataFrame, min_docs: int = MIN_DOCS, most: int = MAX_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(lang, term) of every kept term, and lang, source, term, count of every
    kept term that occurs in the group."""
    spark = docs.sparkSession
    counted = staged(tally(docs), "divergence-terms")
    n = slices(docs, min_docs, most, counted)
    mark = TAG.decode()
    term = F.substring_index("tagged", mark, -1).alias("term")
    lang = F.decode(F.unhex(F.substring_index("tagged", mark, 1)), "UTF-8").alias("lang")
    counts = vocabulary = None
    for i in range(n):
        part = counted if n == 1 else counted.where(F.pmod(F.xxhash64("tagged"), F.lit(n)) == i)
        held = part.groupBy("tagged").agg(F.sum("docs").alias("docs")).mapInArrow(frequencies(min_docs), "terms array<string>")
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=MAX_INT).fit(held)
        path = shared_path(spark, "divergence-vocabulary")
        model.save(path)
        terms = spark.read.parquet(f"{path}/data").select(F.explode("vocabulary").alias("tagged")).select(lang, term)
        sums = (model.transform(part.withColumn("terms", F.array("tagged"))).where(F.size(F.unwrap_udt("vector").getField("indices")) > 0)
                .select(lang, "source", term, "count"))
        counts = sums if counts is None else counts.unionByName(sums)
        vocabulary = terms if vocabulary is None else vocabulary.unionByName(terms)
    return vocabulary, counts


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (n + PRIOR * v)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")
    return F.call_function("div", top, (n + PRIOR * v).cast("decimal(19,0)")) + 1


def _groups(docs: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, no (from 0 per lang), n, v, p0 of every group."""
    size = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    total = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    out = (docs.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(size, "lang", "left")
           .select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v")))
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return out.select("lang", "source", no.alias("no"), "n", "v",
                      F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v"))).otherwise(zero).alias("p0"))


def shared_terms(batches):
    """C per lang and pair (a < b), one row per pair and chunk, from rows of
    lang and ent: the groups that have a term, as (no, p, p0) by no."""
    for batch in batches:
        lang, ent = batch.column("lang").dictionary_encode(), batch.column("ent")
        start, code = np.asarray(ent.offsets), np.asarray(lang.indices)
        start, size = start[:-1] - start[0], np.diff(start)
        flat = ent.flatten()
        own = [np.asarray(flat.field(name)).astype(np.int64) for name in ("no", "p", "p0")]
        for k in np.unique(size):
            for which in range(len(lang.dictionary)):
                rows = np.flatnonzero((size == k) & (code == which))
                step = max(1, PAIRS // int(k))
                for lo in range(0, len(rows), step):
                    at = start[rows[lo:lo + step], None] + np.arange(k)
                    for pair, c in _pairs(*(x[at] for x in own)):
                        yield pa.record_batch({"lang": pa.array([lang.dictionary[which].as_py()] * len(c), pa.string()),
                                               "a": pa.array(pair >> 31, pa.int32()), "b": pa.array(pair & MAX_INT, pa.int32()), "c": pa.array(c)})


def _pairs(no, p, p0):
    """Sums per pair (a * 2**31 + b) over terms that k groups each have: arrays
    of terms x k, worked on by the distance of two entries in their row."""
    keys, values, held = [], [], 0
    for d in range(1, no.shape[1]):
        x, y = slice(None, -d), slice(d, None)
        keys.append(((no[:, x] << 31) | no[:, y]).ravel())
        values.append((np.abs(p[:, x] - p[:, y]) - np.abs(p[:, x] - p0[:, y]) - np.abs(p0[:, x] - p[:, y]) + np.abs(p0[:, x] - p0[:, y])).ravel())
        held += keys[-1].size
        if held >= PAIRS or d == no.shape[1] - 1:
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            yield key[first], np.add.reduceat(value, first)
            keys, values, held = [], [], 0


def _distances(groups: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value of every pair of a language's groups.
    ``known``: lang, no, term, count, p, p0 of each group's own terms."""
    side = lambda x: groups.select("lang", F.col("no").alias(x), F.col("p0").alias(f"p0{x}"), F.col("v").alias("v" if x == "a" else "_v"))
    pair = side("a").join(side("b").drop("_v"), "lang").where("a < b").select("lang", "a", "b", (F.col("v") * F.abs(F.col("p0a") - F.col("p0b"))).alias("value"))

    # A: a group's own terms against the other's constant, by how many have a share.
    same = known.groupBy("lang", "no", "p", "p0").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("no").alias("s"), F.col("p0").alias("q0"))
    own = (same.join(other, "lang").where("no <> s")
           .groupBy("lang", F.least("no", "s").alias("a"), F.greatest("no", "s").alias("b"))
           .agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0")))).alias("value")))

    # C: the terms that both have.
    rows = known.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("no", "p", "p0"))).alias("ent")).where(F.size("ent") > 1)
    both = rows.select("lang", "ent").mapInArrow(shared_terms, "lang string, a int, b int, c long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("c").alias("value"))
    return pair.unionByName(own).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, most: int = MAX_VOCABULARY) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    vocabulary, counts = count_terms(docs, min_docs, most)
    counts = staged(counts, "divergence-counts")
    groups = staged(_groups(plain(docs), vocabulary, counts), "divergence-groups")
    # The groups of a counted table: broadcast only within the bound.
    rows = groups.count()
    small = F.broadcast(groups) if rows <= BROADCAST_ROWS else groups
    known = counts.join(small, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    value = staged(_distances(groups, known), "divergence-pairs")
    names = groups.select("lang", "source", "no")
    one = lambda x, y: (value.join(names.select("lang", F.col("source"), F.col("no").alias(x)), ["lang", x])
                        .join(names.select("lang", F.col("source").alias("item"), F.col("no").alias(y)), ["lang", y]).select("lang", "source", "item", "value"))
    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = best(one("a", "b").unionByName(one("b", "a"))).withColumn("part", F.lit("pair"))

    # The language's own shares: its counts are the sums over its groups.
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.first("v").alias("v"))
    total = (counts.groupBy("lang", "term").agg(F.sum("count").alias("count"))
             .join(F.broadcast(whole) if rows <= BROADCAST_ROWS else whole, "lang")
             .select("lang", "term", share(F.col("count"), F.col("n"), F.col("v")).alias("q")))
    over = known.join(total, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = best(over).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


#: DuckDB SQL of ``audit`` with its defaults, from the definition.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
 t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
 k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n
       FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x
         ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
 p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p FROM c JOIN v USING (lang)),
 l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
 q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v) AS q FROM l JOIN v USING (lang)),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
