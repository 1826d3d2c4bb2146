"""Ranked lexical search of all documents for each benchmark item.

Terms are runs of ASCII letters and digits and of all characters from U+0080
on, with A-Z (only) lower-cased.  With N documents that hold a term, L terms in
all, n terms in a document, df documents with a term and tf occurrences:
``w = floor(1000 ln((2N+2)/(2df+1)))`` in doubles, ``m = 25 + (75 n N) div L``
and a document's score for an item is the sum of ``w * ((10^9 tf) div
(1000 tf + 8 m))`` over the item's terms, repeats included, in 64-bit integers.

1. Items are taken in blocks of at most about ``ITEM_TERMS`` terms, each against
   all documents: only a block's terms are ever on the driver or broadcast.
2. One pass over the texts keeps of each document n and the counts of the
   block's terms.  N, L and df are Spark sums over these rows.
3. Each document becomes its terms in order of falling df.  Documents are dealt
   by range of (length class of m, first terms, id), so that tasks are even
   even if a third of all documents are copies, and come sorted.
4. A task builds a document FP-tree of each ``BLOCK_ENTRIES`` entries: sorted
   documents that share a prefix are a subtree (a range), a subtree of at most
   ``LEAF`` documents is a leaf, small neighbours share one.  Each node has the
   largest tf of every term and the smallest m below it.  The score grows with
   tf and falls with m, so these give an upper bound for every document below.
   Per item the tree is searched depth first, the best bound first; a subtree
   whose bound lies below the item's tenth score so far is cut, equal bounds
   are kept for the tie on ids.  Documents with equal vectors score equally:
   only the ``top`` smallest ids of such a run can rank and enter the tree.
5. The tasks' best rows are ranked per item by a window.

Edge cases: null and empty texts and texts without a term are no documents;
items without a term, or with none that occurs, give no row; null doc_ids rank
behind others of equal score; repeated rows of documents each rank; items of
equal id and text count once, of equal id and other texts each have their ranks;
empty tables give no row; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TOP = 10
ITEM_TERMS = 20_000     # terms of a block of items, about
TASK_ENTRIES = 500_000  # (document, term) entries of a task, about
BLOCK_ENTRIES = 1_000_000
BLOCK_DOCS = 16_000
LEAF = 64
PREFIX = 6              # leading terms in the range key

#: Bytes of terms (A-Z lower-cased) stay; all others become spaces.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def _texts(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the counts tfs of the vocabulary's terms, of every
    document that holds a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = shared.value.get
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                words = terms_of(text)
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    ids.append(doc_id)
                    ns.append(len(words))
                    terms.append(list(found))
                    tfs.append(list(found.values()))
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()),
                                   "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _offsets(column) -> np.ndarray:
    at = np.asarray(column.offsets)
    return at - at[0]


def in_order(rows: DataFrame, order: np.ndarray) -> DataFrame:
    """Each document's terms as places in ``order`` (by falling df), sorted."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        for batch in batches:
            at = _offsets(batch.column("terms"))
            places = shared.value[np.asarray(batch.column("terms").flatten())]
            tfs = np.asarray(batch.column("tfs").flatten())
            by = np.lexsort((places, np.repeat(np.arange(len(at) - 1), np.diff(at))))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x[by], pa.int32()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "m": batch.column("m"), "class": batch.column("class"),
                                   "seq": lists(places), "tfs": lists(tfs)})

    return rows.mapInArrow(run, "doc_id long, m long, class int, seq array<int>, tfs array<int>")


def saturation(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """FP-tree of sorted documents.  A node is a range of them; children of a
    node have larger numbers than it and follow each other."""

    def __init__(self, at, seq, tf, m, shared):
        """``at``: where each document's entries begin; ``shared[i]``: length of
        the path that documents i - 1 and i share."""
        self.at, self.seq, self.sat = at, seq, saturation(tf, np.repeat(m, np.diff(at)))
        self.lo, self.hi, self.kids = [0], [len(m)], []
        node = 0
        while node < len(self.lo):
            lo, hi, first = self.lo[node], self.hi[node], len(self.lo)
            if hi - lo > LEAF:
                inner = shared[lo + 1:hi]
                cuts = [lo, *(lo + 1 + np.flatnonzero(inner == inner.min())), hi]
                begin = lo
                for left, right in zip(cuts, cuts[1:]):
                    if right - begin > LEAF and left > begin:
                        self._add(begin, left)
                        begin = left
                self._add(begin, hi)
            self.kids.append((first, len(self.lo)))
            node += 1
        nodes = len(self.lo)
        self.terms, local = np.unique(seq, return_inverse=True)
        self.most = np.zeros((nodes, len(self.terms)), np.int32)
        self.least = np.zeros(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):
            first, last = self.kids[node]
            if first == last:
                s, e = at[self.lo[node]], at[self.hi[node]]
                np.maximum.at(self.most[node], local[s:e], tf[s:e])
                self.least[node] = m[self.lo[node]:self.hi[node]].min()
            else:
                self.most[node] = self.most[first:last].max(0)
                self.least[node] = self.least[first:last].min()

    def _add(self, lo, hi):
        self.lo.append(int(lo))
        self.hi.append(int(hi))

    def bounds(self, terms, weights) -> np.ndarray:
        """Of each node: no document below it scores more for the item."""
        place = np.searchsorted(self.terms, terms)
        there = place < len(self.terms)
        there[there] = self.terms[place[there]] == terms[there]
        tf = self.most[:, place[there]].astype(np.int64)
        return saturation(tf, self.least[:, None]) @ weights[there]

    def scores(self, lo, hi, dense) -> np.ndarray:
        """Of documents lo to hi; ``dense``: the item's weight of each term."""
        at = self.at[lo:hi + 1]
        sums = np.concatenate([[0], np.cumsum(dense[self.seq[at[0]:at[-1]]] * self.sat[at[0]:at[-1]])])
        return sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]


class Best:
    """An item's best (score, id) so far; equal scores by id, null ids last."""

    def __init__(self, top):
        self.top, self.score, self.key = top, np.zeros(0, np.int64), np.zeros((2, 0), np.int64)

    @property
    def floor(self):
        return self.score[-1] if len(self.score) == self.top else 1

    def add(self, score, key):
        score, key = np.concatenate([self.score, score]), np.concatenate([self.key, key], axis=1)
        by = np.lexsort((key[1], key[0], -score))[:self.top]
        self.score, self.key = score[by], key[:, by]


def search(tree: Tree, keys: np.ndarray, terms, weights, dense, best: Best) -> int:
    """Depth first, best bound first; returns the number of scored documents."""
    bound = tree.bounds(terms, weights)
    seen, stack = 0, [0]
    while stack:
        node = stack.pop()
        if bound[node] < best.floor:
            continue
        first, last = tree.kids[node]
        if first < last:
            stack += sorted((k for k in range(first, last) if bound[k] >= best.floor), key=bound.__getitem__)
            continue
        lo, hi = tree.lo[node], tree.hi[node]
        score = tree.scores(lo, hi, dense)
        seen += hi - lo
        good = np.flatnonzero(score >= best.floor)
        if len(good):
            best.add(score[good], keys[:, lo + good])
    return seen


class _Block:
    """Sorted documents up to the bound; of a run of equal vectors the first
    ``top`` (they come in order of their ids)."""

    def __init__(self, top):
        self.top, self.last, self.run = top, None, 0
        self.clear()

    def clear(self):
        self.seq, self.tf, self.m, self.key, self.shared, self.entries = [], [], [], [], [], 0

    def add(self, kind, m, key, seq, tf):
        shared = -1
        if self.last is not None:
            a, b, c = self.last
            n = min(len(b), len(seq))
            off = np.flatnonzero(b[:n] != seq[:n])
            shared = (int(off[0]) if len(off) else n) if a[0] == kind else -1
            equal = a == (kind, m) and shared == len(b) == len(seq) and np.array_equal(c, tf)
            self.run = self.run + 1 if equal else 0
        self.last = ((kind, m), seq, tf)
        if self.run < self.top:
            self.seq.append(seq)
            self.tf.append(tf)
            self.m.append(m)
            self.key.append(key)
            self.shared.append(shared)
            self.entries += len(seq)

    @property
    def full(self):
        return self.entries >= BLOCK_ENTRIES or len(self.m) >= BLOCK_DOCS

    def tree(self):
        at = np.concatenate([[0], np.cumsum([len(x) for x in self.seq])])
        tree = Tree(at, np.concatenate(self.seq), np.concatenate(self.tf).astype(np.int64), np.array(self.m), np.array(self.shared))
        return tree, np.array(self.key, np.int64).T


def search_sorted(batches, items, size, top):
    """Best rows of each item over sorted (class, m, seq, tfs, doc_id) rows.
    ``items``: number, terms and weights; ``size``: number of terms."""
    best = {no: Best(top) for no, _, _ in items}
    block = _Block(top)

    def work():
        if block.m:
            tree, keys = block.tree()
            dense = np.zeros(size, np.int64)
            for no, terms, weights in items:
                dense[terms] = weights
                search(tree, keys, terms, weights, dense, best[no])
                dense[terms] = 0
            block.clear()

    for batch in batches:
        at, seq, tf = _offsets(batch.column("seq")), np.asarray(batch.column("seq").flatten()), np.asarray(batch.column("tfs").flatten())
        for i, (kind, m, doc_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("class", "m", "doc_id")))):
            block.add(kind, m, (doc_id is None, doc_id or 0), seq[at[i]:at[i + 1]], tf[at[i]:at[i + 1]])
            if block.full:
                work()
    work()
    for no, b in best.items():
        yield pa.record_batch({"no": pa.array([no] * len(b.score), pa.int32()), "score": pa.array(b.score),
                               "doc_id": pa.array([None if null else k for null, k in b.key.T.tolist()], pa.int64())})


def _search_block(docs: DataFrame, items: list, top: int) -> DataFrame:
    """Ranked rows of a block of items: (item_id, text) rows."""
    spark = docs.sparkSession
    counts = [Counter(terms_of(r.text.encode())) for r in items]
    words = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    rows = staged(vectors(docs, words), "search-vectors")
    total = rows.agg(F.count("*").alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("entries")).first()
    held = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())     # at most the block's terms
    df = np.array([held.get(i, 0) for i in range(len(words))])
    order = np.empty(len(words), np.int32)
    order[np.argsort(-df, kind="stable")] = np.arange(len(words), dtype=np.int32)
    weight = np.array([math.floor(1000 * math.log((2 * total.N + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    known = []
    for no, c in enumerate(counts):
        own = {words[t]: k for t, k in c.items() if df[words[t]]}
        places = sorted(own, key=order.__getitem__)
        if places:
            known.append((no, order[places].astype(np.int64), np.array([own[i] for i in places]) * weight[places]))

    rows = rows.where(F.size("terms") > 0).select(
        "doc_id", F.expr(f"25 + ((75 * n * {total.N}L) div {total.L or 1}L)").alias("m"), "terms", "tfs")
    rows = in_order(rows.withColumn("class", F.floor(F.log2("m") * 2).cast("int")), order)
    tasks = max(1, -(-(total.entries or 0) // TASK_ENTRIES))
    rows = (rows.repartitionByRange(tasks, "class", F.slice("seq", 1, PREFIX), "doc_id")
            .sortWithinPartitions("class", "seq", "m", "tfs", F.asc_nulls_last("doc_id")))
    shared, size = spark.sparkContext.broadcast(known), len(words)
    found = rows.mapInArrow(lambda batches: search_sorted(batches, shared.value, size, top), "no int, score long, doc_id long")
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(no, r.item_id) for no, r in enumerate(items)], "no int, item_id long")
    return (found.withColumn("rank", rank).where(F.col("rank") <= top)
            .join(F.broadcast(names), "no").select("item_id", "rank", "doc_id", "score"))


def rank(docs: DataFrame, benchmark: DataFrame, top: int = TOP, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, -(-size // item_terms))
    out = None
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        if block:
            found = _search_block(docs, block, top)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


#: DuckDB SQL of ``rank`` with its defaults, from the definition.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
 q AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
       FROM (SELECT DISTINCT item_id, text FROM benchmark)),
 s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
 t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n),
 m AS (SELECT row, doc_id, 25 + (75 * len(terms) * n) // l AS m FROM d, s WHERE len(terms) > 0),
 f AS (SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
       FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (row) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
