"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by a benchmark item if some window of as many words
as the item (the whole document, if it is shorter) has a weighted similarity of
``SIMILAR`` or more with it: shingles of five words, weighted by how often they
occur, sum of the smaller weights over sum of the larger ones.  Words are runs
of letters and digits, lower-cased; an item of fewer than five words is one
shingle of all its words.

1. Places of a document whose shingle occurs in some item of n words are
   found by one join on shingle hashes.  A window can reach the similarity only
   if enough of its places are such; moving it right to its first such place
   loses none of them.  So only windows that begin there (or end the document)
   and hold enough of them are kept: no window that could pass is lost.
2. Windows and items get 64-bit SimHash fingerprints.  With ``RADIUS`` + 1
   blocks, two fingerprints within the radius agree in a block at least, so a
   join on (item length, block, its bits) finds all pairs within it.  At the
   threshold itself a pair differs in 9.7 bits on average (standard deviation
   2.9); the radius of 20 leaves out about 2 in 10,000 of these and none in
   practice of closer ones.
3. Each pair is verified with its exact weighted similarity.

All of it is DataFrame and SQL functions.

Edge cases: null or empty texts and texts without letters or digits match
nothing; null ids are kept as ids; rows of the same id and text count once, of
the same id and other texts each; of equally similar windows the first is
reported; an empty table on either side gives no row; extra columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 20
LANES = 32              # sums that hold two 32-bit counters each


def word_hashes(text: str) -> Column:
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; empty if there are fewer."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(1), F.size(words) - (k - 1)),
        lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(bags: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the SimHash ``f`` and weight ``total`` of bags given as rows
    (keys, h, c).  Each sum counts two bits, 32 apart, of all hashes."""
    mask = F.lit((1 << 32) + 1)
    sums = bags.groupBy(*keys).agg(F.sum("c").alias("total"), *[
        F.sum(F.shiftrightunsigned("h", j).bitwiseAND(mask) * F.col("c")).alias(f"s{j}") for j in range(LANES)])
    bits = []
    for j in range(LANES):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{j}", 32)
        for count, b in ((low, j), (high, j + 32)):
            value = (1 << b) if b < 63 else -(1 << 63)
            bits.append(F.when(count * 2 > F.col("total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, "total", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("f"))


def blocks(df: DataFrame) -> DataFrame:
    """One row for each block of the fingerprint: b, v."""
    n = RADIUS + 1
    edges = [64 * j // n for j in range(n + 1)]
    parts = [F.struct(F.lit(j).alias("b"), F.shiftrightunsigned("f", a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("v"))
             for j, (a, z) in enumerate(zip(edges, edges[1:]))]
    return df.withColumn("__b", F.explode(F.array(*parts))).select("*", "__b.b", "__b.v").drop("__b")


def windows(docs: DataFrame, items: DataFrame, ks: list[int]) -> DataFrame:
    """Key, n, k and start (from 1) of the windows that hold enough shingles of
    items of n words."""
    known = staged(items.select("k", "n", F.explode("sh").alias("h")).distinct(), "decon-known")
    hashes = known.count()
    found = None
    for k in ks:
        places = docs.select("doc_id", "th", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        part = places.join(maybe_broadcast(known.where(F.col("k") == k), hashes), "h").select("doc_id", "th", "size", "n", "k", "pos")
        found = part if found is None else found.unionByName(part)
    m = F.col("n") - F.col("k") + 1
    of = F.least(m, F.col("size") - F.col("k") + 1)
    need = F.greatest(F.lit(1), F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * (m + of) - 1e-9)).cast("int")
    per = (found.groupBy("doc_id", "th", "size", "n", "k").agg(F.sort_array(F.collect_set("pos")).alias("p"))
           .withColumn("need", need).where(F.size("p") >= F.col("need")))
    good = F.expr("filter(sequence(1, size(p) - need + 1), i -> element_at(p, i + need - 1) - element_at(p, i) <= n - k)")
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))
    return (per.withColumn("good", good).withColumn("last", last)
            .withColumn("start", F.explode(F.expr("array_distinct(transform(good, i -> least(element_at(p, i), last)))")))
            .select("doc_id", "th", "n", "k", (F.col("start") + 1).alias("start")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word (from 0), n_words, similarity and text_hash
    of the best window for every contaminated document and item."""
    items = (benchmark.select("item_id", word_hashes("text").alias("w")).where(F.size("w") > 0)
             .withColumn("n", F.size("w")).withColumn("k", F.least(F.lit(SHINGLE), F.col("n"))))
    sh = reduce(lambda e, k: e.when(F.col("k") == k, shingles(F.col("w"), k)), range(2, SHINGLE + 1),
                F.when(F.col("k") == 1, shingles(F.col("w"), 1)))
    items = staged(items.withColumn("sh", sh).drop("w"), "decon-items")
    ks = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()] or [SHINGLE]
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), word_hashes("text").alias("w"))
    found = staged(windows(texts, items, ks), "decon-windows")

    n = found.count()
    wanted = (found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("n", "k", "start")).alias("win"))
              .withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t"))
    hit = texts.join(maybe_broadcast(wanted, n), F.col("th").eqNullSafe(F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    hit = hit.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "w", F.explode("win").alias("x")).select("doc_id", "th", "w", "x.*")
    key = ["doc_id", "th", "n", "start"]
    words = F.slice("w", F.col("start"), F.col("n"))
    cut = hit.withColumn("v", words)
    cut = cut.withColumn("sh", reduce(lambda e, k: e.when(F.col("k") == k, shingles(F.col("v"), k)), ks[1:],
                                      F.when(F.col("k") == ks[0], shingles(F.col("v"), ks[0]))))
    bags = staged(cut.select(*key, F.explode("sh").alias("h")).groupBy(*key, "h").agg(F.count("*").alias("c")), "decon-bags")

    item_bags = staged(items.select("item_id", "n", F.explode("sh").alias("h")).groupBy("item_id", "n", "h")
                       .agg(F.count("*").alias("c")), "decon-item-bags")
    prints = fingerprints(bags, key)
    item_prints = fingerprints(item_bags, ["item_id", "n"]).select("item_id", F.col("n").alias("in_"), F.col("f").alias("if_"), F.col("total").alias("it"))
    item_blocks = staged(blocks(item_prints.withColumnRenamed("if_", "f")).withColumnRenamed("f", "if_"), "decon-item-blocks")
    pairs = blocks(prints).join(
        maybe_broadcast(item_blocks.withColumnRenamed("b", "ib").withColumnRenamed("v", "iv"), item_blocks.count()),
        (F.col("n") == F.col("in_")) & (F.col("b") == F.col("ib")) & (F.col("v") == F.col("iv"))
        & (F.bit_count(F.col("f").bitwiseXOR(F.col("if_"))) <= RADIUS))
    pairs = staged(pairs.select(*key, "total", "item_id", "it").distinct(), "decon-pairs")

    a, b = pairs.alias("a"), bags.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "doc_id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in key]
    both = a.join(b, reduce(lambda x, y: x & y, same)).select(*[F.col(f"a.{c}") for c in pairs.columns], "b.h", "b.c")
    ib = item_bags.select(F.col("item_id").alias("i"), F.col("h").alias("ih"), F.col("c").alias("ic"))
    both = both.join(maybe_broadcast(ib, item_bags.count()), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("ih")))
    sim = (both.groupBy(*pairs.columns).agg(F.sum(F.least("c", "ic")).alias("o"))
           .withColumn("similarity", F.col("o") / (F.col("total") + F.col("it") - F.col("o")))
           .where(F.col("similarity") >= SIMILAR - 1e-12))
    best = sim.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s") - 1).alias("start_word"), F.col("m.n").alias("n_words"), "m.similarity",
                       F.col("th").alias("text_hash"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    bad = staged(contaminated(docs, benchmark).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct(), "decon-bad")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col("text")) == F.col("__t"))
    return docs.join(maybe_broadcast(bad, bad.count()), same, "left_anti")
