"""N-gram Jaccard join in regions around pivots.

Sets are the distinct shingles of whole texts (64-bit hashes); two documents
link at a Jaccard similarity of a ratio or more.  A ``Rule`` has both: three
words and 0.9 unless the caller names others.  Equal sets are one node (the 64-bit hash of the set), so copies cost nothing further.

Jaccard distance is a metric, and regions are built around pivots:

1. Subspace pivots.  Distances of most texts to any text are close to 1, so
   whole sets as first pivots would replicate every document everywhere.  The
   shingles are therefore dealt, by hash, into m subspaces.  Two sets that link
   differ in at most D = smaller size x (1 - ratio) / ratio shingles (a ninth of
   it at 0.9, a quarter at 0.8), so with m > D subspaces they are at distance 0 in one of them: the pivots of a subspace are the
   distinct subsets found there, and the window around each has width 0.
   Documents are replicated to the regions of all their subsets.  Sets of
   similar size use the same m; those near a border of sizes use both.  Two
   sets that link agree in m - D subspaces at least: before any set is read, a
   set leaves the size classes in which it shares fewer regions than that.
   Regions with one document end here, the others are joined where they share
   documents, so that every link lies inside one region.  Where that chains
   many small regions to a large one, they are worked on one by one instead.
2. Regions of bounded size are joined exactly in one task.
3. Larger ones take documents as pivots: each document goes to the Voronoi
   region of its nearest pivot and, by the triangle inequality, to every pivot
   that is at most twice the link distance further; then regions are joined
   recursively.  Where that doesn't shrink a region, its blocks are joined pair
   by pair, and pairs of blocks that are one component already (all linked to
   the same pivot) are left out.

Links are kept as spanning trees; components follow by label propagation.

Edge cases: null or blank texts have the empty set, link with nothing and are
their own component; with fewer words than a shingle has the whole sequence is one
shingle; repeated rows are linked as any equal sets; rows with null doc_id keep
their row and link as any others, and a component of such rows only has a null
component_id; of a doc_id that stands with several texts each text counts by
itself; an empty table
gives no rows; extra columns are not read; a very long text is one row of long
numbers and joins in a block of its own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, drop_staged, maybe_broadcast, staged
from .components import connected

NUM, DEN = 90, 100
SLACK = 3               # subspaces beyond D, as some are empty
REGION_ROWS = 512       # largest region joined in one task, in documents
REGION_SHINGLES = 4_000_000     # and in shingles
PIVOTS = 16
DEPTH = 3
CELLS = 16_000_000      # of an incidence matrix held at a time
BASE_ROWS = 500         # whose region hashes a task holds at a time
CLASS_BITS = 8          # of a region's hash: sizes grow by a quarter or more from class to class
SEEN = 500_000          # sets that a task remembers to have given regions for
PRUNING = 2             # times that shared regions are counted


class Rule(NamedTuple):
    """Words of a shingle, and the ratio num / den at which two sets link."""
    words: int = 3
    num: int = NUM
    den: int = DEN

    @property
    def fewest(self) -> int:
        """Smaller sets link with equal ones only (at 0.9, 9 of 10 is the first ratio below 1)."""
        return -(-self.num // (self.den - self.num))

    @property
    def wide(self) -> bool:
        """Are there so many shingles to a difference that few subspaces are empty."""
        return self.num >= 6 * (self.den - self.num)

    @property
    def growth(self) -> float:
        """Of the sizes that share a number of subspaces."""
        return 1.5 if self.wide else 1.25

    def differences(self, n: int) -> int:
        """Most shingles that a set of ``n`` and a larger one that it links to don't share."""
        return n * (self.den - self.num) // self.num

    def subspaces(self, d: int) -> int:
        return d + SLACK + (0 if self.wide else d * 15 // 100)


RULE = Rule()

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P3
    h = (h ^ (h >> np.uint64(29))) * _P2
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def shingle_set(text: str | None, rule: Rule = RULE) -> np.ndarray:
    """Sorted distinct shingle hashes.  bytes.lower() and bytes.split() know
    ASCII only, which is what the words are defined by."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    width = min(rule.words, len(h))
    n = len(h) - width + 1
    out = h[:n]
    for j in range(1, width):
        out = out * (_P1 if j % 2 else _P2) + h[j:j + n]
    return np.unique(mix(out if width == rule.words else out + np.uint64(width)))


def size_classes(n: int, rule: Rule = RULE) -> list[tuple[int, int, int]]:
    """(number, start, differences) of the classes that a set of ``n`` shingles
    shares with any set it may link to: from that of the smallest set it may
    link to up to its own.  Differences are those of the class's largest size."""
    out, no, low = [], 0, rule.fewest
    least = -(-n * rule.num // rule.den)
    while low <= n:
        high = max(low + 1, int(low * rule.growth))
        if least < high:
            out.append((no, low, rule.differences(high - 1)))
        no, low = no + 1, high
    return out


def placed_signatures(s: np.ndarray, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One hash for each (class, subspace, subset) region of a set, the start of
    its class, and how many regions of the class any set that links to this one
    shares with it at least: of m subspaces D at most differ, and those that are
    empty here are no regions unless there are many.  A hash has 48 bits, the
    class's number in the last eight, as hashes are most of what is shuffled.
    Regions that fall together cost work, never a link."""
    out, starts, needs = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    if len(s) >= rule.fewest:
        m_of = mix(s ^ _P1)
        for no, low, d in size_classes(len(s), rule):
            m = rule.subspaces(d)
            bucket = (m_of % np.uint64(m)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[o], return_index=True)
            sums = np.add.reduceat(m_of[o], first)
            seed = np.array([low], np.uint64) * _P2
            mine = mix(sums * _P1 + used.astype(np.uint64) * _P3 + seed)
            if len(used) <= d:      # so many are empty that a pair may agree in empty ones only
                empty = np.setdiff1d(np.arange(m), used).astype(np.uint64)
                mine = np.concatenate([mine, mix(empty * _P3 + seed + np.uint64(1))])
            mine = np.unique((mine >> np.uint64(24) << np.uint64(CLASS_BITS)) | np.uint64(no))
            out.append(mine)
            starts.append(np.full(len(mine), low, np.int32))
            needs.append(np.full(len(mine), len(mine) - d, np.int32))
    return np.concatenate(out), np.concatenate(starts), np.concatenate(needs)


def signatures(s: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    return placed_signatures(s, rule)[0]


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


_BASE = "doc_id long, th long, n long, d1 long, d2 long, sigs array<long>, classes array<int>, needs array<int>"


def base_frames(batches, rule: Rule = RULE):
    """Rows of ``base_table`` from batches of doc_id, th and text.  Region hashes
    can take more room than their text: those of ``BASE_ROWS`` rows are held, and
    of equal sets in a task the first has them."""
    claim("jaccard", _WORDS)
    seen, none = set(), np.empty(0, np.uint64)
    for b in batches:
        for lo in range(0, len(b), BASE_ROWS):
            part, rows = b.iloc[lo:lo + BASE_ROWS], []
            for i, h, t in zip(part["doc_id"], part["th"], part["text"]):
                s = shingle_set(t, rule)
                both = digest(s)
                again = both in seen
                sigs, _, needs = placed_signatures(none if again else s, rule)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(both)
                # one number and need for each class, in place of each region's
                classes, first = np.unique(sigs & np.uint64((1 << CLASS_BITS) - 1), return_index=True)
                rows.append((i, h, len(s), *both, signed(sigs), classes.astype(np.int32), needs[first]))
            d = pd.DataFrame(rows, columns=["doc_id", "th", "n", "d1", "d2", "sigs", "classes", "needs"])
            d["doc_id"] = pd.Series([None if i is None else int(i) for i in d["doc_id"]], dtype="Int64")
            yield d


def base_table(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Text hash, set size, set digest and region hashes of every row."""
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return src.mapInPandas(lambda batches: base_frames(batches, rule), _BASE)


def intersections(sets: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, by incidence matrices over the shingles
    that occur at least twice."""
    left = len(sets)
    every = sets + (other or [])
    flat = np.concatenate(every) if every else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    o = np.argsort(flat, kind="stable")
    flat, owner = flat[o], owner[o]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(flat)))
    col = np.repeat(np.cumsum(length > 1) - 1, length)
    many = np.repeat(length > 1, length)
    col, owner = col[many], owner[many]
    width = int(col[-1]) + 1 if len(col) else 0
    out = np.zeros((left, len(other) if other is not None else left), np.float64)
    step = max(1, CELLS // max(1, len(every)))
    for c in range(0, width, step):
        here = slice(*np.searchsorted(col, [c, c + step]))
        m = np.zeros((len(every), min(step, width - c)), np.float32)
        m[owner[here], col[here] - c] = 1
        out += m[:left] @ (m[left:].T if other is not None else m.T)
    return np.rint(out).astype(np.int64)


def links(inter: np.ndarray, a: np.ndarray, b: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    return rule.den * inter >= rule.num * (a[:, None] + b[None, :] - inter)


class Union:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[p]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning(pairs) -> list[tuple[int, int]]:
    u = Union()
    return [(x, y) for x, y in pairs if u.join(x, y)]


def region_links(ids: np.ndarray, sets: list[np.ndarray], other_ids=None, other=None, rule: Rule = RULE) -> list[tuple[int, int]]:
    """Spanning links of a region, or of those between two blocks."""
    n = np.array([len(s) for s in sets])
    if other is None:
        ok = np.triu(links(intersections(sets), n, n, rule), 1)
        other_ids = ids
    else:
        ok = links(intersections(sets, other), n, np.array([len(s) for s in other]), rule)
    return spanning((int(ids[i]), int(other_ids[j])) for i, j in zip(*np.nonzero(ok)))


def _edges(pairs) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")


def join_small(members: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Links inside regions of bounded size; many share a task, one is held at
    a time.  A set that comes more than once counts once."""
    src = members.select("region", "id", "set").repartition("region").sortWithinPartitions("region", "id")

    def run(batches):
        now, ids, sets, out = None, [], [], []
        for b in batches:
            for r, i, s in zip(b["region"].tolist(), b["id"].tolist(), b["set"]):
                if r != now:
                    out += region_links(np.array(ids), sets, rule=rule) if len(ids) > 1 else []
                    now, ids, sets = r, [], []
                if not ids or ids[-1] != i:
                    ids.append(i)
                    sets.append(s)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        out += region_links(np.array(ids), sets, rule=rule) if len(ids) > 1 else []
        if out:
            yield _edges(out)

    return src.mapInPandas(run, "a long, b long")


def region_sizes(members: DataFrame, key: str = "region") -> DataFrame:
    return members.groupBy(key).agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))


_SMALL = f"(`rows` <= {REGION_ROWS} and weight <= {REGION_SHINGLES})"


def voronoi(members: DataFrame, sizes: DataFrame, n: int, depth: int, rule: Rule = RULE) -> DataFrame:
    """region, id, home (nearest pivot, the smaller id of two), linked (to it),
    cells (pivots whose region the document belongs to, home included).  The
    ``n`` regions are worked on in parts of bounded size."""
    count = F.greatest(F.ceil(F.col("rows") / (REGION_ROWS // 2)), F.ceil(F.col("weight") / (REGION_SHINGLES // 2))).cast("int")
    few = maybe_broadcast(sizes.select("region", "rows", count.alias("parts")), n)
    pivots = (members.join(few, "region").where(F.pmod(F.xxhash64("id", F.lit(depth)), F.col("rows")) < PIVOTS)
              .select("region", "parts", F.col("id").alias("pid"), F.col("set").alias("pset")))
    parts = (members.join(few, "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
             .select("region", "part", "id", "n", "set"))
    # new names, as both sides of the cogroup come from the same table
    everywhere = pivots.select(F.col("region").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "pid", "pset")

    def near(m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(m):
            p = p.sort_values("pid")
            if len(p):
                a, b = m["n"].to_numpy(), np.array([len(s) for s in p["pset"]])
                i = intersections(list(m["set"]), list(p["pset"]))
                union = a[:, None] + b[None, :] - i
                d = 1 - i / union
                home = d.argmin(axis=1)
                reach = d.min(axis=1) + 2 * (rule.den - rule.num) / rule.den + 1e-9
                pid = p["pid"].to_numpy()
                ok = links(i, a, b, rule)
                for r, x, h, row, lim, l in zip(m["region"], m["id"], home, d, reach, ok):
                    out.append((r, x, pid[h], bool(l[h]), pid[row <= lim]))
            else:
                out = [(r, x, -1, False, np.array([-1])) for r, x in zip(m["region"], m["id"])]
        return pd.DataFrame(out, columns=["region", "id", "home", "linked", "cells"])

    return (parts.groupBy("region", "part").cogroup(everywhere.groupBy("to", "chunk"))
            .applyInPandas(near, "region long, id long, home long, linked boolean, cells array<long>"))


def join_blocks(members: DataFrame, placed: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Links of regions that pivots don't shrink, block against block.  Blocks
    hold documents that are linked to the same pivot (their group), or to none;
    two blocks of the same group are one component and are left out.  A group
    that fills less than a block is dealt with those of none: each block is sent
    to every other one of its region, and many small ones are many copies."""
    own = placed.select("region", "id", F.when(F.col("linked"), F.col("home")).alias("group"))
    large = (own.where("group is not null").groupBy("region", "group").agg(F.count("*").alias("rows")).where(F.col("rows") >= REGION_ROWS)
             .select(F.col("region").alias("at"), F.col("group").alias("large")))
    own = own.join(large, (F.col("region") == F.col("at")) & (F.col("group") == F.col("large")), "left").select("region", "id", F.col("large").alias("group"))
    m = members.join(staged(own, "jac-own"), ["region", "id"])
    sizes = m.groupBy("region", "group").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("rows") / REGION_ROWS), F.ceil(F.col("weight") / REGION_SHINGLES)).cast("int")
    sizes = staged(sizes.select("region", "group", parts.alias("parts")), "jac-parts")
    blocks = staged(sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                    .select("region", "group", "part").withColumn("block", F.xxhash64("region", "group", "part")), "jac-blocks")
    o = blocks.select("region", F.col("group").alias("group2"), F.col("block").alias("block2"))
    pairs = (blocks.join(o, "region").where(F.col("block") <= F.col("block2"))
             .where(F.col("group").isNull() | F.col("group2").isNull() | (F.col("group") != F.col("group2")))
             .select("block", "block2").withColumn("pair", F.xxhash64("block", "block2")))
    m = (m.join(sizes.withColumnRenamed("region", "r").withColumnRenamed("group", "g"),
                (F.col("region") == F.col("r")) & F.col("group").eqNullSafe(F.col("g")))
         .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
         .withColumn("block", F.xxhash64("region", "group", "part")).select("id", "set", "block"))
    sides = pairs.select("pair", F.lit(0).alias("side"), "block").unionByName(
        pairs.where("block <> block2").select("pair", F.lit(1).alias("side"), F.col("block2").alias("block")))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, b = t[t["side"] == 0], t[t["side"] == 1]
        if len(b):
            return _edges(region_links(a["id"].to_numpy(), list(a["set"]), b["id"].to_numpy(), list(b["set"]), rule))
        return _edges(region_links(a["id"].to_numpy(), list(a["set"]), rule=rule))

    return m.join(sides, "block").select("pair", "side", "id", "set").groupBy("pair").applyInPandas(run, "a long, b long")


def join_regions(members: DataFrame, rule: Rule = RULE) -> list[DataFrame]:
    """All links of regions (region, id, n, set), recursively; written tables."""
    found, depth = [], 0
    while True:
        sizes = staged(region_sizes(members), "jac-sizes")
        small = members.join(sizes.where(_SMALL).select("region"), "region", "left_semi")
        found.append(staged(join_small(small, rule), "jac-links"))
        big = sizes.where(f"not {_SMALL} and `rows` > 1")
        n = big.count()
        if not n:
            return found
        inside = staged(members.join(big.select("region"), "region", "left_semi"), "jac-inside")
        placed = staged(voronoi(inside, big, n, depth, rule), "jac-placed")
        found.append(placed.where("linked and id <> home").select(F.col("id").alias("a"), F.col("home").alias("b")))
        cells = placed.select("region", "id", F.explode("cells").alias("cell"))
        # a region is split if its cells cost at most half of what it costs itself
        cost = cells.groupBy("region", "cell").count().groupBy("region").agg(F.sum(F.col("count") * F.col("count")).alias("cost"))
        split = staged(big.join(cost, "region").select("region", (F.col("cost") * 2 <= F.col("rows") * F.col("rows")).alias("split")), "jac-split")
        depth += 1
        flat = split if depth > DEPTH else split.where(~F.col("split"))
        stay = inside.join(flat.select("region"), "region", "left_semi")
        found.append(staged(join_blocks(stay, placed, rule), "jac-links"))
        if depth > DEPTH:
            return found
        go = cells.join(split.where(F.col("split")).select("region"), "region", "left_semi")
        members = staged(inside.join(go, ["region", "id"]).select(F.xxhash64("region", "cell").alias("region"), "id", "n", "set"), "jac-members")
        if not members.head(1):
            return found


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart; the first 64 are the set's node id."""
    return int(signed(np.array([mix(s).sum(dtype=np.uint64)]))[0]), int(signed(np.array([mix(s * _P1 + _P3).sum(dtype=np.uint64)]))[0])


def shared_regions(base: DataFrame) -> DataFrame:
    """(id, sig): the regions that a set shares with another one, of the size
    classes in which it shares as many as it would with any set that it links to.
    Counting again where others have gone leaves out more; no link's regions are
    ever left out, as both its sets keep theirs.  A region's rows are shuffled
    once, and told from single ones where they meet, whatever their number: no
    list of shared regions is joined back to all of them."""
    needs = base.select(F.col("d1").alias("id"), F.explode(F.arrays_zip("classes", "needs")).alias("r")).select(
        "id", F.col("r.classes").alias("class"), F.col("r.needs").alias("need")).distinct()
    met, rows = Window.partitionBy("sig"), None
    for _ in range(PRUNING):
        every = base.select(F.col("d1").alias("id"), F.explode("sigs").alias("sig")) if rows is None else rows
        here = every.select("id", "sig", F.min("id").over(met).alias("a"), F.max("id").over(met).alias("b")).where("a <> b").select("id", "sig")
        here = staged((here.distinct() if rows is None else here).withColumn("class", F.expr(f"cast(sig & {(1 << CLASS_BITS) - 1} as int)")), "jac-hits")
        if rows is not None:
            drop_staged(rows)
        counts = here.groupBy("id", "class").agg(F.count("*").alias("n"))
        enough = staged(needs.join(counts, ["id", "class"]).where("n >= need").select("id", "class"), "jac-enough")
        rows = staged(here.join(maybe_broadcast(enough, enough.count()), ["id", "class"], "left_semi").select("id", "sig"), "jac-hits")
        drop_staged(here)
        drop_staged(enough)
    return rows


def unchained(coarse: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, region): the components of shared regions, and in place of a large
    one its single regions, if they cost at most half of what it costs.  Near
    copies share dozens of regions with the same members: of these one stays."""
    big = staged(coarse.groupBy("label").agg(F.count("*").alias("rows")).where(F.col("rows") > REGION_ROWS), "jac-big")
    whole = coarse.select("id", F.col("label").alias("region"))
    n = big.count()
    if not n:
        return whole
    large = staged(coarse.join(maybe_broadcast(big, n), "label"), "jac-large")
    single = staged(hits.select("id", "sig").join(maybe_broadcast(large, large.count()), "id").select("label", "rows", "id", "sig"), "jac-single")
    # 128 bits that tell the members of regions apart
    mark = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    kinds = (single.groupBy("label", "rows", "sig").agg(F.count("*").alias("count"), *mark).where("count > 1")
             .groupBy("label", "rows", "count", "mark0", "mark1").agg(F.min("sig").alias("sig")))
    kinds = staged(kinds.select("label", "rows", "sig", "count"), "jac-kinds")
    cost = kinds.groupBy("label", "rows").agg(F.sum(F.col("count") * F.col("count")).alias("cost"))
    split = staged(cost.where(F.col("cost") * 2 <= F.col("rows") * F.col("rows")).select("label"), "jac-unchain")
    split = maybe_broadcast(split, split.count())
    stay = coarse.join(split, "label", "left_anti").select("id", F.col("label").alias("region"))
    alone = kinds.join(split, "label", "left_semi").select("label", "sig")
    alone = single.join(maybe_broadcast(alone, kinds.count()), ["label", "sig"], "left_semi")
    return stay.unionByName(alone.select("id", F.col("sig").alias("region")))


def components(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return labelled(docs, rule).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def labelled(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, text hash th, set size n and component_id of every row, and
    component_th: of the texts of its component's smallest doc_id, the hash of
    the one that stands for it."""
    base = staged(base_table(docs, rule), "jac-base")
    sets = staged(base.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best"))
                  .withColumn("first", F.col("best.doc_id")), "jac-sets")
    hits = shared_regions(base.where(F.size("sigs") > 0))
    hubs = hits.groupBy("sig").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("sig", "hub")
    coarse = staged(connected(hits.join(hubs, "sig").select("id", "hub").where("id <> hub").distinct(), "id", "hub"), "jac-coarse")
    regions = staged(unchained(coarse, hits).groupBy("id").agg(F.collect_set("region").alias("regions")), "jac-regions")
    drop_staged(hits)
    whole, base = base, staged(base.select("doc_id", "th", "n", "d1", "d2"), "jac-base")
    drop_staged(whole)          # region hashes take as much room as the texts

    # one text of each set that shares a region, fetched by its best row's id and text hash
    members = staged(regions.join(sets, F.col("id") == F.col("d1"))
                     .select(F.col("first").cast("string").alias("doc"), F.col("best.th").alias("th"), "id", "regions"), "jac-fetch")
    count, more = members.agg(F.count("*"), F.sum(F.size("regions"))).first()
    rows = docs.select(F.col("doc_id").cast("string").alias("row_doc"), F.xxhash64("text").alias("row_th"), "text")
    texts = rows.join(maybe_broadcast(members, count, 48 * count + 8 * (more or 0)), F.col("row_doc").eqNullSafe(F.col("doc")) & (F.col("row_th") == F.col("th")))

    def run(batches):
        done = set()                # of a row that stands several times, a task reads one
        for b in batches:
            found = []
            for where, i, t in zip(b["regions"], b["id"], b["text"]):
                if i not in done and digest(s := shingle_set(t, rule))[0] == i:
                    done.add(i)
                    found.append((where, i, len(s), signed(s)))
            yield pd.DataFrame(found, columns=["regions", "id", "n", "set"]).astype({"id": "int64", "n": "int64"})

    # each set is written once and shuffled once to each of its regions
    inside = staged(texts.mapInPandas(run, "regions array<long>, id long, n long, set array<long>"), "jac-sets-inside")
    inside = inside.select(F.explode("regions").alias("region"), "id", "n", "set")
    edges = None
    for part in join_regions(inside, rule):
        edges = part if edges is None else edges.unionByName(part)
    labels = connected(edges)
    named = sets.join(labels, F.col("d1") == F.col("id"), "left").withColumn("label", F.coalesce("label", "d1"))
    least = named.groupBy("label").agg(F.min("best").alias("least"))
    named = staged(named.join(least, "label").select("n", "d1", "d2", F.col("least.doc_id").alias("component"), F.col("least.th").alias("component_th")), "jac-named")
    return (base.select("doc_id", "th", "n", "d1", "d2").join(maybe_broadcast(named, named.count()), ["n", "d1", "d2"], "left")
            .select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("component_th")).otherwise(F.col("th")).alias("component_th")))


def keep_first(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component:
    of repeated rows with its id and text one stays.  Rows with null doc_id stay
    if their component has no other id."""
    found = staged(labelled(docs, rule), "jac-components")
    own = F.col("doc_id").isNull() | (F.col("th") == F.col("component_th"))
    first = staged(found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & own)
                   .groupBy(F.col("doc_id").alias("__keep"), F.col("th").alias("__text")).agg(F.count("*").alias("__rows")), "jac-first")
    more = first.where("__keep is not null and __rows > 1").select("__keep", "__text")
    n, repeated = first.count(), more.count()

    def semi(rows: DataFrame, keys: DataFrame, size: int, how: str) -> DataFrame:
        return rows.join(maybe_broadcast(keys, size), F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.xxhash64("text") == F.col("__text")), how)

    once = first if not repeated else first.where("__keep is null or __rows = 1")
    kept = semi(docs, once.select("__keep", "__text"), n, "left_semi")
    return kept if not repeated else kept.unionByName(semi(docs, more, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
