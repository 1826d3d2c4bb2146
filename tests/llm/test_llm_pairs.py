"""op8 and op10 against brute force, op3 against all inner products."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import CLASH, ODD, docs_frame, words
from pyspark.sql import functions as F

from panelcast.llm import components, jaccard_regions, simhash_decontam, srs_search

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_sets(rows):
    out = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII))
        out.append({tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= 90 * (len(sets[a]) + len(sets[b]) - inter):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(str((i, len(s), least.get(find(a)))) for a, ((i, _), s) in enumerate(zip(rows, sets)))


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
    return " ".join(w)


def near_copies():
    """Clusters of copies with few to many edits, shared passages, tiny texts."""
    rows, i = [], 100
    passage = words(60, 999)
    for c in range(8):
        base = words(40 + 90 * c, c)
        for e in range(9):
            rows.append((i, edited(base, e * (1 + c // 3), 31 * c + e)))
            i += 1
        rows.append((i, base + " " + passage))
        i += 1
    for n in range(1, 14):
        rows += [(i, words(n, 5)), (i + 1, words(n, 5).upper()), (i + 2, words(n + 1, 5)), (i + 3, passage + " " + words(n, n))]
        i += 4
    random.Random(1).shuffle(rows)
    return rows


def found(docs):
    return sorted(str(tuple(r)) for r in jaccard_regions.components(docs).collect())


def test_components_equal_brute_force(spark):
    rows = near_copies() + [r for r in ODD if r[0] is not None]
    assert found(docs_frame(spark, rows)) == brute_components(rows)


def test_components_by_pivots_and_blocks(spark, monkeypatch):
    """The same with regions so small that pivots, windows, recursion and
    blocks do the work."""
    monkeypatch.setattr(jaccard_regions, "REGION_ROWS", 6)
    monkeypatch.setattr(jaccard_regions, "_SMALL", "(`rows` <= 6)")
    monkeypatch.setattr(jaccard_regions, "PIVOTS", 4)
    rows = near_copies()
    assert found(docs_frame(spark, rows)) == brute_components(rows)


def test_components_edge_cases(spark):
    rows = ODD
    got = found(docs_frame(spark, rows))
    assert len(got) == len(rows) and str((1, 0, 1)) in got and got.count(str((4, 1, 4))) == 2
    empty = docs_frame(spark, [])
    assert found(empty) == []
    docs = docs_frame(spark, rows)
    kept = jaccard_regions.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 1


def test_keep_first_of_null_and_shared_ids(spark):
    """Null-id rows stay unless a document with an id stands for them; an id
    with two texts that don't link keeps both, copies of either go."""
    a, b, c, d = (words(30, s) for s in (1, 2, 3, 4))
    rows = [(None, a), (None, b), (None, ""), (None, c), (7, c), (7, c), (7, d), (9, d), (9, c), (9, words(30, 5)), (8, ""), (8, "")]
    got = jaccard_regions.keep_first(docs_frame(spark, rows)).select("doc_id", "text").collect()
    want = [(None, a), (None, b), (None, ""), (7, c), (7, d), (9, words(30, 5)), (8, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    near = [(7, c), (7, c + " end")]    # two texts of one id that link: one stays
    assert jaccard_regions.keep_first(docs_frame(spark, near)).count() == 1


def test_null_ids_link_and_bridge(spark):
    """A set under null ids only links two others that don't link themselves."""
    w = words(80, 11, 100_000).split()
    texts = [" ".join(w[k:k + 60]) for k in (0, 3, 6)]
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (None, words(30, 12)), *ODD]
    assert str((2, 58, 1)) in brute_components(rows)
    assert found(docs_frame(spark, rows)) == brute_components(rows)


def shares_enough(s, t, rule=jaccard_regions.RULE):
    """Whether in a size class both sets share as many regions as each must."""
    (a, la, na), (b, lb, nb) = (jaccard_regions.placed_signatures(x, rule) for x in (s, t))
    for low in np.intersect1d(la, lb):
        x, y = a[la == low], b[lb == low]
        if np.intersect1d(x, y).size >= max(na[la == low][0], nb[lb == low][0], 1):
            return True
    return False


def test_every_linking_pair_shares_a_region():
    r = np.random.default_rng(0)
    for n in (9, 10, 13, 20, 47, 130, 400, 1000):
        for _ in range(30):
            s = np.unique(r.integers(0, 2 ** 63, n).astype(np.uint64))
            d = int(len(s) / 9)
            drop = r.integers(0, d + 1)
            t = np.unique(np.concatenate([s[drop:], r.integers(0, 2 ** 63, (d - drop) // 2 + 1).astype(np.uint64)]))
            inter = len(np.intersect1d(s, t))
            if 100 * inter >= 90 * (len(s) + len(t) - inter):
                assert np.intersect1d(jaccard_regions.signatures(s), jaccard_regions.signatures(t)).size
                assert shares_enough(s, t)


def test_chance_regions_are_pruned(spark):
    """Texts that share a passage share some regions, but too few to link: they
    are left out before any set is read; copies with an edit stay."""
    passage = words(14, 77, 100_000)
    rows = [(i, words(10, i, 100_000) + " " + passage) for i in range(90)] + [(100 + i, edited(words(150, i // 2, 100_000), i % 2, i)) for i in range(10)]
    base = jaccard_regions.base_table(docs_frame(spark, rows))
    every = base.select("d1", F.explode("sigs").alias("sig"))
    shared = every.join(every.groupBy("sig").agg(F.countDistinct("d1").alias("n")).where("n > 1"), "sig").select("d1").distinct().count()
    kept = {r.id for r in jaccard_regions.shared_regions(base).select("id").distinct().collect()}
    ids = {r.doc_id: r.d1 for r in base.collect()}
    assert {ids[100 + i] for i in range(10)} <= kept and len(kept) < shared and shared > 40


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    ids = list(range(10_000))
    random.Random(5).shuffle(ids)
    for order in (ids, sorted(ids)):
        made = []
        monkeypatch.setattr(components, "staged", lambda df, name, keep=components.staged: made.append(name) or keep(df, name))
        d = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
        got = components.connected(d)
        assert got.agg(F.count("*"), F.max("label"), F.sum("id")).first() == (10_000, 0, sum(ids))
        monkeypatch.undo()
        assert made.count("cc-up") <= 16


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(100), r.randrange(100)) for _ in range(70)] + [(1000 + i, 999) for i in range(50)]
    d = spark.createDataFrame(edges, "a long, b long")
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {x.id: x.label for x in components.connected(d).collect()} == want
    assert components.connected(d.limit(0)).count() == 0


def brute_leaks(docs, items):
    norm = lambda s: re.findall(r"[^\W_]+", s.lower()) if s else []
    out = {}
    for item, text in items:
        q = norm(text)
        if not q:
            continue
        k, n = min(5, len(q)), len(q)
        bag = Counter(tuple(q[j:j + k]) for j in range(n - k + 1))
        for i, t in docs:
            w = norm(t)
            if not any(tuple(w[j:j + k]) in bag for j in range(len(w) - k + 1)):
                continue
            best = 0
            for s in range(max(1, len(w) - n + 1)):
                v = w[s:s + n]
                d = Counter(tuple(v[j:j + k]) for j in range(len(v) - k + 1))
                same = sum((d & bag).values())
                best = max(best, same / (sum(d.values()) + sum(bag.values()) - same))
            if best >= 0.8:
                out[i, item] = best
    return out


def test_decontamination_equals_brute_force(spark):
    items = [(k, words(n, 50 + k, 200)) for k, n in enumerate((3, 5, 6, 12, 30, 31, 60))] + [(20, "a a a a a a a a b"), (21, None), (22, " .. "), (23, "Solo")]
    docs, i = [(900, None), (901, ""), (902, "... "), (903, words(3000, 7)), (904, "solo, act"), (905, "a " * 40 + "b")], 0
    for k, text in items[:7]:
        for e in range(5):
            mid = edited(text, e, 9 * k + e)
            w = text.split()
            docs += [(i, words(30, i) + " " + mid + " " + words(25, i + 1)), (i + 1, mid.upper() + "!"), (i + 2, " ".join(w[:len(w) - e])),
                     (i + 3, words(9, i) + "\n" + " ".join(w[:len(w) // 2] + ["extra"] * e + w[len(w) // 2:]))]
            i += 4
    frame = docs_frame(spark, docs + docs[-1:])
    bench = spark.createDataFrame([x + ("?",) for x in items], "item_id long, text string, n string")
    got = {(r.doc_id, r.item_id): r.similarity for r in simhash_decontam.contaminated(frame, bench).collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 50 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = simhash_decontam.remove(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (None, "eight nine ten eleven twelve thirteen")], "item_id long, text string")
    docs = docs_frame(spark, [(None, "x one two three four five six seven y"), (2, "eight nine ten eleven twelve thirteen"), *ODD])
    got = {(r.doc_id, r.item_id) for r in simhash_decontam.contaminated(docs, bench).collect()}
    assert got == {(None, 1), (2, None)}
    assert {r.doc_id for r in simhash_decontam.remove(docs, bench).collect()} == {r[0] for r in ODD}
    assert simhash_decontam.contaminated(docs.limit(0), bench).count() == 0
    assert simhash_decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_fingerprint_join_finds_all_within_the_radius(spark):
    """Blocks against a scan of all pairs of fingerprints."""
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(20)]
    far = [b ^ sum(1 << j for j in r.sample(range(64), k)) for b in base for k in (0, 5, 15, 20, 21, 30)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    a = spark.createDataFrame([(i, sign(x)) for i, x in enumerate(base)], "i int, f long")
    b = spark.createDataFrame([(i, sign(x)) for i, x in enumerate(far)], "j int, f long").withColumnRenamed("f", "f2")
    from pyspark.sql import functions as F
    bb = simhash_decontam.blocks(b.withColumnRenamed("f2", "f")).selectExpr("j", "f as f2", "b as b2", "v as v2")
    got = (simhash_decontam.blocks(a).join(bb, F.expr("b = b2 and v = v2 and bit_count(f ^ f2) <= 20")).select("i", "j").distinct().collect())
    assert {(x.i, x.j) for x in got} == {(i, j) for i, x in enumerate(base) for j, y in enumerate(far) if (x ^ y).bit_count() <= 20}


def vectors(spark, rows):
    return spark.createDataFrame([r + ("?", "?") for r in rows], "vec_id long, embedding array<float>, cell string, score string")


def exact(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            s[ids == i] = -np.inf
            o = np.lexsort((ids, -s))[:min(k, len(ids) - 1)]
            out[int(i)] = [(int(ids[j]), s[j]) for j in o]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == want.keys()
    hit = []
    for i, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(want[i])
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hit.append(len({r.vec_id for r in rows} & {v for v, _ in want[i]}) / len(rows))
    return np.mean(hit)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "norms"])
def test_neighbours_reach_the_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(srs_search, "BLOCK", 300)
    monkeypatch.setattr(srs_search, "LEAF", 16)
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 24))
    if kind == "clusters":
        x = x * 0.1 + r.standard_normal((12, 24))[r.integers(0, 12, 1500)]
    if kind == "norms":
        x *= r.lognormal(0, 1, (1500, 1))
    rows = list(enumerate(x.tolist()))
    got = srs_search.search(vectors(spark, rows)).collect()
    assert recall(got, exact(rows)) >= 0.9


def test_neighbours_edge_cases(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0, 2.0]) for i in range(0, 60)]
    bad = [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 1.0]), (180, [nan, 1.0, 1.0]), (200, [inf, 1.0, 1.0]),
           (None, [1.0, 1.0, 1.0]), (220, [1.0, 1.0])]
    got = srs_search.search(vectors(spark, same + bad + same[:5])).collect()
    assert recall(got, exact(same)) == 1.0
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == list(range(1, 21))
    few = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [-1.0, 3.0])]
    assert recall(srs_search.search(vectors(spark, few)).collect(), exact(few)) == 1.0
    assert srs_search.search(vectors(spark, few[:1])).count() == 0
    assert srs_search.search(vectors(spark, [])).columns == ["query_id", "rank", "vec_id", "score"]


def test_chi_square_quantile():
    assert abs(srs_search.chi_square_quantile(0.95, 8) - 15.50731) < 1e-4


def test_clash_covers_the_operators_names():
    assert {"n", "id", "w", "set"} <= set(CLASH)


def test_region_hashes_are_held_for_few_rows():
    import pandas as pd
    rule = jaccard_regions.Rule(words=5, num=80, den=100)
    n = 2 * jaccard_regions.BASE_ROWS + 7
    texts = [None if i % 50 == 0 else words(10 + i % 40, i) for i in range(n)]
    frames = list(jaccard_regions.base_frames([pd.DataFrame({"doc_id": [str(i) for i in range(n)], "th": range(n), "text": texts})], rule))
    assert max(map(len, frames)) <= jaccard_regions.BASE_ROWS
    whole = pd.concat(frames)
    assert list(whole["doc_id"]) == list(range(n)) and list(whole["th"]) == list(range(n))
    assert list(whole["n"]) == [len(jaccard_regions.shingle_set(t, rule)) for t in texts]


def test_regions_are_shuffled_once_however_many_are_shared(spark, monkeypatch):
    """With more shared regions than are broadcast, a region's rows still go
    through one shuffle of two numbers, and equal sets of a task through none."""
    rows = [(i, edited(words(120, i // 2, 100_000), i % 2, i)) for i in range(60)] + [(1000 + i, words(90, 5)) for i in range(40)]
    seen, real = [], jaccard_regions.staged

    def staged(df, name="staged"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(jaccard_regions, "staged", staged)
    monkeypatch.setattr(jaccard_regions, "maybe_broadcast", lambda df, rows, size=0: df)
    base = real(jaccard_regions.base_table(docs_frame(spark, rows).coalesce(1)))
    assert base.where("doc_id >= 1000 and size(sigs) > 0").count() == 1
    hits = jaccard_regions.shared_regions(base)
    first = next(plan for name, plan in seen if name == "jac-hits")
    assert first.count("Exchange hashpartitioning(sig") == 1 and "Join" not in first
    ids = {r.doc_id: r.d1 for r in base.collect()}
    assert {r.id for r in hits.collect()} == {ids[i] for i in range(60)}
