"""The pipeline against its stages' brute-force meaning, and the registry."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from llm_helpers import docs_frame, words

from panelcast.llm import hd_langid, jaccard_regions, quality_rules, queries
from panelcast.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    from test_llm_pairs import brute_leaks
    docs = table(spark, DATA, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    (_, language), (_, quality), (_, near), (_, clean), (_, encode) = corpus_pipeline.STAGES

    one = language(spark, docs, DATA).cache()
    assert one.columns == docs.columns
    protos = hd_langid.learn(docs)
    want = {i for i, r in rows.items() if (v := hd_langid.profile(r.text)) is not None and max(p @ v for p in protos.values()) >= hd_langid.MIN_SCORE * (v @ v) ** 0.5}
    assert {r.doc_id for r in one.collect()} == want

    two = quality(spark, one, DATA).cache()
    scores = {r.doc_id: r.predicted for r in quality_rules.classify(one, table(spark, DATA, "labels")).collect()}
    kept = {r.doc_id for r in two.collect()}
    assert two.columns == docs.columns and kept == {i for i, p in scores.items() if p}

    three = near(spark, two, DATA).cache()
    pairs = [(i, rows[i].text) for i in sorted(kept)]
    first = brute_first(pairs, 5, 80, 100)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == first

    four = clean(spark, three, DATA).cache()
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    bad = {i for i, _ in brute_leaks([(i, rows[i].text) for i in sorted(first)], items)}
    left = {r.doc_id for r in four.collect()}
    assert four.columns == docs.columns and left == first - bad

    five = encode(spark, four, DATA).collect()
    assert {r.doc_id for r in five} == left
    assert all(r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest() and r.n_tokens == len(r.ids) for r in five)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == left


def test_registry():
    import __spark_entry__ as e
    q = e.queries()
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.QUERIES) <= set(q) and "pipeline" in q


def brute_first(rows, width, num, den):
    """Ids that stay: the smallest of each group of linked texts."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[root(a)] = min(i, least.get(root(a), i))
    return set(least.values())


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_of_five_words(spark, monkeypatch, small):
    """The stage links at 0.8 of five-word shingles: a copy with one edited
    word in forty to sixty is found, which three words and 0.9 leave in."""
    from test_llm_pairs import near_copies
    if small:
        monkeypatch.setattr(jaccard_regions, "REGION_ROWS", 6)
        monkeypatch.setattr(jaccard_regions, "_SMALL", "(`rows` <= 6)")
        monkeypatch.setattr(jaccard_regions, "PIVOTS", 4)
    rows, i = near_copies(), 5000
    for n in range(40, 64):
        w = words(n, n).split()
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:n // 2] + ["edited"] + w[n // 2 + 1:]))]
        i += 2
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_frame(spark, rows), DATA).collect()}
    want = brute_first(rows, 5, 80, 100)
    assert want != brute_first(rows, 3, 90, 100) and got == want


def test_linking_pairs_of_the_stage_share_a_region():
    from test_llm_pairs import shares_enough
    r, rule = np.random.default_rng(1), corpus_pipeline.NEAR
    seen = 0
    for n in (4, 5, 6, 9, 13, 20, 47, 130, 400, 1000):
        for _ in range(60):
            s = np.unique(r.integers(0, 2 ** 63, n).astype(np.uint64))
            drop = r.integers(0, n // 4 + 1)
            t = np.unique(np.concatenate([s[drop:], r.integers(0, 2 ** 63, r.integers(0, n // 4 - drop + 1)).astype(np.uint64)]))
            inter = len(np.intersect1d(s, t))
            if 100 * inter >= 80 * (len(s) + len(t) - inter):
                seen += 1
                assert np.intersect1d(jaccard_regions.signatures(s, rule), jaccard_regions.signatures(t, rule)).size
                assert shares_enough(s, t, rule)
    assert seen > 300
