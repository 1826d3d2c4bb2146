"""op4: the law, gapless slots, groups kept together, hot groups split evenly."""

import zlib

from llm_helpers import ODD, docs_frame, words

from panelcast.llm import label_shards


def held(rows, n, shards=24):
    counts = [0] * shards
    slots = {}
    for r in rows:
        counts[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert len(rows) == n and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def cut(rows):
    by = {}
    for r in rows:
        by.setdefault((r.size, r.text_crc32), []).append(r.shard)
    return sum(len(s) - max(map(s.count, set(s))) for s in by.values())


def test_groups_come_together(spark):
    rows = [(i, words(8, i // 3 if i < 600 else i)) for i in range(2000)]
    got = label_shards.assign(docs_frame(spark, rows)).collect()
    held(got, 2000)
    by = dict(rows)
    assert all(r.size == len(by[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(by[r.doc_id].encode()) for r in got)
    assert cut(got) <= 10


def test_a_hot_group_is_spread_evenly(spark):
    rows = [(i, "the same text" if i < 700 else words(9, i // 2)) for i in range(2000)]
    got = label_shards.assign(docs_frame(spark, rows)).collect()
    held(got, 2000)
    hot = [r.shard for r in got if r.size == 21]
    assert len(hot) == 700 and len(set(hot)) < 24       # a shard holds 84 rows at most: 9 shards at least


def test_iterations_lower_the_cut(spark):
    rows = label_shards.table_of(docs_frame(spark, [(i, words(8, i // 4)) for i in range(800)]))
    _, cuts = label_shards.propagate(rows, label_shards.quotas(800, 24))
    assert cuts == sorted(cuts, reverse=True) and cuts[-1] < cuts[0] / 3


def test_buckets_rank_as_one(spark, monkeypatch):
    monkeypatch.setattr(label_shards, "BUCKET_ROWS", 50)
    held(label_shards.assign(docs_frame(spark, [(i, words(5, i // 2)) for i in range(900)]), shards=5).collect(), 900, 5)


def test_edge_cases(spark):
    got = label_shards.assign(docs_frame(spark, ODD)).collect()
    held(got, len(ODD))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 1} == {(8, 0)}
    assert label_shards.assign(docs_frame(spark, [])).count() == 0


def test_native_plan(spark):
    d = label_shards.assign(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = d._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
