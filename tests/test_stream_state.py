"""The previous row in a stream, and metrics of a scored stream."""

import datetime as dt
import random

import pandas as pd
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from panelcast.functions.features import lag_feature
from panelcast.plans.common import prep
from panelcast.streaming import evaluation
from panelcast.streaming.lag import History, lag_stream, rocksdb_state

DAY = dt.date(2020, 1, 1)
SCHEMA = "series string, day date, y long, extra string"


def day(n):
    return DAY + dt.timedelta(days=n)


class Feed:
    """A folder that gets a file per micro-batch, and a query that reads it."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.files = spark, tmp_path, schema, 0

    def add(self, rows, folder="in"):
        import os
        df = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(str(self.path / folder))
        self.files += 1
        for f in (self.path / folder).glob("*.parquet"):         # files in the order they were added
            if str(f) not in self.__dict__.setdefault("seen", {}):
                self.seen[str(f)] = 1_600_000_000 + 60 * self.files
                os.utime(f, (self.seen[str(f)],) * 2)

    def source(self, folder="in", schema=None):
        return self.spark.readStream.schema(schema or self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / folder))

    def run(self, df):
        with rocksdb_state(self.spark):
            q = (df.writeStream.format("parquet").option("path", str(self.path / "out"))
                 .option("checkpointLocation", str(self.path / "chk")).trigger(availableNow=True).start())
        q.awaitTermination()
        return [tuple(r) for r in self.spark.read.parquet(str(self.path / "out")).collect()]


def test_stream_lag_equals_the_batch_lag_over_restarts(spark, tmp_path):
    p = prep(spark, SF_SMALL, ["y"]).select("series", "day", "y", "x_qty").persist()
    cuts = [r.day for r in p.select("day").distinct().orderBy("day").collect()]
    cuts = [cuts[0], cuts[len(cuts) // 4], cuts[len(cuts) // 2], cuts[3 * len(cuts) // 4], cuts[-1] + dt.timedelta(days=1)]
    feed = Feed(spark, tmp_path, p.schema)
    part = [p.where((F.col("day") >= a) & (F.col("day") < b)) for a, b in zip(cuts, cuts[1:])]
    for x in part[:2]:
        feed.add(x.orderBy(F.rand(1)))                           # within a micro-batch in any order
    first = feed.run(lag_stream(feed.source(), "y"))
    for x in part[2:]:
        feed.add(x)
    got = feed.run(lag_stream(feed.source(), "y"))               # a new query, state from the checkpoint
    assert 0 < len(first) < len(got)
    want = [tuple(r) + ("on time",) for r in lag_feature(p, "y").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_late_repeated_and_undated_records(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    feed.add([("a", day(i), 10 * i, None) for i in (3, 1, 5)] + [("a", day(5), 99, "again"), (None, day(1), 7, None)])
    feed.add([("a", day(2), 20, "late"), ("a", day(5), 98, "again"), ("a", None, 1, None), ("b", day(9), 1, None)])
    feed.add([("a", day(0), 0, "late"), ("a", day(6), None, "null value"), (None, day(2), 8, None)])
    feed.add([("a", day(7), 70, None)])
    got = {(r[0], r[1]): r[2:] for r in feed.run(lag_stream(feed.source(), "y"))}
    assert got == {("a", day(1)): (10, None, None, "on time"), ("a", day(3)): (30, None, 10, "on time"), ("a", day(5)): (50, None, 30, "on time"),
                   ("a", day(2)): (20, "late", 10, "late"), ("a", None): (1, None, None, "undated"), ("b", day(9)): (1, None, None, "on time"),
                   ("a", day(0)): (0, "late", None, "late"), ("a", day(6)): (None, "null value", 50, "on time"), ("a", day(7)): (70, None, None, "on time"),
                   (None, day(1)): (7, None, None, "on time"), (None, day(2)): (8, None, 7, "on time")}


def test_state_is_bounded(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    feed.add([("a", day(i), i, None) for i in range(10)])
    feed.add([("a", day(20), 20, None), ("a", day(8), 88, "repeat"), ("a", day(1), 1, "forgotten")])
    got = {(r[1], r[3]): r[4:] for r in feed.run(lag_stream(feed.source(), "y", keep=3))}
    assert len(got) == 12
    assert got[day(20), None] == (9, "on time") and got[day(1), "forgotten"] == (None, "lost")


def test_history_equals_a_sorted_list():
    r = random.Random(1)
    for keep in (3, 50):
        h, seen = History([], [], False, keep), []
        for _ in range(300):
            d, n = r.randrange(80), r.choice([1, 2])
            got = h.add(d, d * 2, n)
            kept = sorted(seen)[-keep:]
            older = [x for x in kept if x < d]
            if d in kept:
                assert got is None
            elif len(older) >= n:
                assert got[0] == older[-n] * 2 and got[1] == ("late" if older[-1] != kept[-1] else "on time")
            else:
                assert got[0] is None
            if got is not None and got[1] != "lost":
                seen.append(d)
            assert len(h.days) <= keep and h.days == sorted(h.days)


def test_a_key_and_a_place_are_needed(spark, tmp_path):
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="series key"):
        lag_stream(s, "y", by="")
    with pytest.raises(ValueError, match="between"):
        lag_stream(s, "y", n=9, keep=3)


# --- metrics of a stream ---

P, T = "series string, day date, prediction double", "series string, day date, y long"


def batch_metrics(predictions, truths, until, days=28):
    """From the definition, with pandas: windows that end by ``until``."""
    p = pd.DataFrame(predictions, columns=["series", "day", "prediction"])
    t = pd.DataFrame(truths, columns=["series", "day", "y"])
    x = p.merge(t, "left", on=["series", "day"])
    x["w"] = [(d - dt.date(1970, 1, 1)).days // days for d in x["day"]]
    out = {}
    for w, g in x.groupby("w"):
        if (w + 1) * days > (until - dt.date(1970, 1, 1)).days:
            continue
        m = g.dropna(subset="y")
        e = m["prediction"] - m["y"]
        sst = ((m["y"] - m["y"].mean()) ** 2).sum()
        out[dt.date(1970, 1, 1) + dt.timedelta(days=w * days)] = (len(m), len(g) - len(m), e.abs().mean(), (e * e).mean(), (e * e).mean() ** 0.5, 1 - (e * e).sum() / sst if sst else None)
    return out


def test_metrics_of_a_scored_stream(spark, tmp_path):
    r = random.Random(4)
    predictions = [(s, day(i), r.uniform(0, 50)) for i in range(120) for s in ("a", "b", "c")]
    truths = [(s, d, r.randrange(50)) for s, d, _ in predictions if r.random() > 0.15]
    feed = Feed(spark, tmp_path, P)
    for i in range(0, 120, 30):
        feed.add([x for x in predictions if day(i) <= x[1] < day(i + 30)], "p")
    feed.schema = T
    for i in range(-20, 120, 35):                                # truths trail and come in other cuts, out of order
        some = [x for x in truths if day(i) <= x[1] < day(i + 35)]
        r.shuffle(some)
        if some:
            feed.add(some, "t")

    def query():
        q = evaluation.evaluate_stream(spark, str(tmp_path / "p"), str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "chk"),
                                       spark.createDataFrame([], P).schema, spark.createDataFrame([], T).schema, delay="40 days", files_per_trigger=1)
        q.awaitTermination()
        return {x.window_start: x for x in spark.read.parquet(str(tmp_path / "out")).collect()}

    # the watermark stands 40 days behind the older stream: no window has closed that a late truth may change
    got = query()
    assert all(x.window_end <= day(119 - 40) for x in got.values())
    # records of a far day close all windows before (a heartbeat); state comes from the checkpoint
    feed.schema = P
    feed.add([("end", day(400), 0.0)], "p")
    feed.schema = T
    feed.add([("end", day(400), 0)], "t")
    got = query()
    want = batch_metrics(predictions, truths, day(400 - 40))
    assert set(got) == set(want) and len(want) >= 4
    for w, (n, missing, *values) in want.items():
        assert (got[w].n, got[w].n_unmatched) == (n, missing)
        assert all(abs(a - b) < 1e-9 for a, b in zip((got[w].mae, got[w].mse, got[w].rmse, got[w].r2), values))


def test_window_metrics_of_a_table(spark):
    rows = [("a", day(0), 1.0, 2.0), ("a", day(1), 1.0, None), ("a", day(40), 3.0, 5.0), ("a", day(41), 3.0, 5.0), ("a", day(90), 3.0, None)]
    df = spark.createDataFrame(rows, "series string, event_time date, prediction double, label double").withColumn("event_time", F.col("event_time").cast("timestamp"))
    got = sorted(tuple(r)[2:] for r in evaluation.window_metrics(df).collect())
    assert got == [(0, 1, None, None, None, None), (1, 1, 1.0, 1.0, 1.0, None), (2, 0, 2.0, 4.0, 2.0, None)] or \
        sorted(map(str, got)) == sorted(map(str, [(0, 1, None, None, None, None), (1, 1, 1.0, 1.0, 1.0, None), (2, 0, 2.0, 4.0, 2.0, None)]))
