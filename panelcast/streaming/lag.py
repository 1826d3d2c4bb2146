"""The previous row of a series, in a stream.

``lag_stream`` gives each arriving record the value of the row before it, as
``functions.features.lag_feature`` does for a table: by row position, not by
calendar day.  State is kept per series (``transformWithStateInPandas``): its
last ``keep`` days with their values, so it does not grow with the stream.

* Records of a micro-batch are taken in order of their day, whatever order
  they arrived in.
* A late record (an earlier day than one already seen) gets the value of the
  kept row before it and status ``late``; records that were given out before it
  keep their lag.  If it is older than all kept days while older ones have been
  forgotten, its lag is null and its status ``lost``.
* A repeated day (kept or in the same micro-batch) is left out, as ``(series,
  day)`` is a key; the first record counts.  Repeats of forgotten days can't
  be told from lost records.
* A record without a day has a null lag and status ``undated``; records with a
  null series are one series, as in ``lag_feature``.

With records in order of their days, over any number of micro-batches and
restarts, rows equal ``lag_feature`` on the whole table.
"""

from __future__ import annotations

from bisect import bisect_left
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

KEEP = 64
STATUS = "lag_status"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State stores of queries started inside are RocksDB's, which
    ``transformWithState`` needs; a running query keeps its own."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class History:
    """Kept (day, value) pairs of a series, by day; ``cut``: older ones have
    been forgotten."""

    def __init__(self, days: list, values: list, cut: bool, keep: int):
        self.days, self.values, self.cut, self.keep = list(days), list(values), cut, keep

    def add(self, day, value, n: int):
        """Lag and status of a new record; None if its day is known."""
        at = bisect_left(self.days, day)
        if at < len(self.days) and self.days[at] == day:
            return None
        status = "on time" if at == len(self.days) else "late" if at >= n or not self.cut else "lost"
        before = self.values[at - n] if at >= n else None
        if at or not self.cut:          # an older one than all kept is not kept
            self.days.insert(at, day)
            self.values.insert(at, value)
        while len(self.days) > self.keep:
            del self.days[0], self.values[0]
            self.cut = True
        return before, status


class PreviousRow(StatefulProcessor):
    def __init__(self, value: str, order: str, out: str, n: int, keep: int, schema: T.StructType):
        self.value, self.order, self.out, self.n, self.keep, self.schema = value, order, out, n, keep, schema

    def init(self, handle) -> None:
        fields = {f.name: f.dataType for f in self.schema.fields}
        self.rows = handle.getListState("rows", T.StructType([T.StructField("day", fields[self.order]), T.StructField("value", fields[self.value])]))
        self.cut = handle.getValueState("cut", T.StructType([T.StructField("cut", T.BooleanType())]))

    def handleInputRows(self, key, rows, timerValues):
        arrived = pd.concat(list(rows), ignore_index=True)
        arrived = arrived.sort_values(self.order, kind="stable", na_position="last", ignore_index=True)
        kept = list(self.rows.get()) if self.rows.exists() else []
        history = History([r[0] for r in kept], [r[1] for r in kept], self.cut.exists() and self.cut.get()[0], self.keep)
        chosen, lags, states = [], [], []
        for i, (day, value) in enumerate(zip(arrived[self.order], arrived[self.value])):
            given = (None, "undated") if pd.isna(day) else history.add(day, None if pd.isna(value) else value, self.n)
            if given is not None:
                chosen.append(i)
                lags.append(given[0])
                states.append(given[1])
        self.rows.put([(d, _plain(v)) for d, v in zip(history.days, history.values)])
        self.cut.update((history.cut,))
        out = arrived.iloc[chosen].reset_index(drop=True)
        out[self.out] = pd.Series(lags, dtype=object)
        out[STATUS] = states
        yield out

    def close(self) -> None:
        pass


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def lag_stream(stream: DataFrame, col: str, n: int = 1, out: str | None = None, by: str = "series",
               order: str = "day", keep: int = KEEP) -> DataFrame:
    """``stream`` with the value of ``col`` ``n`` rows earlier in the same
    series and ``lag_status``.  Start the query inside ``rocksdb_state``."""
    if not by:
        raise ValueError("lag_stream needs a series key")
    if not 1 <= n <= keep:
        raise ValueError("n must lie between 1 and keep")
    out = out or (f"{col}_prev" if n == 1 else f"{col}_lag{n}")
    schema = T.StructType([*stream.schema.fields, T.StructField(out, stream.schema[col].dataType), T.StructField(STATUS, T.StringType())])
    return stream.groupBy(by).transformWithStateInPandas(
        statefulProcessor=PreviousRow(col, order, out, n, keep, stream.schema), outputStructType=schema,
        outputMode="Append", timeMode="None").select(*[f.name for f in schema.fields])


def score_records(spark: SparkSession, source: str, model_path: str, sink: str, checkpoint: str, schema: T.StructType,
                  lag_of: str = "y", month_parts=("sin", "cos"), dropna: list[str] | None = None,
                  keep: list[str] | None = None, fmt: str = "parquet", files_per_trigger: int | None = None,
                  available_now: bool = True, processing_time: str | None = None, lag_keep: int = KEEP) -> StreamingQuery:
    """Raw daily records (no lag inside) scored as they arrive: month, its sine
    and cosine, the previous row's ``lag_of``, rows with a null in ``dropna``
    (all columns unless given) left out, then the saved model.  A restarted
    query goes on with the state and files in ``checkpoint``."""
    from ..functions.features import calendar_parts, cyclical, drop_nulls
    from ..sources.io import load_model
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = calendar_parts(reader.load(source), "day", ("month",))
    if month_parts:
        rows = cyclical(rows, "month", 12, month_parts)
    rows = drop_nulls(lag_stream(rows, lag_of, keep=lag_keep), dropna)
    scored = load_model(model_path).transform(rows)
    if keep is not None:
        scored = scored.select(*keep, "prediction")
    w = scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    with rocksdb_state(spark):
        return w.start()
