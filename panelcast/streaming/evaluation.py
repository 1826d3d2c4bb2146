"""Metrics of a scored stream, when the truth arrives after the prediction.

Predictions and truths are two streams keyed by (series, day).  They are joined
on that key, which holds the event time, so state is dropped as the watermark
passes: a truth may trail by ``delay``, and a prediction whose truth has not come
by then counts as unmatched.  Errors are aggregated per event-time window and a
window is given out once, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def with_event_time(stream: DataFrame, day: str = "day", out: str = "event_time", delay: str = "7 days") -> DataFrame:
    """``out``: midnight UTC of the day, whatever the session's zone."""
    return stream.withColumn(out, F.timestamp_seconds(F.unix_date(F.col(day).cast("date")).cast("long") * 86400)).withWatermark(out, delay)


def matched(predictions: DataFrame, truths: DataFrame, label: str = "y", prediction: str = "prediction",
            by: list[str] | tuple = ("series",), day: str = "day", delay: str = "7 days") -> DataFrame:
    """series..., event_time, prediction and label (null where no truth came)."""
    p = with_event_time(predictions, day, delay=delay).select(*by, "event_time", F.col(prediction).cast("double").alias("prediction"))
    t = with_event_time(truths, day, "truth_time", delay).select(
        *[F.col(b).alias(f"truth_{b}") for b in by], "truth_time", F.col(label).cast("double").alias("label"))
    on = F.col("event_time") == F.col("truth_time")
    for b in by:
        on = on & (F.col(b) == F.col(f"truth_{b}"))
    return p.join(t, on, "left_outer").select(*by, "event_time", "prediction", "label")


def window_metrics(rows: DataFrame, window: str = "28 days", by: list[str] | tuple = ()) -> DataFrame:
    """Per window (and ``by``): start and end, n matched, n_unmatched, MAE, MSE,
    RMSE, R2 (null if the truth is constant or none came).  ``rows`` as of
    ``matched``; batch or stream."""
    e = F.col("prediction") - F.col("label")
    n = F.count("label")
    sst = n * F.var_pop(F.when(F.col("prediction").isNotNull(), F.col("label")))
    parts = rows.groupBy(F.window("event_time", window), *by).agg(
        n.alias("n"), F.sum(F.when(F.col("label").isNull(), 1).otherwise(0)).cast("long").alias("n_unmatched"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("_sse"), sst.alias("_sst"))
    date = lambda c: F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))
    return parts.select(date(F.col("window.start")).alias("window_start"), date(F.col("window.end")).alias("window_end"), *by,
                        "n", "n_unmatched", "mae", "mse", F.sqrt("mse").alias("rmse"),
                        (1 - F.when(F.col("_sst") > 0, F.col("_sse") / F.col("_sst"))).alias("r2"))


def evaluate_stream(spark: SparkSession, predictions: str, truths: str, sink: str, checkpoint: str,
                    prediction_schema: StructType, truth_schema: StructType, label: str = "y",
                    window: str = "28 days", delay: str = "7 days", by: list[str] | tuple = (),
                    files_per_trigger: int | None = None, fmt: str = "parquet",
                    available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Read both folders as streams and write the metrics of closed windows."""
    def read(path, schema):
        r = spark.readStream.schema(schema).format(fmt)
        return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)
    rows = matched(read(predictions, prediction_schema), read(truths, truth_schema), label, delay=delay)
    w = (window_metrics(rows, window, by).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
