"""Score daily records as they arrive, with a saved model.

Stateless: each micro-batch is scored by the same ``PipelineModel`` that
scores batches, so stream and batch results are equal.  The lag feature
must arrive inside the record (a streaming query cannot run a row-order
window).  Progress is kept in ``checkpoint`` on shared storage, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def score_stream(spark: SparkSession, source: str, model_path: str, sink: str, checkpoint: str,
                 schema: StructType, keep: list[str] | None = None, fmt: str = "parquet",
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    from ..sources.io import load_model
    model = load_model(model_path)
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    scored = model.transform(stream)
    if keep is not None:
        scored = scored.select(*keep, "prediction")
    w = scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
