"""Row-wise stages as streams: they see each file once, however often they are started."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import classify, text


def scrubbed(events: DataFrame) -> DataFrame:
    """Events with clean content and the classes that need no other row: the stateless half of the strip stage."""
    clean = text.scrub(F.col("content"))
    bash = (F.col("class_") == "code_action") & (F.col("language") == "bash")
    return events.withColumns({"content": clean, "command_class": F.when(bash, classify.command_class(clean)), "noise": (F.col("source") == "environment") & classify.is_noise(clean)})


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, as files of Parquet, and stop; the checkpoint makes each row count once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; the watermark bounds the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
