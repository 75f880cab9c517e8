"""Labels for texts as they arrive.

Votes and posteriors depend on one row only, so the batch projection runs on a stream as it
is; there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weakloom.plans.labeling import FittedLabels
from weakloom.session import fresh_path


def start_labeling(stream: DataFrame, text: str, labels: FittedLabels, path: str,
                   checkpoint: str | None = None) -> StreamingQuery:
    """Append labelled rows to Parquet; progress is kept in the shared folder.

    Name a ``checkpoint`` folder to continue an earlier run.
    """
    location = checkpoint or fresh_path(stream.sparkSession, "labels-progress")
    return (labels.apply(stream, text).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", location).trigger(availableNow=True).start(path))
