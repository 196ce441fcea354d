"""Transcripts are finished recordings, so the operators are batch plans.

turns() and loops work per recording; new recordings can be fed to them file by file with foreachBatch:
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Run a batch plan over every micro-batch of whole recordings and append its rows to folder.

    A batch that is run again after a failure overwrites its own part, so each recording is written once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
