"""When runs happen: once, every so many seconds, or when a message arrives.

A message only wakes a run, which is always a full pass, so its content is not read and all
messages of a micro-batch cause one pass. `poll` is the safety sweep beside the messages. A
`queue` (see `wakes`) wakes a run within a second, sweeps, and keeps its messages until the pass
that they caused is over.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from mediacat.config import POLL_SECONDS
from mediacat.streaming import wakes

# Seconds to wait after an error of a source, names of the message queues.
BACK_OFF = wakes.BACK_OFF
#: Seconds between two looks at a queue.
LOOK = 1.0
VIDEO_QUEUE, IMAGE_QUEUE = "transcode:requests", "pdq:requests"


def is_one_shot(queue: str | None, poll: float) -> bool:
    return not queue and poll <= 0


def patient(run: Callable[[], dict], warn: Callable[[str], None], seconds: float = BACK_OFF, sleep: Callable[[float], None] = time.sleep) -> Callable[[], dict]:
    """run, but an error of the source is a warning and a wait, and the next trigger tries again."""

    def once() -> dict:
        try:
            return run()
        except OSError as e:
            warn(str(e))
            sleep(seconds)
            return {}

    return once


def serve(spark: SparkSession, run: Callable[[], dict], messages: str | None = None, poll: float = 0.0, checkpoint: str | None = None, queue: wakes.Messages | None = None) -> dict | StreamingQuery:
    """One run's summary, or the query that goes on running until it is stopped.

    messages: a directory in which each new JSON-lines file is a message. With messages a poll
    of 0 means the default sweep.
    """
    if is_one_shot(messages, poll) and queue is None:
        return run()
    if queue is not None:
        stream, seconds = wakes.stream(spark, queue, poll or POLL_SECONDS), LOOK
    elif messages:
        stream = spark.readStream.schema("payload string").json(messages).withColumnRenamed("payload", "_p")
        seconds = poll or POLL_SECONDS
    else:
        stream = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        seconds = poll
    writer = stream.writeStream.foreachBatch(lambda batch, number: run() and None).trigger(processingTime=f"{seconds} seconds")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def drain(spark: SparkSession, run: Callable[[], dict], messages: str, checkpoint: str) -> None:
    """A pass for the messages that there are now, then the end; later calls see later ones only."""
    stream = spark.readStream.schema("payload string").json(messages)
    stream.writeStream.foreachBatch(lambda batch, number: run() and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
