"""Streaming ingest and bounded conversation state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TURNS = "conv_id long, turn long, role string, text string"


def ingest(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, priority: str | None = None):
    """Files that land in a folder go through the batch pipeline, a micro-batch at a
    time, each written under its number, so that a batch that is run again replaces
    its own output. Within a batch higher priority and earlier rows come first."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        if priority:
            df = df.orderBy(F.desc(priority), "submit_time")
        work(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_each(events: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen within the watermark's delay: an extension that makes ingest idempotent."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class LastTurns(StatefulProcessor):
    """The last turns of each conversation, kept as state."""

    def __init__(self, most: int = 20):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.turns.get()]
        for pdf in rows:
            held += list(pdf[["turn", "role", "text"]].itertuples(index=False, name=None))
        held = sorted(held, key=lambda r: r[0])[-self.most :]
        self.turns.put(held)
        yield pd.DataFrame([(key[0], len(held), int(held[-1][0]))], columns=["conv_id", "kept", "last_turn"])

    def close(self) -> None:
        pass


def last_turns(turns: DataFrame, most: int = 20) -> DataFrame:
    """conv_id, kept, last_turn after each micro-batch that touches a conversation."""
    return turns.groupBy("conv_id").transformWithStateInPandas(LastTurns(most), "conv_id long, kept long, last_turn long", "Update", "None")
