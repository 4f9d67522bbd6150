"""Counts that are taken while data pass, in batches and streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming.listener import StreamingQueryListener


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what the first job that reads all of it counts on the way: no pass of its own."""
    told = Observation(name)
    return df.observe(told, *[c.alias(k) for k, c in counts.items()]), told


class Progress(StreamingQueryListener):
    """What each micro-batch of the session's streams read and counted, handed to ``keep`` as a
    dictionary: the stream's name and batch, its input rows, and what observe() counted in it."""

    def __init__(self, keep: Callable[[dict], None]):
        self.keep = keep

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.keep({"name": p.get("name"), "batch": p["batchId"], "rows": p["numInputRows"], "observed": p.get("observedMetrics") or {}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
