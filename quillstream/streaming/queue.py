"""A priority queue over micro-batches.

Tasks and requests for tasks are rows of one stream. A request takes so many of a
queue's waiting tasks, those of the highest priority first, ties by the time of
submission and then by the task's number. What no request has taken waits for
later micro-batches and outlives restarts.

``Queues`` keeps waiting tasks in tables: a micro-batch writes the tasks that it
brings, and a request sorts those that wait over many tasks, so that a queue may
have any length. ``taken`` keeps a queue's tasks as state of one key, in one task:
for short queues in great number, whose tasks, given a ``patience``, leave as expired
by a timer when they wait longer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstream.sources import numbering, scratch

#: Rows of the stream: a task (task_id, priority, submitted) or a request for ``take`` of them.
ROWS = "queue string, task_id long, priority int, submitted long, take int"
#: What leaves a queue: the task, its place in the queue's order of leaving, and why (taken or expired).
OUT = "queue string, place long, task_id long, priority int, submitted long, status string"
#: A waiting task: ``part`` is the micro-batch that it came in, ``row`` its number there; both tell tasks alike apart.
TASKS = "queue string, task_id long, priority int, submitted long, part long, row long"
#: After a request: the key of the last task that it took of a queue, and how many have left the queue so far.
CUTS = "queue string, number long, until struct<k1:bigint,k2:bigint,k3:bigint,k4:bigint,k5:bigint>, left long"
WANTS = "queue string, want long"
#: Micro-batches until what waits is written together as one table.
EVERY = 10


def _order() -> dict[str, Column]:
    """The order of leaving: highest priority first, without one last."""
    return {"k1": F.coalesce(-F.col("priority").cast("long"), F.lit(1 << 62)), "k2": F.coalesce("submitted", F.lit((1 << 63) - 1)), "k3": F.col("task_id"), "k4": F.col("part"), "k5": F.col("row")}


def _key() -> Column:
    return F.struct(*[c.alias(k) for k, c in _order().items()])


class Queues:
    """Queues in a folder, a table for each micro-batch under its number: ``came`` (its tasks), ``wants`` (its
    requests), ``taken`` (what left) and ``cuts`` (the last key that left each queue). A task of micro-batch n
    waits as long as its key is above all cuts of n and later, so tasks are written once and not again when
    others leave. Every tenth micro-batch writes those that wait together (``base``) and the queues' totals
    (``lefts``); the next one deletes what these replace. A micro-batch reads what earlier ones wrote and
    replaces what it wrote itself, so one that is run again gives the same."""

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _at(self, name: str, number: int) -> str:
        return f"{self.path}/{name}/batch={number}"

    def _numbers(self, name: str, after: int = -1, until: int | None = None) -> list[int]:
        """Micro-batches that have such a table, after one and up to another."""
        fs, where = scratch.at(self.spark, f"{self.path}/{name}")
        found = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(where)) if fs.exists(where) else []
        return [n for n in found if n > after and (until is None or n <= until)]

    def _read(self, name: str, numbers: list[int], schema: str) -> DataFrame:
        paths = [self._at(name, n) for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(self._at(name, number))

    def _base(self, number: int) -> int:
        """The last micro-batch before this one that wrote what waits together; -1 for none."""
        return max(self._numbers("base", until=number - 1), default=-1)

    def _waiting(self, base: int, came: int, cut: int) -> DataFrame:
        """Tasks that came up to one micro-batch and wait after the cuts up to another. ``held`` is the table they lie in."""
        held = self._read("came", self._numbers("came", base, came), TASKS).withColumn("held", F.col("part"))
        if base >= 0:
            held = held.unionByName(self._read("base", [base], TASKS).withColumn("held", F.lit(base).cast("long")))
        if not (numbers := self._numbers("cuts", base, cut)):
            return held
        # The highest cut for each queue and table: a row for each queue that was asked and micro-batch since the base.
        tables = F.explode(F.sequence(F.lit(base).cast("long"), F.col("number")))
        marks = self._read("cuts", numbers, CUTS).select(F.col("queue").alias("__queue"), tables.alias("__held"), "until").groupBy("__queue", "__held").agg(F.max("until").alias("until"))
        met = held.join(marks, held["queue"].eqNullSafe(marks["__queue"]) & (held["held"] == marks["__held"]), "left")
        return met.where(F.col("until").isNull() | (_key() > F.col("until"))).select(*held.columns)

    def _lefts(self, base: int, until: int) -> DataFrame:
        """queue, left: how many tasks have left each queue that was asked."""
        told = self._read("cuts", self._numbers("cuts", base, until), CUTS).select("queue", "left")
        if base >= 0:
            told = told.unionByName(self._read("lefts", [base], "queue string, left long"))
        return told.groupBy("queue").agg(F.max("left").alias("left"))

    def batch(self, rows: DataFrame, number: int) -> None:
        """One micro-batch of ROWS: its tasks come before its requests, in whatever order rows arrive."""
        base = self._base(number)
        self._forget(base)
        mine = F.lit(number).cast("long")
        self._write(rows.where("task_id IS NOT NULL").select("queue", "task_id", "priority", "submitted", mine.alias("part"), F.monotonically_increasing_id().alias("row")), "came", number)
        self._write(rows.where("take IS NOT NULL").groupBy("queue").agg(F.sum(F.col("take").cast("long")).alias("want")), "wants", number)
        wants = self._read("wants", [number], WANTS).where("want > 0")
        if not wants.isEmpty():
            lefts = self._lefts(base, number - 1).withColumnRenamed("queue", "__queue")
            asked = wants.join(lefts, wants["queue"].eqNullSafe(lefts["__queue"]), "left").select(F.col("queue").alias("__queue"), "want", F.coalesce("left", F.lit(0)).alias("left"))
            held = self._waiting(base, number, number - 1)
            met = held.join(asked, held["queue"].eqNullSafe(asked["__queue"])).drop("__queue", "held").withColumns(_order())
            out = numbering.ranked(met, ["queue"], list(_order())).where("place <= want").withColumn("place", F.col("left") + F.col("place"))
            self._write(out.select("queue", "place", "task_id", "priority", "submitted", F.lit("taken").alias("status"), "part", "row"), "taken", number)
            gone = self._read("taken", [number], f"{OUT}, part long, row long")
            self._write(gone.groupBy("queue").agg(F.max(_key()).alias("until"), F.max("place").alias("left")).select("queue", mine.alias("number"), "until", "left"), "cuts", number)
        if number % self.every == self.every - 1:
            self._write(self._waiting(base, number, number).drop("held"), "base", number)
            self._write(self._lefts(base, number), "lefts", number)

    def _forget(self, base: int) -> None:
        for name in ("came", "wants", "cuts", "base", "lefts"):
            for n in self._numbers(name, until=base if name in ("came", "wants", "cuts") else base - 1):
                fs, where = scratch.at(self.spark, self._at(name, n))
                fs.delete(where, True)

    def follow(self, rows: DataFrame, checkpoint: str, **trigger):
        """The running query that feeds a stream of ROWS to the queues; by default it ends with what is there."""
        return rows.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def taken(self) -> DataFrame:
        """All that has left, as OUT."""
        return self._read("taken", self._numbers("taken"), OUT)


class PriorityQueue(StatefulProcessor):
    """One queue: tasks that come are added to the state, a request reads and writes all. Queues are the unit of parallel work."""

    def __init__(self, patience_ms: int | None = None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rank int, submitted long, task_id long, since long")
        self.left = handle.getValueState("left", "n long")

    def _out(self, key, tasks: list[tuple], status: str) -> Iterator[pd.DataFrame]:
        if not tasks:
            return
        n = self.left.get()[0] if self.left.exists() else 0
        self.left.update((n + len(tasks),))
        yield pd.DataFrame([(key[0], n + i, t[2], -t[0], t[1], status) for i, t in enumerate(tasks, 1)], columns=["queue", "place", "task_id", "priority", "submitted", "status"])

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.patience else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        now, wanted = self._now(timerValues), 0
        for part in rows:
            for task_id, priority, submitted, take in part[["task_id", "priority", "submitted", "take"]].itertuples(index=False, name=None):
                if not pd.isna(task_id):
                    new.append((-int(priority), int(submitted), int(task_id), now))
                if not pd.isna(take):
                    wanted += int(take)
        taken: list[tuple] = []
        if wanted > 0:
            # Within a micro-batch tasks come before requests, in whatever order rows arrive.
            heap = [*(tuple(t) for t in self.waiting.get()), *new]
            heapq.heapify(heap)
            taken = [heapq.heappop(heap) for _ in range(min(wanted, len(heap)))]
            self.waiting.put(heap) if heap else self.waiting.clear()
        elif new:
            self.waiting.appendList(new)
        if self.patience and new:
            self.handle.registerTimer(now + self.patience)
        yield from self._out(key, taken, "taken")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() - self.patience
        heap = [tuple(t) for t in self.waiting.get()]
        gone = sorted(t for t in heap if t[3] <= until)
        kept = [t for t in heap if t[3] > until]
        self.waiting.put(kept) if kept else self.waiting.clear()
        yield from self._out(key, gone, "expired")

    def close(self) -> None:
        pass


def taken(rows: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """A stream of ROWS to the tasks that leave their queues, as OUT. With a patience timers make
    micro-batches without rows too, so the stream needs a trigger by time: availableNow would not end."""
    mode = "ProcessingTime" if patience_ms else "None"
    return rows.groupBy("queue").transformWithStateInPandas(PriorityQueue(patience_ms), OUT, "Append", mode)
