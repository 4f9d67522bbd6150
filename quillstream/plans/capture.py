"""Steps of one's own under capture: a document that one of them fails on is a reject, not the end of a job.

A step is any callable from a value to a value (a parser, a cleaner, an embedder), made
once in each task. Every document goes through all steps, one after another; what
the last gives is its result, and the first error, with the step's name, is its
reject. Results and rejects are one table, written once, and split after it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.sources import scratch

#: A step's name, and what makes it in a task.
Step = tuple[str, Callable[[], Callable[[Any], Any]]]
#: Rows that are worked on at once.
ROWS = 200


def captured(docs: DataFrame, steps: list[Step], id_col: str = "doc_id", value_col: str = "text") -> DataFrame:
    """docs to doc_id, result (JSON of what the last step gives, as its ``value``), step and error, of which
    result or error is null. A null value goes through the steps like any other; repeated
    rows and null ids are kept row by row; a step that cannot be made fails each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, Callable[[Any], Any] | Exception]] = []
        for name, make in steps:
            try:
                made.append((name, make()))
            except Exception as e:  # noqa: BLE001  each row tells why
                made.append((name, e))

        def one(value):
            for name, step in made:
                try:
                    if isinstance(step, Exception):
                        raise step
                    value = step(value)
                except Exception as e:  # noqa: BLE001  a step may fail in any way
                    return None, name, f"{type(e).__name__}: {e}"
            try:
                return json.dumps({"value": value}, ensure_ascii=False), None, None
            except (TypeError, ValueError) as e:
                return None, "result", f"{type(e).__name__}: {e}"

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows = [one(v) for v in part.column(1).to_pylist()]
                columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "result", "step", "error"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("value")).mapInArrow(run, f"doc_id {kind}, result string, step string, error string")


def split(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """What captured() gives to results (doc_id, result of ``schema``) and rejects (doc_id, step, error).
    The rows are written down first, so every step runs once for each document."""
    held = scratch.stored(rows, "captured")
    good = held.where(F.col("error").isNull()).select("doc_id", F.from_json("result", f"struct<value:{schema}>")["value"].alias("result"))
    return good, held.where(F.col("error").isNotNull()).select("doc_id", "step", "error")
