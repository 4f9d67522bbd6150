"""Answers by a language model behind a small interface, and what takes their place.

A client is any callable from a system prompt and a user prompt to a text, made
once in each task by a factory, so that connections are not shipped. Where it
fails the row gets a fallback text with the error and the context, and the error
itself in a column, so that one bad call does not end a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.answer import fallback


class Client(Protocol):
    """A language model: one call, one text."""

    def __call__(self, system: str, user: str) -> str: ...


def echo() -> Client:
    """The offline client, which repeats the end of the user prompt."""
    return lambda system, user: user[-200:]


def completed(prompts: DataFrame, make: Callable[[], Client] = echo, context: Column | None = None) -> DataFrame:
    """prompts (query_id, system_prompt, user_prompt, any others) with answer and error.

    ``context`` is the text that a failed call hands on; null prompts count as empty.
    """
    kept = prompts.withColumn("__context", F.lit("") if context is None else F.coalesce(context, F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for rows in batches:
            texts, errors = [], []
            for system, user in zip(rows["system_prompt"], rows["user_prompt"], strict=True):
                try:
                    texts.append(client(system or "", user or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a client may fail in any way; the row tells how
                    texts.append(None)
                    errors.append(str(e))
            yield rows.assign(__text=texts, __error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    out = kept.mapInPandas(run, f"{schema}, __text string, __error string")
    text = F.when(F.col("__error").isNotNull(), fallback(F.col("__error"), F.col("__context"))).otherwise(F.col("__text"))
    return out.select(*prompts.columns, text.alias("answer"), F.col("__error").alias("error"))
