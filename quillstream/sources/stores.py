"""Files, vector tables and chunk stores as DataFrames, and what changes them."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.sources.numbering import ranked
from quillstream.sources.snapshots import SnapshotStore

CHUNKS = "id string, text string, metadata map<string,string>"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files, for signatures and downloads."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chunks in a file a knowledge base."""
    return spark.read.schema(CHUNKS).json(path, multiLine=True)


def write_chunk_store(rows: DataFrame, path: str) -> None:
    """Chunks (id, text, metadata) as JSON arrays, one in each file, as chunk_store() reads them."""

    def arrays(batches):
        first = True
        for batch in batches:
            lines = ["[" if first and i == 0 else "," for i in range(batch.num_rows)]
            first = first and not batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([m + j for m, j in zip(lines, batch.column(0).to_pylist(), strict=True)], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    rows.select(F.to_json(F.struct("id", "text", "metadata")).alias("value")).mapInArrow(arrays, "value string").write.text(path)


def relational(spark: SparkSession, url: str, name: str, by: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table over JDBC, read in ``parts`` by ranges of a numeric column where one is named."""
    options = {"url": url, "dbtable": name}
    if by is not None:
        options |= {"partitionColumn": by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


class Vectors(Protocol):
    """What a store of vectors can do; another one may take the place of :class:`SnapshotStore`."""

    def read(self, kb: str | None = None) -> DataFrame: ...
    def add(self, rows: DataFrame, dimension: int | None = None) -> None: ...
    def count(self, kb: str | None = None) -> int: ...
    def delete(self, kb: str, ids: DataFrame | None = None, where: Column | None = None) -> None: ...
    def drop(self, kb: str) -> None: ...
    def reset(self) -> None: ...


#: The store that the engine uses.
VectorStore = SnapshotStore


def appended(store: DataFrame, new: DataFrame) -> DataFrame:
    """store and the new rows whose id it has not, each id once (the first by text)."""
    first = Window.partitionBy("id").orderBy("text")
    once = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return store.unionByName(once.join(store.select("id"), "id", "left_anti"))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def vector_rows(chunks: DataFrame, ts: Column) -> DataFrame:
    """Chunks (document_id, chunk_index, text, embedding, structure_path, bbox, ...) as
    vector rows; custom_metadata, a map or a JSON text, is kept where there is such a column."""
    cid = F.concat_ws("_", "document_id", F.lit("chunk"), F.col("chunk_index").cast("string"), F.substring(F.md5("text"), 1, 8))
    custom = F.lit(None).cast("string")
    if "custom_metadata" in chunks.columns:
        custom = F.col("custom_metadata") if chunks.schema["custom_metadata"].dataType.simpleString() == "string" else F.to_json("custom_metadata")
    return chunks.select(
        cid.alias("id"), "embedding", F.col("text").alias("document"), "document_id", "chunk_index", "source_type", F.array_join("structure_path", " > ").alias("source_info"), "uploader_id",
        F.lit(1).alias("version"), ts.alias("ts"), F.when(F.size("bbox") >= 4, F.array_join(F.col("bbox").cast("array<string>"), ",")).alias("bbox"), custom.alias("custom_metadata"), "knowledge_base_id",
    )


def clash_free(names: DataFrame) -> DataFrame:
    """group_id, name, i to a stored name: the 36 characters of an id before the
    first underscore go; a name that a group has already gets the least of _1, _2,
    ... that is free when its turn comes, by i.

    Only names of one family can clash, those alike but for such endings. In most
    families all names are the same, and the n-th of them just gets n - 1: these
    are numbered by ranges, so that a family of any size is the work of many tasks.
    Where names of a family differ, each depends on those before it, and such a
    family is worked off in order."""
    bare = F.when(F.instr("name", "_") == 37, F.substring(F.col("name"), F.lit(38), F.length("name"))).otherwise(F.col("name"))
    stem, ext = F.regexp_replace("bare", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("bare", r"(?<=.)(\.[^.]*)$", 1)
    rows = names.select("group_id", "name", "i", bare.alias("bare")).withColumns({"ext": ext, "stem": stem}).withColumn("family", F.concat(F.regexp_replace("stem", r"(_[0-9]+)+$", ""), "ext"))
    # A row for each family whose names differ.
    mixed = rows.groupBy("group_id", "family").agg((F.min("bare") != F.max("bare")).alias("mixed")).where("mixed")
    told = rows.join(mixed.withColumnsRenamed({"group_id": "__g", "family": "__f"}), F.col("group_id").eqNullSafe(F.col("__g")) & F.col("family").eqNullSafe(F.col("__f")), "left").drop("__g", "__f")
    schema = f"group_id {names.schema['group_id'].dataType.simpleString()}, name string, i {names.schema['i'].dataType.simpleString()}, stored string"
    alike = ranked(told.where(F.col("mixed").isNull()).drop("mixed"), ["group_id", "bare"], ["i", "name"])
    free = F.when(F.col("place") == 1, F.col("bare")).otherwise(F.concat("stem", F.lit("_"), (F.col("place") - 1).cast("string"), "ext"))
    rest = told.where("mixed").drop("mixed").groupBy("group_id", "family").applyInPandas(_free_names, schema)
    return alike.select("group_id", "name", "i", free.alias("stored")).unionByName(rest)


def _free_names(family: pd.DataFrame) -> pd.DataFrame:
    family = family.sort_values(["i", "name"], kind="stable")
    taken, following, out = set(), {}, []
    for bare, stem, ext in family[["bare", "stem", "ext"]].itertuples(index=False, name=None):
        name, n = bare, following.get(bare, 1)
        while name in taken:
            name, n = f"{stem}_{n}{ext}", n + 1
        following[bare] = n
        taken.add(name)
        out.append(name)
    return family[["group_id", "name", "i"]].assign(stored=out)
