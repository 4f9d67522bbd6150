"""A vector store of immutable files under versioned snapshots.

Layout of a store::

    data/segment=<uuid>/knowledge_base_id=<kb>/*.parquet   rows of one commit
    sizes/segment=<uuid>/*.parquet                         (kb, dimension, rows) of one commit
    deletes/segment=<uuid>/*.parquet                       delete vectors: (kb, id) that one commit took out
    snapshots/<version>.json                               which of these make up a version

A change writes its files under new names first, where nobody looks. Its
snapshot, the last one's lists and its own, is then put in place under the next number
by one operation that fails if that number is taken. So a change is seen whole or
not at all wherever it is stopped, and of two writers one is told to look again:
it reads the newer snapshot and commits on top of it, and works its rows out anew
if that snapshot touched the same knowledge bases. Files of a change that was
stopped are garbage that no snapshot names; :meth:`SnapshotStore.vacuum` removes them.

A row is in view if its segment is listed and no delete vector or drop of its
knowledge base that came later names it. Reading without deletes is a plain scan
with partition pruning; with deletes it is one anti-join on (knowledge base, id).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.sources.scratch import at

VECTORS = "id string, embedding array<float>, document string, document_id string, chunk_index int, source_type string, source_info string, uploader_id string, version int, ts timestamp, bbox string, custom_metadata string, knowledge_base_id string"
NAMES = [f.strip().split(" ")[0] for f in VECTORS.split(", ")]
KB = "knowledge_base_id"
#: How often a commit is tried again, and how many knowledge bases a snapshot names as touched; more are all.
TRIES, NAMED = 20, 1_000


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class SnapshotStore:
    """Vectors partitioned by knowledge base."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ snapshots

    def _at(self, name: str):
        return at(self.spark, f"{self.path}/{name}")

    def versions(self) -> list[int]:
        fs, where = self._at("snapshots")
        if not fs.exists(where):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(where))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self, version: int | None = None) -> dict:
        """What makes up a version, the last by default: segments and delete vectors with the
        versions they are of, and drops (knowledge base to the version up to which it is gone)."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "segments": {}, "deletes": {}, "drops": {}, "touched": []}
            version = found[-1]
        fs, where = self._at(f"snapshots/{version:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, snapshot: dict) -> bool:
        """Put a snapshot in its place unless there is one: False where another writer was faster."""
        fs, folder = self._at("snapshots")
        fs.mkdirs(folder)
        _, draft = self._at(f"snapshots/.{uuid.uuid4().hex}")
        _, place = self._at(f"snapshots/{snapshot['version']:012d}.json")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(snapshot).encode()))
        finally:
            out.close()
        self._step("drafted")
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":
                # A rename on a local disk would replace the other's; a link does not.
                paths = jvm.java.nio.file.Paths
                local = [paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (place, draft)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(draft, place, none)
            return True
        except Exception:
            if fs.exists(place):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def _commit(self, base: dict, change, touched: list[str] | None, again=None) -> None:
        """Commit ``change(snapshot, version)`` on top of the newest snapshot. Where that is not
        ``base`` any more and touched one of the same knowledge bases, ``again`` is called with it first."""
        for _ in range(TRIES):
            last = self.snapshot()
            if last["version"] != base["version"]:
                between = [self.snapshot(v)["touched"] for v in range(base["version"] + 1, last["version"] + 1)]
                met = touched is None or any(t is None or set(t) & set(touched) for t in between)
                base = last
                if met and again is not None:
                    again(last)
            self._step("ready")
            new = change(json.loads(json.dumps(last)), last["version"] + 1)
            new |= {"version": last["version"] + 1, "touched": touched if touched is None or len(touched) <= NAMED else None}
            if self._put(new):
                return
        raise Conflict(f"{self.path}: {TRIES} commits in a row were taken by other writers")

    def _step(self, name: str) -> None:
        """Between two steps of a change; tests stop here."""

    # ------------------------------------------------------------ reading

    def read(self, kb: str | None = None, version: int | None = None) -> DataFrame:
        """All vectors, or one knowledge base's by partition pruning; an absent one is empty."""
        return self._rows(self.snapshot(version), kb).select(*NAMES)

    def _parts(self, name: str, segments: dict, schema: str) -> DataFrame | None:
        if not segments:
            return None
        base = f"{self.path}/{name}"
        df = self.spark.read.schema(f"{schema}, segment string").option("basePath", base).parquet(*[f"{base}/segment={s}" for s in segments])
        versions = F.create_map(*[F.lit(x) for s, v in segments.items() for x in (s, v)])
        return df.withColumn("since", F.element_at(versions, F.col("segment")))

    def _rows(self, snapshot: dict, kb: str | None = None) -> DataFrame:
        rows = self._parts("data", snapshot["segments"], VECTORS)
        if rows is None:
            return self.spark.createDataFrame([], VECTORS)
        if kb is not None:
            rows = rows.where(F.col(KB) == kb)
        rows = self._undropped(rows, snapshot)
        gone = self._parts("deletes", {s: d["upto"] for s, d in snapshot["deletes"].items()}, f"{KB} string, id string")
        if gone is not None:
            gone = gone.groupBy(KB, "id").agg(F.max("since").alias("upto"))
            if kb is not None:
                gone = gone.where(F.col(KB) == kb)
            rows = rows.join(gone.withColumnsRenamed({KB: "__kb", "id": "__id"}), (F.col(KB) == F.col("__kb")) & (F.col("id") == F.col("__id")) & (F.col("since") <= F.col("upto")), "left_anti")
        return rows

    def _undropped(self, rows: DataFrame, snapshot: dict) -> DataFrame:
        if not snapshot["drops"]:
            return rows
        upto = F.element_at(F.create_map(*[F.lit(x) for k, v in snapshot["drops"].items() for x in (k, v)]), F.col(KB))
        return rows.where(upto.isNull() | (F.col("since") > upto))

    def sizes(self, snapshot: dict | None = None) -> DataFrame:
        """knowledge_base_id and dimension of what is stored, from the small tables beside the data."""
        snapshot = snapshot or self.snapshot()
        told = self._parts("sizes", snapshot["segments"], f"{KB} string, dimension int, n long")
        if told is None:
            return self.spark.createDataFrame([], f"{KB} string, dimension int")
        return self._undropped(told, snapshot).groupBy(KB).agg(F.max("dimension").alias("dimension"))

    def dimension(self, kb: str) -> int | None:
        """How many numbers the embeddings of a knowledge base have; None while it has none.
        It stays as long as the base is not dropped, even without rows."""
        row = self.sizes().where(F.col(KB) == kb).first()
        return row["dimension"] if row else None

    def count(self, kb: str | None = None) -> int:
        return self.read(kb).count()

    # ------------------------------------------------------------ changes

    def _check(self, rows: DataFrame, snapshot: dict, dimension: int | None) -> list[str] | None:
        """Raise unless all embeddings of each knowledge base have one length, as stored or as
        told; one job for all of them. The knowledge bases, None where they are many."""
        size = F.size("embedding")
        none = F.count_if(F.col("embedding").isNull() | F.col("id").isNull() | F.col(KB).isNull())
        per = rows.groupBy(KB).agg(F.min(size).alias("least"), F.max(size).alias("most"), none.alias("none"))
        met = per.join(self.sizes(snapshot), KB, "left")
        want = F.coalesce(F.lit(dimension).cast("int"), "dimension", "most")
        wrong = (F.col("none") > 0) | (F.col("least") != want) | (F.col("most") != want)
        # One failing row is the message; those that fail come first, so one look tells all.
        found = met.select(KB, wrong.alias("wrong"), want.alias("want")).orderBy(F.desc("wrong")).limit(NAMED + 1).collect()
        if found and found[0]["wrong"]:
            raise ValueError(f"a row of {found[0][KB]} has no id, no knowledge base or no embedding of {found[0]['want']} numbers")
        return [r[KB] for r in found] if len(found) <= NAMED else None

    def _stage(self, rows: DataFrame) -> str:
        """Write rows as a new segment, with its sizes; its name."""
        segment = uuid.uuid4().hex
        rows.select(*NAMES).write.partitionBy(KB).parquet(f"{self.path}/data/segment={segment}")
        self._step("written")
        written = self._parts("data", {segment: 0}, VECTORS)
        written.groupBy(KB).agg(F.max(F.size("embedding")).alias("dimension"), F.count("*").alias("n")).write.parquet(f"{self.path}/sizes/segment={segment}")
        self._step("staged")
        return segment

    def add(self, rows: DataFrame, dimension: int | None = None) -> None:
        """Append. Of rows with one id the first by chunk and text is kept, and none
        if the table has the id already. All embeddings of a knowledge base have one
        length, that of the table or else of the batch, or ``dimension``; any other,
        and a null id or knowledge base, raises and nothing is seen of the batch."""
        first = Window.partitionBy(KB, "id").orderBy("chunk_index", "document")
        once = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        held: dict = {}

        def prepare(snapshot: dict) -> None:
            held["touched"] = self._check(rows, snapshot, dimension)
            old = self._rows(snapshot).select(KB, "id")
            held["segment"] = self._stage(once.join(old, [KB, "id"], "left_anti"))

        def change(snapshot: dict, version: int) -> dict:
            snapshot["segments"][held["segment"]] = version
            return snapshot

        base = self.snapshot()
        prepare(base)
        self._commit(base, change, held["touched"], prepare)

    def delete(self, kb: str, ids: DataFrame | None = None, where: Column | None = None) -> None:
        """Take out the rows of a knowledge base that both conditions name, by a delete vector."""
        if ids is None and where is None:
            raise ValueError("nothing says what to delete")
        held: dict = {}

        def prepare(snapshot: dict) -> None:
            gone = self._rows(snapshot, kb)
            if where is not None:
                gone = gone.where(where)
            if ids is not None:
                gone = gone.join(ids.select("id").distinct(), "id", "left_semi")
            held.update(segment=uuid.uuid4().hex, upto=snapshot["version"])
            gone.select(KB, "id").write.parquet(f"{self.path}/deletes/segment={held['segment']}")
            self._step("staged")

        def change(snapshot: dict, version: int) -> dict:
            # What others added since is not meant: the vector reaches up to the version it was made of.
            snapshot["deletes"][held["segment"]] = {"upto": held["upto"], "version": version}
            return snapshot

        base = self.snapshot()
        prepare(base)
        self._commit(base, change, [kb], prepare)

    def replace(self, kb: str, rows: DataFrame, dimension: int | None = None) -> None:
        """Put rows in the place of a knowledge base, in one commit."""
        rows = rows.withColumn(KB, F.lit(kb))
        first = Window.partitionBy("id").orderBy("chunk_index", "document")
        once = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        empty = {"version": 0, "segments": {}, "deletes": {}, "drops": {}}
        base = self.snapshot()
        self._check(rows, empty, dimension)
        segment = self._stage(once)

        def change(snapshot: dict, version: int) -> dict:
            snapshot["drops"][kb] = version - 1
            snapshot["segments"][segment] = version
            return snapshot

        self._commit(base, change, [kb])

    def drop(self, kb: str) -> None:
        """A knowledge base is gone: no file is touched."""
        def change(snapshot: dict, version: int) -> dict:
            snapshot["drops"][kb] = version - 1
            return snapshot

        self._commit(self.snapshot(), change, [kb])

    def reset(self) -> None:
        """All of them are gone."""
        self._commit(self.snapshot(), lambda s, v: {"segments": {}, "deletes": {}, "drops": {}}, None)

    # ------------------------------------------------------------ upkeep

    def compact(self) -> None:
        """One segment in the place of all, without what is deleted or dropped. It touches everything:
        whoever commits meanwhile makes this start anew, and the other way round."""
        held: dict = {}

        def prepare(snapshot: dict) -> None:
            held["segment"] = self._stage(self._rows(snapshot))

        base = self.snapshot()
        prepare(base)
        self._commit(base, lambda s, version: {"segments": {held["segment"]: version}, "deletes": {}, "drops": {}}, None, prepare)

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Remove snapshots but the last ``keep`` and files that no kept one names, if they are older than so
        many seconds (younger ones may be a change that is under way); how many folders went."""
        versions = self.versions()
        named = {s for v in versions[-keep:] for part in ("segments", "deletes") for s in self.snapshot(v)[part]}
        gone, until = 0, (time.time() - older_than) * 1000
        for v in versions[:-keep]:
            fs, where = self._at(f"snapshots/{v:012d}.json")
            if fs.getFileStatus(where).getModificationTime() <= until:
                fs.delete(where, False)
        for part in ("data", "sizes", "deletes"):
            fs, where = self._at(part)
            for status in fs.listStatus(where) if fs.exists(where) else ():
                name = status.getPath().getName().removeprefix("segment=")
                if name not in named and status.getModificationTime() <= until:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone
