"""Word documents (.docx) as a source: a row for each paragraph and table, and one for each broken file.

A file is a zip of XML parts. Its main part is read as a stream of XML events, so
a document is never held as a whole; files are dealt over partitions by their
sizes. ``spark.read.format("docx").option("path", folder).load()`` after
``register(spark)``.

Very many files lie in packs, tar archives of bounded size that ``Packer`` writes: a
folder then has few files to be created and listed, and a pack is read from its
beginning to its end. Files in a folder and files in its packs are read alike.
"""

from __future__ import annotations

import io
import re
import shutil
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, element_index int, element_type string, level int, raw_content string, error string"
#: The markup's name space. Fixed value.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN = "word/document.xml"
#: Bytes of files for a partition, and of a pack's files, more only where one file has more.
PART_BYTES = PACK_BYTES = 8 << 20
#: Bytes of a packed file up to which it is read in memory, on a task's disk beyond, and of texts for a batch of rows.
HELD_BYTES = 16 << 20
BATCH_CHARS = 4 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    import pyarrow.fs as pfs

    return pfs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))


def paragraph_text(p: ElementTree.Element) -> str:
    """Runs, tabs and breaks of a paragraph."""
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def paragraph_kind(p: ElementTree.Element) -> tuple[str, int | None]:
    """heading with its level, list_item or paragraph, by style and numbering."""
    style = p.find(f"{W}pPr/{W}pStyle")
    name = (style.get(f"{W}val") or "").lower() if style is not None else ""
    if name == "title":
        return "heading", 1
    if name.startswith("heading") and name[7:].strip().isdigit():
        return "heading", min(6, max(1, int(name[7:].strip())))
    if p.find(f"{W}pPr/{W}numPr") is not None or name.startswith("list"):
        return "list_item", None
    return "paragraph", None


def elements(file) -> Iterator[tuple[str, int | None, str]]:
    """type, level and text of each part of a document that is not blank, as the file is read."""
    with zipfile.ZipFile(file) as z, z.open(MAIN) as main:
        rows: list[list[str]] | None = None
        depth, body = 0, None
        for event, e in ElementTree.iterparse(main, ("start", "end")):
            if event == "start":
                if e.tag == f"{W}body":
                    body = e
                elif e.tag == f"{W}tbl":
                    depth += 1
                    rows = [] if depth == 1 else rows
                elif e.tag == f"{W}tr" and depth == 1:
                    rows.append([])
                continue
            if e.tag == f"{W}p" and not depth:
                if (text := paragraph_text(e)).strip():
                    yield (*paragraph_kind(e), text)
                body.clear()  # what was read goes
            elif e.tag == f"{W}tc" and depth == 1:
                rows[-1].append("\n".join(paragraph_text(p) for p in e.iter(f"{W}p")))
                e.clear()
            elif e.tag == f"{W}tbl":
                depth -= 1
                if not depth:
                    if rows:
                        yield "table", None, "\n".join("| " + " | ".join(c.replace("\n", " ") for c in r) + " |" for r in rows)
                    body.clear()


class Packer:
    """Files of a task, written to tar archives below ``root`` under the number of its partition. An archive gets
    its name once it is whole, and a task that is run again replaces what it wrote."""

    def __init__(self, root: str, limit: int = PACK_BYTES):
        self.fs, self.root = file_system(root)
        self.fs.create_dir(self.root)
        self.limit, self.packs, self.tar = limit, 0, None
        task = TaskContext.get()
        self.task, self.attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)

    def add(self, name: str, body: bytes) -> None:
        if self.tar is None:
            self.name, self.size = f"{self.root}/pack-{self.task:05d}-{self.packs:05d}.tar", 0
            self.file = self.fs.open_output_stream(f"{self.name}.{self.attempt}.tmp")
            self.tar = tarfile.open(fileobj=self.file, mode="w|", bufsize=1 << 20)
        told = tarfile.TarInfo(name)
        told.size = len(body)
        self.tar.addfile(told, io.BytesIO(body))
        self.size += len(body)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.file.close()
            self.fs.move(f"{self.name}.{self.attempt}.tmp", self.name)
            self.packs, self.tar = self.packs + 1, None


def packed(fs, path: str) -> Iterator[tuple[str, io.IOBase]]:
    """Path and file of each Word file in a pack, as it is read."""
    with fs.open_input_stream(path, buffer_size=1 << 20) as f, tarfile.open(fileobj=f, mode="r|", bufsize=1 << 20) as tar:
        for told in tar:
            if told.isfile() and told.name.lower().endswith(".docx"):
                with tempfile.SpooledTemporaryFile(HELD_BYTES) as held:
                    shutil.copyfileobj(tar.extractfile(told), held)
                    held.seek(0)
                    yield f"{path}/{told.name}", held


class DocxReader(DataSourceReader):
    def __init__(self, root: str, files: list[tuple[str, int]]):
        self.root, self.files = root, files

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, n in sorted(self.files, key=lambda f: -f[1]):
            if out[-1].paths and size + n > PART_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def _elements(self, path: str, file) -> Iterator[tuple]:
        i = 0
        try:
            for kind, level, text in elements(file):
                yield path, i, kind, level, text, None
                i += 1
        except Exception as e:  # noqa: BLE001  a broken archive or part may fail in any way; its row tells how
            yield path, i, "error", None, None, f"{type(e).__name__}: {e}"

    def _rows(self, paths: list[str]) -> Iterator[tuple]:
        fs, _ = file_system(self.root)
        for path in paths:
            try:
                if path.lower().endswith(".tar"):
                    for name, file in packed(fs, path):
                        yield from self._elements(name, file)
                else:
                    with fs.open_input_file(path) as f:
                        yield from self._elements(path, f)
            except (OSError, tarfile.TarError) as e:
                yield path, 0, "error", None, None, f"{type(e).__name__}: {e}"

    def read(self, partition: Files):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("element_index", pa.int32()), ("element_type", pa.string()), ("level", pa.int32()), ("raw_content", pa.string()), ("error", pa.string())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        held, size = [], 0
        for row in self._rows(partition.paths):
            held.append(row)
            size += 100 + len(row[4] or "")
            if size >= BATCH_CHARS:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class DocxSource(DataSource):
    """All .docx files of a folder and those below it, and those in its packs (.tar). Null-safe: a file without text has no rows, a broken one an
    error row after what could be read, a broken pack one after its last whole file; files of any size are read as streams."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocxReader:
        import pyarrow.fs as pfs

        fs, root = file_system(self.options["path"])
        found = fs.get_file_info(pfs.FileSelector(root, recursive=True, allow_not_found=True))
        return DocxReader(self.options["path"], [(f.path, f.size) for f in found if f.type == pfs.FileType.File and f.path.lower().endswith((".docx", ".tar"))])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)
