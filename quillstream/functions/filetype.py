"""File kinds, parse strategies and names as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTETS = "application/octet-stream"
# MIME type, first bytes, whether case counts not; the first that fits decides.
SIGNATURES = (
    ("image/jpeg", b"\xff\xd8\xff", False),
    ("image/png", b"\x89PNG\r\n\x1a\n", False),
    ("image/gif", b"GIF87a", False),
    ("image/gif", b"GIF89a", False),
    ("image/bmp", b"BM", False),
    ("image/webp", b"RIFF", False),
    ("application/pdf", b"%PDF-", False),
    ("application/msword", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", False),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", b"PK\x03\x04", False),
    ("application/zip", b"PK\x05\x06", False),
    ("application/zip", b"PK\x07\x08", False),
    ("application/x-rar-compressed", b"Rar!\x1a\x07\x00", False),
    ("application/x-rar-compressed", b"Rar!\x1a\x07\x01\x00", False),
    ("application/x-7z-compressed", b"7z\xbc\xaf'\x1c", False),
    ("application/gzip", b"\x1f\x8b", False),
    ("text/plain", b"#!", False),
    ("text/html", b"<!doctype html", True),
    ("text/html", b"<html", True),
    ("text/xml", b"<?xml", True),
    ("text/xml", b"<\\?xml", True),
    ("text/markdown", b"# ", True),
    ("text/markdown", b"## ", True),
    ("text/markdown", b"- ", True),
    ("text/markdown", b"* ", True),
)
#: Extension to MIME type, as common registries have them. Fixed values.
EXTENSIONS = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".xml": "text/xml",
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".zip": "application/zip", ".gz": "application/gzip",
}
#: MIME prefix to strategy; then by size in bytes. Fixed values.
STRATEGIES = (("image/", "ocr"), ("text/markdown", "balanced"), ("text/plain", "quick"), ("text/html", "balanced"), ("text/xml", "balanced"), ("application/pdf", "deep"), ("application/msword", "deep"), ("application/vnd.openxmlformats-officedocument", "deep"), ("application/vnd.ms-excel", "deep"), ("application/vnd.ms-powerpoint", "deep"))
SMALL, MEDIUM, LARGE = 100 << 10, 10 << 20, 100 << 20
#: strategy: chunk bytes, seconds, workers, memory bytes. Fixed values.
SETTINGS = {"quick": (512 << 10, 60, 2, 512 << 20), "balanced": (1 << 20, 180, 4, 512 << 20), "deep": (2 << 20, 600, 2, 1 << 30), "ocr": (1 << 20, 300, 1, 512 << 20), "stream": (10 << 20, 1800, 1, 256 << 20)}
#: Extensions of each kind of file in listings. Fixed values.
CATEGORIES = {
    "document": (".pdf", ".doc", ".docx", ".txt", ".md", ".ppt", ".pptx", ".xls", ".xlsx"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"),
    "video": (".mp4", ".avi", ".mov", ".wmv", ".flv"),
    "audio": (".mp3", ".wav", ".flac", ".aac"),
}
UPLOAD_LIMIT = 50 << 20


def _cases(pairs, otherwise: Column) -> Column:
    out = otherwise
    for test, value in reversed(list(pairs)):
        out = F.when(test, value).otherwise(out)
    return out


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def mime_by_extension(name: Column) -> Column:
    ext = extension(name)
    return _cases(((ext == e, F.lit(m)) for e, m in EXTENSIONS.items()), F.lit(OCTETS))


def mime_by_signature(content: Column) -> Column:
    """From the first 32 bytes, as hex digits so that bytes compare on any engine."""
    head = F.hex(F.substring(content, 1, 32))
    folded = F.hex(F.lower(F.decode(F.substring(content, 1, 32), "ISO-8859-1")).cast("binary"))
    fits = [((folded if fold else head).startswith(magic.hex().upper()), F.lit(mime)) for mime, magic, fold in SIGNATURES]
    webp = (head.startswith(b"RIFF".hex().upper())) & (F.instr(F.substring(head, 9, 64), b"WEBP".hex().upper()) == 0) & (F.length(head) >= 16)
    fits = [(test & ~webp if m == "image/webp" else test, v) for (test, v), (m, _, _) in zip(fits, SIGNATURES, strict=True)]
    return _cases(fits, F.lit(None).cast("string"))


def identify(name: Column, content: Column) -> Column:
    """struct(mime, extension, confidence): the signature wins, agreement gives 1."""
    by_name, by_bytes = mime_by_extension(name), mime_by_signature(content)
    return F.struct(
        F.coalesce(by_bytes, by_name).alias("mime"),
        extension(name).alias("extension"),
        F.when((by_name != OCTETS) & by_name.eqNullSafe(by_bytes), 1.0).otherwise(0.8).alias("confidence"),
    )


def strategy(mime: Column, size: Column) -> Column:
    base = _cases(((mime.startswith(p), F.lit(s)) for p, s in STRATEGIES), F.lit("balanced"))
    deep = base == "deep"
    return F.when(size <= SMALL, F.when(deep, "deep").otherwise("quick")).when(size <= MEDIUM, F.when(deep, "deep").otherwise("balanced")).when(size <= LARGE, "deep").otherwise("stream")


def settings(strategy_: Column) -> Column:
    """struct(chunk_bytes, timeout, workers, memory) of a strategy."""
    pick = lambda i: _cases(((strategy_ == s, F.lit(v[i]).cast("long")) for s, v in SETTINGS.items()), F.lit(None).cast("long"))
    return F.struct(pick(0).alias("chunk_bytes"), pick(1).alias("timeout"), pick(2).alias("workers"), pick(3).alias("memory"))


def category(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return _cases(((ext.isin(*e), F.lit(k)) for k, e in CATEGORIES.items()), F.lit("other"))


def parser_of(name: Column) -> Column:
    """The parser that a file's name chooses: canonical routing."""
    ext = extension(name)
    return F.when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".txt", ".text"), "plain_text").when(ext.isin(".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp"), "image").when(ext.isin(".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"), "rejected").otherwise("plain_text")


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def document_id(content: Column) -> Column:
    """Deterministic id from the content."""
    return F.concat(F.lit("doc_"), F.substring(F.md5(content), 1, 8))


def format_bytes(n: Column) -> Column:
    """A size with two digits, halves to the even one, in the largest unit that it fills."""
    shown = lambda unit, shift: F.format_string(f"%.2f {unit}", F.bround(n / float(1 << shift), 2))
    out = shown("TB", 40)
    for unit, shift in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(n < float(1 << (shift + 10)), shown(unit, shift)).otherwise(out)
    return F.when(n < 1024, F.format_string("%.2f B", n.cast("double"))).otherwise(out)
