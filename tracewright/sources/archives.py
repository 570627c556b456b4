"""Members of zip, tar and tgz archives as rows, within limits."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of an archive.
MAX_ENTRIES, MAX_FILE, MAX_TOTAL, MAX_RATIO = 10_000, 64 << 20, 256 << 20, 200

MEMBERS = "archive string, path string, size long, content binary, error string"


def safe_path(path: str) -> str | None:
    """A member's path with single slashes; None if it is absolute, has a drive letter or leads out."""
    text = path.replace("\\", "/")
    if not text or "\0" in text or text.startswith("/") or (len(text) > 1 and text[0].isalpha() and text[1] == ":" and text[2:3] in ("", "/")):
        return None
    parts = [p for p in text.split("/") if p not in ("", ".")]
    return None if not parts or ".." in parts else "/".join(parts)


def _members(name: str, data: bytes) -> Iterator[tuple[str, int, int | None, object]]:
    """(path, size, compressed size, opener) of the files of an archive; a link has no opener."""
    if name.lower().endswith(".zip"):
        archive = zipfile.ZipFile(io.BytesIO(data))
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, info.file_size, info.compress_size, lambda i=info: archive.open(i)
    else:
        archive = tarfile.open(fileobj=io.BytesIO(data), mode="r:*")
        for info in archive:
            if not info.isdir():
                yield info.name, info.size, None, (lambda i=info: archive.extractfile(i)) if info.isfile() else None


def read_members(name: str, data: bytes) -> Iterator[tuple[str | None, int | None, bytes | None, str | None]]:
    """(path, size, content, error) of each file; the first breach of a limit ends the archive with a row of its own."""
    total = count = 0
    try:
        for path, size, packed, opener in _members(name, data):
            count, total = count + 1, total + size
            clean = safe_path(path)
            error = (
                "unsafe path" if clean is None
                else "link" if opener is None
                else "too many entries" if count > MAX_ENTRIES
                else "file too large" if size > MAX_FILE
                else "archive too large" if total > MAX_TOTAL
                else "compression ratio" if packed is not None and size > MAX_RATIO * max(packed, 1)
                else None
            )
            if error:
                yield path, size, None, error
                return
            content = opener().read(MAX_FILE + 1)
            if len(content) != size:
                yield path, size, None, "size differs"
                return
            yield clean, size, content, None
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, NotImplementedError) as e:
        yield None, None, None, f"unreadable: {type(e).__name__}"


def members(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(archive, path, size, content, error) of the files in archives; an archive's limits bound what a row can hold."""

    def read(frames):
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, *row) for row in read_members(name, bytes(data))]
                yield pd.DataFrame(rows, columns=["archive", "path", "size", "content", "error"]).astype({"size": "Int64"})

    return archives.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(read, MEMBERS)


def archive_kind(path):
    """zip, tgz or tar by extension; null for others."""
    low = F.lower(path)
    return F.when(low.endswith(".zip"), "zip").when(low.endswith(".tgz") | low.endswith(".tar.gz"), "tgz").when(low.endswith(".tar"), "tar")


def input_files(spark: SparkSession, folder: str) -> DataFrame:
    """A ``binaryFile`` scan of a folder and all below it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
