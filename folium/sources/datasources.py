"""Spark data sources of this library's own: entries of ZIP archives, and one file for each document.

Both reach files by pyarrow's file systems (local, S3, GCS, HDFS), in the tasks. register(spark) makes them known.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LOCAL = b"PK\x03\x04"
CHUNK = 1 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# -- ZIP archives as a source
@dataclass
class Range(InputPartition):
    """Entries of one archive whose headers begin in [start, end)."""

    path: str
    start: int
    end: int


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("suffix", ".zip")
        self.bytes = int(options.get("rangebytes", 64 << 20))  # Spark hands options over in lower case
        self.names = options.get("names", "*")

    def partitions(self) -> list[Range]:
        """Archives by their sizes alone: no archive is opened here."""
        files, root = _place(self.root)
        found = files.get_file_info(root)
        if found.type == fs.FileType.Directory:
            infos = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(self.glob)]
        else:
            infos = [found] if found.type == fs.FileType.File else []
        return [Range(i.path, at, at + self.bytes) for i in sorted(infos, key=lambda i: i.path) for at in range(0, max(1, i.size), self.bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        files, _ = _place(self.root)
        with files.open_input_file(part.path) as f:
            try:
                listed = zipfile.ZipFile(f).infolist()
            except (zipfile.BadZipFile, struct.error, NotImplementedError, ValueError):
                return
            entries = {}
            for i in listed:  # the last of equal names counts; names are UTF-8 whether or not the archive says so
                name = i.filename if i.flag_bits & 0x800 else i.orig_filename.encode("cp437", "replace").decode("utf-8", "replace")
                entries[name] = i
            for name, i in entries.items():
                if not name.endswith("/") and part.start <= i.header_offset < part.end and fnmatchcase(name, self.names):
                    yield part.path, name, i.file_size, i.compress_size, _entry(f, i)


def _entry(f, i: zipfile.ZipInfo) -> bytes | None:
    """The entry's bytes, inflated as they are read; None where they break off or aren't stored or deflated."""
    f.seek(i.header_offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != LOCAL or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None
    f.seek(i.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    left, out, inflate = i.compress_size, [], zlib.decompressobj(-15)
    stored = i.compress_type == zipfile.ZIP_STORED
    while left:
        piece = f.read(min(CHUNK, left))
        if not piece:
            return None
        left -= len(piece)
        try:
            out.append(piece if stored else inflate.decompress(piece))
        except zlib.error:
            return None
    return b"".join(out) if stored or inflate.eof else None


class ZipSource(DataSource):
    """spark.read.format("folium_zip").load(folder or archive): path, name, size, packed, content of every entry.

    Folders are searched to any depth for files that end with the option suffix (.zip). A task reads the entries of rangeBytes of an archive, and of these only those whose name fits the option names, a pattern such as *.html
    (an option, since Spark 4.1 keeps a filter that it has once handed to a Python source for every later use of the same DataFrame); what fails to inflate has null content, what is no archive has no rows."""

    @classmethod
    def name(cls) -> str:
        return "folium_zip"

    def schema(self) -> str:
        return "path string, name string, size long, packed long, content binary"

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(dict(self.options))


# -- one file for each document
LONGEST = 200


def file_name(path: str, suffix: str = "") -> str:
    """The path as one file's name: percent signs for what names can't have; a long one is cut and told apart by its digest."""
    name = quote(path, safe="")
    if name[:1] in (".", "_"):  # readers pass over such files
        name = f"%{ord(name[0]):02X}{name[1:]}"
    if len(name) + len(suffix) > LONGEST:
        name = f"{name[:LONGEST - 33 - len(suffix)]}-{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    return name + suffix


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own in a staging folder; the commit moves the files of the attempts that Spark names, an abort removes all of it."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.root, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        self.at, self.kind = [schema.names.index(c) for c in ("path", "content")], schema["content"].dataType.typeName()
        self.staging = f"_staging-{uuid.uuid4().hex}"
        if self.kind not in ("binary", "string"):
            raise ValueError("content must be binary or string")

    def write(self, iterator) -> Written:
        files, root = _place(self.root)
        folder, n = f"{root}/{self.staging}/{uuid.uuid4().hex}", 0
        files.create_dir(folder, recursive=True)
        for row in iterator:
            path, content = (row[i] for i in self.at)
            if path is None or content is None:
                continue
            with files.open_output_stream(f"{folder}/{file_name(path, self.suffix)}") as out:
                out.write(content.encode("utf-8", "replace") if isinstance(content, str) else bytes(content))
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _place(self.root)
        if self.overwrite:
            for i in files.get_file_info(fs.FileSelector(root)):
                if not i.base_name.startswith("_staging-"):
                    (files.delete_dir if i.type == fs.FileType.Directory else files.delete_file)(i.path)
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is not None and m.files:
                    names = [i.path for i in files.get_file_info(fs.FileSelector(m.folder))]
                    list(pool.map(lambda p: files.move(p, f"{root}/{p.rpartition('/')[2]}"), names))
        self._drop(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*_place(self.root))

    def _drop(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class FileSink(DataSource):
    """df.write.format("folium_files").option("suffix", ".md").save(folder): one file for each row of path and content (string or binary), named by its path, in one folder.

    Rows without a path or content write nothing; of rows of one path one file stays. Overwriting happens at the commit, once everything is written."""

    @classmethod
    def name(cls) -> str:
        return "folium_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make both known to the session."""
    for source in (ZipSource, FileSink):
        spark.dataSource.register(source)


def read_zip(spark: SparkSession, path: str, names: str = "*", suffix: str = ".zip", range_bytes: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("folium_zip").option("suffix", suffix).option("names", names).option("rangeBytes", str(range_bytes)).load(path)


def write_files(df: DataFrame, folder: str, suffix: str = "", mode: str = "append") -> None:
    """path and content of df, a file each. mode: append, overwrite, or errorifexists for a folder that must be empty."""
    register(df.sparkSession)
    if mode == "errorifexists":
        files, root = _place(folder)
        if files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            raise FileExistsError(folder)
    df.select("path", "content").write.format("folium_files").option("suffix", suffix).mode("append" if mode == "errorifexists" else mode).save(folder)
