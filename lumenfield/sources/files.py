"""Data sources over single files: ``picture_headers`` reads the heads of pictures and nothing else, ``named_files`` writes rows as files of given names.

    files.register(spark)
    spark.read.format("picture_headers").load("/archive/day1/frame_%04d.hdr")
    df.select("name", "content").write.format("named_files").mode("append").save("/archive/out")

Paths are those of pyarrow's file systems: local and mounted ones, and URIs it knows (``s3://``, ``gs://``, ``hdfs://``). For stores that only Spark
reaches, ``pictures.header_scan`` takes whole contents instead.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO

from pyarrow import fs as stores
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 8192
#: A header without its end is given up after so many bytes; no writer makes longer ones.
LONGEST = 64 << 20
HEADERS = "path string, length long, header_lines array<string>, width int, height int, problem string"


def store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path and the path in it. Spark's ``file:/x`` is the local ``/x``."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), posixpath.abspath(path))


# --- input lists


def frame_pattern(name: str) -> re.Match | None:
    """The one ``%d``-style conversion of a name that has exactly one and no other ``%`` but ``%%``."""
    found = list(re.finditer(r"%(?:%|([-+ #0]*)(\d*)(?:\.(\d+))?([diu])|)", name))
    numbers = [m for m in found if m[4]]
    return numbers[0] if len(numbers) == 1 and all(m[4] or m[0] == "%%" for m in found) else None


def frame_name(name: str, number: int) -> str:
    return name.replace("%u", "%d").replace("%i", "%d") % number


def expand(inputs: Sequence[str]) -> list[str]:
    """Files behind the inputs, in the order given.

    A name that exists is taken as it is, whatever signs it holds; a folder stands for all files below it, by name, but for names that begin with ``_`` or ``.``. Else a frame pattern stands for its numbers from
    0, or from 1 if there is no 0, up to the first that is missing; a name with ``*``, ``?`` or ``[`` for its matches, by name. An input without any file raises, and so does an empty list.
    """
    out: list[str] = []
    for item in inputs:
        where, path = store(item)
        kind = where.get_file_info(path).type
        if kind == stores.FileType.File:
            found = [path]
        elif kind == stores.FileType.Directory:
            found = sorted(f.path for f in where.get_file_info(stores.FileSelector(path, recursive=True)) if f.is_file and not re.search(r"(^|/)[_.]", f.path[len(path) :]))
        elif frame_pattern(path):
            found = _numbered(where, path)
        else:
            found = _matches(where, path) if re.search(r"[*?\[]", path) else []
        if not found:
            raise ValueError(f"no input files in {item}")
        prefix = "" if isinstance(where, stores.LocalFileSystem) else item[: item.index("://") + 3]
        out += [prefix + f for f in found]
    if not out:
        raise ValueError("no input files")
    return out


def _numbered(where: stores.FileSystem, path: str, step: int = 256) -> list[str]:
    for start in (0, 1):
        found: list[str] = []
        while True:
            names = [frame_name(path, start + len(found) + i) for i in range(step)]
            there = [f.is_file for f in where.get_file_info(names)]
            found += names[: there.index(False)] if False in there else names
            if False in there:
                break
        if found:
            return found
    return []


def _matches(where: stores.FileSystem, path: str) -> list[str]:
    """Names that match a pattern, folder by folder; a sign never stands for a slash."""
    parts = path.strip("/").split("/")
    plain = next(i for i, p in enumerate(parts) if re.search(r"[*?\[]", p))
    level = ["/" * path.startswith("/") + "/".join(parts[:plain])]
    for i, part in enumerate(parts[plain:], plain):
        below = [f for folder in level for f in where.get_file_info(stores.FileSelector(folder or ".", allow_not_found=True)) if fnmatchcase(f.base_name, part)]
        level = [f.path for f in below if (f.is_file if i == len(parts) - 1 else not f.is_file)]
    return sorted(level)


# --- heads of pictures

_SIZE = re.compile(rb"[-+][XY]\s*\d+\s+[-+][XY]\s*\d+")


def read_head(file: BinaryIO) -> bytes:
    """The file up to the end of the line behind the first blank line, read in small pieces; all of it (up to ``LONGEST``) if there is none."""
    head, blank = bytearray(), -1
    while len(head) < LONGEST and (piece := file.read(CHUNK)):
        start = max(0, len(head) - 1)
        head += piece
        blank = head.find(b"\n\n", start) if blank < 0 else blank
        if blank >= 0 and (head.find(b"\n", blank + 2) >= 0 or len(head) > blank + 2 + CHUNK):
            break
    return bytes(head)


def parse_head(content: bytes | memoryview) -> tuple[list[str], int | None, int | None, str | None]:
    """(header lines, width, height, problem)."""
    blank = re.search(rb"\n\n", content)
    head = bytes(content[: blank.start()] if blank else content)
    found = _SIZE.match(content, blank.end()) if blank else None
    size = {m[1]: int(m[2]) for m in re.finditer(rb"([XY])\s*(\d+)", found.group())} if found else {}
    problem = None if len(size) == 2 else "no size line" if blank else "no blank line after the header"
    return head.decode("ISO-8859-1").split("\n"), size.get(b"X"), size.get(b"Y"), problem


def head_of(path: str) -> tuple[list[str], int | None, int | None, str | None]:
    where, inner = store(path)
    with where.open_input_file(inner) as file:
        return parse_head(read_head(file))


@dataclass
class Files(InputPartition):
    paths: list[str]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = options.get("paths")
        self.inputs = json.loads(given) if given else [options["path"]]
        self.each = int(options.get("filesperpartition", 256))

    def partitions(self) -> list[Files]:
        paths = expand(self.inputs)
        return [Files(paths[i : i + self.each]) for i in range(0, len(paths), self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            where, inner = store(path)
            with where.open_input_file(inner) as file:
                size = file.size()
                yield path, size, *parse_head(read_head(file))


class PictureHeaders(DataSource):
    """One row per picture: its header and size. ``load(path)`` or the option ``paths``, a JSON list, take what ``expand`` takes; ``filesPerPartition`` sets how many files a task opens."""

    @classmethod
    def name(cls) -> str:
        return "picture_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader({k.lower(): v for k, v in self.options.items()})


# --- files of given names


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class FileWriter(DataSourceWriter):
    """Each task writes into a staging folder of its own. Only the commit of the whole job moves files to their names, so a failed or repeated task never leaves a file among them.

    A task that is killed after the job's end may leave a staging folder; its name begins with ``_``, so no reader looks into it.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        where, staging = store(self.staging)
        folder, names = f"{staging}/{uuid.uuid4().hex}", []
        where.create_dir(folder, recursive=True)
        for row in rows:
            name = row["name"]
            if not name or name.startswith(("/", "_staging")) or ".." in name.split("/"):
                raise ValueError(f"not a file name: {name!r}")
            where.create_dir(posixpath.dirname(f"{folder}/{name}"), recursive=True)
            with where.open_output_stream(f"{folder}/{name}") as file:
                file.write(bytes(row["content"] or b""))
            names.append(name)
        return Written(names, folder)

    def commit(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        if self.overwrite:
            for info in where.get_file_info(stores.FileSelector(path, allow_not_found=True)):
                if not info.base_name.startswith("_staging"):
                    (where.delete_file if info.is_file else where.delete_dir)(info.path)
        for folder in sorted({posixpath.dirname(n) for n in names}):
            where.create_dir(f"{path}/{folder}".rstrip("/"), recursive=True)
        for m in done:
            for name in m.names:
                where.move(f"{m.folder}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, staging = store(self.staging)
        if where.get_file_info(staging).type == stores.FileType.Directory:
            where.delete_dir(staging)


class NamedFiles(DataSource):
    """Sink for (name, content): names are relative and may hold folders; null contents are empty files. ``append`` keeps other files, ``overwrite`` replaces the folder's."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PictureHeaders)
    spark.dataSource.register(NamedFiles)
