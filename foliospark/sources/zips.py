"""Zip archives as a data source: `zip_members` (read and write) and `zip_lines` (read).

An archive is cut into byte ranges of `split` bytes from its size alone. The task of a range reads the archive's central directory from the end of the file and
then, by position, the members whose entry begins in its range; so an archive of any size is read by many tasks, no file is read whole,
and the driver only lists files. Small archives share a partition.

Options: path (a folder, searched with its subfolders, or a file), pattern (of file names, `*.zip`), members (a regular expression on the lower-cased
member name), split (bytes). Files are opened through pyarrow's file systems; `archives.members` reads those of stores that only Spark knows.

zip_members: (source, member, size, content, error). zip_lines: (source, member, line_no, line, error), decoded as UTF-8 while it is read, so a member may be larger than memory;
lines end in \\n, further \\r and \\n at their end go, empty ones are left out but counted. What cannot be read gives one row with its error: an archive (member
null), a member (content null, or the last line_no and a null line after those lines that could be read): damaged, encrypted, an unknown method, or larger than a cell may be.
"""

from __future__ import annotations

import fnmatch
import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from foliospark.storage import small_batches

SPLIT, BUFFER, BATCH_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 4 << 20, 2_000
#: Bytes of a member that a cell can hold.
MOST_CELL = (1 << 31) - (1 << 20)
MEMBER_ROW = "source string, member string, size long, content binary, error string"
LINE_ROW = "source string, member string, line_no long, line string, error string"
DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError)
try:
    from lzma import LZMAError

    DAMAGE += (LZMAError,)
except ImportError:
    pass


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: (path, from, to); to is None in the last range of a file."""

    ranges: list[tuple[str, int, int | None]]


class Store:
    """The file system of a path, and names as Spark writes them."""

    def __init__(self, path: str):
        local = re.fullmatch(r"file:(?://)?(/.*)", path)
        self.root = local[1] if local else path
        if local or path.startswith("/"):
            self.fs, self.prefix = pa.fs.LocalFileSystem(), "file:"
        else:
            self.fs, inner = pa.fs.FileSystem.from_uri(path)
            self.prefix, self.root = path[: len(path) - len(inner)], inner

    def files(self, pattern: str) -> list[pa.fs.FileInfo]:
        """Files of the folder or the file itself, by path; what begins with _ or . is not seen."""
        at = self.fs.get_file_info(self.root)
        if at.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.prefix + self.root)
        if at.is_file:
            return [at]
        found = [f for f in self.fs.get_file_info(pa.fs.FileSelector(self.root, recursive=True)) if f.is_file]
        seen = lambda f: not any(p[:1] in "_." for p in f.path[len(self.root) :].strip("/").split("/"))
        return sorted((f for f in found if seen(f) and fnmatch.fnmatch(f.base_name, pattern)), key=lambda f: f.path)

    def open(self, path: str) -> io.BufferedReader:
        return io.BufferedReader(_Positioned(self.fs.open_input_file(path)), BUFFER)


class _Positioned(io.RawIOBase):
    """A random access file of pyarrow as Python's raw file."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("a position before the file")
        return self.file.seek(place)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def split_ranges(sizes: list[tuple[str, int]], split: int) -> list[list[tuple[str, int, int | None]]]:
    """Ranges of files (path, bytes), one large file's range or several small files a partition."""
    out: list[list[tuple[str, int, int | None]]] = []
    small, held = [], 0
    for path, size in sizes:
        if size > split:
            starts = range(0, size, split)
            out += [[(path, at, at + split if at + split < size else None)] for at in starts]
            continue
        if small and held + size > split:
            out.append(small)
            small, held = [], 0
        small.append((path, 0, None))
        held += size
    return [*out, small] if small else out


def damage(error: Exception) -> bool:
    """A fault of the data, not of the store: bzip2's faults are OSErrors without a number."""
    return isinstance(error, DAMAGE) or isinstance(error, OSError) and error.errno is None


def directory(file, low: int, high: int | None, wanted: re.Pattern) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]]:
    """The archive and its members whose entry begins in the range, in their order there."""
    archive = zipfile.ZipFile(file)
    inside = [i for i in archive.infolist() if not i.is_dir() and i.header_offset >= low and (high is None or i.header_offset < high) and wanted.fullmatch(i.filename.lower())]
    return archive, sorted(inside, key=lambda i: i.header_offset)


def whole(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """(content, error) of a member; what it unpacks to is counted while it is read."""
    try:
        out = bytearray()
        with archive.open(info) as f:
            while chunk := f.read(BUFFER):
                out += chunk
                if len(out) > MOST_CELL:
                    return None, f"larger than {MOST_CELL} bytes"
        return bytes(out), None
    except Exception as e:
        if damage(e):
            return None, _told(e)
        raise


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def member_rows(file, source: str, low: int, high: int | None, wanted: re.Pattern) -> Iterator[tuple]:
    try:
        archive, infos = directory(file, low, high, wanted)
    except Exception as e:
        if not damage(e):
            raise
        if low == 0:
            yield source, None, None, None, _told(e)
        return
    for info in infos:
        content, error = whole(archive, info)
        yield source, info.filename, info.file_size, content, error


def line_rows(file, source: str, low: int, high: int | None, wanted: re.Pattern) -> Iterator[tuple]:
    try:
        archive, infos = directory(file, low, high, wanted)
    except Exception as e:
        if not damage(e):
            raise
        if low == 0:
            yield source, None, None, None, _told(e)
        return
    for info in infos:
        at = 0
        try:
            with archive.open(info) as f:
                for raw in io.BufferedReader(f, BUFFER):
                    line = raw.decode("utf-8", "replace").rstrip("\r\n")
                    if line:
                        yield source, info.filename, at, line, None
                    at += 1
        except Exception as e:
            if not damage(e):
                raise
            yield source, info.filename, at, None, _told(e)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict, lines: bool):
        self.path, self.pattern, self.wanted, self.split, self.lines = options["path"], options.get("pattern", "*.zip"), options.get("members", ".*"), int(options.get("split", SPLIT)), lines

    def partitions(self) -> list[Ranges]:
        parts = split_ranges([(f.path, f.size) for f in Store(self.path).files(self.pattern)], self.split)
        return [Ranges(p) for p in parts] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string() if self.lines else pa.binary(), pa.string()]
        names = [x.split()[0] for x in (LINE_ROW if self.lines else MEMBER_ROW).split(", ")]
        store, rows, held = Store(self.path), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for path, low, high in partition.ranges:
            with store.open(path) as file:
                for row in (line_rows if self.lines else member_rows)(file, store.prefix + path, low, high, re.compile(self.wanted)):
                    size = len(row[3] or "")
                    if rows and (held + size > BATCH_BYTES or len(rows) >= BATCH_ROWS):
                        yield batch()
                        rows, held = [], 0
                    rows.append(row)
                    held += size
        if rows:
            yield batch()


@dataclass
class Made(WriterCommitMessage):
    files: list[tuple[str, str]]


class ZipWriter(DataSourceWriter):
    """Rows (archive, member, content): each partition's archives under names of its own, moved to their place when all tasks have ended. Rows of an archive stand together."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.mark = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Made:
        store, made, archive, sink, now = Store(self.path), [], None, None, None
        for r in rows:
            if r["archive"] != now:
                if archive is not None:
                    archive.close()
                    sink.close()
                now = r["archive"]
                kept = f"{store.root}/_writing-{self.mark}/{uuid.uuid4().hex}"
                store.fs.create_dir(kept.rsplit("/", 1)[0], recursive=True)
                sink = store.fs.open_output_stream(kept)
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                made.append((kept, f"{store.root}/{now}"))
            archive.writestr(zipfile.ZipInfo(r["member"]), bytes(r["content"] or b""), zipfile.ZIP_DEFLATED)
        if archive is not None:
            archive.close()
            sink.close()
        return Made(made)

    def commit(self, messages: list[Made | None]) -> None:
        store = Store(self.path)
        if self.overwrite and store.fs.get_file_info(store.root).type == pa.fs.FileType.Directory:
            for f in store.files("*"):
                store.fs.delete_file(f.path)
        for kept, place in (x for m in messages if m for x in m.files):
            store.fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
            store.fs.move(kept, place)
        self._tidy(store)

    def abort(self, messages: list[Made | None]) -> None:
        self._tidy(Store(self.path))

    def _tidy(self, store: Store) -> None:
        left = f"{store.root}/_writing-{self.mark}"
        if store.fs.get_file_info(left).type == pa.fs.FileType.Directory:
            store.fs.delete_dir(left)


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER_ROW

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options, False)

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options, overwrite)


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return LINE_ROW

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options, True)


def register(spark: SparkSession) -> SparkSession:
    """Makes both formats known to the session."""
    for source in (ZipMembers, ZipLines):
        spark.dataSource.register(source)
    return spark


def write_archives(rows: DataFrame, path: str) -> None:
    """rows (archive, member, content) as zip files `archive` under path; the members of one are written by one task in order of their names."""
    register(rows.sparkSession)
    small_batches(rows.sparkSession)
    rows.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member").write.format("zip_members").mode("append").save(path)
