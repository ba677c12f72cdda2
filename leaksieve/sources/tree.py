"""Folder trees as a Spark data source, in batches and as a stream, and written back.

``read_tree`` plans a bounded part of a tree in the driver; what lies beyond is walked by the
tasks. Options on path, size and mode are part of the walk: a file that they rule out is never
opened, nor is a folder listed that lies aside. ``stream_tree`` gives files as they
are made or changed, and ``write_tree`` puts texts back as files, each of them whole or not at all.
"""

from __future__ import annotations

import json
import os
import re
import stat
import sys
import time
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.model import MANIFEST
from leaksieve.sources.folder import _READ_BLOCKS, MAX_LINE_BYTES, _decode, _failed

FORMAT = "leaksieve_tree"
#: Files and folders that the driver lists at most; beyond them tasks walk what is left.
PLAN_FILES = 100_000
PLAN_FOLDERS = 10_000
#: Tasks that share the files of a folder which the driver did not list, by a hash of their paths.
SHARES = 16
PART_FILES = 10_000
PART_BYTES = 128 * 1024 * 1024
BLOCK_BYTES = 32 * 1024 * 1024
EXECUTE_BITS = 0o111
#: Files that a task writes at a time: each waits for the disk to have it.
WRITERS = 16
#: Seconds that a stream leaves a file alone after its last change: clocks of file servers are coarse and differ.
SETTLE = 2.0

TREE = T.StructType([*MANIFEST.fields, *_READ_BLOCKS.fields[len(MANIFEST.fields) :]])
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def local_root(path: str) -> str:
    """A folder's plain path; of URIs only those of files that every node has mounted."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return unquote(parsed.path) if parsed.scheme else path
    raise ValueError(f"{path}: a tree of files is read from a mounted folder")


@dataclass
class Part(D.InputPartition):
    """Listed files or, where ``of`` is not 0, a share of the files below unlisted folders."""

    paths: list[str]
    share: int = 0
    of: int = 0


def _shown(path: str) -> str:
    """A path as text; bytes of a name that are not UTF-8 become replacement characters."""
    return os.fsencode(path).decode("utf-8", "replace")


class Walk:
    """The files of a tree that the options choose, and that changed after one time and up to another."""

    def __init__(self, options: dict[str, str], after: int | None = None, until: int | None = None) -> None:
        self.root, self.after, self.until = options["path"], after, until
        self.head = options.get("below", "")
        self.max_size = int(options["maxsize"]) if "maxsize" in options else None
        self.executables = options.get("executables", "true") == "true"
        names = "|".join(map(re.escape, json.loads(options.get("exempt", "[]"))))
        self.exempt = re.compile(rf"(?:\A|/)(?:{names})") if names else None

    def entries(self, below: str) -> Iterator[tuple[str, bool]]:
        """Path and whether it is a folder of all directly below; folders that no wanted path goes through are left out."""
        with os.scandir(os.path.join(self.root, below)) as found:
            for entry in found:
                path = f"{below}/{entry.name}" if below else entry.name
                is_folder = entry.is_dir(follow_symlinks=False)
                inside = path + "/" if is_folder else path
                # What exempts a folder exempts all that is below it.
                if self.exempt and self.exempt.search(_shown(inside)):
                    continue
                if inside.startswith(self.head) or is_folder and self.head.startswith(inside):
                    yield path, is_folder

    def row(self, path: str) -> tuple | None:
        """The manifest row of a file, if it is wanted and regular."""
        whole = os.path.join(self.root, path)
        try:
            own, target = os.lstat(whole), os.stat(whole)
        except OSError:
            return None
        mode = stat.S_IMODE(target.st_mode)
        fits = self.max_size is None or own.st_size <= self.max_size
        changed = own.st_ctime_ns
        timely = (self.after is None or changed > self.after) and (self.until is None or changed <= self.until)
        fits = fits and (self.executables or not mode & EXECUTE_BITS)
        if not (stat.S_ISREG(target.st_mode) and fits and timely):
            return None
        return path, own.st_size, mode, _EPOCH + timedelta(microseconds=own.st_mtime_ns // 1000)

    def files(self, part: Part) -> Iterator[tuple]:
        """The rows of a part. Shares go by a hash of the path, so each file is in one of them."""
        if not part.of:
            yield from (row for path in part.paths if (row := self.row(path)))
            return
        open_folders = deque(part.paths)
        while open_folders:
            for path, is_folder in self.entries(open_folders.popleft()):
                if is_folder:
                    open_folders.append(path)
                elif zlib.crc32(os.fsencode(path)) % part.of == part.share and (row := self.row(path)):
                    yield row

    def newest(self, until: int) -> int:
        """The latest change, up to a time, of any file."""
        latest, open_folders = -1, deque([""])
        while open_folders:
            for path, is_folder in self.entries(open_folders.popleft()):
                if is_folder:
                    open_folders.append(path)
                    continue
                try:
                    changed = os.lstat(os.path.join(self.root, path)).st_ctime_ns
                except OSError:
                    continue
                if latest < changed <= until:
                    latest = changed
        return latest

    def parts(self, plan_files: int = PLAN_FILES, plan_folders: int = PLAN_FOLDERS) -> list[Part]:
        """Parts of bounded size. The driver holds no more than the bounds say, however large the tree is."""
        out: list[Part] = []
        held: list[str] = []
        size = seen = folders = 0
        open_folders = deque([""])
        while open_folders and folders < plan_folders and seen < plan_files:
            below = open_folders.popleft()
            folders += 1
            files, inner = [], []
            for path, is_folder in self.entries(below):
                seen += 1
                if seen > plan_files:
                    break
                (inner if is_folder else files).append(path)
            if seen > plan_files:
                # Listed in part only: its tasks list it as a whole.
                open_folders.appendleft(below)
                break
            open_folders += inner
            for row in map(self.row, files):
                if row is None:
                    continue
                if held and (size + row[1] > PART_BYTES or len(held) >= PART_FILES):
                    out.append(Part(held))
                    held, size = [], 0
                held.append(row[0])
                size += row[1]
        if held:
            out.append(Part(held))
        if open_folders:
            out += [Part(list(open_folders), share, SHARES) for share in range(SHARES)]
        return out or [Part([])]


def _rows(root: str, file: tuple, block_bytes: int, max_line_bytes: int) -> Iterator[tuple]:
    """The rows of a file: blocks of whole lines, with the number of lines before each."""
    before, first = 0, True
    shown = (_shown(file[0]), *file[1:])
    try:
        with open(os.path.join(root, file[0]), "rb") as handle:
            size = os.fstat(handle.fileno()).st_size
            # No more is asked for than there is, since room is made for all that is asked for; the one byte more tells the end.
            while (content := handle.read(min(block_bytes, max(0, size - handle.tell()) + 1))) or first:
                if content and not content.endswith(b"\n"):
                    rest = handle.readline(max_line_bytes + 1)
                    if len(rest) > max_line_bytes:
                        raise ValueError(f"{file[0]}: a line of more than {max_line_bytes} bytes")
                    content += rest
                yield (*shown, *_decode(content, exact=True), before)
                before, first = before + content.count(b"\n"), False
    except OSError as error:
        yield (*shown, *_failed(error), before)


_ARROW = pa.schema([
    ("path", pa.string()), ("size", pa.int64()), ("mode", pa.int32()), ("mtime", pa.timestamp("us", "UTC")),
    ("text", pa.string()), ("valid_utf8", pa.bool_()), ("read_error", pa.string()), ("line_base", pa.int64()),
])


def _arrow(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded rows and characters."""
    held: list[tuple] = []
    length = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells, kind) for cells, kind in zip(zip(*held), _ARROW.types)], schema=_ARROW)

    for row in rows:
        held.append(row)
        length += len(row[4] or "")
        if length >= BLOCK_BYTES or len(held) >= PART_FILES:
            yield made()
            held, length = [], 0
    if held:
        yield made()


class _Reading:
    """What both readers do in a task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.block_bytes = int(options.get("blockbytes", BLOCK_BYTES))
        self.max_line_bytes = int(options.get("maxlinebytes", MAX_LINE_BYTES))
        self.limits = int(options.get("planfiles", PLAN_FILES)), int(options.get("planfolders", PLAN_FOLDERS))
        self.options = options
        self.walk = Walk(options)

    def rows(self, walk: Walk, part: Part) -> Iterator[pa.RecordBatch]:
        wanted = (row for file in walk.files(part) for row in _rows(self.root, file, self.block_bytes, self.max_line_bytes))
        return _arrow(wanted)


class TreeReader(_Reading, D.DataSourceReader):
    """Takes no pushed filters: Spark 4.1 lets those of one use of a frame act on another use of it, which loses rows. So options choose."""

    def partitions(self) -> list[Part]:
        return self.walk.parts(*self.limits)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.rows(self.walk, partition)


@dataclass
class Epoch(D.InputPartition):
    part: Part
    after: int
    until: int


class TreeStream(_Reading, D.DataSourceStreamReader):
    """Offsets are times of change: a batch holds the files that last changed after one offset and up to the next.

    The time is that of the file's entry, which moving a file renews and nobody can set back.
    """

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.settle = float(options.get("settle", SETTLE))
        self.last = -1

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        # Taken before the walk: what changes while it goes on is later than this and belongs to a later batch.
        until = time.time_ns() - int(self.settle * 1e9)
        self.last = max(self.last, self.walk.newest(until))
        return {"changed": self.last}

    def partitions(self, start: dict, end: dict) -> list[Epoch]:
        walk = Walk(self.options, start["changed"], end["changed"])
        return [Epoch(part, start["changed"], end["changed"]) for part in walk.parts(*self.limits)]

    def read(self, partition: Epoch) -> Iterator[pa.RecordBatch]:
        return self.rows(Walk(self.options, partition.after, partition.until), partition.part)


class FolderTree(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return TREE

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader({key.lower(): value for key, value in self.options.items()})

    def streamReader(self, schema: T.StructType) -> TreeStream:
        return TreeStream({key.lower(): value for key, value in self.options.items()})


def _by_value() -> None:
    """What runs in workers travels by value, so executors need no copy of the package."""
    for name in (__name__, _decode.__module__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def _known(spark: SparkSession) -> None:
    _by_value()
    spark.dataSource.register(FolderTree)


def read_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The files below ``root``, names that begin with a dot too, as blocks of whole lines (see ``read_blocks``).

    Options that choose files: ``below`` (how paths begin), ``maxSize`` (bytes), ``exempt`` (a JSON list as of
    ``exempt_by_path``; exempt folders aren't listed) and ``executables`` (false: without them). Others: ``blockBytes``,
    ``maxLineBytes``, ``planFiles``, ``planFolders``. A large file is one task's, a block at a time;
    ``read_blocks`` shares one among tasks. An empty tree gives no rows, a missing one an error. A file that goes
    while the tree is walked has no row; one that cannot be read has ``read_error``. Links to files are
    read, links to folders are not followed.
    """
    _known(spark)
    found = spark.read.format(FORMAT).options(**options).load(local_root(root))
    return found.withColumn("exact", F.lit(True))


def stream_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """``read_tree`` as a stream: each file once, and again after it has changed.

    Besides the options of ``read_tree``, ``settle`` is for how many seconds a changed file is left alone. A batch
    that is run again holds the same files, but for those that have changed since: these come in a later one.
    """
    _known(spark)
    found = spark.readStream.format(FORMAT).options(**options).load(local_root(root))
    return found.withColumn("exact", F.lit(True))


_WRITTEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write texts as files below ``root``, with their modes, where the result is evaluated; path and size of each return.

    A file is written under a name of its own beside its place and then moved there: readers see its earlier
    state or the new one, and a task that is run again, or twice at once, leaves the same. Rows without a path or text are
    not written. Paths that lead out of ``root`` end the job. A path is unique, and a file one row.
    """
    if "line_base" in files.columns:
        raise ValueError("a file is written from one row, and these are blocks")
    _by_value()
    top = os.path.abspath(local_root(root))

    def target_of(path: str) -> str:
        target = os.path.normpath(os.path.join(top, path))
        if not target.startswith(top.rstrip("/") + "/"):
            raise ValueError(f"{path}: outside of the tree")
        return target

    def place(row: tuple[str, str, float]) -> int:
        target, text, mode = row
        os.makedirs(os.path.dirname(target), exist_ok=True)
        held = os.path.join(os.path.dirname(target), f".{os.urandom(8).hex()}.part")
        content = text.encode("utf-8")
        try:
            with open(held, "xb") as handle:
                handle.write(content)
                handle.flush()
                os.fsync(handle.fileno())
            if not pd.isna(mode):
                os.chmod(held, int(mode))
            os.replace(held, target)
        except BaseException:
            if os.path.exists(held):
                os.unlink(held)
            raise
        return len(content)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(WRITERS) as pool:
            for batch in batches:
                # A path that leads out ends this before any row after it; the rows ahead are written.
                rows = ((target_of(path), text, mode) for path, text, mode in batch.itertuples(index=False))
                sizes = list(pool.map(place, rows))
                yield pd.DataFrame({"path": batch["path"], "size": pd.Series(sizes, dtype="int64")})

    return files.select("path", "text", "mode").dropna(subset=["path", "text"]).mapInPandas(write, _WRITTEN)
