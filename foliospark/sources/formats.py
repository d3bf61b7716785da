"""The data source "folio": files of several formats read as ordered blocks and written through a commit.

``spark.read.format("folio").load(path)`` lists folder by folder, deals the files into partitions by size, and reads each by the
reader of its suffix. ``df.write.format("folio").save(path)`` takes rows (name, content). A task puts its files into a folder
of its own that readers don't see; only when all tasks are done does the commit move them into place, a folder that is new and
one task's as a whole, else file by file. A task that fails deletes its folder, and an abort deletes what other tasks have left, so no
part of a failed write is ever seen. The driver knows folders and never more files than one of them holds: names dealt over
many folders (``spread``) keep it small. ``files`` and ``contents`` list and read files in tasks alone.
Paths are those of any file system that pyarrow knows, and have to be shared by driver and executors.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from foliospark.shared import shared_dir
from foliospark.sources.batches import SLICE, portions
from foliospark.sources.importers import BLOCKS, READERS, file_blocks
from foliospark.sources.sinks import WRITERS, converted, exported

#: Bytes of files that one partition reads, if of more than one file.
PART = 64 << 20
#: Renames of a commit that run at once, those that wait for them, and the file systems that rename a folder by one of them.
MOVES, WAITING = 16, 10_000
RENAMING = ("local", "hdfs")
#: Folders that names are dealt over.
FOLDERS = 1024
HIDDEN = (".", "_")


def system(path: str):
    """The path's file system and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def walked(at, folder: str) -> Iterator[tuple[str, list]]:
    """Each visible folder from this one down, with its visible files in order of their names: one folder's at a time."""
    from pyarrow import fs

    left = [folder]
    while left:
        one = left.pop()
        found = sorted((f for f in at.get_file_info(fs.FileSelector(one)) if not f.base_name.startswith(HIDDEN)), key=lambda f: f.path)
        left += reversed([f.path for f in found if f.type == fs.FileType.Directory])
        yield one, [f for f in found if f.type == fs.FileType.File]


def listed(path: str) -> list:
    """Visible files below a folder in order of their names, or the file itself."""
    from pyarrow import fs

    at, folder = system(path)
    own = at.get_file_info(folder)
    if own.type == fs.FileType.File:
        return [own]
    return sorted((f for _, found in walked(at, folder) for f in found), key=lambda f: f.path)


def gone(at, folder: str, tries: int = 20) -> None:
    """Deletes a folder into which a task may still be writing."""
    from pyarrow import fs

    for n in range(tries):
        if at.get_file_info(folder).type == fs.FileType.NotFound:
            return
        try:
            at.delete_dir(folder)
        except OSError:
            if n == tries - 1:
                raise
            time.sleep(0.05)


@dataclass
class Files(InputPartition):
    """Files by their paths, and those of folders from one name to another."""

    paths: tuple[str, ...] = ()
    spans: tuple[tuple[str, str, str], ...] = ()


class FolioReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.suffixes = tuple(x.strip().lower() for x in options["suffixes"].split(",")) if "suffixes" in options else ("",)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        at, top = system(self.path)
        if at.get_file_info(top).type == fs.FileType.File:
            return [Files((top,) if top.lower().endswith(self.suffixes) else ())]
        parts, size = [[]], 0
        for folder, found in walked(at, top):
            for f in found:
                if not f.path.lower().endswith(self.suffixes):
                    continue
                if parts[-1] and size + f.size > PART:
                    parts.append([])
                    size = 0
                if parts[-1] and parts[-1][-1][0] == folder:
                    parts[-1][-1] = (folder, parts[-1][-1][1], f.base_name)
                else:
                    parts[-1].append((folder, f.base_name, f.base_name))
                size += f.size
        return [Files(spans=tuple(p)) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        at, _ = system(self.path)
        kinds = {"string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in BLOCKS.split(","))])
        rows, held = [], 0
        found = (f for folder, first, last in partition.spans for f in next(walked(at, folder))[1] if first <= f.base_name <= last)
        for path in chain(partition.paths, (f.path for f in found if f.path.lower().endswith(self.suffixes))):
            with at.open_input_stream(path) as f:
                content = f.read()
            rows += file_blocks(path, content)
            held += len(content)
            if held >= SLICE:
                yield _batch(rows, schema)
                rows, held = [], 0
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


@dataclass
class Staged(WriterCommitMessage):
    """A task's own folder, and the folders in it that hold files."""

    place: str
    folders: tuple[str, ...]


TWICE = "a name was written more than once"


class FolioWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = f".staged-{uuid.uuid4().hex}"
        at, folder = system(self.path)
        at.create_dir(f"{folder}/{self.job}", recursive=True)  # tasks need it: one that goes on after an abort fails

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Each file's bytes go from the batch to the file: a batch counts rows, which are whole files."""
        at, folder = system(self.path)
        mine = f"{folder}/{self.job}/{uuid.uuid4().hex}"
        folders: set[str] = set()
        at.create_dir(mine, recursive=False)
        try:
            for given, content in ((n.as_py(), c) for b in iterator for n, c in zip(b.column("name"), b.column("content"), strict=True)):
                name = posixpath.normpath(given)
                if name.startswith(("/", *HIDDEN)) or "\\" in name or "\0" in name:
                    raise ValueError(f"not a name inside the folder: {given!r}")
                inside = posixpath.dirname(name)
                if inside not in folders:
                    folders.add(inside)
                    if inside:
                        at.create_dir(f"{mine}/{inside}", recursive=True)
                if _there(at, f"{mine}/{name}"):
                    raise ValueError(TWICE)
                with at.open_output_stream(f"{mine}/{name}") as f:
                    f.write(content.as_buffer())
        except BaseException:
            gone(at, mine)
            raise
        return Staged(mine, tuple(sorted(folders)))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at, top = system(self.path)
        places: dict[str, list[str]] = {}  # of each folder
        for m in messages:
            for folder in m.folders if m else ():
                places.setdefault(folder, []).append(f"{m.place}/{folder}".rstrip("/"))
        for several in (p for p in places.values() if len(p) > 1):
            names: set[str] = set()
            for f in chain.from_iterable(_files(at, p) for p in several):
                if f.base_name in names:
                    self.abort(messages)
                    raise ValueError(TWICE)
                names.add(f.base_name)
        if self.overwrite:
            for _, found in walked(at, top):
                for f in found:
                    at.delete_file(f.path)
        above = {""} | {"/".join(parts[:n]) for parts in (x.split("/") for x in places) for n in range(1, len(parts))}
        with ThreadPoolExecutor(MOVES) as pool:
            whole = [(p[0], f"{top}/{x}") for x, p in places.items() if len(p) == 1 and x not in above and at.type_name in RENAMING and not _there(at, f"{top}/{x}")]
            kept = {source for source, _ in whole}
            for parent in {posixpath.dirname(target) for _, target in whole}:
                at.create_dir(parent, recursive=True)
            _moved(at, pool, whole)
            for folder, several in places.items():
                if several[0] not in kept:
                    target = f"{top}/{folder}".rstrip("/")
                    at.create_dir(target, recursive=True)
                    _moved(at, pool, ((f.path, f"{target}/{f.base_name}") for p in several for f in _files(at, p)))
        gone(at, f"{top}/{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        at, folder = system(self.path)
        gone(at, f"{folder}/{self.job}")


def _there(at, path: str) -> bool:
    from pyarrow import fs

    return at.get_file_info(path).type != fs.FileType.NotFound


def _files(at, folder: str) -> list:
    """All files of a folder, those in folders below it not."""
    from pyarrow import fs

    return [f for f in at.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]


def _moved(at, pool: ThreadPoolExecutor, moves) -> None:
    for some in batched(moves, WAITING):
        for _ in pool.map(lambda x: at.move(*x), some):
            pass


class Folio(DataSource):
    """Documents as files; ``suffixes`` limits what is read."""

    @classmethod
    def name(cls) -> str:
        return "folio"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return FolioReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"rows to write need {', '.join(sorted(missing))}")
        return FolioWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Folio)


def read(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """Blocks of the files of a folder."""
    register(spark)
    return spark.read.format("folio").option("suffixes", ",".join(suffixes or READERS)).load(path)


def spread(name: Column) -> Column:
    """A name in one of FOLDERS folders, which it decides itself."""
    return F.concat(F.lower(F.lpad(F.hex(F.crc32(name.cast("binary")) % FOLDERS), 3, "0")), F.lit("/"), name)


def write(files: DataFrame, path: str, mode: str = "append", together: bool = False) -> None:
    """Files (name, content) into a folder, all or none; ``together`` brings those of a folder to one task, so that folders are moved as a whole."""
    register(files.sparkSession)
    rows = files.select("name", "content")
    rows = rows.repartition(F.regexp_extract("name", "^(.*)/", 1)) if together else rows
    rows.write.format("folio").mode(mode).save(path)


def files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """path, length of the visible files below a folder, empty ones too. A task lists the folder itself, others what is below."""
    wanted = suffixes or ("",)

    def batch(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([f.path for f in found], pa.string()), "length": pa.array([f.size for f in found], pa.int64())})

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, folder = system(path)
        for _ in batches:  # one row
            own = at.get_file_info(folder)
            yield batch([own] if own.type == fs.FileType.File else [f for f in at.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(HIDDEN)])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _ = system(path)
        for b in batches:
            yield b.filter(b.column("length").is_valid())
            for folder in b.filter(b.column("length").is_null()).column("path").to_pylist():  # folders have no length
                yield from (batch(found) for _, found in walked(at, folder))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = spark.createDataFrame([(0,)], "n int").coalesce(1)  # rows of a size that Spark can't estimate: by range(1) it would broadcast what is listed
    found = start.mapInArrow(top, "path string, length long").repartition(parts, "path").mapInArrow(below, "path string, length long")
    # by the listed folders, which are few, an adaptive plan would take the files for few and broadcast them in a join
    return found.hint("shuffle_merge").where(F.lower("path").rlike("(" + "|".join(x.replace(".", "\\.") for x in wanted) + ")$"))


def contents(found: DataFrame, path: str) -> DataFrame:
    """path, content of files found in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _ = system(path)

        def content(p: str) -> bytes:
            with at.open_input_stream(p) as f:
                return f.read()

        for b in batches:
            for some in portions(((p, content(p)) for p in b.column("path").to_pylist()), lambda x: len(x[1])):
                yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in some], pa.string()), "content": pa.array([c for _, c in some], pa.binary())})

    return found.select("path").mapInArrow(run, "path string, content binary")


def _inside(c: str, path: str) -> Column:
    """A file's path below the folder."""
    return F.substring(c, len(system(path)[1].rstrip("/")) + 2, 1 << 30)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file (its path below the folder), digest of the files of a folder."""
    return contents(files(spark, path), path).select(_inside("path", path).alias("file"), F.sha2("content", 256).alias("digest"))


def convert(spark: SparkSession, source: str, target: str, suffix: Column) -> DataFrame:
    """Every readable file of ``source`` in another format in ``target``; ``suffix`` is an expression over file and its suffix.

    A file keeps its folder. A name that the target folder has already, or that two files would get, is made free; sources are never
    written to, and have to have the same digests afterwards. Gives file, name; files that can't be read have an error and no name.
    """
    held = digests(spark, source).withColumnRenamed("digest", "before").checkpoint()
    once = f"{shared_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"  # several steps read them, one for each suffix
    read(spark, source).withColumn("file", _inside("file", source)).write.parquet(once)
    blocks = spark.read.schema(BLOCKS).parquet(once)
    stem, old = F.regexp_extract("file", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("file", r"(\.[^./]*)$", 1)
    named = blocks.where("error IS NULL").select("file").distinct().select(F.col("file").alias("id"), stem.alias("stem"), F.lower(old).alias("old"), "file")
    named = named.withColumn("suffix", suffix).withColumn("format", F.substring("suffix", 2, 99)).where(F.col("suffix").isin(*WRITERS))
    there = files(spark, target).select(_inside("path", target).alias("n")) if exists(target) else spark.createDataFrame([], "n string")
    taken = there.select(F.regexp_extract("n", r"^(.*)\.([^./]*)$", 1).alias("stem"), F.regexp_extract("n", r"^(.*)\.([^./]*)$", 2).alias("format"))
    names = converted(named, taken.where("format <> ''")).checkpoint()
    pieces = blocks.where("error IS NULL").join(named.select("file", "stem", "suffix"), "file")
    title = F.element_at(F.split("stem", "/"), -1)
    made = exported(pieces.select(F.col("file").alias("document_id"), "ord", "kind", "text", title.alias("title"), F.lit("txt").alias("format"), "suffix"))
    folders = names.select(F.regexp_extract("name", "^(.*)/", 1)).distinct().count()
    write(made.join(names, made["document_id"] == names["id"]).select("name", "content"), target, together=folders >= MOVES)
    changed = digests(spark, source).join(held, "file", "full_outer").where("NOT coalesce(digest = before, false)")
    if not changed.isEmpty():
        raise ValueError("a source changed while it was converted")
    failed = blocks.where("error IS NOT NULL").select("file", F.lit(None).cast("string").alias("name"), "error")
    return names.select(F.col("id").alias("file"), "name", F.lit(None).cast("string").alias("error")).union(failed)


def exists(path: str) -> bool:
    return _there(*system(path))
