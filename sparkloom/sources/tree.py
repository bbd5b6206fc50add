"""File trees as DataFrames, including dotfiles and underscore files, which Spark's own file sources hide."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx
from .shared import file_system, written

DIRECTORIES_PER_TASK = 200
LISTED = "path string, is_dir boolean, size long"


def _children(store: pafs.FileSystem, root: str, folder: str) -> list[tuple[str, bool, int | None]]:
    """The entries of a folder: path relative to root, whether it is a folder, size. A folder that is gone has none; a link to a
    folder is not followed, since it could lead back."""
    at = f"{root}/{folder}" if folder else root
    out = []
    for info in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        is_dir = info.type == pafs.FileType.Directory
        if is_dir and isinstance(store, pafs.LocalFileSystem) and os.path.islink(info.path):
            continue
        if is_dir or info.type == pafs.FileType.File:
            out.append((f"{folder}/{info.base_name}" if folder else info.base_name, is_dir, info.size))
    return out


def listing(spark: SparkSession, root: str, everything: bool = False) -> DataFrame:
    """path (relative, POSIX), size of the files below root, in any store that pyarrow opens; dotfiles included.

    One round of tasks for each level of folders: a task lists some folders of the level, and their subfolders are dealt anew
    for the next, so one deep or wide subtree is no single task and the driver only ever holds a count. A folder's own entries
    are listed at once. Unless everything is asked for, ignored folders are not entered and lock files not listed.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                rows = [r for r in _children(store, top, folder) if everything or r[0].rsplit("/", 1)[-1] not in (catalog.IGNORED_PARTS if r[1] else ignored_names)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["path", "is_dir", "size"])

    ignored_names = [*catalog.IGNORED_PARTS, *catalog.LOCKFILES]
    folders, n, levels = spark.createDataFrame([("",)], "folder string"), 1, []
    while n:
        tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // DIRECTORIES_PER_TASK)))
        levels.append(written(folders.repartition(tasks).mapInArrow(entries, LISTED)))
        folders = levels[-1].where("is_dir").select(F.col("path").alias("folder"))
        n = folders.count()
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out.where("NOT is_dir").select("path", "size")


def contents(root: str) -> Callable[[Column | str], Column]:
    """A column function: the bytes of the file at a path below root, null where it cannot be read.

    It is a function of the path alone, so a plan that does not use its result reads no file, and filters on paths come first.
    A task holds the bytes of a hundred files at a time.
    """

    @F.udf("binary", useArrow=False)
    def read(path: str) -> bytes | None:
        store, top = file_system(root)
        try:
            with store.open_input_stream(f"{top}/{path}") as f:
                return f.read()
        except OSError:
            return None

    return lambda path: read(tx.as_column(path))


def read_tree(spark: SparkSession, root: str, repo: str = "", everything: bool = False) -> DataFrame:
    """repo, path, content, size of the files below root. Files are read only if content is used, and only where filters leave them."""
    files = listing(spark, root, everything)
    return files.select(F.lit(repo).alias("repo"), "path", contents(root)("path").alias("content"), "size")


def write_tree(files: DataFrame, root: str) -> int:
    """Writes path, content as files below root, each by the task that holds it; the number of files. A path that repeats keeps one."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(root)
        made = set()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, content in zip(paths, batch.column("content"), strict=True):
                if (folder := f"{top}/{path}".rsplit("/", 1)[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{path}") as f:
                    f.write(content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return written(files.select("path", "content").mapInArrow(put, "path string")).count()


def is_binary(content: Column | str) -> Column:
    """A zero byte somewhere; content that could not be read counts as binary. (position() reads characters and would miss
    a zero byte behind a cut one.)"""
    c = tx.as_column(content)
    return F.coalesce(F.contains(c, F.lit(b"\x00")), F.lit(True))


def decode_all(content: pa.Array) -> pa.Array:
    """Texts of files without zero bytes: UTF-8 without what does not decode, line ends as newlines.

    All files are joined by zero bytes, which end any character that is cut, decoded and folded as one text, and cut again."""
    if not len(content):
        return pa.array([], pa.large_string())
    content = content.cast(pa.large_binary())
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(content)], pa.int64()), content)
    joined = pc.binary_join(whole, pa.scalar(b"\0", pa.large_binary()))[0].as_buffer().to_pybytes() + b"\0"
    data = np.frombuffer(joined.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n").encode(), np.uint8)
    ends = np.flatnonzero(data == 0)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data[data != 0]))


def decoded(files: DataFrame) -> DataFrame:
    """repo, path, text of the files that can be read and are not binary, a batch of files at a time."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.invert(pc.match_substring(b.column("content"), "\0")), False))
            yield pa.RecordBatch.from_arrays([b.column("repo"), b.column("path"), decode_all(b.column("content")).cast(pa.string())], ["repo", "path", "text"])

    return files.select("repo", "path", "content").mapInArrow(texts, "repo string, path string, text string")


def read_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """Lists of changed paths, one a line, in any store that Spark reads; blank lines go. A missing list is empty."""
    out = spark.createDataFrame([], "path string")
    for p in paths:
        try:
            out = out.union(spark.read.text(p).toDF("path"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out.where(tx.strip("path") != "")


def base_ref(argument: str | None, environment: str | None, upstream: str | None, existing: set[str]) -> str:
    """The base of a comparison: argument, environment, upstream, else the first of the usual branches that exists; else empty."""
    return next((x for x in (argument, environment, upstream, *[b for b in ("origin/main", "origin/master", "main", "master") if b in existing]) if x), "")


def toml_json(text: Column | str) -> Column:
    """TOML as JSON text; what does not parse is an empty object."""

    @F.pandas_udf("string")
    def convert(values):
        def one(x):
            try:
                return json.dumps(tomllib.loads(x or ""), default=str)
            except (tomllib.TOMLDecodeError, ValueError):
                return "{}"

        return values.map(one)

    return convert(tx.as_column(text))


def from_json_or_empty(text: Column | str, schema: str) -> Column:
    """A struct from JSON text; what does not parse has null fields."""
    return F.from_json(tx.as_column(text), schema)


def glob_files(paths: DataFrame, globs: list[str]) -> DataFrame:
    """repo, path of the files that a root glob takes, sorted by path within a repository; ``*`` stays in one directory here."""
    patterns = [tx.glob_regex(g)[4:].replace(".*", "[^/]*") for g in globs]
    return paths.where(F.col("path").rlike("|".join(f"(?:{p})" for p in patterns))).select("repo", "path").distinct()


def write_lines(lines: DataFrame, path: str) -> DataFrame:
    """Ordered lines (column value, as rendered gives them) as text files below path, whose names sort as their lines do.

    Returns the manifest: part, first (the number of its first line, from 1), n. It is also written below path, as _manifest.
    Each task of the order writes its own part."""
    spark = lines.sparkSession
    lines.select("value").write.mode("overwrite").text(path)
    counts = spark.read.text(path).groupBy(F.substring_index(F.input_file_name(), "/", -1).alias("part")).agg(F.count("*").alias("n"))
    # one row a part
    manifest = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + 1).alias("first"), "n")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return spark.read.schema("part string, first long, n long").json(f"{path}/_manifest")


def to_pretty_json(column: Column | str) -> Column:
    return F.to_json(tx.as_column(column), {"pretty": "true"})
