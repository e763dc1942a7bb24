"""Note files: a tree of HTML files with front matter, walked and read by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_jobs.functions.frontmatter import front_matter_map, note_defaults, published_flag, slug_from_path, split_front_matter, url_from_slug, value_of
from corpus_jobs.functions.text import normalize_tags
from corpus_jobs.schemas import PARSED
from corpus_jobs.sources.shared import materialise

#: What a task reads at most, about: files and bytes.
FILES_A_TASK, BYTES_A_TASK = 20_000, 64 << 20


def _store(root: str):
    """(file system, path on it) of a folder; a path without a scheme is a local one."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root if "://" in root or not root.startswith("file:") else root.replace("file:", "file://", 1))


def _listed(folders: DataFrame, root: str, suffix: str) -> DataFrame:
    """(path, is_folder, size) of the entries of every folder (path below ``root``) that are folders or end in ``suffix``."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType, LocalFileSystem

        store, base = _store(root)
        local = isinstance(store, LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [], [], []
                for info in store.get_file_info(FileSelector(f"{base}/{folder}".rstrip("/"))):
                    # folders behind links aren't entered, so that a walk ends
                    is_folder = info.type == FileType.Directory and not (local and os.path.islink(info.path))
                    if is_folder or info.type == FileType.File and info.base_name.endswith(suffix):
                        for column, value in zip(found, (f"{folder}/{info.base_name}".lstrip("/"), is_folder, info.size), strict=True):
                            column.append(value)
                columns = (pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.bool_(), pa.int64()), strict=True))
                yield pa.RecordBatch.from_arrays([*columns], names=["path", "is_folder", "size"])

    return folders.mapInArrow(listed, "path string, is_folder boolean, size bigint")


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path below ``root``, size) of every file of a tree whose name ends in ``suffix``, whatever it begins with.

    Each level of the tree is a job whose tasks share the folders of that level. Lists are written to shared storage,
    so a lost executor doesn't make them start again. A ``root`` that isn't there is an error, as are folders and files
    that go away meanwhile. A folder's names are held by one task.
    """
    found, folders = [], spark.createDataFrame([("",)], "path string")
    while True:
        level = materialise(_listed(folders, root, suffix), "listed")
        found.append(level.where("not is_folder").select("path", "size"))
        folders = level.where("is_folder").select("path")
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), F.xxhash64("path"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def read_note_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of every ``*.html`` below ``root``; line ends become ``\\n``.

    Hidden files and folders (names with ``.`` or ``_`` in front) and empty files come, too: what to make of them is
    parse_notes' decision, and a sync that didn't see a file would delete its note. Texts must be UTF-8. Files are
    dealt to tasks by number and size. ``root`` is a path or URI that pyarrow's file systems know. See list_files for
    what is an error.
    """
    files = list_files(spark, root, ".html")
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(min(n, spark.sparkContext.defaultParallelism), -(-n // FILES_A_TASK), -(-size // BYTES_A_TASK), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        paths, texts, held = [], [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "raw"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{path}") as stream:
                    raw = stream.read()
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError as e:
                    raise ValueError(f"{root.rstrip('/')}/{path} is not UTF-8: {e}") from None
                paths.append(f"{root.rstrip('/')}/{path}")
                texts.append(text.replace("\r\n", "\n").replace("\r", "\n"))
                held += len(raw)
                if held >= 4 << 20 or len(paths) >= 1000:
                    yield flushed()
                    paths, texts, held = [], [], 0
        if paths:
            yield flushed()

    return files.select("path").repartition(tasks, F.xxhash64("path")).mapInArrow(read, "path string, raw string")


def parse_notes(files: DataFrame, root: str) -> DataFrame:
    """Notes of files (path, raw): see PARSED for the columns. A file without front matter or title, such as an empty one, is an error that names it."""
    source = F.col("path")
    split = files.select("path", slug_from_path(source, root).alias("slug"), split_front_matter(F.col("raw"), source).alias("s"))
    rows = split.select("path", "slug", front_matter_map(F.col("s.front"), source).alias("entries"), F.col("s.body").alias("content_html"))
    entries = F.col("entries")
    columns = {"slug": F.col("slug"), "url": url_from_slug(F.col("slug")), "content_html": F.col("content_html"), **note_defaults(entries, source)}
    columns |= {"published": published_flag(entries), "tags": normalize_tags(value_of(entries, "tags"))}
    return rows.select(*(columns[f.name].alias(f.name) for f in PARSED.fields))
