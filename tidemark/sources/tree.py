"""Directory-tree scan as a Python data source, one partition per top-level entry.

Options: path (the root), ignore_dirs and ignore_files (JSON lists). Rows are
tagged: 'file' rows carry size, ticks and attributes, 'dir' rows the directory's
identifier, 'failed' rows a directory that could not be listed ('.': the root).
Symbolic links are never followed and never returned; ignored directories are
not entered. Metadata only, file contents are not opened.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, path string, size long, mtime long, attrs int, frn string"
READONLY, HIDDEN, DIRECTORY, ARCHIVE = 0x1, 0x2, 0x10, 0x20


def attributes(st: os.stat_result, name: str) -> int:
    a = DIRECTORY if stat.S_ISDIR(st.st_mode) else ARCHIVE
    return a | (HIDDEN if name.startswith(".") else 0) | (0 if st.st_mode & 0o200 else READONLY)


def ticks_of(st: os.stat_result) -> int:
    return st.st_mtime_ns // 100


def try_stat(path: str) -> tuple[int, int, int] | None:
    """(size, ticks, attributes) of a file; None if missing, a directory or unreadable."""
    try:
        st = os.stat(path)
    except OSError:
        return None
    return None if stat.S_ISDIR(st.st_mode) else (st.st_size, ticks_of(st), attributes(st, os.path.basename(path)))


class Part(InputPartition):
    def __init__(self, rel: str | None):
        super().__init__(rel)
        self.rel = rel


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        fold = lambda k: tuple(x.strip().upper() for x in json.loads(options.get(k, "[]")) if x.strip())
        self.dirs, self.files = fold("ignore_dirs"), fold("ignore_files")

    def partitions(self):
        """The root's own files, and one partition per directory in it."""
        try:
            with os.scandir(self.root) as it:
                tops = sorted(e.name for e in it if e.is_dir(follow_symlinks=False) and not self._skip(e.name, self.dirs))
        except OSError:
            tops = []
        return [Part(None), *(Part(t) for t in tops)]

    @staticmethod
    def _skip(name: str, prefixes: tuple[str, ...]) -> bool:
        return name.upper().startswith(prefixes) if prefixes else False

    def _list(self, rel: str) -> list[os.DirEntry]:
        with os.scandir(os.path.join(self.root, rel)) as it:
            return sorted(it, key=lambda e: e.name)

    def read(self, partition: Part) -> Iterator[tuple]:
        todo = [partition.rel or ""]
        while todo:
            rel = todo.pop()
            shown = rel.replace(os.sep, "\\")
            try:
                st = os.stat(os.path.join(self.root, rel))
                entries = self._list(rel)
            except OSError:
                yield ("failed", shown or ".", None, None, None, None)
                continue
            yield ("dir", shown, None, ticks_of(st), attributes(st, os.path.basename(rel)), f"{st.st_dev << 64 | st.st_ino:x}")
            for e in entries:
                sub = f"{rel}{os.sep}{e.name}" if rel else e.name
                try:
                    if e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if partition.rel is not None and not self._skip(e.name, self.dirs):
                            todo.append(sub)
                    elif not self._skip(e.name, self.files):
                        s = e.stat(follow_symlinks=False)
                        yield ("file", sub.replace(os.sep, "\\"), s.st_size, ticks_of(s), attributes(s, e.name), None)
                except OSError:
                    continue


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan(spark, path: str, ignore_dirs: list[str] | None = None, ignore_files: list[str] | None = None):
    """Rows of a tree; split by kind."""
    spark.dataSource.register(TreeSource)
    return (
        spark.read.format("tree").option("path", path).option("ignore_dirs", json.dumps(ignore_dirs or [])).option("ignore_files", json.dumps(ignore_files or [])).load()
    )
