"""A data source that lists directories: spark.dataSource.register(Walk), then .format("walk").option("roots", json)."""

from __future__ import annotations

import json
import os
import queue
import stat
import string
import sys
import threading
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROOT_TIMEOUT, DRIVE_TIMEOUT = 30, 5
SCHEMA = "path string, name string, ext string, dir string, size long, mtime double, scan_started_at double, error string"


def within(seconds: float, call: Callable[[], object]) -> object:
    """call's result. A call that takes longer raises TimeoutError and is left behind in its daemon thread, for which nobody waits."""
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((call(), None))
        except OSError as e:
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer in {seconds} s") from None
    if error:
        raise error
    return value


def roots_of(all_drives: bool, folders: list[str], windows: bool = sys.platform == "win32", seconds: float = DRIVE_TIMEOUT) -> Iterator[tuple[str, bool]]:
    """Each root asked for, and whether it can be walked: the folders, or all drives (one root on systems without drives)."""
    asked = [f"{c}:\\" for c in string.ascii_uppercase] if all_drives and windows else [os.sep] if all_drives else folders
    for root in asked:
        try:
            yield root, bool(within(seconds, lambda: os.path.isdir(root)))
        except (TimeoutError, OSError):
            yield root, False


def hidden(name: str, about: os.stat_result) -> bool:
    """By a leading dot, or by the attribute that Windows keeps."""
    return name.startswith(".") or bool(getattr(about, "st_file_attributes", 0) & stat.FILE_ATTRIBUTE_HIDDEN)


def listed(root: str, no_folders: set[str], no_extensions: set[str], started: float, scan: Callable = os.scandir, seconds: float = ROOT_TIMEOUT) -> Iterator[tuple]:
    """Rows of one root: depth first, without hidden entries and links; unreadable entries give a row with an error."""
    try:
        stack = [(root, within(seconds, lambda: list(scan(root))))]
    except (TimeoutError, OSError) as e:
        yield (root, None, None, None, None, None, started, f"{type(e).__name__}: {e}")
        return
    while stack:
        folder, entries = stack.pop()
        for entry in entries:
            try:
                about = entry.stat(follow_symlinks=False)
                if hidden(entry.name, about) or entry.is_symlink() or entry.is_junction():
                    continue
                if stat.S_ISDIR(about.st_mode):
                    if entry.name.lower() not in no_folders:
                        stack.append((entry.path, list(scan(entry.path))))
                    continue
                ext = os.path.splitext(entry.name)[1].lower()
                if ext not in no_extensions and stat.S_ISREG(about.st_mode):
                    yield (entry.path, entry.name, ext, folder, about.st_size, about.st_mtime, started, None)
            except OSError as e:
                yield (entry.path, None, None, None, None, None, started, f"{type(e).__name__}: {e}")


class Root(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        get = lambda k: json.loads(options.get(k, "[]"))
        self.roots, self.started = get("roots"), float(options.get("started", "0"))
        self.no_folders, self.no_extensions = ({x.lower() for x in get(k)} for k in ("exclude_folders", "exclude_extensions"))

    def partitions(self) -> list[Root]:
        return [Root(r) for r in self.roots]

    def read(self, partition: Root) -> Iterator[tuple]:
        yield from listed(partition.path, self.no_folders, self.no_extensions, self.started)


class Walk(DataSource):
    """Options, JSON lists: roots (one partition each), exclude_folders, exclude_extensions; and started (epoch seconds)."""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options)
