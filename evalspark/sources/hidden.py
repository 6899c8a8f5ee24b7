"""Files whose names Spark's own listing leaves out, as a data source.

    spark.dataSource.register(HiddenFiles)
    spark.read.format("hidden_files").option("path", "/data/raw").load()   # path, length, content

Spark hides names that begin with ``.`` or ``_``, and all that lies below folders of such names. This
source lists just those, on any file system that pyarrow opens by its address, and reads the content of
files with one of ``suffixes`` (comma-separated, any case) up to ``limit`` bytes; that of the
others, and of files that cannot be opened, is null. The driver lists folders until there are enough of them to
share, tasks list what is below; a file is one row, so it fits a task as its value does.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, content binary"
# Folders that the driver lists at most before tasks take over, and that make one partition each.
FOLDERS = 256


def hides(name: str) -> bool:
    """The rule of Spark's file listing, for one part of a path."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def checksum(name: str) -> bool:
    """Written by Hadoop beside a local file; part of that file."""
    return name.startswith(".") and name.endswith(".crc")


def opened(address: str):
    """``(file system, folder in it, what goes before a path to make its address)``."""
    from pyarrow import fs

    if "://" not in address and not address.startswith("file:"):
        address = "file://" + os.path.abspath(address)
    if address.startswith("file:"):
        # As Hadoop writes local paths: one slash.
        folder = "/" + address.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), folder.rstrip("/") or "/", "file:"
    system, folder = fs.FileSystem.from_uri(address)
    return system, folder.rstrip("/"), address.rstrip("/").removesuffix(folder.rstrip("/"))


class Folder(InputPartition):
    def __init__(self, path: str, hidden: bool, deep: bool):
        super().__init__(path)
        self.path, self.hidden, self.deep = path, hidden, deep


class HiddenFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.address = options["path"]
        self.suffixes = tuple(s.lower() for s in options.get("suffixes", "").split(",") if s)
        self.limit = int(options.get("limit", 2**31 - 1))

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        system, folder, _ = opened(self.address)
        level, listed = [Folder(folder, False, True)], []
        while level and len(level) < FOLDERS:
            below = []
            for at in level:
                listed.append(Folder(at.path, at.hidden, False))
                for info in system.get_file_info(fs.FileSelector(at.path)):
                    if info.type == fs.FileType.Directory:
                        below.append(Folder(info.path, at.hidden or hides(info.base_name), True))
            level = below
            if len(listed) >= FOLDERS:
                break
        return listed + level

    def read(self, partition: Folder) -> Iterator[tuple[str, int, bytes | None]]:
        from pyarrow import fs

        system, _, before = opened(self.address)
        waiting = [(partition.path, partition.hidden)]
        while waiting:
            folder, hidden = waiting.pop()
            for info in system.get_file_info(fs.FileSelector(folder)):
                inside = hidden or hides(info.base_name)
                if info.type == fs.FileType.Directory:
                    if partition.deep:
                        waiting.append((info.path, inside))
                elif inside and not checksum(info.base_name):
                    yield before + info.path, info.size, self.content(system, info)

    def content(self, system, info) -> bytes | None:
        if not info.base_name.lower().endswith(self.suffixes) or info.size > self.limit:
            return None
        try:
            with system.open_input_stream(info.path) as stream:
                return stream.read()
        except OSError:
            return None


class HiddenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hidden_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HiddenFilesReader:
        return HiddenFilesReader(self.options)
