"""File changes below a folder as a stream: a Python data source that compares listings.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("folder_changes").option("path", folder).option("state", shared).load()

Each trigger lists the folder once, on the driver, as names, sizes and times only.  If the
listing differs from the last one it is kept below ``state`` under the next number, and
numbers are the stream's offsets; so the changes between two offsets follow from two
kept listings, and a restart or a repeated batch reads the same ones.  Listings before the
last committed offset are removed.  Rows are (path, kind, size, ts); ``kind`` is
``created``, ``modified`` (another size or time) or ``deleted``.  The first listing counts as
created.  ``path`` and ``state`` may be in any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, size long, ts timestamp"
PARTS = 8  # tasks that a comparison is dealt to; a task opens the two listings and keeps its share


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def listing(uri: str) -> dict[str, list]:
    """path -> [size, time in ns] of the files below ``uri``; hidden files and what starts with _ are left out."""
    from pyarrow import fs

    store, root = _open(uri)
    out = {}
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path[len(root) :].strip("/").split("/")
        if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in parts):
            out["/".join(parts)] = [f.size, f.mtime_ns]
    return out


class Kept:
    """Numbered listings below a folder."""

    def __init__(self, uri: str):
        self.store, self.root = _open(uri)

    def read(self, number: int) -> dict[str, list]:
        if number < 0:
            return {}
        with self.store.open_input_stream(f"{self.root}/{number}.json") as f:
            return json.loads(f.read())

    def write(self, number: int, files: dict[str, list]) -> None:
        """Under a name of its own first, so that no reader sees half a listing."""
        self.store.create_dir(self.root, recursive=True)
        with self.store.open_output_stream(f"{self.root}/{number}.part") as f:
            f.write(json.dumps(files).encode())
        self.store.move(f"{self.root}/{number}.part", f"{self.root}/{number}.json")

    def numbers(self) -> list[int]:
        from pyarrow import fs

        names = [f.base_name for f in self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def drop_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.store.delete_file(f"{self.root}/{n}.json")


def compare(old: dict[str, list], new: dict[str, list]) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(path, kind, size, time in ns), by path."""
    for path in sorted(old.keys() | new.keys()):
        if path not in old:
            yield path, "created", *new[path]
        elif path not in new:
            yield path, "deleted", None, None
        elif old[path] != new[path]:
            yield path, "modified", *new[path]


class Share(InputPartition):
    def __init__(self, first: int, last: int, part: int, now: float):
        self.first, self.last, self.part, self.now = first, last, part, now


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state = options["path"], options["state"]

    def initialOffset(self) -> dict:
        return {"listing": -1}

    def latestOffset(self) -> dict:
        kept, now = Kept(self.state), listing(self.path)
        last = (kept.numbers() or [-1])[-1]
        if last < 0 or kept.read(last) != now:
            last += 1
            kept.write(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        import time

        return [Share(start["listing"], end["listing"], part, time.time()) for part in range(PARTS)]

    def read(self, share: Share) -> Iterator[tuple]:
        from datetime import datetime, timezone

        kept = Kept(self.state)
        mine = lambda files: {p: f for p, f in files.items() if zlib.crc32(p.encode()) % PARTS == share.part}
        for path, kind, size, at in compare(mine(kept.read(share.first)), mine(kept.read(share.last))):
            yield path, kind, size, datetime.fromtimestamp(at / 1e9 if at is not None else share.now, timezone.utc)

    def commit(self, end: dict) -> None:
        Kept(self.state).drop_before(end["listing"])


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(self.options)
