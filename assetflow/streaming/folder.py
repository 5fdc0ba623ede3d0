"""A folder as a streaming source that sees new, changed and renamed files.

Spark's file source remembers names only, so a file written again or renamed onto a known name never comes back.  This
source keeps listings: every trigger lists the folder (path, time of change, length), and where something differs from the last listing
a new one is stored in the state folder, in shards by a hash of the path.  An offset is the number of a listing; a batch is what
differs between two listings, told shard by shard in the tasks.  Both listings stay until Spark has committed the batch, so a
batch that is repeated gives the same rows, and a restarted stream goes on from its offset.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.cloudpickle import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from assetflow.streaming.watch import watched

LISTED = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("length", pa.int64())])
DONE = "done.json"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shard(InputPartition):
    def __init__(self, start: int, end: int, number: int) -> None:
        self.start, self.end, self.number = start, end, number


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.state = options["path"], options["state"].rstrip("/")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.existing = options.get("existing", "true").lower() == "true"
        self.shards = int(options.get("shards", "8"))

    # on the driver
    def initialOffset(self) -> dict:
        return {"listing": 0} if self.existing else self.latestOffset()

    def latestOffset(self) -> dict:
        found: list[list[tuple[str, int, int]]] = [[] for _ in range(self.shards)]
        system, root = _opened(self.folder)
        scheme = self.folder.split(":", 1)[0] if ":" in self.folder.split("/", 1)[0] else "file"
        for info in system.get_file_info(fs.FileSelector(root, recursive=self.recursive, allow_not_found=True)):
            if info.type == fs.FileType.File:
                path = f"{scheme}:{info.path}"
                found[zlib.crc32(path.encode()) % self.shards].append((path, (info.mtime_ns or 0) // 1000, info.size))
        digest = [f"{len(rows)}-{zlib.crc32(repr(sorted(rows)).encode())}" for rows in found]
        last, known = self._last()
        if digest == known:
            return {"listing": last}
        self._store(last + 1, found, digest)
        return {"listing": last + 1}

    def _last(self) -> tuple[int, list[str]]:
        """Number and digest of the last whole listing."""
        system, root = _opened(self.state)
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory]
        for n in sorted((int(x.removeprefix("listing-")) for x in names if x.startswith("listing-")), reverse=True):
            if system.get_file_info(f"{root}/listing-{n}/{DONE}").type == fs.FileType.File:
                with system.open_input_stream(f"{root}/listing-{n}/{DONE}") as held:
                    return n, json.loads(held.read())
        return 0, [f"0-{zlib.crc32(b'[]')}"] * self.shards

    def _store(self, n: int, found: list, digest: list[str]) -> None:
        system, root = _opened(self.state)
        system.create_dir(f"{root}/listing-{n}", recursive=True)
        for i, rows in enumerate(found):
            columns = list(zip(*rows)) if rows else [[], [], []]
            table = pa.table([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()])], names=LISTED.names).cast(LISTED)
            with system.open_output_stream(f"{root}/listing-{n}/{i}.arrow") as out, pa.ipc.new_file(out, LISTED) as writer:
                writer.write_table(table)
        with system.open_output_stream(f"{root}/listing-{n}/{DONE}") as out:  # a listing counts once this is there
            out.write(json.dumps(digest).encode())

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(start["listing"], end["listing"], i) for i in range(self.shards)]

    def commit(self, end: dict) -> None:
        system, root = _opened(self.state)
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("listing-") and int(info.base_name.removeprefix("listing-")) < end["listing"]:
                system.delete_dir(info.path)

    # in the tasks
    def _shard(self, n: int, number: int) -> pa.Table:
        if n == 0:
            return LISTED.empty_table()
        system, root = _opened(self.state)
        with system.open_input_file(f"{root}/listing-{n}/{number}.arrow") as held:
            return pa.ipc.open_file(held).read_all()

    def read(self, part: Shard) -> Iterator[pa.RecordBatch]:
        before = self._shard(part.start, part.number).rename_columns(["path", "was", "had"])
        both = self._shard(part.end, part.number).join(before, "path", join_type="left outer")
        same = pc.and_(pc.equal(both["modified"], both["was"]), pc.equal(both["length"], both["had"]))
        new = both.filter(pc.invert(pc.fill_null(same, False))).select(LISTED.names)
        yield from new.cast(LISTED).to_batches()


class FolderSource(DataSource):
    """Options: ``path``, ``state`` (a folder of the stream's own that driver and executors share), ``recursive``, ``existing`` (whether
    files that are there at the start are told), ``shards``."""

    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return "path string, modified timestamp, length bigint"

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


# Python workers that plan the stream import nothing shipped with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def watch_folder(spark: SparkSession, directory: str, state: str, recursive: bool = True, existing: bool = True, shards: int = 8) -> DataFrame:
    """New, changed and renamed files below ``directory`` as a stream of ``path, modified, length, path_key``; a renamed file comes
    under its new name, a deleted one does not come.  ``state`` belongs to this stream, as its checkpoint does."""
    spark.dataSource.register(FolderSource)
    stream = spark.readStream.format("watched_folder").option("state", state).option("shards", shards)
    stream = stream.option("recursive", str(recursive).lower()).option("existing", str(existing).lower())
    return watched(stream.load(directory))
