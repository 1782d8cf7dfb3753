"""A log whose readers see whole batches only, as a data source for streams: ``committed_log``.

Writing: each task writes its records to files of its own and reports them, with the range of
offsets per log partition; when all tasks are done the batch's list of files is published in one
move. A batch that fails is never listed and its files go; one that is done again replaces its list.

Reading: a position is the next offset of each log partition, from the earliest one on. A batch of
the reading stream goes up to at most ``max_rows`` further records, cut inside a file if need be, and
is read by one task per file and range. The end of each planned batch is kept in a small file beside
the log, under the reader's ``name``, from which a restarted stream goes on; Spark's checkpoint
decides what is read again.

Options: path; for streams that read, ``max_rows`` (none by default) and ``name``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)

from gamelog.sources.schemas import LOG_RECORD

NAME = "committed_log"
ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()),
                   ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC"))])


class _Store:
    """Files and published lists below a path, on any file system that Arrow opens."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), path

    def batches(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/_log", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def load(self, file: str):
        if self.fs.get_file_info(f"{self.root}/{file}").type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.root}/{file}") as f:
            return json.loads(f.read())

    def save(self, file: str, content) -> None:
        """In one move, so that nobody reads half a file."""
        folder = f"{self.root}/{file}".rpartition("/")[0]
        self.fs.create_dir(folder, recursive=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(draft, f"{self.root}/{file}")

    def files(self) -> list[tuple[int, list[dict]]]:
        return [(b, self.load(f"_log/{b}.json")) for b in self.batches()]

    def remove(self, names) -> None:
        for name in names:
            if self.fs.get_file_info(f"{self.root}/data/{name}").type != pafs.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/data/{name}")


@dataclass
class Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        store, open_files, files = _Store(self.path), {}, {}
        store.fs.create_dir(f"{store.root}/data", recursive=True)
        try:
            for batch in iterator:
                rows = pa.Table.from_batches([batch]).select(ARROW.names).cast(ARROW)
                for number in pc.unique(rows["partition"]).to_pylist():
                    part = rows.filter(pc.equal(rows["partition"], number))
                    if number not in open_files:
                        name = f"{uuid.uuid4().hex}.parquet"
                        open_files[number] = pq.ParquetWriter(f"{store.root}/data/{name}", ARROW, filesystem=store.fs)
                        files[number] = {"file": name, "partition": number, "rows": 0, "low": None, "high": None}
                    open_files[number].write_table(part)
                    f, ends = files[number], pc.min_max(part["offset"]).as_py()
                    f["rows"] += part.num_rows
                    f["low"] = ends["min"] if f["low"] is None else min(f["low"], ends["min"])
                    f["high"] = ends["max"] if f["high"] is None else max(f["high"], ends["max"])
        finally:
            for w in open_files.values():
                w.close()
        return Written(list(files.values()))

    def commit(self, messages, batchId: int) -> None:
        store = _Store(self.path)
        before = store.load(f"_log/{batchId}.json") or []
        store.save(f"_log/{batchId}.json", [f for m in messages if m is not None for f in m.files])
        store.remove(f["file"] for f in before)

    def abort(self, messages, batchId: int) -> None:
        _Store(self.path).remove(f["file"] for m in messages if m is not None for f in m.files)


class Range(InputPartition):
    """Records of one file with offsets from ``start`` up to, but without, ``end``."""

    def __init__(self, file: str, start: int | None, end: int | None):
        self.file, self.start, self.end = file, start, end


def _read(path: str, part: Range):
    store = _Store(path)
    with store.fs.open_input_file(f"{store.root}/data/{part.file}") as f:
        for batch in pq.ParquetFile(f).iter_batches(10_000):
            rows = pa.Table.from_batches([batch]).select(ARROW.names)
            if part.start is not None:
                rows = rows.filter(pc.and_(pc.greater_equal(rows["offset"], part.start), pc.less(rows["offset"], part.end)))
            yield from rows.cast(ARROW).to_batches()


class _BatchReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Range(f["file"], None, None) for _, files in _Store(self.path).files() for f in files] or [Range("", None, None)]

    def read(self, partition):
        return _read(self.path, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, name: str, max_rows: int | None):
        self.path, self.max_rows = path, max_rows
        self.progress = f"_readers/{name}.json"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store = _Store(self.path)
        position = dict(store.load(self.progress) or {})
        left = self.max_rows
        for _, files in store.files():
            for number in sorted({f["partition"] for f in files}):
                at = position.get(str(number))
                mine = [f for f in files if f["partition"] == number and (at is None or f["high"] >= at)]
                if not mine:
                    continue
                high = max(f["high"] for f in mine)
                if left is not None:
                    offsets = self._offsets(store, mine, at)
                    if len(offsets) > left:
                        if left:
                            position[str(number)] = offsets[left]
                        return position
                    left -= len(offsets)
                position[str(number)] = high + 1
        return position

    @staticmethod
    def _offsets(store: _Store, files: list[dict], at: int | None) -> list[int]:
        """Offsets from ``at`` on in some files of one batch and log partition, in order."""
        found = []
        for f in files:
            column = pq.read_table(f"{store.root}/data/{f['file']}", columns=["offset"], filesystem=store.fs)["offset"].to_pylist()
            found += [o for o in column if at is None or o >= at]
        return sorted(found)

    def partitions(self, start: dict, end: dict):
        store = _Store(self.path)
        store.save(self.progress, end)
        out = []
        for _, files in store.files():
            for f in files:
                low, high = start.get(str(f["partition"]), f["low"]), end.get(str(f["partition"]), f["low"])
                if f["high"] >= low and f["low"] < high:
                    out.append(Range(f["file"], low, high))
        return out

    def read(self, partition):
        return _read(self.path, partition)


class CommittedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return LOG_RECORD

    def reader(self, schema):
        return _BatchReader(self.options["path"])

    def streamReader(self, schema):
        rows = self.options.get("max_rows")
        return _StreamReader(self.options["path"], self.options.get("name", "reader"), int(rows) if rows else None)

    def streamWriter(self, schema, overwrite):
        return _Writer(self.options["path"])


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """All records of the committed batches."""
    spark.dataSource.register(CommittedLog)
    return spark.read.format(NAME).option("path", path).load()


def read_committed_stream(spark: SparkSession, path: str, name: str = "reader", max_rows: int | None = None) -> DataFrame:
    """The log as a stream from its earliest record, ``max_rows`` a trigger; ``name`` is the reader's own."""
    spark.dataSource.register(CommittedLog)
    reader = spark.readStream.format(NAME).option("path", path).option("name", name)
    return (reader.option("max_rows", str(max_rows)) if max_rows else reader).load()


def start_committed_log(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write a stream of log records to the log at ``path``."""
    records.sparkSession.dataSource.register(CommittedLog)
    return (records.select(*LOG_RECORD.fieldNames()).writeStream.format(NAME).option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
