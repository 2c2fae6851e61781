"""Polls of a table by its change-time column: what has changed since the last poll, once each.

The offset is a pair (change time, id): of rows that changed at one moment those with greater
ids come later, so a poll may end between them. A row that changes again comes again, with its
new time. The offset is in the stream's checkpoint, so a restart goes on where it ended.

A writer may still add rows to the latest moments, also with smaller ids than those seen; such
moments are left for later polls until `settle` has passed.

    spark.dataSource.register(Changes)
    spark.readStream.format("changes").schema("id long, changed timestamp, ...")
        .options(path=..., time="changed", id="id", settle="5 seconds").load()

Files are read by the executors, a task a file, with the time and id pushed down to them; the
driver reads the two columns to know where a poll ends, of those files only that may have newer
rows. Paths are what Arrow can open.

Edge cases: rows without a time or an id never come; with equal time and id both come, if in
one poll; an empty or absent folder has no rows; columns that a file lacks are null.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changes"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangeReader(dict(self.options), schema)


class Part(InputPartition):
    def __init__(self, path: str, start: dict, end: dict) -> None:
        self.path, self.start, self.end = path, start, end


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.time, self.id = options["path"], options["time"], options["id"]
        self.settle = pd.Timedelta(options.get("settle", "0 seconds")).value // 1_000
        self.schema = to_arrow_schema(schema)
        self.last: dict[str, Any] = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"time": None, "id": None}

    def _files(self, system: fs.FileSystem, at: str) -> list[str]:
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if system.get_file_info(at).type != fs.FileType.File else [system.get_file_info(at)]
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")) and "/_temporary/" not in f.path)

    def _open(self, files: list[str] | None = None) -> ds.Dataset | None:
        system, at = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        files = self._files(system, at) if files is None else files
        return ds.dataset(files, schema=self.schema, format="parquet", filesystem=system) if files else None

    def _moment(self, micros: int) -> pa.Scalar:
        return pa.scalar(micros, pa.timestamp("us", "UTC")).cast(self.schema.field(self.time).type)

    def _since(self, start: dict) -> pc.Expression:
        """Rows behind an offset."""
        known = ds.field(self.time).is_valid() & ds.field(self.id).is_valid()
        if start["time"] is None:
            return known
        at = self._moment(start["time"])
        return known & ((ds.field(self.time) > at) | ((ds.field(self.time) == at) & (ds.field(self.id) > start["id"])))

    def latestOffset(self) -> dict:
        rows, best = self._open(), (self.last["time"], self.last["id"])
        upto = ds.field(self.time) <= self._moment(int(time.time() * 1e6) - self.settle)
        for b in rows.to_batches(columns=[self.time, self.id], filter=self._since(self.last) & upto) if rows else ():
            if b.num_rows:
                at = b.column(0).cast(pa.timestamp("us", "UTC")).cast(pa.int64())
                top = pc.max(at)
                new = (top.as_py(), pc.max(b.column(1).filter(pc.equal(at, top))).as_py())
                best = new if best[0] is None or new > best else best
        self.last = {"time": best[0], "id": best[1]}
        return self.last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        rows = self._open()
        # files whose statistics show nothing newer are left out
        return [Part(f.path, start, end) for f in rows.get_fragments() if f.split_by_row_group(filter=self._since(start), schema=self.schema)] if rows and end["time"] is not None else []

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        at = self._moment(partition.end["time"])
        upto = (ds.field(self.time) < at) | ((ds.field(self.time) == at) & (ds.field(self.id) <= partition.end["id"]))
        for b in self._open([partition.path]).to_batches(filter=self._since(partition.start) & upto):
            if b.num_rows:
                yield b

    def commit(self, end: dict) -> None:
        pass
