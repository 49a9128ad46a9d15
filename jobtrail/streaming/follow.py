"""Follow mode: flow events as a stream whose offset is their sequence number.

A poll looks at the footers of the event files for the highest sequence there is; what lies between two
polls is read in ranges of sequence numbers, each by a task that skips the files and row groups outside
of its range. The checkpoint keeps the offset, so a poll that comes late or again delivers what is new and
nothing twice; an event that was appended twice under its number is delivered once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Sequence numbers that one task reads at most, and rows of one batch.
RANGE, ROWS = 500_000, 10_000


def event_files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, base = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return fs, sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


def span(fs: pafs.FileSystem, path: str) -> tuple[int, int] | None:
    """Least and highest sequence of a file, by its footer; none of an empty one."""
    with fs.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
    columns = [meta.row_group(k).column(j) for k in range(meta.num_row_groups) for j in range(meta.num_columns) if meta.row_group(k).column(j).path_in_schema == "sequence"]
    known = [c.statistics for c in columns if c.statistics is not None and c.statistics.has_min_max]
    return (min(s.min for s in known), max(s.max for s in known)) if known else None


class Span(InputPartition):
    """Events with low < sequence <= high."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class FlowEventReader(DataSourceStreamReader):
    def __init__(self, path: str, since: int, schema: StructType):
        self.path, self.since, self.names = path, since, schema.names
        self.spans: dict[str, tuple[int, int] | None] = {}

    def initialOffset(self) -> dict:
        return {"sequence": self.since}

    def latestOffset(self) -> dict:
        fs, files = event_files(self.path)
        for f in files:
            if f not in self.spans:  # files are written once
                self.spans[f] = span(fs, f)
        return {"sequence": max([self.since, *(s[1] for f, s in self.spans.items() if s)])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["sequence"], end["sequence"]
        return [Span(a, min(a + RANGE, high)) for a in range(low, high, RANGE)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, files = event_files(self.path)
        inside = (ds.field("sequence") > partition.low) & (ds.field("sequence") <= partition.high)
        seen: set[int] = set()
        for batch in ds.dataset(files, filesystem=fs, format="parquet").scanner(columns=self.names, filter=inside, batch_size=ROWS).to_batches() if files else ():
            new = []
            for k, sequence in enumerate(batch.column(self.names.index("sequence")).to_pylist()):
                if sequence not in seen:
                    seen.add(sequence)
                    new.append(k)
            if new:
                yield batch.take(pa.array(new))

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


class FlowEvents(DataSource):
    """readStream.format("flow_events").option("path", ...).option("since", sequence)."""

    @classmethod
    def name(cls) -> str:
        return "flow_events"

    def schema(self) -> StructType:
        fs, files = event_files(self.options["path"])
        if not files:
            raise ValueError(f"no event files below {self.options['path']}: name their schema")
        return from_arrow_schema(pq.read_schema(files[0], filesystem=fs))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FlowEventReader(self.options["path"], int(self.options.get("since", "0")), schema)


def follow(spark: SparkSession, path: str, since: int = 0, schema: StructType | str | None = None) -> DataFrame:
    """A stream of the flow events below a folder (a URI that pyarrow reads) whose sequence is beyond `since`.

    Sequence numbers must grow with time: one that appears when a higher one was polled is not seen any more.
    """
    spark.dataSource.register(FlowEvents)
    reader = spark.readStream.format("flow_events").option("path", path).option("since", str(since))
    return (reader.schema(schema) if schema else reader).load()
