"""A folder of Parquet rows as a log: a data source with an offset for each topic and partition.

`OffsetLog` reads the log as a table or as a stream, by the options of a broker's source: path,
startingOffsets and endingOffsets (earliest, latest, or JSON {topic: {partition: offset}}; an end
is not included), and maxOffsetsPerTrigger, the most records of a micro-batch. A restarted stream
goes on behind the last offsets of its checkpoint (option checkpoint).

What a file holds comes from its footer: row groups of one partition by their statistics, other
ones by reading the two columns. Files never change, so each is looked at once by a reader.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME, RECORDS = "offsetlog", 2000
COLUMNS = ("key", "value", "topic", "partition", "offset", "timestamp")
SCHEMA = "key string, value string, topic string, partition int, offset long, timestamp timestamp"

#: (topic, partition) -> offset
Offsets = dict[tuple[str, int], int]


def to_json(offsets: Offsets) -> str:
    out: dict[str, dict[str, int]] = {}
    for (topic, partition), offset in sorted(offsets.items()):
        out.setdefault(topic, {})[str(partition)] = offset
    return json.dumps(out)


def from_json(text: str) -> Offsets:
    return {(topic, int(p)): int(o) for topic, parts in json.loads(text).items() for p, o in parts.items()}


def file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Piece:
    """Records of one partition in one row group: first and last offset, and how many."""

    path: str
    group: int
    place: tuple[str, int]
    first: int
    last: int
    rows: int


def pieces_of(fs, path: str) -> list[Piece]:
    import pyarrow.parquet as pq

    found = []
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        names = file.schema_arrow.names
        for g in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(g)
            stats = {n: group.column(names.index(n)).statistics for n in ("topic", "partition", "offset")}
            if all(s is not None and s.has_min_max for s in stats.values()) and all(stats[n].min == stats[n].max for n in ("topic", "partition")):
                found.append(Piece(path, g, (stats["topic"].min, stats["partition"].min), stats["offset"].min, stats["offset"].max, group.num_rows))
            elif group.num_rows:
                told = file.read_row_group(g, ["topic", "partition", "offset"]).group_by(["topic", "partition"])
                for r in told.aggregate([("offset", "min"), ("offset", "max"), ("offset", "count")]).to_pylist():
                    found.append(Piece(path, g, (r["topic"], r["partition"]), r["offset_min"], r["offset_max"], r["offset_count"]))
    return found


class Index:
    """What the log's files hold, by partition; refreshed for new files."""

    def __init__(self, path: str):
        self.fs, self.top = file_system(path)
        self.seen: dict[str, list[Piece]] = {}

    def refresh(self) -> dict[tuple[str, int], list[Piece]]:
        from pyarrow import fs

        hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(self.top) :].split("/"))
        for info in self.fs.get_file_info(fs.FileSelector(self.top, recursive=True, allow_not_found=True)):
            if info.is_file and info.path.endswith(".parquet") and info.path not in self.seen and not hidden(info.path):
                self.seen[info.path] = pieces_of(self.fs, info.path)
        out: dict[tuple[str, int], list[Piece]] = {}
        for piece in (p for pieces in self.seen.values() for p in pieces):
            out.setdefault(piece.place, []).append(piece)
        return {k: sorted(v, key=lambda p: (p.first, p.path, p.group)) for k, v in out.items()}


def ends(index: dict[tuple[str, int], list[Piece]]) -> Offsets:
    return {place: max(p.last for p in pieces) + 1 for place, pieces in index.items()}


def advance(start: Offsets, index: dict[tuple[str, int], list[Piece]], most: int) -> Offsets:
    """The offsets up to which at most so many records lie behind start, shared among partitions by what each has left.

    Offsets that a partition lacks, before the next record that it has, cost nothing.
    """
    last, begin, left = ends(index), {}, {}
    for place, pieces in index.items():
        at = start.get(place, 0)
        nearest = min((max(at, p.first) for p in pieces if p.last >= at), default=last[place])
        begin[place], left[place] = nearest, max(0, last[place] - nearest)
    total = sum(left.values())
    if total <= most:
        return {**start, **last}
    share = {place: most * n // total for place, n in left.items()}
    spare = most - sum(share.values())
    for place in sorted(left, key=lambda k: (-left[k], k)):
        more = min(spare, 1, left[place] - share[place])
        share[place], spare = share[place] + more, spare - more
    return {**start, **{place: begin[place] + n if n else start.get(place, 0) for place, n in share.items()}}


class Range(InputPartition):
    """Records of a row group with offsets from start to before end."""

    def __init__(self, piece: Piece, start: int, end: int):
        super().__init__((piece.path, piece.group))
        self.piece, self.start, self.end = piece, start, end


def ranges(index: dict[tuple[str, int], list[Piece]], start: Offsets, end: Offsets) -> list[Range]:
    out = []
    for place, pieces in sorted(index.items()):
        low, high = start.get(place, 0), end.get(place, 0)
        out += [Range(p, low, high) for p in pieces if p.first < high and p.last >= low]
    return out


def read_range(path: str, part: Range) -> Iterator:
    """Arrow batches of a range's records."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    fs, _ = file_system(path)
    topic, partition = part.piece.place
    with fs.open_input_file(part.piece.path) as f:
        file = pq.ParquetFile(f)
        have = [c for c in COLUMNS if c in file.schema_arrow.names]
        types = {"key": pa.string(), "value": pa.string(), "topic": pa.string(), "partition": pa.int32(), "offset": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
        for b in file.iter_batches(row_groups=[part.piece.group], columns=have):
            rows = pa.Table.from_batches([b])
            keep = pc.and_(pc.equal(rows["topic"], topic), pc.equal(rows["partition"], partition))
            keep = pc.and_(keep, pc.and_(pc.greater_equal(rows["offset"], part.start), pc.less(rows["offset"], part.end)))
            rows = rows.filter(keep)
            cast = lambda c: rows[c].cast(types[c]) if c in have else pa.nulls(rows.num_rows, types[c])  # noqa: B023, E731
            yield from pa.table({c: cast(c) for c in COLUMNS}).to_batches()


def place_of(option: str, index: dict[tuple[str, int], list[Piece]]) -> Offsets:
    return {} if option == "earliest" else ends(index) if option == "latest" else from_json(option)


class TableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        index = Index(self.options["path"]).refresh()
        start, end = place_of(self.options.get("startingOffsets", "earliest"), index), place_of(self.options.get("endingOffsets", "latest"), index)
        return ranges(index, start, end) or [Range(Piece("", 0, ("", 0), 0, 0, 0), 0, 0)]

    def read(self, partition):
        if partition.piece.path:
            yield from read_range(self.options["path"], partition)


def last_offsets(checkpoint: str) -> str | None:
    """The offsets that a stream's checkpoint planned last, as JSON; None of a new stream."""
    from pyarrow import fs as pafs

    fs, top = file_system(checkpoint)
    found = [i.path for i in fs.get_file_info(pafs.FileSelector(f"{top}/offsets", allow_not_found=True)) if i.base_name.isdigit()]
    if not found:
        return None
    with fs.open_input_stream(max(found, key=lambda p: int(p.rsplit("/", 1)[1]))) as f:
        return f.read().decode().strip().splitlines()[-1]


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxOffsetsPerTrigger", RECORDS))
        self.checkpoint, self.start, self.index, self.at = options.get("checkpoint"), options.get("startingOffsets", "earliest"), None, None

    def files(self) -> dict:
        self.index = self.index or Index(self.path)
        return self.index.refresh()

    def initialOffset(self) -> dict:
        return {"offsets": to_json(place_of(self.start, self.files()))}

    def latestOffset(self) -> dict:
        if self.at is None:
            planned = last_offsets(self.checkpoint) if self.checkpoint else None
            self.at = from_json(json.loads(planned)["offsets"]) if planned else from_json(self.initialOffset()["offsets"])
        self.at = advance(self.at, self.files(), self.most)
        return {"offsets": to_json(self.at)}

    def partitions(self, start: dict, end: dict):
        return ranges(self.files(), from_json(start["offsets"]), from_json(end["offsets"]))

    def read(self, partition):
        yield from read_range(self.path, partition)

    def commit(self, end: dict) -> None:
        pass  # the checkpoint keeps the offsets


class OffsetLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TableReader:
        return TableReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known; its code goes to the workers with it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(OffsetLog)


def between(log: DataFrame, start: Offsets, end: Offsets | None = None) -> DataFrame:
    """A table of log rows from start on and, if there are ends, before the end of each partition that has one."""
    of = lambda place: (F.col("topic") == place[0]) & (F.col("partition") == place[1])
    if end is None:
        for place, offset in sorted(start.items()):
            log = log.where(~(of(place) & (F.col("offset") < offset)))
        return log
    kept = F.lit(False)
    for place, offset in sorted(end.items()):
        kept = kept | (of(place) & (F.col("offset") >= start.get(place, 0)) & (F.col("offset") < offset))
    return log.where(kept)
