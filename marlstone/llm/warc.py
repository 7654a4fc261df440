"""WARC archives with a two-level capture index.

Writing: each task appends one gzip member per record to archives of its own in the shared
folder; a file's name holds the task's attempt, so a task that is run again leaves whole
files only. Of records with equal payloads of at least SMALLEST bytes, that with the largest
page_id is a response, and the others are revisits that point to it without payload.

Index: captures are sorted by reversed-host URL key and page_id (so that a hot URL spans
partitions), written as compressed blocks of BLOCK lines; each index file ends in its sparse
block directory, and a list of the files' first keys is the level above. A lookup bisects the
list, then a file's directory, then a block, and reads the record's byte range.

Defined results: null html counts as empty; a null or odd URL gets a key without host; rows
that share the largest page_id are all responses; repeated rows each get a record and a row;
an empty table gives empty archives and results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import batch, file_system, settle, small_batches, table, text_bytes, work_dir

SMALLEST = 1000
#: Lines in a block of the index; bytes after which a task starts another archive; stored bytes that a task reads back.
BLOCK, ARCHIVE_BYTES, READ_BYTES = 3000, 1 << 30, 4 << 20
LEVEL = 3
NO_ID = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
TAIL = "<QI"


def safe(url: str | None) -> str:
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def surt(url: str | None) -> str:
    """com,example,www)/path?query: the key that captures are sorted by."""
    scheme, found, rest = safe(url).partition("://")
    if not found:
        return ")" + scheme
    host = re.match(r"[^/?#]*", rest)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :]


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC record as a gzip member; a revisit has the payload's facts but not the payload."""
    digest, page = hashlib.sha1(payload).hexdigest(), "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}\n{safe(url)}\n{digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {safe(refers_url)}", f"WARC-Refers-To-Page: {refers}",
        ]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and payload."""
    head, _, block = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write a record per row of pages; key, page_id, file, at, size of each, as a table in the shared folder."""
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])

    def run(batches):
        fs, top = file_system(path)
        fs.create_dir(top, recursive=True)
        task, out, name, at, n = TaskContext.get(), None, "", 0, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, refers, refers_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at, n = f"{task.partitionId():05d}-{task.taskAttemptId()}-{n}.warc.gz", 0, n + 1
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    kind = "response" if refers is None or refers == page_id else "revisit"
                    member = record(kind, page_id, url, payload, refers, refers_url)
                    out.write(member)
                    rows.append((surt(url), page_id, name, at, len(member)))
                    at += len(member)
                if rows:
                    yield batch(schema, *(list(c) for c in zip(*rows, strict=True)))
        finally:
            if out:
                out.close()

    html = pages.select("page_id", "url", text_bytes("html").alias("payload"))
    facts = html.select("page_id", "url", F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha2"), F.length("payload").alias("n"))
    largest = F.max(F.struct("page_id", "url")).alias("r")
    groups = facts.where(F.col("n") >= SMALLEST).groupBy("sha1", "sha2", "n").agg(largest, F.count("*").alias("copies")).where("copies > 1")
    known = html.withColumns({"sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256), "n": F.length("payload")}).join(groups, ["sha1", "sha2", "n"], "left")
    small_batches(pages.sparkSession)
    rows = known.select("page_id", "url", "payload", "r.page_id", "r.url").toDF("page_id", "url", "payload", "refers", "refers_url")
    return settle(rows.mapInArrow(run, "key string, page_id long, file string, at long, size long"), "captures")


@dataclass(frozen=True)
class Index:
    """The level above the directories: where archives and index files are, each file's first entry, and the records' bytes."""

    archives: str
    path: str
    files: tuple[tuple[tuple[str, int], str], ...]
    size: int


def write_index(captures: DataFrame, archives: str) -> Index:
    path = f"{archives}/index"

    def run(batches):
        fs, top = file_system(path)
        fs.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.idx"
        out, at, directory, lines = None, 0, [], []

        def flush():
            nonlocal at, lines
            block = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), LEVEL)
            out.write(block)
            directory.append((lines[0][:2], lines[-1][:2], at, len(block)))
            at, lines = at + len(block), []

        for b in batches:
            for key, page_id, *place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                lines.append((key, NO_ID if page_id is None else page_id, *place))
                if len(lines) == BLOCK:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(packed + struct.pack(TAIL, at, len(packed)))
            out.close()
            yield pa.RecordBatch.from_pydict({"key": [directory[0][0][0]], "page_id": [directory[0][0][1]], "file": [name]})

    sorted_ = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "at")
    # one row per index file, not per capture
    files = sorted_.select("key", "page_id", "file", "at", "size").mapInArrow(run, "key string, page_id long, file string").collect()
    size = captures.agg(F.sum("size")).first()[0] or 0
    return Index(archives, path, tuple(sorted(((r.key, r.page_id), r.file) for r in files)), size)


class Reader:
    """Lookups and range reads in one task; keeps a few directories, blocks and payloads."""

    def __init__(self, index: Index):
        self.index = index
        self.fs, self.top = file_system(index.archives)
        self.firsts = [f[0] for f in index.files]
        self.directory = lru_cache(maxsize=64)(self._directory)
        self.block = lru_cache(maxsize=8)(self._block)
        self.file = lru_cache(maxsize=64)(self._file)
        self.payload = lru_cache(maxsize=32)(self._payload)

    def _file(self, name: str):
        return self.fs.open_input_file(f"{self.top}/{name}")

    def _directory(self, name: str) -> list:
        f = self.file(f"index/{name}")
        width = struct.calcsize(TAIL)
        at, size = struct.unpack(TAIL, f.read_at(width, f.size() - width))
        return [(tuple(a), tuple(b), at, n) for a, b, at, n in json.loads(zlib.decompress(f.read_at(size, at)))]

    def _block(self, name: str, at: int, size: int) -> list:
        lines = zlib.decompress(self.file(f"index/{name}").read_at(size, at)).decode().split("\n")
        return [(key, int(i), file, int(at), int(n)) for key, i, file, at, n in (x.split("\t") for x in lines)]

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """file, at, size of each capture of the key and page."""
        wanted = (key, NO_ID if page_id is None else page_id)
        first = max(0, bisect_right(self.firsts, wanted) - 1)
        while first and self.firsts[first] == wanted:  # equal entries may begin in the file before
            first -= 1
        for k in range(first, len(self.index.files)):
            if self.firsts[k] > wanted:
                return
            name = self.index.files[k][1]
            directory = self.directory(name)
            lasts = [d[1] for d in directory]
            start = bisect_right(lasts, wanted)
            while start and lasts[start - 1] == wanted:
                start -= 1
            for low, _, at, size in directory[start:]:
                if low > wanted:
                    break
                lines = self.block(name, at, size)
                i = bisect_right(lines, (*wanted, "", -1, -1))
                while i < len(lines) and lines[i][:2] == wanted:
                    yield lines[i][2:]
                    i += 1

    def read(self, file: str, at: int, size: int) -> tuple[dict[str, str], bytes]:
        return parse(self.file(file).read_at(size, at))

    def _payload(self, url: str, page_id: int, digest: str) -> bytes:
        """The payload that a revisit refers to."""
        for place in self.find(surt(url), page_id):
            headers, payload = self.read(*place)
            if headers["WARC-Payload-Digest"] == digest and headers["WARC-Type"] == "response":
                return payload
        raise LookupError(f"no response of page {page_id}")


def read_back(queries: DataFrame, index: Index) -> DataFrame:
    """Per capture of the distinct (url, page_id) of queries: what its record says and holds."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        reader = Reader(index)
        for b in batches:
            rows = []
            for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for place in reader.find(key, page_id):
                    headers, payload = reader.read(*place)
                    refers = None
                    if headers["WARC-Type"] == "revisit":
                        refers = int(headers["WARC-Refers-To-Page"])
                        payload = reader.payload(headers["WARC-Refers-To-Target-URI"], refers, headers["WARC-Payload-Digest"])
                    rows.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), headers["WARC-Type"], refers))
            if rows:
                yield batch(schema, *(list(c) for c in zip(*rows, strict=True)))

    @F.pandas_udf("string")
    def key(url):
        return url.map(surt)

    wanted = queries.select(key(F.coalesce("url", F.lit(""))).alias("key"), "page_id").distinct()
    # keys are short, but what is read for them is not: the number of tasks follows from the stored bytes
    tasks = max(1, -(-index.size // READ_BYTES))
    wanted = wanted.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return wanted.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = work_dir(spark, "archives")
    return read_back(pages, write_index(write_archives(pages, archives), archives))


QUERIES = {"op6_warc": op6_warc}
SQL = {
    "op6_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS top FROM p)
    SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM g"""
}
