"""Exact deduplication by Grace hash partitioning with complete comparison of contents.

1. Each map task folds the equal texts of a window of rows into one local group, so that a
   group of copies that holds a third of all rows crosses the shuffle once per window.
2. The local groups' texts are dealt out by content hash. A task reads its share into an
   open-addressing table that compares complete contents; what does not fit its budget goes
   to spill files by further hash bits, and each file is treated the same way in turn.
3. The members join their group by its local number, so no join key is hot.

Defined results: null text counts as empty; texts are equal when identical after replacing
each run of ASCII white space by one space; the row with the smallest doc_id stays (null ids
last, among repeated rows the first); an empty table gives an empty result; extra columns of
any name pass through deduplicate() unchanged.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marlstone.llm.common import batch, scratch, settle, small_batches, table

#: Bytes of text in one window of a map task, rows in it, and bytes of distinct texts in a hash table.
WINDOW_BYTES, WINDOW_ROWS, TABLE_BYTES = 24 << 20, 100_000, 48 << 20
FANOUT = 16
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
HEAD = struct.Struct("<?qqqI")


def normalise(text: bytes | None) -> bytes:
    text = (text or b"").translate(BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class ContentTable:
    """Open addressing with linear probing; two contents are one only if all their bytes agree."""

    def __init__(self):
        self.slots, self.hashes, self.contents, self.held = [-1] * 1024, [], [], 0

    def find(self, key: int, content: bytes) -> int:
        """The content's number, or -1 less the free slot where it would go."""
        mask = len(self.slots) - 1
        at = key & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == key and self.contents[i] == content:
                return i
            at = (at + 1) & mask
        return -1 - at

    def add(self, key: int, content: bytes, free: int) -> int:
        self.slots[-1 - free] = i = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.held += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for n, k in enumerate(self.hashes):
                at = k & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = n
        return i


def first_of(doc_id: int | None, local: int) -> tuple:
    return (doc_id is None, doc_id or 0, local)


Row = tuple[int | None, int, int, bytes]  # doc_id, local group, its rows, content


def grace(rows: Iterable[Row], folder: str, budget: int = TABLE_BYTES, depth: int = 0) -> Iterator[tuple[bytes, list[int], int | None, int, int]]:
    """Per distinct content: content, its local groups, the smallest doc_id, the local group that has it, rows."""
    known, groups, files = ContentTable(), [], {}
    try:
        for doc_id, local, n, content in rows:
            key = xxh64_intdigest(content, depth)
            i = known.find(key, content)
            if i < 0 and (known.held + len(content) <= budget or not known.contents):
                i = known.add(key, content, i)
                groups.append([[], first_of(doc_id, local), 0])
            if i >= 0:
                g = groups[i]
                g[0].append(local)
                g[1] = min(g[1], first_of(doc_id, local))
                g[2] += n
                continue
            part = key >> 40 & (FANOUT - 1)
            if part not in files:
                files[part] = open(os.path.join(folder, f"{depth}-{part}-{os.urandom(4).hex()}"), "w+b")  # noqa: SIM115
            files[part].write(HEAD.pack(doc_id is None, doc_id or 0, local, n, len(content)) + content)
        for content, (locals_, (absent, low, local), n) in zip(known.contents, groups, strict=True):
            yield content, locals_, None if absent else low, local, n
        del known, groups
        for f in files.values():
            f.seek(0)
            yield from grace(spilled(f), folder, budget, depth + 1)
            f.close()
            os.unlink(f.name)
    finally:
        for f in files.values():
            f.close()


def spilled(f) -> Iterator[Row]:
    while head := f.read(HEAD.size):
        absent, low, local, n, size = HEAD.unpack(head)
        yield None if absent else low, local, n, f.read(size)


def fold_window(batches: list[pa.RecordBatch], first_local: int) -> tuple[pa.RecordBatch, int]:
    """A window's rows with their local group; of a group's rows only the first keeps its text."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    known, number, firsts, counts = ContentTable(), [], [], []
    ids = rows["doc_id"].to_pylist()
    for at, (doc_id, text) in enumerate(zip(ids, rows["text"], strict=True)):
        content = normalise(text.as_py())
        key = xxh64_intdigest(content)
        if (i := known.find(key, content)) < 0:
            i = known.add(key, content, i)
            firsts.append(at)
            counts.append(0)
        elif first_of(doc_id, at) < first_of(ids[firsts[i]], firsts[i]):
            firsts[i] = at
        counts[i] += 1
        number.append(i)
    kept = set(firsts)
    first = [at in kept for at in range(len(ids))]
    chunk = lambda name: rows[name].chunk(0) if rows.num_rows else pa.array([], rows.schema.field(name).type)
    text = pc.if_else(pa.array(first), chunk("text"), pa.scalar(None, pa.binary()))
    keys = [known.hashes[i] - (1 << 63) if f else 0 for f, i in zip(first, number, strict=True)]
    out = pa.RecordBatch.from_arrays(
        [chunk("doc_id"), text, chunk("rest"), pa.array([first_local + i for i in number], pa.int64()), pa.array(first)]
        + [pa.array([counts[i] if f else 0 for f, i in zip(first, number, strict=True)], pa.int64()), pa.array(keys, pa.int64())],
        names=["doc_id", "text", "rest", "local", "first", "n", "hash"],
    )
    return out, first_local + len(firsts)


def local_groups(docs: DataFrame) -> DataFrame:
    """Step 1, written to the shared folder: doc_id, text (of a local group's first row), rest, local, first, n, hash."""
    def run(batches):
        local, held, size, rows = TaskContext.get().partitionId() << 36, [], 0, 0
        for b in batches:
            held.append(b)
            size, rows = size + b.nbytes, rows + b.num_rows
            if size >= WINDOW_BYTES or rows >= WINDOW_ROWS:
                out, local = fold_window(held, local)
                held, size, rows = [], 0, 0
                yield out
        if rows:
            yield fold_window(held, local)[0]

    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.struct(*(rest or [F.lit(0).alias("none")])).alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()
    return settle(rows.mapInArrow(run, f"doc_id long, text binary, rest {kind}, local long, first boolean, n long, hash long"), "dedup-local")


def resolve(groups: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """Step 2: local, keep_id, keep_local, group_size, text_sha256; one row per local group."""
    schema = pa.schema([("local", pa.int64()), ("keep_id", pa.int64()), ("keep_local", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def rows(batches):
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), map(normalise, b.column(3).to_pylist()), strict=True)

    def run(batches):
        with scratch() as folder:
            out = []
            for content, locals_, low, keep, n in grace(rows(batches), folder, budget):
                digest = hashlib.sha256(content).hexdigest()
                out += [(local, low, keep, n, digest) for local in locals_]
                if len(out) >= 10_000:
                    yield batch(schema, *(list(c) for c in zip(*out, strict=True)))
                    out = []
            if out:
                yield batch(schema, *(list(c) for c in zip(*out, strict=True)))

    firsts = groups.where("first").select("doc_id", "local", "n", "text", "hash").repartition("hash")
    return firsts.drop("hash").mapInArrow(run, "local long, keep_id long, keep_local long, group_size long, text_sha256 string")


def duplicates(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = local_groups(docs.select("doc_id", "text"))
    found = resolve(groups, budget)
    kept = (F.col("first") & (F.col("local") == F.col("keep_local"))).alias("kept")
    return groups.select("doc_id", "local", "first").join(found, "local").select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def deduplicate(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    groups = local_groups(docs)
    winners = resolve(groups, budget).where("local = keep_local").select("local")
    rows = groups.where("first").join(winners, "local", "left_semi")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text").cast("string").alias("text")}
    return rows.select(*(own[c] if c in own else F.col(f"rest.`{c}`") for c in docs.columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: the normalised text is the partition key, so contents are compared completely.
NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
SQL = {
    "op3_exact_dedup": f"""
    WITH t AS (SELECT doc_id, {NORMALISED} AS norm FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)"""
}
