"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared in blocks: a block's bit planes are stored vertically (64
fingerprints to a word), the distances from a fingerprint to all lanes are counted at once by
carry-save bitwise counters, and words of lanes are abandoned once all exceed the radius.

Which fingerprints meet: any two within the radius agree on two of four 16-bit quarters, so a
fingerprint goes to six buckets. Small buckets share blocks; in a bucket over BLOCK fingerprints
the other two quarters are cut likewise, and again, until eight bits are left, so no bucket's
work grows with the square of its size. Of a block the links that span its groups leave, not all
its pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
equal fingerprints are compared once; repeated rows each get their row; null ids never become
a component's id while it has others; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marlstone.llm.common import batch, settle, small_batches, table, text_bytes
from marlstone.llm.components import roots

WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a block.
BLOCK = 2048
#: Hashes counted at once.
SLICE = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else iter([b" ".join(found)])
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), mark (a hash of the text); one row per row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("mark", pa.int64())])

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64)
            yield batch(schema, b.column(0), pa.array(found.view(np.int64)), b.column(1))

    small_batches(docs.sparkSession)
    return docs.select("doc_id", mark_of(text).alias("mark"), text_bytes(text)).mapInArrow(run, "doc_id long, fp long, mark long")


def mark_of(text: str = "text"):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 x words: bit i of word w of plane k is bit k of the value at 64 * w + i."""
    padded = np.zeros(-(-len(values) // 64) * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def check_radius(radius: int) -> None:
    """Buckets and counters hold for the radii 0 to 2 only."""
    if radius not in (0, 1, 2):
        raise ValueError(f"the radius is {radius}, but only 0, 1 and 2 are supported")


def near_pairs(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of all values that differ in at most radius (0 to 2) bits."""
    check_radius(radius)
    n = len(values)
    planes = bit_planes(values)
    width = planes.shape[1]
    full = ~np.uint64(0)
    # lanes up to a value itself, and those past the end, count as exceeded from the start
    lanes = np.arange(width * 64).reshape(width, 64)
    out = (lanes[None] <= np.arange(n)[:, None, None]) | (lanes[None] >= n)
    gone = np.packbits(out.reshape(n, -1), axis=1, bitorder="little").view("<u8").ravel()
    query, word = np.divmod(np.flatnonzero(gone != full), width)
    gone = gone[query * width + word]
    ones, twos = np.zeros_like(gone), np.zeros_like(gone)
    for k in range(64):
        differs = planes[k, word] ^ (np.uint64(0) - (values[query] >> np.uint64(k) & np.uint64(1)))
        carry = ones & differs
        ones ^= differs
        gone |= twos & carry
        twos ^= carry
        if radius < 2:
            gone |= twos if radius else ones | twos
        else:
            gone |= ones & twos
        if k % 4 == 3:
            left = np.flatnonzero(gone != full)
            if not len(left):
                return left, left
            if len(left) < 0.7 * len(gone):
                query, word, gone, ones, twos = query[left], word[left], gone[left], ones[left], twos[left]
    hits = np.unpackbits((~gone).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(hits)
    return query[row], word[row] * 64 + lane


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest that the links a-b reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups within the radius: at most one for each value of the block."""
    values = np.unique(values.view(np.uint64))
    root = spanning(len(values), *near_pairs(values, radius))
    own = np.flatnonzero(root != np.arange(len(values)))
    return values[own].view(np.int64), values[root[own]].view(np.int64)


def finer_keys(rows: DataFrame, width: int) -> DataFrame:
    """fp, key, rest: for each two of the four parts of the rest's width bits a key of those, and the other two as the rest."""
    part = lambda i: F.shiftrightunsigned("rest", width // 4 * i).bitwiseAND((1 << width // 4) - 1)
    found = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        found.append(F.struct(F.xxhash64("key", F.lit(t), part(i), part(j)).alias("key"), F.shiftleft(part(k), width // 4).bitwiseOR(part(m)).alias("rest")))
    return rows.select("fp", F.inline(F.array(*found)))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) that give the same components as all pairs within the radius."""
    check_radius(radius)
    # what differs in two bits at most agrees on two of four equal parts, and so does what is left of it
    large, met = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), None
    for width in (64, 32, 16):
        rows = finer_keys(large, width)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        rows = settle(rows.join(sizes, "key"), "buckets")
        # after the last level eight bits are left: 256 fingerprints at most
        small = (rows if width == 16 else rows.where(F.col("n") <= BLOCK)).select("fp", F.col("key").alias("bucket"))
        met = small if met is None else met.unionByName(small)
        large = rows.where(F.col("n") > BLOCK).select("fp", "key", "rest")
        if large.isEmpty():
            break
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held_fp, held_bucket = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def ready(last: bool):
            """Cut what is held into blocks of whole buckets."""
            nonlocal held_fp, held_bucket
            ends = np.append(np.flatnonzero(np.diff(held_bucket)) + 1, len(held_bucket))
            start, done = 0, len(ends) if last else len(ends) - 1
            for k in range(done):
                if ends[k] - start >= BLOCK or k == done - 1:
                    yield batch(schema, *map(pa.array, block_links(held_fp[start : ends[k]], radius)))
                    start = ends[k]
            held_fp, held_bucket = held_fp[start:], held_bucket[start:]

        for b in batches:
            held_fp = np.append(held_fp, b.column(0).to_numpy())
            held_bucket = np.append(held_bucket, b.column(1).to_numpy())
            if len(held_fp) >= 4 * BLOCK:
                yield from ready(False)
        if len(held_fp):
            yield from ready(True)

    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fp and other columns) with component_id, the smallest doc_id reachable, itself
    included, and root, the component's smallest fingerprint."""
    prints = settle(prints, "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    root = roots(links(distinct.select("fp"), radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    component = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return prints.join(component, "fp")


def near_deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component that with the smallest doc_id.

    Rows with the same doc_id and text count as one row; deduplicate exactly before.
    """
    return without_copies(docs, settle(near_components(fingerprints(docs), radius).select("doc_id", "mark", "root"), "near-components"))


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that come first in their component. found: doc_id, mark and root of each row, settled."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = found.groupBy("root").agg(F.min(rank).alias("first"))
    rest = found.join(first, "root").where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))))
    rest = rest.select(F.col("doc_id").alias("gone"), "mark").distinct()
    return docs.join(rest, docs["doc_id"].eqNullSafe(rest["gone"]) & (mark_of() == rest["mark"]), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(fingerprints(table(spark, sf_dir, "documents")).drop("mark"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
