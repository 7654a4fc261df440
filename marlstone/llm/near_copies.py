"""SimHash for near copies: five-word shingles with a Jaccard similarity of at least 0.8.

A text's fingerprint has BITS bits of SimHash over its set of shingles. Fingerprints are compared
as in `simhash`, in blocks of vertical bit planes: carry-save counters hold the distances from a
fingerprint to 64 lanes at once, and words of lanes are abandoned once all exceed the radius. At
this similarity that is RADIUS bits, too wide for equal parts of fingerprints to find all pairs,
so texts meet in buckets of banded minima of their shingles' hashes.

* A bucket's pivot, the text that shares buckets with most others, is compared with each of its
  texts, in parts of BLOCK, so a large group of copies costs work in proportion to its size.
* What the pivot did not join is compared with the rest of the bucket, in pairs of parts. Texts
  that are joined already are not compared.
* The similarity of a pair within the radius is computed from the two sets of shingles, nearest
  first, unless a good link has joined the two texts already. A block emits its good links, which
  are a spanning forest, not its pairs.

So of the pairs that share a bucket and are within the radius none is lost: a pair at 0.8 shares
no bucket with a probability of 7e-5 and is beyond the radius with one of 1e-5.

A 64-bit hash stands for a shingle, and one for a set of shingles. A text of fewer words than a shingle is one shingle,
and texts with no word (or null) are alike; A to Z are folded; extra columns go through.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marlstone.llm.common import batch, settle, small_batches, text_bytes
from marlstone.llm.components import roots
from marlstone.llm.simhash import mark_of, without_copies

WORDS, LEAST, SEED = 5, 0.8, 42
#: At 0.8 fingerprints differ in 78 bits on average, with a standard deviation of 8.
BITS, RADIUS = 512, 114
BANDS, DEPTH = 24, 5
RNG = np.random.default_rng(SEED)
FACTORS = RNG.integers(0, 1 << 31, BANDS * DEPTH, dtype=np.uint32) * 2 + 1
SPREAD = RNG.integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts in a part of a bucket, shingles taken at once, planes between two looks at the radius, and bytes held.
BLOCK, SLICE, STEP, HELD = 512, 1 << 12, 32, 64 << 20
FULL = ~np.uint64(0)


def shingles(text: bytes, words: int = WORDS) -> set[bytes]:
    found = text.lower().split()
    if len(found) < words:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))


def hashed(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    found = shingles(text)
    return np.sort(np.fromiter(map(xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repetitions."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signature(text: bytes) -> tuple[int, list[int], bytes]:
    """Of a text's shingles: a hash of the set, one key a band, and the fingerprint."""
    hashes = hashed(text)
    low = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    ones = np.zeros(BITS, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), SLICE):
        np.minimum(low, (FACTORS[:, None] * short[None, at : at + SLICE]).min(axis=1), out=low)
        mixed = hashes[at : at + SLICE, None] * SPREAD
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    rows = low.astype("<u4").reshape(BANDS, DEPTH)
    keys = [xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]
    return xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED), keys, np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark, sid (the hash of the set), keys, fp; one row per row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("sid", pa.int64()), ("keys", pa.list_(pa.int64())), ("fp", pa.binary())])

    def run(batches):
        for b in batches:
            found = [signature(t.as_py()) for t in b.column(2)]
            keys = [np.array(k, np.uint64).view(np.int64) for _, k, _ in found]
            yield batch(schema, b.column(0), b.column(1), np.array([s for s, _, _ in found], np.uint64).view(np.int64), pa.array(keys, pa.list_(pa.int64())), [f for _, _, f in found])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", mark_of().alias("mark"), text_bytes()).mapInArrow(run, "doc_id long, mark long, sid long, keys array<long>, fp binary")


def beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose count is over the radius."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def near_lanes(prints: np.ndarray, query: np.ndarray, stop: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, distance: the lanes j from i + 1 to before stop that are within the radius of the query i.

    prints: rows of bytes; query: rows' numbers, each with its stop.
    """
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    padded = np.zeros((-(-len(bits) // 64) * 64, bits.shape[1]), np.uint8)
    padded[: len(bits)] = bits
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view("<u8")
    some = query + 1 < stop
    query, stop = query[some], stop[some]
    first = (query + 1) // 64
    words = (stop - 1) // 64 - first + 1
    row = np.repeat(np.arange(len(query)), words)
    word = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words) + first[row]
    low = np.maximum(query[row] + 1 - 64 * word, 0).astype(np.uint64)
    high = np.minimum(stop[row] - 64 * word, 64).astype(np.uint64)
    gone = ~((FULL << low) & (FULL >> (np.uint64(64) - high)))
    query = query[row]
    counters = [np.zeros_like(gone) for _ in range(radius.bit_length())]
    for k in range(bits.shape[1]):
        carry = planes[k, word] ^ (np.uint64(0) - bits[query, k].astype(np.uint64))
        for c in counters:
            up = c & carry
            c ^= carry
            carry = up
        gone |= carry
        if k % STEP == STEP - 1:
            gone |= beyond(counters, radius)
            left = np.flatnonzero(gone != FULL)
            if len(left) < 0.7 * len(gone):
                query, word, gone, counters = query[left], word[left], gone[left], [c[left] for c in counters]
    gone |= beyond(counters, radius)
    row, lane = np.nonzero(np.unpackbits((~gone).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    distance = sum(((c[row] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k, c in enumerate(counters))
    return query[row], word[row] * 64 + lane, distance


def pairs_in_buckets(bucket: np.ndarray, root: np.ndarray, queries: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """i, j: rows of a bucket within the radius whose roots differ, nearest first; i is a query.

    Rows in order of bucket, queries first.
    """
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
    query = np.flatnonzero(queries)
    i, j, distance = near_lanes(prints, query, ends[np.searchsorted(ends, query, side="right")])
    apart = np.flatnonzero(root[i] != root[j])
    order = apart[np.lexsort((j[apart], i[apart], distance[apart]))]
    return i[order], j[order]


def good_links(bucket: np.ndarray, sid: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Of the pairs i, j those that are alike and join two groups of their bucket."""
    # one vertex for each bucket and root
    _, vertex = np.unique(np.stack([bucket, root]), axis=1, return_inverse=True)
    vertex, parent, known, out = vertex.reshape(-1).tolist(), list(range(len(sid))), {}, []

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    names = sid.tolist()
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if (v := find(vertex[x])) != (w := find(vertex[y])):
            pair = (min(names[x], names[y]), max(names[x], names[y]))
            if pair not in known:
                known[pair] = jaccard(sets[x], sets[y]) >= least
            if known[pair]:
                parent[v] = w
                out.append(pair)
    return sorted(set(out))


def compared(rows: DataFrame, least: float | None = None) -> DataFrame:
    """a, b: links between the rows of a bucket. rows: bucket, sid, root, query, fp.

    With least, and the column hashes of the rows, the links are alike by that much; without, they
    are within the radius.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(held: pa.Table):
        bucket, sid, root = (held[c].to_numpy() for c in ("bucket", "sid", "root"))
        prints = np.frombuffer(b"".join(held["fp"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
        i, j = pairs_in_buckets(bucket, root, held["query"].to_numpy(zero_copy_only=False), prints)
        if least is None:
            a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
            return batch(schema, pa.array(a), pa.array(b))
        sets = [np.frombuffer(h.as_py(), "<u8") for h in held["hashes"]]
        found = good_links(bucket, sid, root, i, j, sets, least)
        return batch(schema, [a for a, _ in found], [b for _, b in found])

    def run(batches):
        held = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) >= 4 * BLOCK or sum(t.nbytes for t in held) >= HELD:
                rows = pa.concat_tables(held)
                bucket = rows["bucket"].to_numpy()
                # the last bucket may go on in the next batch
                whole = int(np.searchsorted(bucket, bucket[-1]))
                if whole:
                    yield links(rows.slice(0, whole))
                held = [rows.slice(whole)]
        if held and (rows := pa.concat_tables(held)).num_rows:
            yield links(rows)

    small_batches(rows.sparkSession)
    rows = rows.select("bucket", "sid", "root", "query", "fp", *(["hashes"] if least is not None else []))
    return rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("query"), "sid").mapInArrow(run, "a long, b long").distinct()


def hash_sets(texts: DataFrame) -> DataFrame:
    """sid, hashes of texts (sid, text)."""
    schema = pa.schema([("sid", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column(0), [hashed(t.as_py()).astype("<u8").tobytes() for t in b.column(1)])

    small_batches(texts.sparkSession)
    return texts.select("sid", text_bytes()).mapInArrow(run, "sid long, hashes binary")


def alike(links: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The links whose sets (sid, hashes) have at least that similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(h.as_py(), "<u8") for h in b.column(k)] for k in (2, 3))
            yield batch(schema, *b.columns[:2]).filter(pa.array([jaccard(p, q) >= least for p, q in zip(x, y, strict=True)], pa.bool_()))

    small_batches(links.sparkSession)
    of = lambda name, value: sets.select(F.col("sid").alias(name), F.col("hashes").alias(value))
    return links.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def parts_of(n):
    return F.ceil(n / BLOCK)


def pivot_blocks(met: DataFrame) -> DataFrame:
    """bucket, sid, query: the texts of each key in parts, each part with the key's pivot. met: sid, key, n."""
    company = met.groupBy("sid").agg(F.sum("n").alias("company"))
    pivots = met.join(company, "sid").groupBy("key", "n").agg(F.max_by("sid", F.struct("company", "sid")).alias("sid"))
    lanes = met.select("key", F.pmod(F.xxhash64("sid"), parts_of(F.col("n"))).alias("part"), "sid", F.lit(False).alias("query"))
    queries = pivots.select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts_of(F.col("n")) - 1)).alias("part"), "sid", F.lit(True).alias("query"))
    return lanes.unionByName(queries).select(F.xxhash64("key", "part").alias("bucket"), "sid", "query")


def rest_blocks(met: DataFrame, root: DataFrame) -> DataFrame:
    """bucket, sid, query: of the keys that hold several roots, what is not of the largest one against all."""
    rows = met.join(root, "sid", "left").select("sid", "key", F.coalesce("root", "sid").alias("root"))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("n")).where("n > most")
    few, many = parts_of(F.col("n") - F.col("most")), parts_of(F.col("most"))
    rows = rows.join(keys, "key").withColumns({"few": few, "many": many, "hash": F.xxhash64("sid")})
    below = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")
    apart = rows.where("root <> main").select("key", "sid", F.pmod("hash", "few").alias("part"), below(F.col("few") + F.col("many")))
    main = rows.where("root = main").select("key", "sid", (F.col("few") + F.pmod("hash", "many")).alias("part"), below(F.col("few")))
    bucket = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"), F.lit(1))
    return apart.unionByName(main).select(bucket.alias("bucket"), "sid", (F.col("part") <= F.col("other")).alias("query"))


def root_of(links: DataFrame) -> DataFrame:
    return roots(links.select("a", "b")).select(F.col("a").alias("sid"), F.col("b").alias("root"))


def near_roots(docs: DataFrame, prints: DataFrame, least: float = LEAST) -> DataFrame:
    """sid, root of the sets of shingles that are not their group's smallest. prints: the settled signatures of docs."""
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("row")
    distinct = settle(prints.groupBy("sid").agg(least_row, F.first("keys").alias("keys"), F.first("fp").alias("fp")), "distinct-signatures")
    rows = distinct.select("sid", F.explode("keys").alias("key"))
    met = settle(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared-buckets")
    ends = met.select("sid").distinct().join(distinct, "sid").select("sid", F.col("row.doc_id").alias("of"), F.col("row.mark").alias("mark"))
    texts = docs.select("doc_id", mark_of().alias("mark"), "text").join(ends, "mark").where(F.col("doc_id").eqNullSafe(F.col("of")))
    sets = settle(hash_sets(texts.select("sid", "text").dropDuplicates(["sid"])), "hash-sets")
    prints = distinct.select("sid", "fp")
    stars = pivot_blocks(met).join(prints, "sid").withColumn("root", F.col("sid"))
    good = settle(alike(settle(compared(stars), "pivot-links"), sets, least), "pivot-good")
    root = root_of(good)
    rest = settle(rest_blocks(met, root), "rest-blocks").join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    more = settle(compared(rest.join(prints, "sid").join(sets, "sid"), least), "rest-good")
    return root_of(good.unionByName(more))


def deduplicate(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies that with the smallest doc_id.

    Groups are connected by links of at least that similarity. Rows with the same doc_id and
    text count as one row; deduplicate exactly before. An empty table gives an empty result.
    """
    prints = settle(signatures(docs), "signatures")
    root = near_roots(docs, prints, least)
    found = prints.select("doc_id", "mark", "sid").join(root, "sid", "left").select("doc_id", "mark", F.coalesce("root", "sid").alias("root"))
    return without_copies(docs, settle(found, "near-components"))
