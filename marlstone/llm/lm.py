"""Perplexity under an interpolated modified Kneser-Ney n-gram model counted in Spark.

Documents are tokenised into chunks of bounded size, each a file in the shared folder. Level by
level, from the n-grams down to single words, a chunk asks the shards of the model (equal ranges
of hashes) about the distinct grams that it holds, each once:

1. ask: per shard the chunk's sorted gram hashes with what the chunk adds to the gram's facts.
   For n-grams that is the count in training texts; below, it follows from the longer grams that
   the chunk owns: one chunk owns each gram that occurs in training.
2. answer: a shard's facts are added up and stored as a sorted hash array in the model's folder;
   the worker maps the stored array into memory and looks the chunks' grams up in it.
3. After the last level a chunk has the facts of all its grams, and sums its tokens'
   probabilities by document.

Equal grams of a chunk are folded before they are shuffled, and shards are ranges of hashes, so
neither frequent words nor frequent grams make a large task. Chunks and shards have a bounded
size, so their numbers grow with the input; a chunk writes a message for each shard, so messages
grow with the square of it (a message has about 400 grams at 30 GB, and 10 at 1 TB). Answers are settled
at each level; a lost executor repeats a level at most. A word's and a gram's identity is a
64-bit hash.

Defined results: null text counts as empty and has the end token alone; repeated rows each
get their row; unknown words get the share of one word more than the vocabulary; without
training documents all probabilities are uniform; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marlstone.llm.common import batch, crc_mod, discard, file_system, scratch, settle, small_batches, table, text_bytes, work_dir

ORDER = 3
#: Tokens of a chunk, and of all chunks for each shard of the model.
CHUNK, SHARD = 2_000_000, 2_000_000
#: No word has a space, so these are no word's hashes.
END, BEGIN = xxh64_intdigest(b" end"), xxh64_intdigest(b" begin")
U8, U32, U64 = np.dtype("u1"), np.dtype("<u4"), np.dtype("<u8")

CHUNKS = "chunk long, file string, tokens long"
MESSAGES = "chunk long, file string, level int, shard int, payload binary, totals array<long>"
SCHEMA = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary()), ("totals", pa.list_(pa.int64()))])
#: Facts of a gram shorter than the longest: how many words come before it, the sum of its
#: followers' facts, and how many followers have 1, 2 or more of that. A word has its count
#: before these, and the longest grams have their count alone.
BEFORE, SUM, ONCE, TWICE, MORE = range(5)


# Bytes ------------------------------------------------------------------------------------


def planes(values: np.ndarray, dtype: np.dtype) -> bytes:
    """Byte by byte instead of value by value: what is small or sorted then compresses well."""
    return np.ascontiguousarray(values, dtype).view(np.uint8).reshape(-1, dtype.itemsize).T.tobytes()


def unplane(data: bytes, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def rising(values: np.ndarray) -> bytes:
    """A sorted array as differences."""
    return planes(np.diff(values, prepend=np.zeros(1, U64)), U64)


def unrising(data: bytes) -> np.ndarray:
    return np.cumsum(unplane(data, U64), dtype=U64)


def dump(*blobs: bytes) -> bytes:
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(b) for b in blobs]
    return struct.pack(f"<{len(packed) + 1}I", len(packed), *map(len, packed)) + b"".join(packed)


def load(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    sizes, at, out, unpacker = struct.unpack_from(f"<{n}I", data, 4), 4 * n + 4, [], zstandard.ZstdDecompressor()
    for size in sizes:
        out.append(unpacker.decompress(data[at : at + size]))
        at += size
    return out


def small_and_large(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as single bytes; where that is 255, the place and the 64-bit count are apart."""
    at = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(U8), at.astype(U64), values[at].astype(U64)


def counts_bytes(values: np.ndarray) -> tuple[bytes, bytes]:
    small, _, large = small_and_large(values)
    return small.tobytes(), planes(large, U64)


def counts_from(small: bytes, large: bytes) -> np.ndarray:
    values = np.frombuffer(small, U8).astype(U64)
    values[values == 255] = unplane(large, U64)
    return values


# Grams of a chunk -------------------------------------------------------------------------


def gram_hash(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = prefix * np.uint64(0x9E3779B97F4A7C15) + word
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def slices(values: np.ndarray, shards: int) -> list[slice]:
    """Where each shard's range of a sorted array of hashes is."""
    bounds = np.array([(s << 64) // shards for s in range(1, shards)], U64)
    at = [0, *np.searchsorted(values, bounds).tolist(), len(values)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


class Numbers(dict):
    """Word -> its number, by first occurrence; the first two are those of the end and the beginning."""

    def __missing__(self, word):
        self[word] = n = len(self) + 2
        return n


class Level:
    """The distinct grams of one length: hashes in order, each place's gram, and one place of each gram."""

    def __init__(self, at_place: np.ndarray):
        order = np.argsort(at_place)
        ordered = at_place[order]
        new = np.diff(ordered, prepend=~ordered[:1]) != 0
        self.hashes, self.place = ordered[new], order[new]
        self.gram = np.empty(len(order), np.int32)
        self.gram[order] = np.cumsum(new, dtype=np.int32) - 1


class Chunk:
    """Documents as numbers of words, and the grams of each length that end at their places.

    Before each document stand order - 1 beginnings, so that each of its tokens ends a gram of
    the full length. Grams that span two documents end at those places only, and are never
    counted.
    """

    def __init__(self, order: int, ids: np.ndarray, flags: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, hashes: np.ndarray):
        self.ids, self.missing, self.held = ids, (flags & 2).astype(bool), (flags & 1).astype(bool)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        document = np.repeat(np.arange(len(lengths)), lengths)
        self.places = np.arange(len(tokens)) + (order - 1) * (document + 1)
        self.trained = self.places[~self.held[document]]
        words = np.full(len(tokens) + (order - 1) * len(lengths), BEGIN, U64)
        words[self.places] = hashes[tokens]
        self.words, self.found = words, {}

    def level(self, n: int) -> Level:
        """Made when it is first asked for: a step needs one or two lengths."""
        if n not in self.found:
            grams = self.words
            for _ in range(1, n):
                grams = gram_hash(np.append(U64.type(0), grams[:-1]), self.words)
            self.found[n] = Level(grams)
        return self.found[n]

    def counts(self, n: int) -> np.ndarray:
        """How often each gram of n words occurs in training."""
        return np.bincount(self.level(n).gram[self.trained], minlength=len(self.level(n).hashes))

    def prefix(self, n: int) -> np.ndarray:
        """For each gram of n words that of n - 1 words that it begins with."""
        return self.level(n - 1).gram[np.maximum(self.level(n).place - 1, 0)]

    def suffix(self, n: int) -> np.ndarray:
        return self.level(n - 1).gram[self.level(n).place]

    def lower_facts(self, n: int, values: np.ndarray, owned: np.ndarray) -> list[np.ndarray]:
        """What the owned grams of n + 1 words, with these values, say of those of n words."""
        size = len(self.level(n).hashes)
        before, value = self.prefix(n + 1)[owned], values[owned]
        count = lambda at: np.bincount(at, minlength=size)
        total = np.zeros(size, U64)
        np.add.at(total, before, value)
        return [*([self.counts(1)] if n == 1 else []), count(self.suffix(n + 1)[owned]), total, count(before[value == 1]), count(before[value == 2]), count(before[value > 2])]


def write_chunks(docs: DataFrame, held: Column, folder: str, text: str = "text") -> DataFrame:
    """A file for each chunk of documents: chunk, file, tokens."""
    schema = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("tokens", pa.int64())])

    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        task = TaskContext.get()
        chunk, size, state = task.partitionId() << 32, 0, ([], [], [], [], Numbers())

        def flush():
            ids, flags, lengths, tokens, numbers = state
            hashes = np.array([END, BEGIN, *map(xxh64_intdigest, numbers)], U64)
            name = f"{chunk}-{task.taskAttemptId()}.chunk"
            with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(dump(planes(np.array(ids, np.int64), U64), np.array(flags, U8).tobytes(), planes(np.array(lengths), U32), planes(np.concatenate(tokens), U32), hashes.tobytes()))
            return batch(schema, [chunk], [name], [size])

        for b in batches:
            for doc_id, held_out, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = data.lower().split()
                ids, flags, lengths, tokens, numbers = state
                ids.append(doc_id or 0)
                flags.append(held_out | 2 * (doc_id is None))
                lengths.append(len(words) + 1)
                found = np.zeros(len(words) + 1, U32)
                found[:-1] = np.fromiter(map(numbers.__getitem__, words), U32, len(words))
                tokens.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield flush()
                    chunk, size, state = chunk + 1, 0, ([], [], [], [], Numbers())
        if size:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", held.alias("held"), text_bytes(text).alias("text")).mapInArrow(run, CHUNKS)


def read_chunk(folder: str, name: str, order: int) -> Chunk:
    fs, top = file_system(folder)
    with fs.open_input_file(f"{top}/{name}") as f:
        ids, flags, lengths, tokens, hashes = load(f.read())
    return Chunk(order, unplane(ids, U64).view(np.int64), np.frombuffer(flags, U8), unplane(lengths, U32).astype(np.int64), unplane(tokens, U32), np.frombuffer(hashes, U64))


# Messages ---------------------------------------------------------------------------------


def message(chunk: int, file: str | None, level: int, shard: int, payload: bytes | None, totals: list[int] | None = None) -> pa.RecordBatch:
    return batch(SCHEMA, [chunk], [file], [level], [shard], [payload], [totals])


def runs(batches, key: int) -> Iterator[list[tuple]]:
    """The rows of consecutive batches as lists with the same value in the column key."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def questions(chunk: int, file: str, level: int, hashes: np.ndarray, facts: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    for s, part in enumerate(slices(hashes, shards)):
        if part.stop > part.start:
            yield message(chunk, file, level, s, dump(rising(hashes[part]), *(x for f in facts for x in counts_bytes(f[part]))))


def facts_told(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Facts and ownership of a chunk's grams, from the answers in the order of shards."""
    columns, owned = [], []
    for data in payloads:
        own, *facts = load(data)
        found = [counts_from(*facts[k : k + 2]) for k in range(0, len(facts), 2)]
        columns.append(found)
        owned.append(np.unpackbits(np.frombuffer(own, U8), count=len(found[0])).astype(bool))
    return [np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate(owned)


class StoredShard:
    """A shard of the model: a sorted hash array and its facts, mapped from files.

    The array is kept as starts, where each value of the upper 24 bits from that of the first
    hash begins, and the other bits as low (32 of them) and middle (8). small has a byte for
    each fact; where that is 255, large has the count, and large_at its place.
    """

    NAMES = ("starts", "low", "middle", "small", "large_at", "large")
    UPPER = np.uint64(40)

    def __init__(self, folder: str, name: str, local: str):
        fs, top = file_system(folder)
        for part in self.NAMES:
            path = f"{top}/{name}.{part}.npy"
            if fs.type_name != "local":
                path, source = f"{local}/{name}.{part}.npy", path
                with fs.open_input_stream(source, compression=None) as f, open(path, "wb") as out:
                    out.writelines(iter(lambda: f.read(1 << 22), b""))  # noqa: B023
            setattr(self, part, np.load(path, mmap_mode="r"))
        base, starts = self.starts[0], self.starts[1:].astype(np.int64)
        upper = np.repeat(np.arange(len(starts) - 1, dtype=U64) + base, np.diff(starts))
        self.hashes = upper << self.UPPER | self.middle.astype(U64) << U64.type(32) | self.low

    @classmethod
    def store(cls, folder: str, name: str, hashes: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        places = [at + U64.type(k * len(hashes)) for k, (_, at, _) in enumerate(columns)]
        upper = hashes >> cls.UPPER
        starts = np.searchsorted(upper, np.arange(upper[0], upper[-1] + U64.type(2), dtype=U64)).astype(U64)
        arrays = (np.append(upper[:1], starts), hashes.astype(U32), (hashes >> U64.type(32)).astype(U8), np.stack([c[0] for c in columns]), np.concatenate(places), np.concatenate([c[2] for c in columns]))
        for part, values in zip(cls.NAMES, arrays, strict=True):
            with fs.open_output_stream(f"{top}/{name}.{part}.npy", compression=None) as out:
                np.lib.format.write_array(out, values)

    def facts(self, grams: np.ndarray) -> list[np.ndarray]:
        """The facts of sorted grams; all 0 of those that the shard does not have."""
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        unknown, out = self.hashes[at] != grams, []
        for k, small in enumerate(self.small):
            values = small[at].astype(U64)
            large = np.flatnonzero(values == 255)
            values[large] = self.large[np.searchsorted(self.large_at, at[large].astype(U64) + U64.type(k * len(self.hashes)))]
            values[unknown] = 0
            out.append(values)
        return out


def frequencies(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, 3, 4, over 0, and their sum."""
    return [*(int((values == k).sum()) for k in (1, 2, 3, 4)), int((values > 0).sum()), int(values.sum(dtype=U64))]


def answer_shard(rows: list[tuple], folder: str) -> Iterator[pa.RecordBatch]:
    """Add up and store a shard's facts, then answer the chunks' questions from the stored arrays.

    The first fact of a gram (the second one of a word) is what the gram counts for.
    """
    level, shard = rows[0][2:4]
    name = f"{shard:08d}-{TaskContext.get().taskAttemptId()}"
    asked = [load(r[4]) for r in rows]
    hashes = np.concatenate([unrising(a[0]) for a in asked])
    order = np.argsort(hashes, kind="stable")  # the questions are sorted runs
    first = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    distinct, asker = hashes[order[first]], order[first]
    columns, totals = [], []
    for k in range(1, len(asked[0]), 2):
        sums = np.add.reduceat(np.concatenate([counts_from(*a[k : k + 2]) for a in asked])[order], first)
        columns.append(small_and_large(sums))
        if level == 1 and k == 1:
            totals = frequencies(sums)
        elif k <= 3 and (k == 1 or level == 1):  # what the discounts of this level are of
            value = sums
    owned = np.zeros(len(hashes), bool)
    owned[asker[value > 0]] = True
    del hashes, order
    StoredShard.store(folder, name, distinct, columns)
    yield message(-1, None, level, shard, None, frequencies(value) + totals)
    del distinct, columns, sums, value
    with scratch() as local:
        stored, at = StoredShard(folder, name, local), 0
        for (chunk, file, *_), a in zip(rows, asked, strict=True):
            grams = unrising(a[0])
            facts = stored.facts(grams)
            yield message(chunk, file, level, shard, dump(np.packbits(owned[at : at + len(grams)]).tobytes(), *(x for f in facts for x in counts_bytes(f))))
            at += len(grams)
        del stored


# Scores -----------------------------------------------------------------------------------


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and over 2, from how many counts are 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in counts[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        found.append(min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) if a and y else 0.5 * k)
    return np.array(found)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_chunk(chunk: Chunk, order: int, told: dict[int, list[np.ndarray]], totals: dict[int, list[int]]) -> pa.RecordBatch:
    """One row per document. told: the facts of the chunk's grams by level; totals: frequencies of all grams."""
    seen, told = told[1][0], told | {1: told[1][1:]}
    vocabulary, n = totals[1][10:12]
    base = np.log10((seen + 0.1) / (n + 0.1 * (vocabulary + 1)))
    # the share of each word among all that follow a word, interpolated with the uniform one
    one, two, *_, all_kinds, contexts = totals[1][:6]
    d = discounts(totals[1][:4])
    p = np.full(len(base), 1 / (vocabulary + 1))
    if contexts:
        rest = (d[1] * one + d[2] * two + d[3] * (all_kinds - one - two)) / contexts
        before = told[1][BEFORE]
        p = np.maximum(before - d[np.minimum(before, 3).astype(int)], 0) / contexts + rest / (vocabulary + 1)
    for level in range(2, order + 1):
        value, shorter = told[level][0], told[level - 1]
        d, followers = discounts(totals[level][:4]), np.maximum(shorter[SUM], 1).astype(float)
        back = np.where(shorter[SUM] > 0, (d[1] * shorter[ONCE] + d[2] * shorter[TWICE] + d[3] * shorter[MORE]) / followers, 1.0)
        prefix = chunk.prefix(level)
        p = np.maximum(value - d[np.minimum(value, 3).astype(int)], 0) / followers[prefix] + back[prefix] * p[chunk.suffix(level)]
    add = lambda values, level: np.add.reduceat(values[chunk.level(level).gram[chunk.places]], chunk.starts)
    score = add(np.log10(p), order)
    names = [x.split()[0] for x in SCORES.split(", ")]
    columns = [
        pa.array(chunk.ids, mask=chunk.missing), pa.array(chunk.held), pa.array(chunk.lengths), pa.array(add((seen > 0).astype(np.int64), 1)),
        pa.array(np.full(len(chunk.ids), n, np.int64)), pa.array(add(base, 1)), pa.array(score), pa.array(10 ** (-score / chunk.lengths)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def score(docs: DataFrame, held: Column, shards: int | None = None, text: str = "text", order: int = ORDER, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of docs.

    held: the rows that the model does not learn from. shards: of the model, by default as many
    as the tokens need. order: words of the longest grams. model: a folder in which the model
    stays; else each level is removed once its answers are settled.
    """
    if order < 2:
        raise ValueError(f"the order is {order}, but a model needs grams of two words at least")
    spark = docs.sparkSession
    folder, keep = work_dir(spark, "lm-texts"), model is not None
    model = model or work_dir(spark, "lm-model")
    chunks = settle(write_chunks(docs, held, folder, text), "lm-chunks")
    parts, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if not parts:
        return spark.createDataFrame([], SCORES)
    shards = shards or -(-tokens // SHARD)

    def first_questions(batches):
        for b in batches:
            for chunk, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = read_chunk(folder, file, order)
                yield from questions(chunk, file, order, own.level(order).hashes, [own.counts(order)], shards)

    def lower_questions(level: int):
        def run(batches):
            for rows in runs(batches, 0):
                own = read_chunk(folder, rows[0][1], order)
                facts, owned = facts_told([r[4] for r in rows])
                yield from questions(rows[0][0], rows[0][1], level, own.level(level).hashes, own.lower_facts(level, facts[0], owned), shards)

        return run

    def answers(at: str):
        def run(batches):
            for rows in runs(batches, 3):
                yield from answer_shard(rows, at)

        return run

    by_chunk = lambda df: df.where("chunk >= 0").repartition(parts, "chunk").sortWithinPartitions("chunk", "level", "shard")
    told, totals = {}, {}
    asked = chunks.select("chunk", "file").repartitionByRange(parts, "chunk").mapInArrow(first_questions, MESSAGES)
    for level in range(order, 0, -1):
        by_shard = asked.repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
        told[level] = settle(by_shard.mapInArrow(answers(f"{model}/order-{level}"), MESSAGES), f"lm-told-{level}")
        sums = told[level].where("chunk < 0").agg(*(F.sum(F.get("totals", F.lit(k))) for k in range(12))).first()
        totals[level] = [x or 0 for x in sums]
        if not keep:
            discard(spark, f"{model}/order-{level}")
        if level > 1:
            asked = by_chunk(told[level]).mapInArrow(lower_questions(level - 1), MESSAGES)

    def scored(batches):
        for rows in runs(batches, 0):
            facts = {n: facts_told([r[4] for r in rows if r[2] == n])[0] for n in range(1, order + 1)}
            yield score_chunk(read_chunk(folder, rows[0][1], order), order, facts, totals)

    every = told[1]
    for level in range(2, order + 1):
        every = every.unionByName(told[level])
    return by_chunk(every).mapInArrow(scored, SCORES)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


QUERIES = {"op5_lm": op5_lm}
SQL: dict[str, str] = {}
