"""Phrase collocations per language by mergeable Misra-Gries summaries and an exact second pass.

Texts are lower-cased (A-Z), split into pieces at stops and line ends, and pieces into words.
Chunks of documents, each a file in the shared folder, take part in two rounds, first with their
words and pairs of words, then with the n-grams (3 to LONGEST words) all of whose pairs came through:

1. a chunk sends its distinct grams' hashes and counts, cut at the ranges of the hash partitions;
2. a partition adds the messages up in a Misra-Gries summary. Its capacity exceeds the mass that
   the partition has received divided by the threshold, so that a summary, however often it is
   merged and cut, gives away less than the threshold of any gram: each frequent gram survives;
3. the chunks hear which of their grams survived, and count those by their words.

What the chunks count is added up by text, so equal hashes of unlike grams do no harm: they only
let a rare gram survive until the exact counts drop it. Partitions are ranges of hashes and get
each gram once from a chunk, so a frequent gram makes no large task. The numbers of chunks and
partitions grow with the input, and a chunk has a message for each partition (about 700 grams at 30 GB,
20 at 1 TB; beyond that CHUNK and PARTITION have to grow with the executors).

A candidate's parts are as frequent as it is, so the exact counts hold them all. Scores are exact
in decimals of 38 digits.

Defined results: null counts as the empty text, and a null language as `und`; repeated rows count
each time; a word may hold any character but blanks, tabs and those that split; a table without a
frequent phrase, or without rows, gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marlstone.llm.common import batch, discard, file_system, settle_at, small_batches, table, text_bytes, work_dir
from marlstone.llm.lm import U32, U64, counts_bytes, counts_from, dump, gram_hash, load, planes, rising, slices, unplane, unrising

THRESHOLD, LONGEST, KEEP = 100, 5, 2000
#: A candidate goes if a longer one around it has this percentage of its occurrences.
REDUNDANT = 100
#: Words of a chunk, and of all grams for each hash partition.
CHUNK, PARTITION = 2_000_000, 8_000_000
#: What splits texts becomes a line end, a tab becomes a blank.
SPLIT = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n" * 9 + b" ")

CHUNKS = "chunk long, file string, mass array<long>, langs array<string>, words array<long>"
CHUNKS_ARROW = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("mass", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.int64()))])
MESSAGES = "bucket int, chunk long, file string, payload binary"
MESSAGES_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("file", pa.string()), ("payload", pa.binary())])
COUNTS = "lang string, phrase string, f long"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


class Numbers(dict):
    """Word -> its number in the chunk; each language numbers its own words."""

    def __init__(self, lang: int, words: list[bytes], langs: list[int]):
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word):
        self[word] = n = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


class Builder:
    """Documents on their way into a chunk."""

    def __init__(self):
        self.names, self.by_lang, self.words, self.langs, self.tokens, self.pieces, self.size = [], {}, [], [], [], [], 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.by_lang:
            self.by_lang[lang] = Numbers(len(self.names), self.words, self.langs)
            self.names.append(lang)
        found = [p.split() for p in text.lower().translate(SPLIT).split(b"\n")]
        lengths = np.fromiter(map(len, found), U32, len(found))
        total = int(lengths.sum())
        self.tokens.append(np.fromiter(map(self.by_lang[lang].__getitem__, chain.from_iterable(found)), U32, total))
        self.pieces.append(lengths[lengths > 0])
        self.size += total

    def blob(self, longest: int = LONGEST) -> tuple[bytes, list[int], list[int]]:
        """The chunk as bytes, how many grams of each length it has, and how many words of each language."""
        tokens, pieces = (np.concatenate([*x, np.empty(0, U32)]).astype(U32) for x in (self.tokens, self.pieces))
        langs = np.array(self.langs, np.int64)
        mass = [int(np.maximum(pieces.astype(np.int64) - n, 0).sum()) for n in range(longest)]
        data = dump(json.dumps(self.names).encode(), b" ".join(self.words), planes(langs, U32), planes(tokens, U32), planes(pieces, U32))
        return data, mass, np.bincount(langs[tokens], minlength=len(self.names)).tolist()


class Chunk:
    """A chunk's words and pieces."""

    def __init__(self, data: bytes):
        names, words, langs, tokens, pieces = load(data)
        self.names, self.words = json.loads(names), words.split(b" ") if words else []
        self.langs, self.tokens = unplane(langs, U32), unplane(tokens, U32).astype(np.int64)
        ends = np.cumsum(unplane(pieces, U32).astype(np.int64))
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(self.tokens))
        marks = [x.encode() + b"\n" for x in self.names]
        self.hashes = np.fromiter((xxh64_intdigest(marks[g] + w) for g, w in zip(self.langs.tolist(), self.words, strict=True)), U64, len(self.words))

    def grams(self, n: int, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where grams of n words begin, and their hashes. pairs: the hashes, in order, that all pairs of words in them have."""
        at = np.flatnonzero(self.left >= n)
        if pairs is not None:
            alive = np.zeros(len(self.left), bool)
            places, hashes = self.grams(2)
            alive[places] = among(hashes, pairs)
            at = at[np.all([alive[at + k] for k in range(n - 1)], axis=0)]
        hashes = self.hashes[self.tokens[at]]
        for k in range(1, n):
            hashes = gram_hash(hashes, self.hashes[self.tokens[at + k]])
        return at, hashes

    def counted(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place and the count of each of the grams of n words that begin there, told apart by their words."""
        same = self.tokens[at]
        for k in range(1, n):
            same = np.unique(same * len(self.words) + self.tokens[at + k], return_inverse=True)[1]
        _, first, counts = np.unique(same, return_index=True, return_counts=True)
        return at[first], counts

    def said(self, n: int, at: np.ndarray) -> list[bytes]:
        rows = np.stack([self.tokens[at + k] for k in range(n)], axis=1).tolist()
        return [b" ".join([self.words[w] for w in r]) for r in rows]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def write_chunks(docs: DataFrame, folder: str, longest: int) -> DataFrame:
    """Chunk files. mass: how many grams of each length a chunk has; words: how many of each language."""

    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        task = TaskContext.get()
        chunk, held = task.partitionId() << 32, Builder()

        def flush():
            (data, mass, words), name = held.blob(longest), f"{chunk}-{task.taskAttemptId()}.chunk"
            with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(data)
            return batch(CHUNKS_ARROW, [chunk], [name], [mass], [held.names], [words])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(lang, text.as_py())
                if held.size >= CHUNK:
                    yield flush()
                    chunk, held = chunk + 1, Builder()
        if held.size:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes().alias("text")).mapInArrow(run, CHUNKS)


# Summaries --------------------------------------------------------------------------------


def added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes as one, in order, with the sum of their counts."""
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    return hashes[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Summary:
    """A mergeable Misra-Gries summary: at most so many counters; given is what one may lack at most."""

    def __init__(self, capacity: int):
        self.capacity, self.given = capacity, 0
        self.hashes, self.counts = np.empty(0, U64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merge(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Add counters; those waiting are at most as many as the capacity and one message."""
        self.waiting.append((hashes, counts))
        self.size += len(hashes)
        if self.size > self.capacity:
            self.cut()

    def cut(self) -> None:
        """Add up what waits; if that is too much, all counters lose what the first one beyond the capacity has."""
        parts = [(self.hashes, self.counts), *self.waiting]
        self.hashes, self.counts = added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        self.waiting, self.size = [], 0
        if len(self.counts) > self.capacity:
            beyond = np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1]
            kept = self.counts > beyond
            self.hashes, self.counts, self.given = self.hashes[kept], self.counts[kept] - beyond, self.given + int(beyond)

    def frequent(self, threshold: int) -> np.ndarray:
        """Hashes, in order, of all that may have reached the threshold."""
        self.cut()
        return self.hashes[self.counts + self.given >= threshold]


def survivors(told: pa.Table, threshold: int) -> Iterator[tuple[int, str, np.ndarray]]:
    """For each message to a partition, the hashes in it that survive in the summary of all."""
    messages = [load(x) for x in told.column("payload").to_pylist()]
    parts = [(unrising(h), counts_from(*c).astype(np.int64)) for h, *c in messages]
    summary = Summary(sum(int(c.sum()) for _, c in parts) // threshold + 1)
    for hashes, counts in parts:
        summary.merge(hashes, counts)
    kept = summary.frequent(threshold)
    for chunk, file, (hashes, _) in zip(told.column("chunk").to_pylist(), told.column("file").to_pylist(), parts, strict=True):
        found = hashes[among(hashes, kept)]
        if len(found):
            yield chunk, file, found


# Rounds -----------------------------------------------------------------------------------


def read_chunk(folder: str, name: str) -> Chunk:
    fs, top = file_system(folder)
    with fs.open_input_file(f"{top}/{name}") as f:
        return Chunk(f.read())


def ask(chunk: int, file: str, hashes: np.ndarray, partitions: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct grams with their counts, a message for each hash partition."""
    hashes, counts = added(hashes, np.ones(len(hashes), np.int64))
    for s, part in enumerate(slices(hashes, partitions)):
        if part.stop > part.start:
            yield batch(MESSAGES_ARROW, [s], [chunk], [file], [dump(rising(hashes[part]), *counts_bytes(counts[part]))])


def tell(chunk: int, file: str, own: Chunk, kept: np.ndarray, lengths: range, partitions: int) -> Iterator[pa.RecordBatch]:
    """A chunk's exact counts of the grams that survived, by their words, a message for each hash partition."""
    hashes, counts, langs, phrases = [], [], [], []
    for n in lengths:
        at, found = own.grams(n)
        alive = among(found, kept)
        first, many = own.counted(n, at[alive])
        hashes.append(found[np.searchsorted(at, first)])
        counts.append(many)
        langs.append(own.langs[own.tokens[first]])
        phrases += own.said(n, first)
    hashes, counts, langs = (np.concatenate(x) for x in (hashes, counts, langs))
    order = np.argsort(hashes, kind="stable")
    for s, part in enumerate(slices(hashes[order], partitions)):
        mine = order[part]
        if len(mine):
            listed = b"\n".join([phrases[k] for k in mine.tolist()])
            yield batch(MESSAGES_ARROW, [s], [chunk], [file], [dump(json.dumps(own.names).encode(), planes(langs[mine], U32), listed, *counts_bytes(counts[mine]))])


def told_counts(payloads: list[bytes], threshold: int) -> pa.Table:
    """(lang, phrase, f) of a partition's phrases that reach the threshold."""
    tables = []
    for data in payloads:
        names, langs, listed, *counts = load(data)
        names = pa.array(json.loads(names), pa.string())
        phrases = pa.array(listed.split(b"\n"), pa.binary())
        tables.append(pa.table([names.take(pa.array(unplane(langs, U32))), phrases, pa.array(counts_from(*counts).astype(np.int64))], names=["lang", "phrase", "f"]))
    sums = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    sums = sums.filter(pc.greater_equal(sums.column("f_sum"), threshold))
    return pa.table([sums.column("lang"), sums.column("phrase").cast(pa.string()), sums.column("f_sum")], schema=COUNTS_ARROW)


def frequent_grams(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f): all phrases of 1 to longest words with f of at least threshold, exactly; (lang, n): words in all."""
    if threshold < 1 or longest < 2:
        raise ValueError(f"the threshold is {threshold} and the longest phrase has {longest} words, but they are 1 and 2 at least")
    spark = docs.sparkSession
    folder, kept = work_dir(spark, "phrases"), work_dir(spark, "phrase-counts")
    chunks = settle_at(write_chunks(docs, f"{folder}/chunks", longest), f"{folder}/table")
    parts, *masses = chunks.agg(F.count("*"), *(F.coalesce(F.sum(F.get("mass", F.lit(k))), F.lit(0)) for k in range(longest))).first()
    totals = chunks.select(F.explode(F.arrays_zip("langs", "words"))).groupBy(F.col("col.langs").alias("lang")).agg(F.sum("col.words").alias("n"))
    totals = settle_at(totals, f"{kept}/totals")
    if not parts:
        return spark.createDataFrame([], COUNTS), totals
    lengths = range(1, 3), range(3, longest + 1)
    buckets = [partitions or max(1, -(-sum(masses[n - 1] for n in r) // PARTITION)) for r in lengths]

    def first_questions(batches):
        for b in batches:
            for chunk, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = read_chunk(f"{folder}/chunks", file)
                yield from ask(chunk, file, np.concatenate([own.grams(n)[1] for n in lengths[0]]), buckets[0])

    def answer(told: pa.Table) -> pa.Table:
        bucket = told.column("bucket")[0].as_py()
        found = [batch(MESSAGES_ARROW, [bucket], [c], [f], [dump(rising(h))]) for c, f, h in survivors(told, threshold)]
        return pa.Table.from_batches(found, MESSAGES_ARROW)

    def heard(told: pa.Table) -> tuple[int, str, Chunk, np.ndarray]:
        """A chunk, and the hashes in order of what came through of it."""
        file = told.column("file")[0].as_py()
        hashes = np.concatenate([unrising(load(x)[0]) for x in told.column("payload").to_pylist()])
        return told.column("chunk")[0].as_py(), file, read_chunk(f"{folder}/chunks", file), np.sort(hashes)

    def later_questions(told: pa.Table) -> pa.Table:
        chunk, file, own, pairs = heard(told)
        found = ask(chunk, file, np.concatenate([own.grams(n, pairs)[1] for n in lengths[1]]), buckets[1])
        return pa.Table.from_batches(list(found), MESSAGES_ARROW)

    def counts_of(k: int):
        return lambda told: pa.Table.from_batches(list(tell(*heard(told), lengths[k], buckets[k])), MESSAGES_ARROW)

    def add_up(told: pa.Table) -> pa.Table:
        return told_counts(told.column("payload").to_pylist(), threshold)

    def by(df: DataFrame, key: str, many: int):
        return df.repartition(many, key).groupBy(key)

    asked = chunks.select("chunk", "file").repartition(parts, "chunk").mapInArrow(first_questions, MESSAGES)
    alive = [settle_at(by(asked, "bucket", buckets[0]).applyInArrow(answer, MESSAGES), f"{folder}/alive-1")]
    if lengths[1]:
        asked = by(alive[0], "chunk", parts).applyInArrow(later_questions, MESSAGES)
        alive.append(settle_at(by(asked, "bucket", buckets[1]).applyInArrow(answer, MESSAGES), f"{folder}/alive-2"))
    found = [by(by(a, "chunk", parts).applyInArrow(counts_of(k), MESSAGES), "bucket", buckets[k]).applyInArrow(add_up, COUNTS) for k, a in enumerate(alive)]
    grams = settle_at(found[0].unionByName(found[1]) if lengths[1] else found[0], f"{kept}/grams")
    discard(spark, folder)
    return grams, totals


# Scores -----------------------------------------------------------------------------------


def collocations(grams: DataFrame, totals: DataFrame, keep: int = KEEP, redundant: int = REDUNDANT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, from frequent_grams."""
    words = F.split("phrase", " ")
    some = grams.withColumn("size", F.size(words)).where("size > 1")
    join = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = some.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": join(F.lit(1), F.col("k")), "rest": join(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 * a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0)))"))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase between a candidate and a longer one around it is as frequent as the longer one, so one word more is enough
    around = some.where("size > 2").select("lang", "f", F.explode(F.array(join(F.lit(1), F.col("size") - 1), join(F.lit(2), F.col("size") - 1))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(redundant) * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*frequent_grams(table(spark, sf_dir, "documents")))


QUERIES = {"op11_collocations": op11_collocations}
SQL = {
    "op11_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM pieces),
placed AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS pos FROM listed WHERE len(words) > 0),
sized AS (SELECT lang, words, pos, unnest([1, 2, 3, 4, 5]) AS size FROM placed),
grams AS (
  SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase, count(*) AS f
  FROM sized WHERE pos + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f AS a, size, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM grams WHERE size > 1)),
scored AS (
  SELECT c.lang, c.phrase, a, n, k, x.f AS l, y.f AS r, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    SELECT 1 FROM grams g WHERE g.lang = w.lang AND g.size > len(string_split(w.phrase, ' ')) AND 100 * g.f >= 100 * w.a AND contains(' ' || g.phrase || ' ', ' ' || w.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000"""
}
