"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Two token sequences of one text are merged by the byte offsets at which their tokens end. All
documents of a batch advance together: one NumPy state vector holds a pointer into A's tokens and
one into B's for each lane. A step links the two tokens that each lane points to, notes a cut where
both end at the same byte, advances the pointer whose token ends first (both at a cut), and drops
the lanes that are finished. A long document takes several lanes, which begin at bytes where both
tokenizers have a token's end, so that it does not hold up the others; each pair of pointers is
visited as in one long lane.

A word with the blanks before it is encoded once for each worker while its table holds it, by both
libraries: no piece of B crosses a blank, and A cuts texts before blanks. Texts in which this does
not hold (another white space before a blank, a literal U+2581 or NUL) go to both libraries whole.

Counts of linked pairs over the corpus are a Spark aggregation over each document's distinct pairs.
They go back to the documents by a broadcast if there are at most BROADCAST pairs, else by a join
in which each pair stands in SALTS partitions.

Defined results: null, empty texts and those whose bytes a tokenizer changes have no tokens: zeros
and an empty digest; repeated rows each get their row and count each time; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import batch, settle, small_batches, table, text_bytes
from marlstone.llm.piece_codec import ChunkTable, default_model

#: Words kept by one worker in each of two generations.
TABLE_SIZE = 300_000
#: Characters of a text that is encoded by ranks.
SHORT = 200
#: Tokens of A in a lane, and how many of them may be passed in search of a common end.
LANE, SEARCH = 256, 64
#: UTF-8 bytes that are merged at a time, or one text.
GROUP = 4 << 20
#: Most linked pairs that are broadcast (about 50 bytes each); salts of the join beyond that.
BROADCAST, SALTS = 2_000_000, 16
#: White space that A's rules may join with the blank after it.
JOINED = re.compile(r"[^\S ] ")
PAIR = 32  # bits of B's id in a pair
# How a byte-level tokenizer's file cuts texts, if it says that it uses the usual pattern.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_bytes_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Tokenizers -------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """The bytes of a vocabulary's tokens by id."""

    def __init__(self, tokens: list[bytes]):
        self.bytes, self.lengths = tokens, np.array([len(t) for t in tokens], np.int64)

    def join(self, ids: bytes) -> bytes:
        return b"".join([self.bytes[i] for i in array("i", ids)])


class Both(ChunkTable):
    """Word without the first blank before it -> A's ids and B's ids as int32 bytes, and whether both give its bytes."""

    def __init__(self, path_a: str, path_b: str, limit: int = TABLE_SIZE):
        from tokenizers import Tokenizer

        super().__init__(path_b, limit)
        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = {i: t for t, i in self.first.get_vocab().items()}
        as_bytes = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.a = Tokens([as_bytes(vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)])
        self.ranked = self.by_ranks(json.loads(self.first.to_str()), as_bytes)
        piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        self.b = Tokens([piece(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())])

    def by_ranks(self, how: dict, as_bytes):
        """A's vocabulary as ranks, for a library that encodes single words faster; None if its file says more than ranks do.

        The two agree where the file cuts texts by the usual pattern alone and each merge makes a
        token of its own, in the order of ids.
        """
        import tiktoken

        model, cut, ids = how["model"], how["pre_tokenizer"] or {}, self.first.get_vocab()
        made = [ids.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        plain = how["normalizer"] is None and {k: cut.get(k) for k in PRE_TOKENIZER} == PRE_TOKENIZER and not model.get("ignore_merges") and not model.get("unk_token")
        if not plain or None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)):
            return None
        letters = byte_letters()
        own = {i for t, i in ids.items() if t in letters} | set(made)
        ranks = {as_bytes(t): i for t, i in ids.items() if i in own}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> bytes:
        # ranks take a time that grows with the square of a word's length
        ids = self.ranked.encode_ordinary(text) if self.ranked and len(text) <= SHORT else self.first.encode(text, add_special_tokens=False).ids
        return array("i", ids).tobytes()

    def encode_b(self, text: str) -> bytes:
        return array("i", self.library.encode(text, num_threads=1)).tobytes()

    def make(self, word: str):
        a, b = self.encode_a(" " + word), self.encode_b(word) if word else array("i", [self.blank]).tobytes()
        whole = (" " + word).encode()
        return a, b, self.a.join(a) == whole == self.b.join(b)

    def tokens(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a blank and the text by A, and of the text by B; none if one of them changes bytes."""
        rows = None if JOINED.search(text) else self.rows(text)
        if rows is not None and all([r[2] for r in rows]):
            return b"".join([r[0] for r in rows]), b"".join([r[1] for r in rows])
        a, b = self.encode_a(" " + text), self.encode_b(text)
        whole = (" " + text).encode()
        return (a, b) if self.a.join(a) == whole == self.b.join(b) else (b"", b"")


@lru_cache(maxsize=1)
def both(path_a: str, path_b: str) -> Both:
    """One for a worker: it outlives the tasks."""
    return Both(path_a, path_b)


# Merging ----------------------------------------------------------------------------------


def lanes(first: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Where lanes begin in A's tokens: at each document's first token, and about every lane tokens at a common end."""
    sizes = np.diff(np.append(first, len(a_ends)))
    more = np.maximum(sizes - 1, 0) // lane
    document = np.repeat(np.arange(len(first)), more)
    within = np.arange(len(document)) - np.repeat(np.cumsum(more) - more, more) + 1
    at, last = first[document] + within * lane, first[document] + sizes[document]
    found = np.zeros(len(at), bool)
    for _ in range(SEARCH):
        left = np.flatnonzero(~found & (at < last))
        if not len(left):
            break
        before = a_ends[at[left] - 1]
        common = b_ends[np.searchsorted(b_ends, before)] == before
        found[left[common]] = True
        at[left[~common]] += 1
    return np.unique(np.concatenate([first[sizes > 0], at[found & (at < last)]]))


def merge(starts: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked tokens of A and of B in order, and which tokens of A and of B end at a cut.

    starts: where lanes begin in A's tokens. Ends are byte offsets over all documents, whose
    last tokens end together.
    """
    cut_a, cut_b = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), cut_a, cut_b
    i, stop = starts.copy(), np.append(starts[1:], len(a_ends))
    j = np.where(i > 0, np.searchsorted(b_ends, a_ends[np.maximum(i - 1, 0)]) + 1, 0)
    links_i, links_j = [], []
    while len(i):
        links_i.append(i)
        links_j.append(j)
        end_a, end_b = a_ends[i], b_ends[j]
        cut = end_a == end_b
        cut_a[i[cut]] = True
        cut_b[j[cut]] = True
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    i, j = np.concatenate(links_i), np.concatenate(links_j)
    # a link's place: every step but those after a cut advances one of the two pointers by one
    place = i + j - (np.cumsum(cut_a) - cut_a)[i]
    in_order = np.empty((2, len(i)), np.int64)
    in_order[0, place], in_order[1, place] = i, j
    return in_order[0], in_order[1], cut_a, cut_b


class Group:
    """Some documents' tokens, merged. at_a and at_b: each document's first token, and the end of all."""

    def __init__(self, tables: Both, texts: list[bytes], lane: int = LANE):
        found = [tables.tokens(t.decode()) if t else (b"", b"") for t in texts]
        self.a, self.b = (np.frombuffer(b"".join([f[k] for f in found]), np.int32) for k in (0, 1))
        self.at_a, self.at_b = (np.cumsum([0, *(len(f[k]) // 4 for f in found)]) for k in (0, 1))
        self.a_ends, self.b_ends = np.cumsum(tables.a.lengths[self.a]), np.cumsum(tables.b.lengths[self.b])
        self.i, self.j, self.cut_a, self.cut_b = merge(lanes(self.at_a[:-1], self.a_ends, self.b_ends, lane), self.a_ends, self.b_ends)
        cuts = np.concatenate([[0], np.cumsum(self.cut_a)])
        self.cuts = cuts[self.at_a]
        self.links = self.at_a + self.at_b - self.cuts

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        group_a, group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        last_a, last_b = np.flatnonzero(self.cut_a) + 1, np.concatenate([[0], np.flatnonzero(self.cut_b) + 1])
        listed = np.empty(len(self.a) + len(self.b), np.int64)
        listed[np.arange(len(self.a)) + last_b[group_a]] = self.a * np.int64(3) + self.cut_a
        listed[np.arange(len(self.b)) + last_a[group_b]] = self.b * np.int64(3) + 2 * self.cut_b
        signs, out = decimals(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1), []
        for start, end in zip(self.at_a[:-1] + self.at_b[:-1], self.at_a[1:] + self.at_b[1:], strict=True):
            said = b"".join([signs[k] for k in listed[start:end].tolist()])
            out.append(hashlib.sha256(said[:-1]).hexdigest() if said else "")
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's distinct linked pairs of ids in order: where a document's begin, pairs, how many links each has."""
        document = np.repeat(np.arange(len(self.links) - 1), np.diff(self.links))
        pair = self.a[self.i].astype(np.int64) << PAIR | self.b[self.j]
        order = np.lexsort((pair, document))
        pair, document = pair[order], document[order]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(document, prepend=-1) != 0))
        return np.searchsorted(document[first], np.arange(len(self.links))), pair[first], np.diff(np.append(first, len(pair)))


@lru_cache(maxsize=2)
def decimals(many: int) -> list[bytes]:
    """For id i: i with a comma at 3i, with a bar at 3i + 1, with a semicolon at 3i + 2."""
    many = max(many, 1 << 16)
    return [b"%d%c" % (i, c) for i in range(many) for c in b",|;"]


def groups(texts: pa.Array, tables: Both, limit: int = GROUP) -> Iterator[tuple[int, Group]]:
    """The batch in groups of bounded size, each with its first row's number."""
    start, held, size = 0, [], 0
    for n, t in enumerate(texts):
        text = t.as_py()
        if held and size + len(text) > limit:
            yield start, Group(tables, held)
            start, held, size = n, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, Group(tables, held)


def ints(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a_ids, b_ids, a_ends, b_ends (bytes of blank and text), link_a, link_b (token numbers), cuts (bytes)."""
    paths, kind = (path_a or default_bytes_tokenizer(), path_b or default_model()), docs.schema[key].dataType.simpleString()
    names = ("a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b", "cuts")

    def run(batches):
        tables = both(*paths)
        for b in batches:
            for start, g in groups(b.column(1), tables):
                rows = len(g.at_a) - 1
                a_doc, b_doc, link_doc = (np.repeat(np.arange(rows), np.diff(x)) for x in (g.at_a, g.at_b, g.links))
                base = np.concatenate([[0], g.a_ends])[g.at_a[:-1]]
                ends_a = g.a_ends - base[a_doc]
                lists = [
                    ints(g.a, g.at_a), ints(g.b, g.at_b), ints(ends_a, g.at_a), ints(g.b_ends - base[b_doc], g.at_b),
                    ints(g.i - g.at_a[:-1][link_doc], g.links), ints(g.j - g.at_b[:-1][link_doc], g.links), ints(ends_a[g.cut_a], g.cuts),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, rows), *lists], names=[key, *names])

    small_batches(docs.sparkSession)
    return docs.select(key, text_bytes(text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} array<int>" for n in names))


# Counts over the corpus -------------------------------------------------------------------

LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
LINKED_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
)


def linked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row per document with its number, its counts and digest, and its distinct linked pairs (A's id << 32 | B's id)."""
    paths = path_a or default_bytes_tokenizer(), path_b or default_model()

    def run(batches):
        tables, row = both(*paths), TaskContext.get().partitionId() << 40
        for b in batches:
            for start, g in groups(b.column(1), tables):
                many = len(g.at_a) - 1
                at, pair, times = g.pairs()
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pair, pa.int64())), ints(times, at)
                counts = (np.diff(x) for x in (g.at_a, g.at_b, g.cuts, g.links))
                yield batch(LINKED_ARROW, row + np.arange(many), b.column(0).slice(start, many), *counts, g.digests(), *lists)
                row += many

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, LINKED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best: whether no pair of its A id has a larger count."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", PAIR))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_counts(rows: DataFrame, counts: DataFrame, broadcast: bool) -> DataFrame:
    """row, n_best, count_sum: each row's links by the counts of their pairs."""
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if broadcast:
        met = each.join(F.broadcast(counts), "pair")
    else:
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["pair", "salt"])
    return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    rows = settle(linked(docs, path_a, path_b), "alignments")
    counts = settle(pair_counts(rows), "pair-counts")
    sums = link_counts(rows, counts, counts.count() <= most)
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    filled = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}
    return out.withColumns(filled).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))


QUERIES = {"op12_alignment": op12_alignment}
SQL: dict[str, str] = {}
