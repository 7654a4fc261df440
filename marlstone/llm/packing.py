"""Packing token streams into windows by order-preserving dynamic programming.

Documents keep the order in which their partition holds them. Cuts fall on document or
sentence boundaries (inside a stretch without any, on hard boundaries every 64 tokens). The
cuts chosen minimise padding plus truncation penalties: a cut after a document is free, after
a sentence it costs SENTENCE_CUT, elsewhere HARD_CUT. The cheapest predecessor of a boundary
is a sliding-window minimum, kept in a monotone queue, so the work is linear in the
boundaries. A window whose length is a power of two needs no padding, and the last window of
a partition is split into such lengths where that is cheaper than padding it.

No shuffle: each input partition is packed by itself, in segments of bounded size, and
sequence_id holds the partition number in its upper bits. With the same input splits the
result is the same each time.

Defined results: null text counts as empty and gives the end token alone; repeated rows are
packed like any others; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import WordCache, batch, small_batches, table, text_bytes

WINDOW = 4096
SENTENCE_CUT, HARD_CUT = 4.0, 32.0
#: Tokens gathered before a segment is packed; its last window is carried into the next one.
SEGMENT = 1 << 18
#: Without a boundary for so many tokens, hard boundaries are set.
GAP, STEP = 128, 64
#: Shorter windows that count as full.
FULL = (256, 512, 1024, 2048)
END = 2
#: Words and parts of words kept by one worker in each of two generations.
WORDS, PARTS_KEPT = 500_000, 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How the tokenizer's file cuts a text before its merges.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of Latin-1 and Latin Extended-A that are in normal form and have one lower-case letter.
LATIN = "À-ÖØ-öø-įı-ſ"
PLAIN = re.compile(f"[!-~{LATIN}]+")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z{LATIN}0-9]+")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PartTable(WordCache):
    """Part of a word (letters, a digit, a run of other signs) -> its ids, by the merges of the tokenizer's model alone."""

    def __init__(self, library, limit: int):
        from tokenizers import pre_tokenizers

        super().__init__(limit)
        self.model, byte_level = library.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}

    def make(self, part: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.signs))])


class WordTable(WordCache):
    """Word (UTF-8, no ASCII white space) -> its ids as little-endian uint32 bytes.

    The tokenizer splits at white space and drops it, so a text's ids are its words' ids. Words
    of plain Latin letters, digits and ASCII signs are cut into parts as the tokenizer's file
    says, if it says NORMALIZER and SPLIT, and each part goes to its model; other words, and
    those that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = WORDS):
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.library = Tokenizer.from_file(path)
        how = json.loads(self.library.to_str())
        split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        steps = ((how["normalizer"] or {}).get("normalizers"), (how["pre_tokenizer"] or {}).get("pretokenizers") or [None])
        known = steps[0] == NORMALIZER and steps[1][0] == split and [s and s["type"] for s in steps[1]] == ["Split", "ByteLevel"]
        self.parts = PartTable(self.library, min(limit, PARTS_KEPT)) if known else None

    def make(self, word: bytes) -> bytes:
        text = word.decode()
        if self.parts is None or "<|" in text or not PLAIN.fullmatch(text):
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join([self.parts[p] for p in PARTS.findall(text.lower())])

    def ids(self, text: bytes) -> bytes:
        return b"".join([self[w] for w in text.split()])

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its token ends in a full stop, a question mark or the like."""
        vocabulary = self.library.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            ends[i] = token.removesuffix("</w>").rstrip("\"')]").endswith((".", "!", "?"))
        return ends


@lru_cache(maxsize=1)
def word_table(path: str) -> WordTable:
    """One for a worker: it outlives the tasks."""
    return WordTable(path)


def windows(places: np.ndarray, costs: np.ndarray, size: int = WINDOW) -> list[int]:
    """Indices into places of the cheapest cuts, from 0 to the last place.

    places: ascending boundaries from 0, no gap over size; costs: what a cut there costs.
    """
    at, cost, n = places.tolist(), costs.tolist(), len(places)
    best, before = [0.0] * n, [0] * n
    keys = [0.0] * n  # best + place: what a window that starts there adds, up to its end
    index = {p: i for i, p in enumerate(at)}
    shorter = [f for f in FULL if f < size]
    queue: deque[int] = deque([0])
    for j in range(1, n):
        p = at[j]
        while p - at[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        value = keys[i] + size - p
        for f in shorter:
            k = index.get(p - f)
            if k is not None and best[k] < value:
                i, value = k, best[k]
        best[j] = value = value + cost[j]
        before[j] = i
        keys[j] = value = value + p
        while queue and keys[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = before[j]
        cuts.append(j)
    return cuts[::-1]


def boundaries(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and costs for a segment: starts are the documents' first tokens, ends the ids that end sentences."""
    total = len(ids)
    documents = np.append(starts, total)
    sentences = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    places = np.union1d(documents, sentences)
    gaps = np.flatnonzero(np.diff(places) > min(GAP, size))
    if len(gaps):
        step = min(STEP, size)
        hard = [np.arange(places[g] + step, places[g + 1], step) for g in gaps]
        places = np.union1d(places, np.concatenate(hard))
    costs = np.full(len(places), HARD_CUT)
    costs[np.searchsorted(places, sentences)] = SENTENCE_CUT
    costs[np.searchsorted(places, documents)] = 0
    return places, costs


def split_tail(start: int, stop: int, size: int = WINDOW) -> list[int]:
    """The last window's ends: itself, or lengths that are powers of two if those are cheaper than padding."""
    length = stop - start
    if size - length <= HARD_CUT * length.bit_count():
        return [stop]
    found, at = [], start
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            at += 1 << bit
            found.append(at)
    return found


class Packer:
    """Takes a partition's documents in order, gives rows of pieces segment by segment."""

    def __init__(self, ends: np.ndarray, first_sequence: int, size: int = WINDOW):
        self.ends, self.sequence, self.size = ends, first_sequence, size
        self.pending: list[tuple[int | None, int, int, bytes]] = []  # doc_id, ids before these, all ids, ids
        self.tokens = 0

    def add(self, doc_id, ids: bytes):
        self.pending.append((doc_id, 0, len(ids) // 4, ids))
        self.tokens += len(ids) // 4
        if self.tokens >= SEGMENT:
            yield from self.flush(False)

    def flush(self, last: bool):
        if not self.pending:
            return
        starts = np.cumsum([0, *(len(d[3]) // 4 for d in self.pending)])
        ids = np.frombuffer(b"".join([d[3] for d in self.pending]), "<u4")
        places, costs = boundaries(ids, starts[:-1], self.ends, self.size)
        cuts = places[windows(places, costs, self.size)].tolist()
        if last:
            cuts[-1:] = split_tail(cuts[-2], cuts[-1], self.size)
        else:
            cuts.pop()  # what may still be filled up is carried into the next segment
        rest, at, d, places_of = self.pending, 0, 0, starts.tolist()
        for stop in cuts[1:]:
            begin = at
            while at < stop:
                doc_id, before, total, held = rest[d]
                take = min(stop, places_of[d + 1]) - at
                inside = at - places_of[d]
                piece = held[inside * 4 : (inside + take) * 4]
                yield doc_id, before + inside, take, zlib.crc32(piece), total, self.sequence, at - begin
                at += take
                if at == places_of[d + 1]:
                    d += 1
            self.sequence += 1
        inside = at - places_of[d] if d < len(rest) else 0
        left = rest[d:]
        if left and inside:
            doc_id, before, total, held = left[0]
            left[0] = (doc_id, before + inside, total, held[inside * 4 :])
        self.pending, self.tokens = left, sum(len(x[3]) // 4 for x in left)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        words = word_table(path)
        packer = Packer(words.sentence_ends(), TaskContext.get().partitionId() << 32)
        columns = lambda rows: batch(schema, *(list(c) for c in zip(*rows, strict=True)))
        for b in batches:
            rows = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += packer.add(doc_id, words.ids(t.as_py()) + end)
            if rows:
                yield columns(rows)
        if rows := list(packer.flush(True)):
            yield columns(rows)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_bytes(text)).mapInArrow(run, PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
