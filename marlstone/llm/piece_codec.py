"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model holds a white-space marker after another character, so segmentation
never crosses the start of a marked word. A text is cut into marked words (a run of spaces
and what follows up to the next space); each distinct marked word is segmented once, kept for
the worker's life, over all of its tasks, in a table of two generations of bounded size, and the
ids are joined back by position. Words over 100 characters are segmented anew each time.

Defined results: null counts as empty; an empty text has the end id alone; a text with a
literal U+2581 or NUL goes to the library whole; repeated rows each get their own result;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import WordCache, batch, small_batches, table, text_bytes

#: Marked words kept by one worker in each of two generations.
TABLE_SIZE = 400_000
MARKED = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable(WordCache):
    """Marked word (without its first space) -> ids as int32 bytes, ids in decimal, decoded UTF-8."""

    def __init__(self, model_path: str, limit: int = TABLE_SIZE):
        import sentencepiece

        super().__init__(limit)
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space marker")
        self.end = self.library.eos_id()
        self.blank = self.library.piece_to_id("▁")
        self.lead = self.library.encode("a", num_threads=1)

    def make(self, word: str):
        ids = self.library.encode(word, num_threads=1) if word else [self.blank]
        decoded = self.library.decode(self.lead + ids)[1:]
        return np.array(ids, np.int32).tobytes(), " ".join(map(str, ids)).encode(), decoded.encode()

    def rows(self, text: str) -> list | None:
        """The table's rows by position; None if the text must go to the library whole."""
        if "▁" in text or "\0" in text:
            return None
        if not text:
            return []
        if "  " in text or text[0] == " ":
            return [self[c[1:]] for c in MARKED.findall(f" {text}")]
        return [self[w] for w in text.split(" ")]

    def encode(self, text: str) -> bytes:
        """int32 ids, the end id last."""
        end = np.int32(self.end).tobytes()
        if (rows := self.rows(text)) is None:
            return np.array(self.library.encode(text, num_threads=1), np.int32).tobytes() + end
        return b"".join([r[0] for r in rows]) + end

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        if (rows := self.rows(text)) is None:
            ids = [*self.library.encode(text, num_threads=1), self.end]
            listed, decoded = " ".join(map(str, ids)).encode(), self.library.decode(ids).encode()
        else:
            listed = b" ".join([*[r[1] for r in rows], str(self.end).encode()])
            # the marker that the library puts before the text is not in the decoded text
            decoded = b"".join([r[2] for r in rows])[1:] if rows else b""
        return listed.count(b" ") + 1, hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=1)
def chunk_table(model_path: str) -> ChunkTable:
    """One for a worker: it outlives the tasks."""
    return ChunkTable(model_path)


def encode(docs: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> (the end id last), one row per row of docs."""
    model, kind = model_path or default_model(), docs.schema[key].dataType.simpleString()

    def run(batches):
        chunks = chunk_table(model)
        for b in batches:
            ids = [np.frombuffer(chunks.encode(t.as_py().decode()), np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    small_batches(docs.sparkSession)
    return docs.select(key, text_bytes(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, text: the library's decode of the column ids (null ids: the empty text)."""
    model, kind = model_path or default_model(), encoded.schema[key].dataType.simpleString()

    def run(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            texts = [library.decode(i.as_py() or []) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from one pass over the chunk table."""
    model = model_path or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        chunks = chunk_table(model)
        for b in batches:
            rows = [chunks.digests(t.as_py().decode()) for t in b.column(1)]
            yield batch(schema, b.column(0), *(list(c) for c in zip(*rows, strict=True))) if rows else batch(schema, [], [], [], [])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_bytes()).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
