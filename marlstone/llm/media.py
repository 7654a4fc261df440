"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images,
written as NPY tiles with difference hashes.

Any byte payload can be stored as a grey picture 64 samples wide (binary PGM, 8 bits a
sample), so that every byte is one sample and the picture is lossless.

Defined results: null counts as empty and gives one row of zero samples; repeated rows and
equal texts give equal values; an empty table gives an empty result; extra columns are not
read; a picture that cannot be parsed raises ValueError.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import batch, small_batches, table, text_bytes

WIDTH = 64
#: Sides of the stored tiles.
TILE = 16
FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def to_pgm(payload: bytes) -> bytes:
    """A payload, padded with zero bytes to a positive multiple of 64, as a binary PGM."""
    rows = max(1, -(-len(payload) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload + bytes(rows * WIDTH - len(payload))


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array of height x width, or x 3 for colours; bitmaps have 1 for black."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm picture")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := FIELD.match(data, at)):
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, depth = (*fields, 1)[:3]
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    if kind == b"P1":
        found = re.findall(rb"[01]", re.sub(rb"#[^\n]*", b"", data[at:]))
        return np.array(found[: height * width]).astype(np.uint8).reshape(shape)
    dtype = np.dtype(">u2" if depth > 255 else "u1")
    if kind in (b"P2", b"P3"):
        found = re.sub(rb"#[^\n]*", b"", data[at:]).split()
        return np.array([int(x) for x in found[: int(np.prod(shape))]], dtype.newbyteorder("=")).reshape(shape)
    at += 1  # one white-space byte ends the header
    if kind == b"P4":
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)
        return bits[:, :width]
    n = int(np.prod(shape))
    if len(data) < at + n * dtype.itemsize:
        raise ValueError("short Netpbm picture")
    return np.frombuffer(data, dtype, n, at).reshape(shape)


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, 24 or 32 bits, to height x width x 3 in RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this BMP layout is not supported")
    stride = (width * bits // 8 + 3) & ~3
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def read_picture(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def grey(picture: np.ndarray) -> np.ndarray:
    return picture if picture.ndim == 2 else (picture.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000


def area_resize(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each target cell's area, read off the integral image at fractional corners."""
    sums = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1))
    np.cumsum(np.cumsum(picture, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def along(values: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n + 1) * ((values.shape[0] - 1) / n)
        low = np.minimum(at.astype(np.int64), values.shape[0] - 2)
        part = (at - low)[:, None]
        return values[low] * (1 - part) + values[low + 1] * part

    corners = along(along(sums, height).T, width).T
    cells = np.diff(np.diff(corners, axis=0), axis=1)
    return cells * (height * width / (picture.shape[0] * picture.shape[1]))


def difference_hash(picture: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is brighter than its left neighbour; 16 hex digits."""
    small = np.round(area_resize(picture, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(picture: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(picture, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as a stored PGM picture."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            payloads = b.column(1).to_pylist()
            yield batch(schema, b.column(0), [len(p) for p in payloads], [to_pgm(p) for p in payloads])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_bytes(text)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Decode the column media; payload facts, the stored form's facts, NPY tile and difference hash."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tile", pa.binary()), ("feature", pa.string())]
    )

    def row(data: bytes):
        picture = read_picture(data)
        payload = picture.tobytes()
        cells = grey(picture)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
            len(data), hashlib.sha256(data).hexdigest(), npy_tile(cells), difference_hash(cells),
        )

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows = [row(m.as_py()) for m in b.column(2)]
                yield batch(schema, b.column(0), b.column(1), *(list(c) for c in zip(*rows, strict=True)))

    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string"
    )


def write_tiles(found: DataFrame, path: str) -> None:
    """NPY tiles and difference hashes as a table, one row per document."""
    found.select("doc_id", "tile", F.col("feature").alias("difference_hash")).write.parquet(path)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents"))).drop("tile")


QUERIES = {"op4_media": op4_media}
SQL: dict[str, str] = {}
