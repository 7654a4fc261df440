import hashlib
import io
import zlib

import numpy as np
import pytest

from marlstone.llm import media, packing, piece_codec
from marlstone.llm.common import WordCache


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def expected_pieces(text, library):
    ids = [*library.encode(text), 2]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))


def test_piece_round_trip_is_the_librarys(spark, sf_dir):
    library = piece_codec.ChunkTable(piece_codec.default_model()).library
    texts = texts_of(spark, sf_dir)
    rows = piece_codec.op9_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected_pieces(texts[r.doc_id], library)


def test_piece_odd_texts(odd, nothing):
    chunks = piece_codec.ChunkTable(piece_codec.default_model())
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.round_trip(odd).collect()}
    assert rows == {(r.doc_id, *expected_pieces(r.text or "", chunks.library)) for r in odd.collect()}
    for text in ("", " ", "  ", "a ", " a", "a  b", "   \n  ", "é\0x", "▁", "　x y", "á b"):
        assert chunks.digests(text) == expected_pieces(text, chunks.library)
        assert np.frombuffer(chunks.encode(text), np.int32).tolist() == [*chunks.library.encode(text), 2]
    assert piece_codec.round_trip(nothing).count() == 0


def test_piece_table_is_bounded():
    chunks = piece_codec.ChunkTable(piece_codec.default_model(), limit=3)
    assert chunks.digests("a b c d e f g") == expected_pieces("a b c d e f g", chunks.library)
    assert len(chunks) <= 3


def test_encode_then_decode(odd):
    back = {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(odd)).collect()}
    assert back[1] == "one two three four five six" and back[2] == "" and back[6] == "word " * 20000


def check_pieces(rows, texts, library, size=packing.WINDOW):
    """texts: list of (doc_id, text). Every id in one piece, sequences gapless and at most size long."""
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts}
    sequences, tokens = {}, 0
    for r in rows:
        have = ids[r.doc_id]
        assert r.doc_tokens == len(have)
        assert r.ids_crc32 == zlib.crc32(have[r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        tokens += r.length
    assert tokens == sum(len(ids[d]) for d, _ in texts)
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / tokens


def test_packing_covers_every_id_once(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    rows = packing.op2_packing(spark, sf_dir).collect()
    starts = {}
    for r in rows:
        starts.setdefault(r.doc_id, []).append((r.start, r.length))
    for found in starts.values():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))
    library = packing.WordTable(packing.default_tokenizer()).library
    assert check_pieces(rows, list(texts.items()), library) < 0.02


def test_packing_odd_texts(odd, nothing):
    library = packing.WordTable(packing.default_tokenizer()).library
    check_pieces(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], library)
    assert packing.pack(nothing).count() == 0


def test_segments_carry_their_last_window(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 300)
    rng = np.random.default_rng(1)
    packer = packing.Packer(np.zeros(50, bool), 0, size=100)
    lengths, rows = rng.integers(1, 250, 60).tolist(), []
    for d, n in enumerate(lengths):
        rows += packer.add(d, np.arange(n, dtype="<u4").tobytes())
    rows += packer.flush(True)
    for d, n in enumerate(lengths):
        pieces = [r for r in rows if r[0] == d]
        assert sum(r[2] for r in pieces) == n
        for _, start, length, crc, total, _, _ in pieces:
            assert total == n and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())


def test_windows_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        places = np.append(0, np.cumsum(rng.integers(1, 9, 14)))
        costs = rng.integers(0, 6, len(places)).astype(float)

        def cheapest(j, places=places, costs=costs):
            best = [0.0] + [1e9] * j
            for b in range(1, j + 1):
                for a in range(b):
                    if places[b] - places[a] <= 16:
                        best[b] = min(best[b], best[a] + 16 - places[b] + places[a] + costs[b])
            return best[j]

        cuts = packing.windows(places, costs, 16)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        spent = sum(16 - (places[b] - places[a]) + costs[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert spent == cheapest(len(places) - 1)


def test_media_facts(spark, sf_dir, odd, nothing):
    texts = texts_of(spark, sf_dir)
    for r in media.op4_media(spark, sf_dir).collect():
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        stored = media.to_pgm(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
    rows = media.features(media.store(odd)).collect()
    assert len(rows) == 12 and {r.payload_bytes for r in rows if not r.n_bytes} == {64}
    assert np.load(io.BytesIO(rows[0].tile)).shape == (16, 16)
    assert media.features(media.store(nothing)).count() == 0


def test_media_formats():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.read_picture(b"P2 # note\n4 3\n11\n" + b" ".join(b"%d" % x for x in range(12))) == grey).all()
    assert (media.read_picture(b"P5\n4 3\n255\n" + grey.tobytes()) == grey).all()
    assert (media.read_picture(b"P1\n3 2\n1 0 1\n0 1 0\n") == [[1, 0, 1], [0, 1, 0]]).all()
    assert (media.read_picture(b"P4\n3 2\n\xa0\x40") == [[1, 0, 1], [0, 1, 0]]).all()
    colours = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (media.read_picture(b"P6 4 2 255\n" + colours.tobytes()) == colours).all()
    assert (media.read_picture(b"P3 4 2 255\n" + b" ".join(b"%d" % x for x in range(24))) == colours).all()
    import struct

    head = lambda bits, used: struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + 4 * used, 40, 4, 2, 1, bits, 0, 0, 0, 0, used, 0)
    assert (media.read_picture(head(24, 0) + colours[::-1, :, ::-1].tobytes()) == colours).all()
    palette = np.arange(32, dtype=np.uint8).reshape(8, 4)
    cells = np.arange(8, dtype=np.uint8).reshape(2, 4)
    assert (media.read_picture(head(8, 8) + palette.tobytes() + cells[::-1].tobytes()) == palette[cells][:, :, 2::-1]).all()
    for bad in (b"GIF", b"P5\n9 9\n255\nshort", b"P5\nx"):
        with pytest.raises(ValueError):
            media.read_picture(bad)


def test_area_resize_is_the_mean():
    picture = np.arange(48, dtype=float).reshape(6, 8)
    assert np.allclose(media.area_resize(picture, 3, 4), picture.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(picture, 1, 1), picture.mean())
    assert np.allclose(media.area_resize(np.full((5, 7), 3.0), 8, 9), 3)


def test_words_by_parts_are_the_librarys(spark, sf_dir):
    table = packing.WordTable(packing.default_tokenizer())
    assert table.parts is not None
    words = {w for t in texts_of(spark, sf_dir).values() for w in t.encode().split()}
    words |= {(chr(c) + s).encode() for c in [*range(0x21, 0x250), 0x301, 0x2028, 0x3A3, 0x1F600] for s in ("", "A", "b'S", "9", "é", "'ll", "́")}
    words |= {w.encode() for w in ("don't", "'RE", "x<|endoftext|>y", "<|", "''s", "'", "1a'd2", "it'll!!", "Ŀl", "ŉa", "ſ", "a\x1cb", "a\xa0b")}
    for w in sorted(words):
        assert table[w] == np.array(table.library.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes(), w


def test_padding_and_cuts_with_lengths_that_need_none():
    """The cheapest cuts of a whole brute force in which lengths of a power of two cost no padding."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        places = np.append(0, np.cumsum(rng.choice([64, 100, 128, 156, 256, 300], 12)))
        costs = rng.choice([0.0, 4.0, 32.0], len(places))
        best = [0.0] + [np.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = places[j] - places[i]
                if n <= 600:
                    best[j] = min(best[j], best[i] + costs[j] + (0 if n in (256, 512) else 600 - n))
        cuts = packing.windows(places, costs, 600)
        total = sum(costs[j] + (0 if places[j] - places[i] in (256, 512) else 600 - (places[j] - places[i])) for i, j in zip(cuts, cuts[1:], strict=False))
        assert total == pytest.approx(best[-1])


def test_boundaries_and_their_costs():
    ends = np.zeros(10, bool)
    ends[7] = True
    ids = np.full(700, 1, "<u4")
    ids[[9, 399]] = 7
    places, costs = packing.boundaries(ids, np.array([0, 300]), ends, 600)
    found = dict(zip(places.tolist(), costs.tolist(), strict=True))
    assert [found[p] for p in (0, 300, 700)] == [0, 0, 0] and [found[p] for p in (10, 400)] == [packing.SENTENCE_CUT] * 2
    assert {c for p, c in found.items() if p not in (0, 10, 300, 400, 700)} == {packing.HARD_CUT}
    assert np.diff(places).max() <= packing.GAP


def brute_cells(picture, height, width):
    """The mean of each target cell, pixel by pixel with the share of it that lies in the cell."""
    rows, columns = picture.shape
    share = lambda at, k, n, size: max(0.0, min(at + 1, (k + 1) * size / n) - max(at, k * size / n))
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            parts = [(share(y, i, height, rows) * share(x, j, width, columns), float(picture[y, x])) for y in range(rows) for x in range(columns)]
            out[i, j] = sum(w * v for w, v in parts) / sum(w for w, _ in parts)
    return out


def test_media_feature_and_tiles(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 400").limit(12).cache()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = media.features(media.store(docs))
    for r in found.collect():
        picture = media.read_picture(media.to_pgm(texts[r.doc_id].encode()))
        cells = np.round(brute_cells(picture, 8, 9), 6)
        bits = "".join("1" if cells[i, j + 1] > cells[i, j] else "0" for i in range(8) for j in range(8))
        assert r.feature == f"{int(bits, 2):016x}"
        assert (np.load(io.BytesIO(r.tile)) == np.clip(np.rint(brute_cells(picture, 16, 16)), 0, 255)).mean() > 0.99
    media.write_tiles(found, f"{tmp_path}/tiles")
    back = spark.read.parquet(f"{tmp_path}/tiles").collect()
    assert {r.doc_id for r in back} == set(texts) and all(np.load(io.BytesIO(r.tile)).shape == (16, 16) for r in back)


def test_word_cache_forgets_the_oldest_and_long_words():
    made = []

    class Upper(WordCache):
        def make(self, word):
            made.append(word)
            return word.upper()

    cache = Upper(2, longest=5)
    assert [cache[w] for w in "abcab"] == list("ABCAB") and made == ["a", "b", "c"]  # a and b came back from the older generation
    assert len(cache) <= 2 and len(cache.older) <= 2
    assert cache["abcdef"] == cache["abcdef"] == "ABCDEF" and made.count("abcdef") == 2
    assert "abcdef" not in cache
