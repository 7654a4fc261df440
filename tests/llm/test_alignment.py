"""Lockstep merging against plain loops, and the digest columns from them."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marlstone.llm import alignment as al
from marlstone.llm.common import table
from marlstone.llm.piece_codec import default_model


@pytest.fixture(scope="module")
def tables():
    return al.Both(al.default_bytes_tokenizer(), default_model())


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(al.default_bytes_tokenizer())
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=default_model())


def plain(libraries, text):
    """a, b, links, groups of one text, token by token."""
    first, second = libraries
    none = [], [], [], []
    if not text:
        return none
    whole = (" " + text).encode()
    signs = {c: bytes([b]) for c, b in al.byte_letters().items()}
    found = first.encode(" " + text, add_special_tokens=False)
    a, a_bytes = found.ids, [b"".join(signs[c] for c in t) for t in found.tokens]
    b = second.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return none
    spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
    sa, sb = spans(a_bytes), spans(b_bytes)
    links = [(i, j) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y]
    cuts = sorted({y for _, y in sa} & {v for _, v in sb})
    groups, low = [], 0
    for cut in cuts:
        groups.append(([a[i] for i, (_, y) in enumerate(sa) if low < y <= cut], [b[j] for j, (_, v) in enumerate(sb) if low < v <= cut]))
        low = cut
    return a, b, links, groups


def brute(libraries, rows):
    docs = [(doc_id, *plain(libraries, text)) for doc_id, text in rows]
    count = Counter(p for _, a, b, links, _ in docs for p in {(a[i], b[j]) for i, j in links})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, a, b, links, groups in docs:
        met = [(a[i], b[j]) for i, j in links]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in met), sum(count[p] for p in met), digest))
    return sorted(out, key=str)


PARTS = [" ", "  ", "\n", "the ", "tokenizer ", "Über", "é", "\t", "12 345", "!!", "中文", "😀", "\r\n", "<|endoftext|>", "</s>", "don't ", "\0", "▁", "　", "\x85", "x" * 9, "antidis", "estab"]


def some_texts(seed, many):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 25))) for _ in range(many)]


def test_ranks_give_what_the_file_gives(tables):
    assert tables.ranked is not None
    r = random.Random(12)
    signs = [chr(c) for c in (*range(0x20, 0x250), 0, 9, 10, 13, 0x85, 0xA0, 0x2003, 0x3000, 0x4E2D, 0x1F600, 0x200B)]
    for _ in range(20_000):
        text = "".join(r.choice(signs if r.random() < 0.3 else "abcdefghijkrstu'd l 0.1") for _ in range(r.randrange(1, 25)))
        assert np.frombuffer(tables.encode_a(text), np.int32).tolist() == tables.first.encode(text, add_special_tokens=False).ids


def test_words_give_what_the_libraries_give(tables):
    for text in some_texts(1, 3000):
        a, b, whole = tables.encode_a(" " + text), tables.encode_b(text), (" " + text).encode()
        same = tables.a.join(a) == whole == tables.b.join(b)
        assert tables.tokens(text) == ((a, b) if same else (b"", b"")) or not text


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_merging_in_lanes_equals_one_pair_at_a_time(libraries, lane):
    texts = some_texts(lane, 120)
    tables = al.Both(al.default_bytes_tokenizer(), default_model(), limit=7)
    g = al.Group(tables, [t.encode() for t in texts], lane)
    for k, text in enumerate(texts):
        a, b, links, groups = plain(libraries, text)
        low, high = g.links[k : k + 2]
        assert list(zip((g.i[low:high] - g.at_a[k]).tolist(), (g.j[low:high] - g.at_b[k]).tolist(), strict=True)) == links
        assert g.a[g.at_a[k] : g.at_a[k + 1]].tolist() == a and g.b[g.at_b[k] : g.at_b[k + 1]].tolist() == b
        assert g.cuts[k + 1] - g.cuts[k] == len(groups)


def test_lanes_begin_at_common_ends():
    rng = np.random.default_rng(1)
    a_ends, b_ends = (np.unique(np.append(rng.integers(1, 40_000, n), 40_000)) for n in (9000, 7000))
    starts = al.lanes(np.array([0]), a_ends, b_ends, 50)
    assert len(starts) > 100 and starts[0] == 0 and np.isin(a_ends[starts[1:] - 1], b_ends).all()
    i, j, cut_a, _ = al.merge(starts, a_ends, b_ends)
    one = al.merge(np.array([0]), a_ends, b_ends)
    assert (i == one[0]).all() and (j == one[1]).all() and (cut_a == one[2]).all()
    assert (a_ends[cut_a] == np.intersect1d(a_ends, b_ends)).all()


@pytest.mark.parametrize("most", [0, 10**6])
def test_counts_equal_brute_force(spark, libraries, most):
    texts = [*some_texts(5, 60), "the tokenizer ", "the tokenizer ", None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in al.alignments(docs, most=most).collect()), key=str) == brute(libraries, rows)


def test_lists(spark, libraries):
    rows = list(enumerate(some_texts(9, 40)))
    found = {r.doc_id: r for r in al.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        a, b, links, groups = plain(libraries, text)
        r = found[doc_id]
        assert (r.a_ids, r.b_ids, list(zip(r.link_a, r.link_b, strict=True)), len(r.cuts)) == (a, b, links, len(groups))
        if a:
            assert r.a_ends[-1] == r.b_ends[-1] == r.cuts[-1] == len((" " + text).encode())


def test_odd_rows(spark, odd, nothing, libraries):
    short = odd.where("length(text) < 1000 or text is null")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    assert sorted((tuple(r) for r in al.alignments(short).collect()), key=str) == brute(libraries, rows)
    long = {r.doc_id: r for r in al.alignments(odd).collect()}
    assert long[6].n_groups == long[6].n_a == 20000 + 1 and long[7].n_links > 0
    assert al.alignments(nothing).collect() == []
    assert al.alignments(nothing).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_gives_a_row_for_each_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = al.op12_alignment(spark, sf_dir)
    assert found.count() == docs.count()
    assert found.where("n_links <> n_a + n_b - n_groups or (n_a = 0) <> (groups_sha256 = '')").count() == 0
