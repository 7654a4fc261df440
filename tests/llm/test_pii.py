"""Base spans against plain rules, the network against brute force and numeric gradients, added spans on held-out windows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from marlstone.llm import pii
from marlstone.llm.common import table


def plain_base(text):
    """The contract's rules, each said in another way than in the module."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = [int(c) for c in m[0] if c.isdigit()]
        check = sum(n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9) for k, n in enumerate(reversed(number)))
        if 14 <= len(number) <= 19 and check % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append(("phone", *m.span()))
    order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def test_base_spans():
    draw = random.Random(4)
    parts = ["a.b", "@", "x-1", ".", "org", " ", "+", "1", "22", "255", "256", "4111", "-", "(", ")", "5555555555554444", "é", "\n", "0", ".0.0.1", "+44 20 7946 0958", "00378282246310005"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text
    text = "é mail a.b@c.d.org, 010.2.3.255 and 256.1.1.1, 4111 1111-1111 1111, 4111111111111112 and +1 (017) 555-7713"
    assert [(k, text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "a.b@c.d.org"), ("ip", "010.2.3.255"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (017) 555-7713")]
    assert pii.listed([("phone", 3, 9), ("ip", 3, 5), ("email", 1, 2)]) == "email:1:2,ip:3:5,phone:3:9"


def small(hidden=3, seed=1, rows=4):
    w = {k: v.astype(np.float64) for k, v in pii.new_weights(hidden, seed).items()}
    rng = np.random.default_rng(seed)
    for k in ("steps", "first", "bias"):
        w[k] = rng.normal(0, 1, w[k].shape)
    texts = ["a@b.c x", "10(.)2", "+1", ""][:rows]
    x = np.zeros((len(texts), 7), np.int16)
    for row, t in zip(x, texts, strict=True):
        row[: len(t)] = pii.classes(t)
    return w, x


def taggings(steps):
    for tags in itertools.product(range(len(pii.TAGS)), repeat=steps):
        if not pii.FIRST_FORBIDDEN[tags[0]] and not any(pii.FORBIDDEN[a, b] for a, b in itertools.pairwise(tags)):
            yield tags


def test_loss_and_best_tags_equal_brute_force():
    w, x = small()
    x = x[:, :4]
    scores = pii.emissions(w, pii.run_lstm(w, x)[0])
    step, first = pii.transitions(w)
    total = lambda row, tags: first[tags[0]] + sum(scores[t, row, k] for t, k in enumerate(tags)) + sum(step[a, b] for a, b in itertools.pairwise(tags))
    every = list(taggings(4))
    best = pii.viterbi(w, scores)
    loss = 0.0
    gold = np.array([every[7 * r + 11] for r in range(len(x))])
    for r in range(len(x)):
        sums = np.array([total(r, tags) for tags in every])
        assert tuple(best[r]) == every[int(sums.argmax())]
        loss += np.log(np.exp(sums - sums.max()).sum()) + sums.max() - total(r, gold[r])
    assert pii.crf_loss(w, scores, gold)[0] == pytest.approx(loss, rel=1e-6)


def test_gradients_equal_differences():
    w, x = small()
    tags = np.array([[1, 2, 2, 0, 3, 4, 0], [0, 0, 5, 6, 6, 1, 1], [7, 8, 0, 0, 0, 0, 0], [0] * 7])
    _, grads = pii.loss_and_gradients(w, x, tags)
    rng = np.random.default_rng(2)
    for name, g in grads.items():
        flat = w[name].reshape(-1)
        places = rng.choice(len(flat), min(25, len(flat)), replace=False)
        if name == "chars":  # those that the texts have
            places = np.flatnonzero(np.abs(g).reshape(-1) > 1e-6)[::17]
        for k in places:
            was = flat[k]
            flat[k] = was + 1e-5
            up = pii.loss_and_gradients(w, x, tags)[0]
            flat[k] = was - 1e-5
            down = pii.loss_and_gradients(w, x, tags)[0]
            flat[k] = was
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-5, abs=2e-4), name


def test_stitching_keeps_spans_that_no_window_holds_whole():
    length = 2 * pii.STRIDE + pii.WIDTH
    truth = np.zeros(length, np.int8)
    truth[30:150] = 2
    truth[30] = 1
    sure = np.linspace(0, 1, length).astype(np.float32)
    parts = [(truth[k : k + pii.WIDTH], sure[k : k + pii.WIDTH]) for k in range(0, length - pii.WIDTH + 1, pii.STRIDE)]
    tags, p = pii.stitch(parts)
    assert (tags == truth).all() and (p == sure).all()
    assert list(pii.tagged(tags)) == [("email", 30, 150)]
    wrong = parts[1][0].copy()
    wrong[:4] = 0  # a window does not see well at its edge
    assert (pii.stitch([parts[0], (wrong, parts[1][1]), parts[2]])[0] == truth).all()
    assert list(pii.tagged(np.array([1, 2, 3, 4, 4, 0, 2, 3], np.int8))) == [("email", 0, 2), ("ip", 2, 5), ("email", 6, 7), ("ip", 7, 8)]


def test_best_set_equals_all_sets():
    draw = random.Random(3)
    for _ in range(200):
        spans = []
        for _ in range(draw.randrange(0, 8)):
            start = draw.randrange(0, 20)
            spans.append((draw.choice(pii.KINDS), start, start + draw.randrange(1, 8), draw.random()))
        found = pii.best_set(spans)
        assert all(a[2] <= b[1] for a, b in itertools.pairwise(found))
        apart = lambda some: all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(some, 2))
        most = max(sum(s[3] for s in some) for n in range(len(spans) + 1) for some in itertools.combinations(spans, n) if apart(some))
        score = {s[:3]: s[3] for s in sorted(spans, key=lambda s: s[3])}
        assert sum(score[f] for f in found) == pytest.approx(most)


@pytest.fixture(scope="module")
def sample(spark):
    """Labelled windows of the documents, in two halves without a text in common."""
    found = pii.labelled_windows(table(spark, "/root/testdata/sf0.1", "documents"), 400)
    return found[::2], found[1::2]


@pytest.fixture(scope="module")
def weights(sample):
    return pii.fit(*pii.training_rows(sample[0]), epochs=4)


def test_disguised_spans_of_unseen_windows_are_found(sample, weights):
    draw, wanted, met, texts = random.Random(8), 0, 0, []
    for item in sample[1]:
        for kind, start, end in item.spans[:1]:
            new = pii.disguise(kind, item.text[start:end], draw)
            text = f"{item.text[:start]}{new}{item.text[end:]}"
            if pii.undisguised(kind, new) and not pii.Covered(pii.base_spans(text)).meets(start, start + len(new)) and end < pii.WIDTH:
                texts.append((text, (kind, start, start + len(new))))
    added = pii.added_spans([t for t, _ in texts], [pii.base_spans(t) for t, _ in texts], weights)
    for (_, span), own in zip(texts, added, strict=True):
        wanted += 1
        met += span in own
    assert wanted > 60 and met / wanted > 0.85


def test_clean_texts_get_no_spans(spark, weights):
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("text").where("text is not null").collect()
    texts = [r.text for r in rows]
    added = pii.added_spans(texts, [pii.base_spans(t) for t in texts], weights)
    assert sum(map(len, added)) == 0
    draw = random.Random(5)
    decoys = [f"the value was {pii.decoy(draw)} in that case" for _ in range(300)]
    assert sum(map(len, pii.added_spans(decoys, [pii.base_spans(t) for t in decoys], weights))) <= 3


def test_added_spans_and_redaction(spark, weights):
    text = "write to nt.34 at mail7 dot example dot com or a.b@c.org, é (017) 555-7713 end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs, weights).collect()}
    kinds = [(s.kind, text[s.start : s.stop], s.base) for s in found[1].spans]
    assert ("email", "a.b@c.org", True) in kinds and ("email", "nt.34 at mail7 dot example dot com", False) in kinds
    assert "<EMAIL> or <EMAIL>, é" in found[1].redacted and found[2].redacted == found[3].redacted == ""
    assert found[2].spans == []


def test_odd_rows(spark, odd, nothing):
    assert pii.train(nothing) is None and pii.train(odd) is None
    found = sorted((tuple(r) for r in pii.digests(odd, None).collect()), key=str)
    assert len(found) == odd.count() and {r[-1] for r in found} == {0}
    assert pii.digests(nothing, None).collect() == []
    assert {r[5] for r in found if r[0] == 2} == {hashlib.sha256(b"").hexdigest()}
    long = "1 " * 60_000 + "a@b.cd" + " 9.9.9.9" * 3
    w = pii.new_weights()
    rows = pii.digests(spark.createDataFrame([(1, long)], "doc_id long, text string"), w).collect()
    assert rows[0].n_ip == 3 and rows[0].n_email == 1


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    found = pii.op13_pii(spark, sf_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        base = plain_base(docs[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
