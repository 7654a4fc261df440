import math
import random
import zlib
from collections import Counter

import numpy as np

from marlstone.llm import language, toxicity


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op8_language(spark, sf_dir).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_symbols_beyond_the_bmp_are_no_letters(odd):
    model = language.train(odd.where("lang is not null"))
    assert model.predict("😀 🎉🚀 𝟘") == ("und", 0.0)
    assert (language.counts("one😀two") == language.counts("one two")).all()
    # CJK extension B and Deseret have letters there
    assert language.counts("𠀀").any() and language.counts("𐐷").any()


def test_language_odd_rows(spark, odd, nothing):
    model = language.train(odd.where("lang is not null"))
    rows = odd.select("doc_id", language.predictor(model)("text").alias("p")).select("doc_id", "p.*").collect()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 8)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 5)} <= {"en", "de", "fr"}
    empty = language.train(nothing)
    assert empty.labels == [] and empty.predict("some text") == ("und", 0.0)
    assert nothing.select(language.predictor(model)("text")).count() == 0


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "Ünïcode und 中文, words " * 50
    whole = language.counts(text)
    monkeypatch.setattr(language, "SLICE", 37)
    assert (language.counts(text) == whole).all() and whole.sum() == 3 * len(text)
    assert not language.counts("12 !? \n").any()


def test_document_frequencies_count_all_rows(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    found = {r.feature: r.df for r in language.document_frequencies(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    want = sum((language.counts(t) > 0).astype(int) for t in texts)
    assert found.pop(-1) == len(texts) and found == {i: n for i, n in enumerate(want.tolist()) if n}


def test_elastic_net_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows = [(np.array([i % 3, 10 + rng.integers(50)]), np.array([0.9, 0.4])) for i in range(300)]
    y = np.array([i % 3 for i in range(300)])
    w = language.ftrl(rows, y, 3, l1=0.5)
    assert (w[100:] == 0).all() and (np.argmax(w[:3], axis=1) == [0, 1, 2]).all()
    logits = rng.normal(size=(2000, 3))
    drawn = np.array([rng.choice(3, p=p) for p in language.softmax(logits / 2.5)])
    assert 2.0 < language.calibrate(logits, drawn) < 3.2


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, sf_dir).collect() if r.doc_id in truth]
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out]
    caught = [p for t, p in held if t]
    assert sum(caught) / len(caught) > 0.85  # some labels there are on texts of junk alone
    assert sum(p for t, p in held if not t) / len(held) < 0.01


def lexicon():
    rng = random.Random(9)
    filler = lambda: " ".join("".join(rng.choices("bcdfghkmnprsuvwz", k=rng.randrange(4, 9))) for _ in range(30))
    toxic = [f"you {w} {filler()} you {w}" for w in ("wretch", "ninnyhammer") for _ in range(30)]
    clean = [filler() for _ in range(90)] + [f"a cardboard wretch of kindness {filler()}" for _ in range(2)]
    return toxicity.fit(toxic + clean, [1] * 60 + [0] * 92, exceptions=("paper wretch",))


def test_lexicon_folds_and_excuses():
    model = lexicon()
    assert model.score("You wretch, such a ninnyhammer!") > 0.7
    assert model.score("You wr3tch, such a n1nnyh@mmer!") > 0.7
    assert model.score("you wrеtсh, you wrеtсh") > 0.7  # Cyrillic letters
    assert model.score("a paper wretch") == model.score("") == model.score(None) < 0.5
    assert model.score("bewretched is another word") < 0.5
    long = "word " * 20000
    assert model.score(long + "wretch") < model.score("wretch") and model.score(long) < 0.5


def test_toxicity_odd_rows(spark, odd, nothing):
    model = lexicon()
    rows = odd.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()
    assert len(rows) == 12 and all(0 <= r.s < 0.5 for r in rows)
    labels = spark.createDataFrame([(1, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(odd, labels).score("anything") < 0.01
    assert toxicity.train(nothing, labels).score("") < 0.01
    assert nothing.select(toxicity.scorer(model)("text")).count() == 0


def brute_language(model, text):
    """The prediction by plain dictionaries of n-grams, one feature at a time."""
    plain = [c if c.isalpha() else " " for c in text.lower()]
    if not any(c != " " for c in plain):
        return "und", 0.0
    codes, mask, found = [32, 32, *map(ord, plain)], 0xFFFFFFFF, Counter()
    mix = [int(m) for m in language.MIX]
    for end in range(2, len(codes)):
        for order in (1, 2, 3):
            gram = codes[end - order + 1 : end + 1]
            key = gram[0] * mix[0] & mask
            for k, c in enumerate(gram[1:], start=1):
                key = (key * mix[1] & mask) ^ (c * mix[k] & mask)
            if order > 1:
                key = key * mix[2] & mask
            found[(order - 1) * (1 << language.BITS) + (key >> (32 - language.BITS))] += 1
    x = {f: (1 + math.log(n)) * model.idf[f] for f, n in found.items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    z = [sum(v / length * model.weights[f, k] for f, v in x.items()) / model.temperature for k in range(len(model.labels))]
    e = [math.exp(v - max(z)) for v in z]
    return model.labels[e.index(max(e))], max(e) / sum(e)


def test_language_predictions_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    texts = [r.text or "" for r in docs.select("text").limit(120).collect()] + ["", "😀 12", "Ünï 𐐷 中文", "a"]
    for text in texts:
        label, score = model.predict(text[:3000])
        want, likely = brute_language(model, text[:3000])
        assert label == want and abs(score - likely) < 1e-9


def test_no_language_is_left_out(spark, monkeypatch):
    """More languages than a fixed table would hold, repeated doc_ids with other languages, and ties between languages."""
    monkeypatch.setattr(language, "ROWS", 600)
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 4 * 230)]
    rows = [(k * 3 + i, "".join(rng.choices(alphabet[4 * k : 4 * k + 4], k=40)), f"l{k:03d}") for k in range(230) for i in range(3)]
    rows += [(0, rows[0][1], "l001"), (None, rows[3][1], "l001")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == [f"l{k:03d}" for k in range(230)]
    tied = spark.createDataFrame([(i, "abc def", lang) for i, lang in enumerate("ab" * 10)], "doc_id long, text string, lang string")
    assert language.train(tied).predict("abc")[0] in ("a", "b")
    assert language.train(tied).predict("abc") == language.train(tied).predict("abc")


def brute_score(model, text):
    """The score by looking for each entry and exception at each place of the folded text."""
    folded, hits, excused = toxicity.fold(text or ""), [], set()
    for at in range(len(folded)):
        for p in model.exceptions:
            if folded.startswith(f" {p}", at):
                excused |= set(range(at + 1, at + 1 + len(p)))
        hits += [(at + 1, e) for e in model.weights if folded.startswith(f" {e}", at)]
    hits = [e for at, e in hits if at not in excused]
    x = (1.0, 0.0, 0.0, 0.0)
    if hits:
        words, times = max(1, len((text or "").split())), Counter(hits)
        total, distinct = sum(model.weights[e] for e in hits), sum(model.weights[e] for e in times)
        x = (1.0, math.log1p(100 * total / words), math.log1p(distinct), math.log1p(max(model.weights[e] * (n - 1) for e, n in times.items())))
    z = sum(c * v for c, v in zip(model.coefficients, x, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def test_toxicity_scores_match_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own, learned = lexicon(), toxicity.train(docs, labels)
    assert learned.weights and own.exceptions
    texts = [r.text for r in docs.where("n_chars < 1500").select("text").limit(150).collect()]
    texts += [None, "", "a paper wretch", "paper wretch wretch", "the\tpaper\nwretch\twr3tch", "cardboard wretch of kindness"]
    for model in (own, learned):
        for text in texts:
            assert abs(model.score(text) - brute_score(model, text)) < 1e-9


def test_toxicity_repeated_labels_and_long_texts(spark):
    rng = random.Random(5)
    filler = lambda: " ".join("".join(rng.choices("bcdfghkmnp", k=6)) for _ in range(8))
    docs = [(i, f"you wretch {filler()} wretch" if i % 2 else f"good day {filler()}", "en") for i in range(80)] + [(1, "you wretch again", "en"), (200, "wretch " * 5000, "en")]
    labels = [(i, 1, i % 2) for i in range(80)] + [(0, 1, None), (1, 0, 0), (200, 1, 1)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # a row that one label calls toxic is; a text over LONGEST is not learned from but scored whole
    assert model.score("wretch " * 5000) > model.score("good day") and len("wretch " * 5000) > toxicity.LONGEST


def test_copies_count_once_in_the_odds():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("bcdfghkmnp", k=7))
    toxic, clean = [f"{word()} grumph {word()} grumph" for _ in range(40)], [f"{word()} {word()} {word()}" for _ in range(60)]
    once = toxicity.fit(toxic + clean, [1] * 40 + [0] * 60).weights
    copied = toxicity.fit(toxic + [toxic[0]] * 500 + clean + [clean[0]] * 500, [1] * 540 + [0] * 560).weights
    assert once == copied != {}


def test_each_language_has_its_share_of_the_ngrams(spark, monkeypatch):
    """The bound on n-grams takes documents from all languages, and a class from none."""
    texts = {"en": "the cat and the other thing", "es": "el gato y las otras cosas", "xx": "zq xk wv zq qx kz"}
    rows = [(i, f"{texts[lang]} {chr(97 + i % 26) * 3}", lang) for i, lang in enumerate(["en"] * 60 + ["es"] * 30 + ["xx"] * 2)]
    rows += [(1000, "the same one", "en")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = []
    real = language.fit
    monkeypatch.setattr(language, "fit", lambda found, langs, idf: taken.append((found, langs)) or real(found, langs, idf))
    for entries in (10, 600, 10**6):
        monkeypatch.setattr(language, "ENTRIES", entries)
        assert language.train(docs).labels == ["en", "es", "xx"]
    sizes = [{lang: sum(len(at) for (at, _), own in zip(found, langs, strict=True) if own == lang) for lang in texts} for found, langs in taken]
    assert [langs.count("en") for _, langs in taken][0] == 1 and all(n <= 200 for n in sizes[1].values())
    assert {lang: taken[2][1].count(lang) for lang in texts} == {"en": 61, "es": 30, "xx": 2}
