"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters they stand for
and everything that is no letter to a space, one character for one character. The lexicon
holds word beginnings, learned from labelled rows: those that occur in significantly many
toxic documents. Hits inside exception phrases do not count. A document's evidence is the
weight of its hits normalised by its length, that of its distinct entries and of its most
repeated one; a logistic function fitted on the same rows turns it into a score.

Fitting takes at most LABELLED rows with texts of at most LONGEST characters, those whose
doc_id hashes lowest. Scoring takes every whole text.

Defined results: null counts as empty, and an empty text gets the score of a text without
hits; without labelled rows of both kinds all scores are 0; repeated rows each get their
score; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import crc_mod, hash_sample, small_batches, table

#: The bound on the sample that the lexicon is learned from.
LABELLED, LONGEST = 6000, 20_000
REJECT = 0.7
#: An entry's length, and how many entries of all candidates may be accidental.
SHORTEST_ENTRY, LONGEST_ENTRY, ACCIDENTAL = 4, 12, 1.0
#: Clean documents with an entry, at most so many for each toxic one; its share of the toxic
#: documents at least, so that the words of one often copied document are no entries.
IMPURE, SHARE = 0.2, 0.02
#: Phrases in which a lexicon word means no harm.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown nose")


@lru_cache(maxsize=1)
def folding() -> dict[int, int]:
    """Code points to their folded letter, or to a space; l and i are one letter, as 1 stands for both."""
    pairs = dict(zip("013457$@|", "oieastsai", strict=True))
    pairs |= dict(zip("аеорсухіѕјԁһкмт", "aeopcyxisjdhkmt", strict=True))  # Cyrillic
    pairs |= dict(zip("αεικνορτυχ", "aeiknoptux", strict=True))  # Greek
    pairs |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {"l": "i", "ł": "i", "ı": "i"}
    found = {c: 32 for c in range(0x3000) if not chr(c).isalpha()}
    found |= {ord(a): ord("i" if b == "l" else b) for a, b in pairs.items()}
    return found


def fold(text: str) -> str:
    return f" {text.lower().translate(folding())} "


def log_tail(toxic: int, clean: int, rate: float) -> float:
    """Log10 of the binomial chance that of so many documents at least so many are toxic."""
    n = toxic + clean
    total = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)) for k in range(toxic, n + 1))
    return math.log10(max(total, 1e-300))


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-50.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(f" {entry}", (len(entry), entry, weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase}", (len(phrase), None, 0.0))
            self._automaton.make_automaton()
        return self._automaton

    def evidence(self, text: str) -> tuple[float, float, float]:
        """Logarithms of the weight per 100 words, of distinct entries, and of the most repeated entry."""
        if not self.weights:
            return 0.0, 0.0, 0.0
        folded = fold(text)
        hits, excused = [], []
        for end, (size, entry, weight) in self.automaton().iter(folded):
            if entry is None:
                excused.append((end - size + 1, end))
            else:
                hits.append((end - size + 1, entry, weight))
        if excused:
            hits = [h for h in hits if not any(a <= h[0] <= b for a, b in excused)]
        if not hits:
            return 0.0, 0.0, 0.0
        words = max(1, len(text.split()))
        times = Counter(h[1] for h in hits)
        distinct = sum(self.weights[e] for e in times)
        repeated = max(self.weights[e] * (k - 1) for e, k in times.items())
        return math.log1p(100 * sum(h[2] for h in hits) / words), math.log1p(distinct), math.log1p(repeated)

    def score(self, text: str | None) -> float:
        x = sum(c * v for c, v in zip(self.coefficients, (1.0, *self.evidence(text or "")), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def beginnings(text: str) -> Counter:
    """Beginnings of the text's folded words, with the number of words that have them."""
    return Counter(w[:n] for w in fold(text).split() for n in range(SHORTEST_ENTRY, min(len(w), LONGEST_ENTRY) + 1))


def sketch(found: Counter) -> tuple[int, ...]:
    """Minima of two hashes: mostly equal for near copies alone."""
    keys = [f.encode() for f in found]
    return tuple(min((zlib.crc32(k, seed) for k in keys), default=0) for seed in (1, 2))


def entries(toxic: list[Counter], clean: list[Counter], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Significant beginnings, as short as they are pure, with their log odds.

    toxic and clean count the documents that have a beginning at all, and those that repeat
    it: a word that clean texts have by chance may still be one that only toxic ones repeat.
    """
    rate = n_toxic / (n_toxic + n_clean)
    most = math.log10(ACCIDENTAL / max(1, sum(n >= 4 for n in toxic[0].values())))
    longer: dict[str, list[str]] = {}
    for f in toxic[0]:
        longer.setdefault(f[:-1], []).append(f)

    least = max(4, SHARE * n_toxic)

    def odds(f: str, t: Counter, c: Counter) -> float:
        if t[f] < least or c[f] > IMPURE * t[f] or log_tail(t[f], c[f], rate) > most:
            return 0.0
        return math.log((t[f] + 0.5) / (n_toxic + 1)) - math.log((c[f] + 0.5) / (n_clean + 1))

    found: dict[str, float] = {}
    for f in sorted(toxic[0], key=lambda f: (len(f), f)):
        if toxic[0][f] < least or any(f[:k] in found for k in range(SHORTEST_ENTRY, len(f))):
            continue
        value, k = max((odds(f, toxic[k], clean[k]), -k) for k in (0, 1))
        if value < 2:
            continue
        t, best = toxic[-k], f
        while nxt := next((g for g in longer.get(best, ()) if t[g] >= 0.95 * t[best] and clean[-k][g] <= clean[-k][best]), None):
            best = nxt
        found[best] = value
    return found


def phrases(texts: list[str], labels: list[int], weights: dict[str, float]) -> list[str]:
    """A lexicon word with the word before or after it, in at least two clean and in no toxic documents."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    sizes = sorted({len(e) for e in weights})
    for text, label in zip(texts, labels, strict=True):
        words, own = fold(text).split(), set()
        for i, w in enumerate(words):
            if any(w[:n] in weights for n in sizes):
                own |= {" ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}
        seen[label].update(p for p in own if " " in p)
    return [p for p, n in seen[0].items() if n >= 2 and not seen[1][p]]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients by Newton's method; the first column of x is 1 and is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    counts = [[Counter(), Counter()], [Counter(), Counter()]]
    n, seen = Counter(), set()
    for text, label in zip(texts, labels, strict=True):
        found = beginnings(text)
        if (mark := sketch(found)) in seen:  # a copy, or nearly one, says nothing new
            continue
        seen.add(mark)
        n[label] += 1
        counts[label][0].update(found.keys())
        counts[label][1].update(f for f, k in found.items() if k > 1)
    if not n[0] or not n[1]:
        return Lexicon()
    weights = entries(counts[1], counts[0], n[1], n[0])
    folded = [fold(p).strip() for p in exceptions]
    model = Lexicon(weights, tuple(dict.fromkeys([*folded, *phrases(texts, labels, weights)])))
    x = np.array([(1.0, *model.evidence(t)) for t in texts])
    model.coefficients = tuple(logistic(x, np.array(labels, float)).tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, most: int = LABELLED) -> Lexicon:
    """The lexicon from the labelled rows of docs for which the condition rows holds."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where(F.lit(True) if rows is None else rows).where(F.length("text").between(1, LONGEST)).select("doc_id", "text")
    chosen = hash_sample(marked.join(texts.select("doc_id"), "doc_id", "left_semi"), "doc_id", most)
    sample = texts.join(chosen, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(most).collect()
    return fit([r.text for r in sample], [int(r.toxic > 0) for r in sample])


def scorer(model: Lexicon):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(model.score).astype(float)

    return score


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = crc_mod("doc_id", 3)
    model = train(docs, table(spark, sf_dir, "labels"), remainder != 1)
    small_batches(spark)
    scored = docs.select("doc_id", (remainder == 1).alias("held_out"), scorer(model)(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
