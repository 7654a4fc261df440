"""Personal data by fixed patterns, and by a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans: e-mail and IP addresses, card numbers that pass Luhn's check,
telephone numbers with a plus sign. The network adds disguised ones ("name (at) host dot org",
"10[.]0[.]0[.]7", "5105.1051.0510.5100", "(017) 555-7713"). It is trained in numpy, on the driver, from
windows of the documents that hold base spans or look like it, at most WINDOWS of each kind, those
with the lowest hashes, and from copies of these in which the spans are disguised.

Tagging: around each sign that a span must contain (a digit, an at sign or a spelt-out one) a
stretch of REACH characters is cut into overlapping windows. Each window is decoded by Viterbi's
algorithm; windows of a stretch are stitched where both give the same tag, as near as possible to
the middle of their overlap. Of all spans of a document that are what they seem once the disguise
is undone, and meet no base span, a set without overlaps and of the highest total score is added.

Defined results: null counts as empty and has no spans; without windows to learn from there are
base spans alone; repeated rows each get their row; an empty table gives an empty result; extra
columns are not read. Base spans may be of any length, a disguised one reaches REACH characters from
its sign.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import batch, small_batches, table, text_bytes

KINDS = ("email", "ip", "card", "phone")
# The base patterns, and how many digits cards and telephone numbers have.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = range(14, 20), range(10, 16)

#: The bound on the sample that the network learns from, for each kind and for none.
WINDOWS = 300
WIDTH, STRIDE, REACH = 96, 48, 44
HIDDEN, EPOCHS, RATE, SEED = 16, 4, 0.03, 11
#: Windows decoded at a time.
DECODED = 1024
#: Spans below this mean probability of their tags are not added.
SURE = 0.8


# Base spans -------------------------------------------------------------------------------


def digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def luhn(number: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in number[-2::-2]]
    return (sum(map(int, number[-1::-2])) + sum(twice)) % 10 == 0


def holds(kind: str, text: str) -> bool:
    """Whether a match of the kind's pattern is one of its spans."""
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in text.split("."))
    if kind == "card":
        return len(found := digits(text)) in CARD_DIGITS and luhn(found)
    return kind == "email" or len(digits(text)) in PHONE_DIGITS


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end in code points, by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    if re.search("[0-9]", text):
        for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            if k != 3 or "+" in text:
                found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if holds(KINDS[k], m[0])]
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


# Disguises --------------------------------------------------------------------------------

AT = re.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+", re.IGNORECASE)
DOT = re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+dot\s+", re.IGNORECASE)
GROUPED = re.compile(r"[0-9]{2,}(?:[ ._/-][0-9]{2,})+")
DIALLED = re.compile(r"(?:00|\+)?[0-9]{0,3}[ ./-]{0,2}\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){1,4}")
#: What a span that is not a base span must contain.
SIGNS = re.compile(r"[0-9@]")
SPELT = re.compile(r"[(\[{]\s?at\s?[)\]}]|\sat(?=\s\S+(?:\sdot\s|\s?[(\[{]\s?dot|\.))", re.IGNORECASE)


def undisguised(kind: str, text: str) -> bool:
    """Whether a text is a span of the kind once the disguise is undone."""
    if kind == "email":
        return bool(EMAIL.fullmatch(DOT.sub(".", AT.sub("@", text))))
    if kind == "ip":
        plain = DOT.sub(".", text)
        return bool(IP.fullmatch(plain)) and holds("ip", plain)
    if kind == "card":
        return bool(GROUPED.fullmatch(text)) and holds("card", text)
    return bool(DIALLED.fullmatch(text)) and len(re.findall(r"[0-9]+", text)) > 2 and holds("phone", text)


def disguise(kind: str, text: str, draw: random.Random) -> str:
    """The span in one of the forms that the patterns do not match."""
    if kind == "email":
        name, _, host = text.partition("@")
        at = draw.choice([" at ", "(at)", "[at]", " (at) ", " [at] ", "{at}"])
        return name + at + host.replace(".", draw.choice([" dot ", "(dot)", "[dot]", ".", ".", "[.]"]))
    if kind == "ip":
        return text.replace(".", draw.choice(["[.]", "(.)", " dot ", "(dot)", "[dot]"]))
    if kind == "card":
        number, size = digits(text), draw.choice([4, 4, 4, 3, 5])
        return draw.choice("._/").join(number[k : k + size] for k in range(0, len(number), size))
    plain = re.sub(r"^\+[0-9]{1,3}[ .-]*", draw.choice(["", "", "00" + text[1] + " "]), text)
    return plain.replace("-", draw.choice(["-", "-", "/", " ", "."]))


def decoy(draw: random.Random) -> str:
    """Numbers that are no personal data: years, dates, versions, measures, amounts."""
    year = lambda: str(draw.randrange(1900, 2040))
    few = lambda: str(draw.randrange(1, 100))
    return draw.choice([
        f"{year()} {year()} {year()}", f"{year()}-{few().zfill(2)}-{few().zfill(2)}", f"{few()}.{few()}", f"{few()}.{few()}.{few()}",
        f"{few()},{few().zfill(3)},{few().zfill(3)}", f"{few()} x {few()} x {few()}", str(draw.randrange(10**9, 10**13)), f"{few()}:{few().zfill(2)}", f"{few()}%",
        f"at {few()} dot", "looked at the map", f"at {year()}",
    ])


# Characters and tags ----------------------------------------------------------------------

PAD, LETTER, DIGIT, ALPHA, BREAK, OTHER = 0, 1, 27, 28, 29, 30
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def class_table() -> np.ndarray:
    """Code point below 0x3000 -> its class: each Latin letter in either case, any digit, each ASCII sign, other letters, line ends, the rest."""
    out, signs = np.full(0x3000, OTHER, np.int16), iter(range(OTHER + 1, 128))
    for c in range(0x3000):
        char = chr(c)
        if c < 128:
            out[c] = LETTER + ord(char.lower()) - 97 if char.isalpha() else DIGIT if char.isdigit() else BREAK if char in "\n\r" else next(signs) if char.isprintable() else OTHER
        elif char.isalpha():
            out[c] = ALPHA
    return out


CLASSES = class_table()
N_CLASSES = int(CLASSES.max()) + 1


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(CLASSES), CLASSES[np.minimum(points, len(CLASSES) - 1)], ALPHA).astype(np.int16)


def windows_array(texts: list[str]) -> np.ndarray:
    """Texts of at most WIDTH characters as rows of classes, padded."""
    out = np.zeros((len(texts), WIDTH), np.int16)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = classes(text)
    return out


def tag_array(spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    out = np.zeros((len(spans), WIDTH), np.int8)
    for row, own in zip(out, spans, strict=True):
        for kind, start, end in own:
            row[start:end] = 2 * KINDS.index(kind) + 2
            row[start] -= 1
    return out


# The network ------------------------------------------------------------------------------


def forbidden() -> np.ndarray:
    """Transitions that no tagging has: an inner tag follows the first or an inner one of its kind."""
    out = np.zeros((len(TAGS), len(TAGS)), bool)
    for inner in range(2, len(TAGS), 2):
        out[:, inner] = True
        out[[inner - 1, inner], inner] = False
    return out


FORBIDDEN, FIRST_FORBIDDEN = forbidden(), np.arange(len(TAGS)) % 2 == 0
FIRST_FORBIDDEN[0] = False
NEVER = np.float32(-1e4)


def new_weights(hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {
        "chars": rng.normal(0, 0.3, (2, N_CLASSES, 4 * hidden)), "back": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
        "out": rng.normal(0, 0.3, (2, hidden, len(TAGS))), "bias": np.zeros(len(TAGS)), "steps": np.zeros((len(TAGS), len(TAGS))), "first": np.zeros(len(TAGS)),
    }
    w["chars"][:, :, hidden : 2 * hidden] += 0.5  # the gate that keeps the cell is open at first
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_lstm(w: dict, x: np.ndarray, keep: bool = False):
    """Both directions at once: hidden states (2, steps, rows, hidden), direction 1 from the end. Gates: in, keep, out, new."""
    both_ways = np.stack([x.T, x.T[::-1]])
    steps, rows, n = x.shape[1], x.shape[0], w["back"].shape[1]
    h, c = (np.zeros((2, rows, n), w["chars"].dtype) for _ in range(2))
    out = np.empty((2, steps, rows, n), h.dtype)
    kept = []
    for t in range(steps):
        z = np.matmul(h, w["back"])
        z[0] += w["chars"][0][both_ways[0, t]]
        z[1] += w["chars"][1][both_ways[1, t]]
        z[..., : 3 * n] *= 0.5
        np.tanh(z, out=z)
        z[..., : 3 * n] += 1
        z[..., : 3 * n] *= 0.5
        before = c
        c = z[..., n : 2 * n] * c + z[..., :n] * z[..., 3 * n :]
        bent = np.tanh(c)
        h = z[..., 2 * n : 3 * n] * bent
        out[:, t] = h
        if keep:
            kept.append((z, before, bent))
    return out, both_ways, kept


def emissions(w: dict, hidden: np.ndarray) -> np.ndarray:
    """(steps, rows, tags)"""
    return hidden[0] @ w["out"][0] + hidden[1, ::-1] @ w["out"][1] + w["bias"]


def transitions(w: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.where(FORBIDDEN, NEVER, w["steps"]), np.where(FIRST_FORBIDDEN, NEVER, w["first"])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def forward_backward(w: dict, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums of all taggings up to each tag, and after it, (steps, rows, tags); of all, (rows,)."""
    step, first = transitions(w)
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = first + scores[0]
    for t in range(1, len(scores)):
        ahead[t] = log_sum(ahead[t - 1][:, :, None] + step, 1) + scores[t]
    for t in range(len(scores) - 2, -1, -1):
        behind[t] = log_sum(step + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    return ahead, behind, log_sum(ahead[-1], 1)


def crf_loss(w: dict, scores: np.ndarray, tags: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Sum of negative log probabilities of the tags; its gradients for transitions and for the scores."""
    step, first = transitions(w)
    steps, rows, _ = scores.shape
    ahead, behind, whole = forward_backward(w, scores)
    gradient = np.exp(ahead + behind - whole[:, None])
    moves = np.zeros_like(step)
    for t in range(1, steps):
        moves += np.exp(ahead[t - 1][:, :, None] + step + (scores[t] + behind[t])[:, None, :] - whole[:, None, None]).sum(axis=0)
    at, row = tags.T, np.arange(rows)
    place = np.arange(steps)[:, None]
    own = scores[place, row, at].sum(axis=0) + first[at[0]] + step[at[:-1], at[1:]].sum(axis=0)
    started = gradient[0].sum(axis=0) - np.bincount(at[0], minlength=len(first))
    gradient[place, row, at] -= 1
    np.subtract.at(moves, (at[:-1], at[1:]), 1)
    return float((whole - own).sum()), {"steps": np.where(FORBIDDEN, 0, moves), "first": np.where(FIRST_FORBIDDEN, 0, started)}, gradient


def loss_and_gradients(w: dict, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Over rows of classes and tags; gradients by back-propagation through time."""
    hidden, both_ways, kept = run_lstm(w, x, keep=True)
    loss, grads, d = crf_loss(w, emissions(w, hidden), tags)
    n = w["back"].shape[1]
    grads |= {k: np.zeros_like(w[k]) for k in ("chars", "back")}
    grads["bias"] = d.sum(axis=(0, 1))
    grads["out"] = np.stack([np.einsum("trh,trk->hk", hidden[0], d), np.einsum("trh,trk->hk", hidden[1, ::-1], d)])
    d_hidden = np.stack([d @ w["out"][0].T, (d @ w["out"][1].T)[::-1]])
    dh, dc, back, each = 0, 0, w["back"].transpose(0, 2, 1), np.eye(N_CLASSES, dtype=d.dtype)
    for t in range(len(kept) - 1, -1, -1):
        z, before, bent = kept[t]
        enter, keep, leave, new = (z[..., k * n : (k + 1) * n] for k in range(4))
        dh = dh + d_hidden[:, t]
        dc = dc + dh * leave * (1 - bent * bent)
        dz = np.concatenate([dc * new * enter * (1 - enter), dc * before * keep * (1 - keep), dh * bent * leave * (1 - leave), dc * enter * (1 - new * new)], axis=-1)
        grads["chars"] += np.matmul(each[both_ways[:, t]].transpose(0, 2, 1), dz)
        if t:
            grads["back"] += np.matmul(hidden[:, t - 1].transpose(0, 2, 1), dz)
        dh, dc = np.matmul(dz, back), dc * keep
    return loss, grads


def viterbi(w: dict, scores: np.ndarray) -> np.ndarray:
    """The best tags, (rows, steps)."""
    step, first = transitions(w)
    best, came = first + scores[0], []
    for t in range(1, len(scores)):
        each = best[:, :, None] + step
        came.append(each.argmax(axis=1).astype(np.int8))
        best = each.max(axis=1) + scores[t]
    out = np.empty((scores.shape[1], len(scores)), np.int8)
    out[:, -1] = best.argmax(axis=1)
    row = np.arange(len(out))
    for t in range(len(came) - 1, -1, -1):
        out[:, t] = came[t][row, out[:, t + 1]]
    return out


def decode(w: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of classes: tags, and the probability of each one among all taggings (1 in rows without a span)."""
    tags, sure = np.zeros(x.shape, np.int8), np.ones(x.shape, np.float32)
    if len(x):
        scores = emissions(w, run_lstm(w, x)[0])
        tags = viterbi(w, scores)
        rows = np.flatnonzero(tags.any(axis=1))
        ahead, behind, whole = forward_backward(w, scores[:, rows])
        at = tags[rows].T[:, :, None].astype(np.int64)
        sure[rows] = np.exp(np.take_along_axis(ahead + behind, at, 2)[:, :, 0] - whole).T
    return tags, sure


def fit(x: np.ndarray, tags: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> dict:
    """Weights by Adam over batches of 64 rows, gradients cut to a norm of 5."""
    w, rng = new_weights(hidden, seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(x) // 64)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            _, grads = loss_and_gradients(w, x[rows], tags[rows])
            norm = np.sqrt(sum(float((g / len(rows)).ravel() @ (g / len(rows)).ravel()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = (g / len(rows) * min(1.0, 5 / max(norm, 1e-9))).astype(np.float32)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w[k] = w[k] - (rate * (1 - 0.9 * step / total)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


# Training ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Labelled:
    """A window and its spans, in code points of the window."""

    text: str
    spans: tuple[tuple[str, int, int], ...]


def labelled_windows(docs: DataFrame, most: int = WINDOWS, text: str = "text") -> list[Labelled]:
    """Windows around base spans, and around signs that are in none, at most so many of each kind."""

    def run(batches):
        schema = pa.schema([("kind", pa.string()), ("part", pa.string())])
        for b in batches:
            kinds, parts = [], []
            for t in b.column(0):
                whole = t.as_py().decode()
                spans = base_spans(whole)
                met = [(k, s) for k, s, e in spans if e - s < WIDTH // 2]
                covered = Covered(spans)
                met += [("none", m.start()) for m in SIGNS.finditer(whole) if not covered.meets(m.start(), m.end())][:8]
                for kind, start in met:
                    kinds.append(kind)
                    parts.append(whole[max(0, start - 8 - len(whole) % 37) :][:WIDTH])
            yield batch(schema, kinds, parts)

    small_batches(docs.sparkSession)
    found = docs.select(text_bytes(text)).mapInArrow(run, "kind string, part string").distinct()
    lowest = Window.partitionBy("kind").orderBy(F.xxhash64(F.lit(SEED), "part"), "part")
    rows = found.withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= most).orderBy("kind", "place").collect()
    return [Labelled(r.part, tuple(s for s in base_spans(r.part) if s[2] - s[1] < WIDTH)) for r in rows]


def training_rows(found: list[Labelled], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The windows, three copies with disguised spans, one with a decoy: classes and tags.

    Digits in the shape of a card number count as one, whatever Luhn's check says, which the network cannot learn.
    """
    draw = random.Random(seed)
    texts, spans = [], []
    for item in found:
        shaped = [s for s in item.spans if s[0] != "card"]
        shaped += [("card", m.start(), m.end()) for m in CARD.finditer(item.text) if len(digits(m[0])) in CARD_DIGITS and not any(s < m.end() and m.start() < e for _, s, e in shaped)]
        versions = [(item.text, sorted(shaped, key=lambda s: s[1]))]
        for _ in range(3 if shaped else 0):
            text, own, at = "", [], 0
            for kind, start, end in versions[0][1]:
                if start < at:
                    continue
                new = disguise(kind, item.text[start:end], draw)
                text += item.text[at:start]
                own.append((kind, len(text), len(text) + len(new)))
                text, at = text + new, end
            versions.append((text + item.text[at:], own))
        if not shaped:
            at = draw.randrange(0, 40)
            versions.append((f"{item.text[:at]} {decoy(draw)} {item.text[at:]}", []))
        for text, own in versions:
            texts.append(text[:WIDTH])
            spans.append([(k, s, e) for k, s, e in own if e <= WIDTH])
            if any(s < WIDTH < e for _, s, e in own):  # cut off: no label fits
                texts.pop()
                spans.pop()
    return windows_array(texts), tag_array(spans)


def train(docs: DataFrame, most: int = WINDOWS) -> dict | None:
    """Weights, or None if there is nothing to learn from."""
    found = labelled_windows(docs, most)
    if not any(item.spans for item in found):
        return None
    return fit(*training_rows(found))


# Finding ----------------------------------------------------------------------------------


class Covered:
    """Whether a stretch meets one of the spans."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def stretches(text: str, covered: Covered) -> list[tuple[int, int]]:
    """Where a span that is no base span may be: REACH characters around each sign outside base spans."""
    at = [m.start() for m in SIGNS.finditer(text) if not covered.meets(m.start(), m.end())]
    if "at" in text or "AT" in text or "At" in text:
        at = sorted(at + [m.start() + 1 for m in SPELT.finditer(text)])
    out: list[tuple[int, int]] = []
    for x in at:
        start, end = max(0, x - REACH), min(len(text), x + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def cuts(start: int, end: int) -> list[int]:
    """Where a stretch's windows begin."""
    return [*range(start, max(start + 1, end - WIDTH + STRIDE), STRIDE)]


def stitch(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows' tags and probabilities as one: over at the place, nearest to the middle, from which both agree."""
    tags, sure = parts[0]
    for k, (t, p) in enumerate(parts[1:], 1):
        at = k * STRIDE
        same = np.flatnonzero(tags[at:] == t[: len(tags) - at])
        middle = (len(tags) - at) // 2
        cut = int(same[np.abs(same - middle).argmin()]) if len(same) else middle
        tags, sure = np.concatenate([tags[: at + cut], t[cut:]]), np.concatenate([sure[: at + cut], p[cut:]])
    return tags, sure


def tagged(tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Spans of a stretch's tags; an inner tag without a first one begins a span."""
    at = np.flatnonzero(tags)
    start = None
    for k, x in enumerate(at.tolist()):
        kind = (int(tags[x]) - 1) // 2
        if start is None or tags[x] % 2 == 1 or x != at[k - 1] + 1 or (int(tags[at[k - 1]]) - 1) // 2 != kind:
            start = x
        if k + 1 == len(at) or at[k + 1] != x + 1 or tags[at[k + 1]] % 2 == 1 or (int(tags[at[k + 1]]) - 1) // 2 != kind:
            yield KINDS[kind], start, x + 1


def best_set(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Spans without overlaps with the highest sum of scores; of equal sums that with the earlier ends."""
    spans = sorted(set(spans), key=lambda x: (x[2], x[1], x[0]))
    ends, best = [s[2] for s in spans], [(0.0, ())]
    for k, (kind, start, end, score) in enumerate(spans):
        total, chosen = best[bisect.bisect_right(ends, start, 0, k)]
        best.append(max(best[-1], (total + score, (k, chosen)), key=lambda x: x[0]))
    chosen, out = best[-1][1], []
    while chosen:
        out.append(spans[chosen[0]][:3])
        chosen = chosen[1]
    return out[::-1]


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], w: dict) -> list[list[tuple[str, int, int]]]:
    """For each text the spans that the network adds to the base ones."""
    jobs, windows, covers = [], [], [Covered(b) for b in base]
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]

    def flush():
        decoded = [decode(w, windows_array(windows[k : k + DECODED])) for k in range(0, len(windows), DECODED)]
        tags, sure = (np.concatenate([d[k] for d in decoded]) for k in (0, 1))
        for n, start, end, first, many in jobs:
            own, p = stitch([(tags[k], sure[k]) for k in range(first, first + many)])
            for kind, s, e in tagged(own[: end - start]):
                while e > s and texts[n][start + s].isspace():
                    s += 1
                while e > s and texts[n][start + e - 1].isspace():
                    e -= 1
                score = float(p[s:e].mean()) if e > s else 0.0
                if score >= SURE and not covers[n].meets(start + s, start + e) and undisguised(kind, texts[n][start + s : start + e]) and alone(texts[n], start + s, start + e):
                    found[n].append((kind, start + s, start + e, score))
        jobs.clear()
        windows.clear()

    for n, text in enumerate(texts):
        for start, end in stretches(text, covers[n]):
            at = cuts(start, end)
            jobs.append((n, start, end, len(windows), len(at)))
            windows += [text[x : min(x + WIDTH, end)] for x in at]
            if len(windows) >= 8 * DECODED:
                flush()
    if windows:
        flush()
    return [best_set(f) for f in found]


def alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit stands right before or after."""
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


FOUND = "doc_id long, spans array<struct<kind:string,start:int,stop:int,base:boolean>>, redacted string"


def find(docs: DataFrame, w: dict | None, text: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, stop in code points, whether a base span), and the text with <KIND> in their place."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("redacted", pa.string())])

    def run(batches):
        for b in batches:
            texts = [t.as_py().decode() for t in b.column(1)]
            base, added = spans_of(texts, w)
            rows = [sorted([(s, e, k, True) for k, s, e in x] + [(s, e, k, False) for k, s, e in y]) for x, y in zip(base, added, strict=True)]
            lists = [[{"kind": k, "start": s, "stop": e, "base": own} for s, e, k, own in r] for r in rows]
            yield batch(schema, b.column(0), lists, [redact(t, r) for t, r in zip(texts, rows, strict=True)])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(run, FOUND)


def redact(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """Spans that overlap become one mark, that of the first."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_of(texts: list[str], w: dict | None) -> tuple[list, list]:
    base = [base_spans(t) for t in texts]
    return base, added_spans(texts, base, w) if w is not None else [[] for _ in texts]


DIGESTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
DIGESTS_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGESTS.split(", ")])


def digests(docs: DataFrame, w: dict | None) -> DataFrame:
    """Counts and digest of the base spans, all spans as listed, and how many the network added."""

    def run(batches):
        for b in batches:
            base, added = spans_of([t.as_py().decode() for t in b.column(1)], w)
            counts = [[sum(s[0] == k for s in x) for x in base] for k in KINDS]
            hashes = [hashlib.sha256(listed(x).encode()).hexdigest() for x in base]
            yield batch(DIGESTS_ARROW, b.column(0), *counts, hashes, [listed(x + y) for x, y in zip(base, added, strict=True)], [len(y) for y in added])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, DIGESTS)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(docs, train(docs))


QUERIES = {"op13_pii": op13_pii}
SQL: dict[str, str] = {}
