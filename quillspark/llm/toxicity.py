"""Toxicity with a subsequence string kernel and a support vector machine.

Two words have the gap-weighted subsequence kernel of length 3: subsequences of three letters (word edges are letters too) that span at most
SPAN + 1 places count DECAY for each place skipped; the kernel is normalised and raised to the power POWER, which leaves near matches
only. Inserted and left-out characters cost some of a match, not all. Marks inside a word are dropped, digits between letters are read as
the letters that they stand for, and single letters in a row (``i d i o t``) are one word.

Nyström landmarks are words: those that set toxic documents apart in the fit, no two of them alike, and common ones. A word maps to its
kernels with them, times K_mm^(-1/2), and a linear support vector machine (squared hinge) is trained there on labelled sentences, as a
multiple-instance SVM: every word of a clean document's sentences is negative; of a toxic document, the sentences that hold a witness are
positive, through their witness (the telling words first, then in each turn what the last machine finds, at least one a document). A
sentence's margin is that of its best word; margins of words already met are kept. A text's score is a logistic function, fitted on the
labels, of the margins of all its sentences.

No sentence or spelt word reaches from one text into another, and margins are sums of multiples of a power of two that fit a double's mantissa, so
a text's score is the same to the last bit whatever texts stand beside it. Of the labelled texts only their distinct words and a few numbers
a text reach the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import written
from ._sample import balanced, checksum_rest
from ._text import Words, groups, slices, tidy

#: Labelled documents of each label to fit on, with their whole texts. A bound that doesn't depend on the table.
FIT_ROWS = 1000
LANDMARKS = 64
SPAN, DECAY, POWER = 4, 0.6, 3
SENTENCE = 24
#: Weight of all negative words, of the positive ones 1.
STRICT = 10.0
#: Weight of the variants of a telling word with a character put in or left out, of the word 1.
BENT = 0.1
#: Words whose margins a worker remembers.
REMEMBERED = 1_200_000
_KERNEL_BITS = 20
_PATTERNS = [(m, s, DECAY ** (s - 2)) for s in range(2, SPAN + 1) for m in range(1, s)]
# Letters that digits and marks stand for between letters.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def plain(word: str) -> str:
    """The letters of a word."""
    word = word.lower()
    if word.isalpha():
        return word
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalpha():
        lo += 1
    while hi > lo and not word[hi - 1].isalpha():
        hi -= 1
    return "".join(filter(str.isalpha, word[lo:hi].translate(STANDS_FOR)))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the gap-weighted subsequences: (word, code, weight), sorted by word, of length one a word."""
    gap = SPAN
    text = ("\0" * gap).join("\1" + w + "\2" for w in words) + "\0" * gap
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    small = np.where((codes >= 97) & (codes < 123), codes - 94, np.where(codes < 3, codes, 29 + codes % 35))
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 + gap for w in words])
    real = codes > 0
    keys, weights = [], []
    n = len(codes) - gap
    for m, s, weight in _PATTERNS:
        at = np.flatnonzero(real[:n] & real[m : n + m] & real[s : n + s] & (owner[:n] == owner[s : n + s]))
        keys.append(owner[at] << 18 | small[at] << 12 | small[at + m] << 6 | small[at + s])
        weights.append(np.full(len(at), weight))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys, weights = keys[first], np.add.reduceat(weights, first) if len(first) else weights
    word = keys >> 18
    norm = np.sqrt(np.bincount(word, weights=weights**2, minlength=len(words)))
    return word, keys & 0x3FFFF, weights / norm[word]


@dataclass
class Model:
    place: np.ndarray  # row in table of each code, or -1
    table: np.ndarray  # landmarks' weights of the codes that they hold
    weights: np.ndarray  # of each landmark, multiples of 2 ** -bits
    bits: int
    bias: float
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    logistic: np.ndarray | None = None


def _landmark_table(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    word, code, weight = features(marks)
    used = np.unique(code)
    place = np.full(1 << 18, -1, np.int32)
    place[used] = np.arange(len(used))
    table = np.zeros((len(used), len(marks)), np.float32)
    table[place[code], word] = weight
    return place, table


def kernels(words: list[str], place: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Words x landmarks."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for at in range(0, len(words), 2000):
        word, code, weight = features(words[at : at + 2000])
        held = place[code] >= 0
        word, rows = word[held], table[place[code[held]]] * weight[held, None].astype(np.float32)
        if len(word):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[at + word[first]] = np.add.reduceat(rows, first)
    return out**POWER


def _unlike(words: list[str], most: int) -> list[str]:
    """The first words that are no near matches of one already taken."""
    if not words:
        return []
    k = kernels(words, *_landmark_table(words))
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) < most and (not taken or k[i, taken].max() < 0.4):
            taken.append(i)
    return [words[i] for i in taken]


def _bent(words: list[tuple[int, str]]) -> tuple[list[str], np.ndarray]:
    """Of each word of five letters or more its variants with a foreign letter put in or an inner letter left out, and whose they are."""
    out, of = [], []
    for i, w in words:
        if len(w) >= 5:
            for k in range(1, len(w)):
                out += [w[:k] + "xqwk"[k % 4] + w[k:], *([w[:k] + w[k + 1 :]] if k < len(w) - 1 else [])]
            of += [i] * (len(out) - len(of))
    return out, np.array(of, np.int64)


class Sentences:
    """Words of texts by hash, with the sentence of each and the text of each sentence."""

    def __init__(self, texts: list[str]):
        w = Words(texts)
        n = len(w.hash)
        text = np.repeat(np.arange(len(texts)), np.diff(w.first))
        last = w.codes[w.end - 1] if n else np.zeros(0, np.uint32)
        ends = (last == 46) | (last == 33) | (last == 63) | (w.codes[w.end] == 10) if n else np.zeros(0, bool)
        starts = np.concatenate(([True], ends[:-1])) if n else ends
        if n:
            starts[w.first[:-1][w.first[:-1] < n]] = True
        begin = np.flatnonzero(starts)
        within = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        starts |= within % SENTENCE == 0
        self.sentence = np.cumsum(starts) - 1
        self.text_of_sentence = text[starts]
        self.hash, self._w, self.words = w.hash, w, np.diff(w.first)
        self.spelled = self._spelled()

    def _spelled(self) -> list[tuple[int, str]]:
        """(place, word) of each run of three or more single letters of a text."""
        w = self._w
        at = np.flatnonzero((w.end - w.start == 1) & (w.codes[w.start] > 64)) if len(w.start) else np.zeros(0, np.int64)
        text = np.searchsorted(w.first, at, "right")
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        return [(int(at[a]), "".join(map(chr, w.codes[w.start[at[a:b]]]))) for a, b in zip(begin, [*begin[1:], len(at)]) if b - a >= 3]

    def word(self, i: int) -> str:
        return self._w.codes[self._w.start[i] : self._w.end[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _describe(margins: np.ndarray, text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each text (words: how many it has): its three largest margins, and how many sentences are over the margin, softly, in all and by length."""
    n = len(words)
    out = np.full((n, 5), -1.0)
    order = np.lexsort((-margins, text))
    sorted_text = text[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_text, sorted_text)
    for k in range(3):
        at = order[place == k]
        out[text[at], k] = np.clip(margins[at], -1, 8)
    soft = np.bincount(text, weights=1 / (1 + np.exp(np.clip(-6 * margins, -30, 30))), minlength=n)
    out[:, 3], out[:, 4] = np.log1p(soft), np.log((soft + 0.1) / (words / 200 + 1))
    return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression with a last, unpenalised column of ones."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Primal Newton for the squared hinge; y holds the margins asked for, with the sign of the class; the last column of z is ones."""
    w = np.zeros(z.shape[1])
    for _ in range(30):
        on = np.sign(y) * (y - z @ w) > 0
        zs, ws = z[on], weight[on]
        new = np.linalg.solve((zs * ws[:, None]).T @ zs + ridge * np.eye(len(w)), zs.T @ (ws * y[on]))
        if abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def vocabulary(texts: list[str]) -> list[list[str]]:
    """Of each text its distinct words, as letters, in order."""
    out: list[list[str]] = []
    for lo, hi in groups([len(t) for t in texts]):
        s = Sentences(texts[lo:hi])
        unique, first, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
        letters = [plain(s.word(i)) for i in first]
        edges = np.concatenate(([0], np.cumsum(s.words)))
        found = [{letters[i] for i in set(inverse[a:b].tolist())} for a, b in zip(edges[:-1], edges[1:])]
        for i, w in s.spelled:
            found[int(np.searchsorted(edges, i, "right")) - 1].add(plain(w))
        out += [sorted(x) for x in found]
    return out


def learn(held: list[list[str]], labels: list[int]) -> Model | None:
    """The machine, from the distinct words of labelled texts. None if a label is missing or there are no words."""
    y = np.array(labels, int)
    if not (0 < y.sum() < len(y)):
        return None
    names = sorted(set().union(*held))
    if not names:
        return None
    number = {w: i for i, w in enumerate(names)}
    pairs = np.array([t * len(names) + number[w] for t, ws in enumerate(held) for w in ws], np.int64)
    word_of_pair, toxic = pairs % len(names), y[pairs // len(names)] == 1
    in_toxic, in_clean = np.bincount(word_of_pair[toxic], minlength=len(names)), np.bincount(word_of_pair[~toxic], minlength=len(names))
    odds = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_clean + 0.5) / ((1 - y).sum() + 1))
    long = np.array([len(w) >= 3 for w in names])
    # A word tells if its counts are too far from the labels' shares for chance among so many words; if none does, any that leans that way.
    expected = (in_toxic + in_clean) * y.mean(), (in_toxic + in_clean) * (1 - y.mean())
    surprise = 2 * sum(n * np.log(np.maximum(n, 1e-9) / e) for n, e in zip((in_toxic, in_clean), expected))
    leaning = long & (in_toxic >= 2) & (odds > 1)
    sure = leaning & (surprise > 1.4 * np.log(len(names)))
    telling = np.where(sure if sure.any() else leaning, in_toxic * odds, 0.0)
    marks = _unlike([names[i] for i in np.argsort(-telling, kind="stable")[: LANDMARKS * 8] if telling[i] > 0], LANDMARKS * 3 // 4)
    common = [names[i] for i in np.argsort(-np.where(long & (telling == 0), in_clean, 0), kind="stable")[: LANDMARKS * 4]]
    marks += _unlike([w for w in common if w not in set(marks)], LANDMARKS - len(marks))
    place, table = _landmark_table(marks)

    k = kernels(names, place, table)
    own = kernels(marks, place, table).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.column_stack((k @ root, np.ones(len(k))))
    witness = telling > 0
    negative = in_clean > 0
    bent, bent_of = _bent([(i, names[i]) for i in np.argsort(-telling, kind="stable")[: LANDMARKS * 8].tolist() if telling[i] > 0])
    bent = np.column_stack((kernels(bent, place, table) @ root, np.ones(len(bent)))) if bent else np.zeros((0, z.shape[1]))
    for _ in range(3):
        positive = witness
        asked = np.where(positive, np.clip(odds / 2, 0.5, 3.0), -1.0)
        weight = np.where(positive, in_toxic, in_clean).astype(float)
        use = positive | negative
        weight = np.where(positive, weight / weight[positive].sum(), weight**0.5 / (weight[negative & ~positive] ** 0.5).sum())
        weight = np.where(positive, 1.0, STRICT) * weight * 20_000
        changed = witness[bent_of]
        changed_weight = weight[bent_of[changed]] * BENT / max(1, len(bent) / max(1, len(set(bent_of.tolist()))))
        weights = _svm(np.vstack((z[use], bent[changed])), np.concatenate((asked[use], 0.7 * asked[bent_of[changed]])), np.concatenate((weight[use], changed_weight)), 1.0)
        margin = z @ weights
        able = np.where(telling > 0, margin, -np.inf)[word_of_pair]
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, pairs // len(names), able)
        chosen = np.unique(word_of_pair[toxic & np.isfinite(able) & (able >= best[pairs // len(names)])])
        witness = (telling > 0) & (margin > 0)
        witness[chosen] = True
    flat = root @ weights[:-1]
    bits = int(52 - _KERNEL_BITS - np.ceil(np.log2(max(1.0, abs(flat).sum()))))
    return Model(place, table, np.rint(flat * 2.0**bits), bits, float(weights[-1]))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, prior: float) -> None:
    """Fits the logistic function to the descriptions x of labelled texts; prior: share of label 1 among all labelled rows."""
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack(((x - model.centre) / model.spread, np.ones(len(y))))
    model.logistic = _newton(z, y, np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())), 0.5)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[int, float] = {}  # by a word's hash
        self.spelt: dict[str, float] = {}  # by its letters

    def margins(self, words: list[str]) -> list[float]:
        letters = [plain(w) for w in words]
        new = list({w for w in letters if w not in self.spelt})
        m = self.model
        exact = np.rint(kernels(new, m.place, m.table).astype(np.float64) * (1 << _KERNEL_BITS)) @ m.weights
        self.spelt.update(zip(new, (exact * 2.0 ** (-m.bits - _KERNEL_BITS) + m.bias).tolist()))
        return [self.spelt[w] for w in letters]

    def describe(self, texts: list[str]) -> np.ndarray:
        """What the logistic function sees of each text."""
        out = np.zeros((len(texts), 5))
        for lo, hi in groups([len(t) for t in texts]):
            s = Sentences(texts[lo:hi])
            if len(self.known) + len(self.spelt) > REMEMBERED:
                self.known, self.spelt = {}, {}
            unique, first, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
            keys = unique.tolist()
            new = [i for i, h in enumerate(keys) if h not in self.known]
            self.known.update(zip([keys[i] for i in new], self.margins([s.word(first[i]) for i in new])))
            each = np.array([self.known[h] for h in keys])[inverse] if keys else np.zeros(0)
            margins = np.full(len(s.text_of_sentence), -np.inf)
            if len(each):
                begin = np.flatnonzero(np.concatenate(([True], s.sentence[1:] != s.sentence[:-1])))
                margins = np.maximum.reduceat(each, begin)
            if s.spelled:
                np.maximum.at(margins, s.sentence[[i for i, _ in s.spelled]], self.margins([w for _, w in s.spelled]))
            out[lo:hi] = _describe(margins, s.text_of_sentence, s.words)
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        m = self.model
        x = (self.describe(texts) - m.centre) / m.spread
        total = np.full(len(texts), m.logistic[-1])
        for k in range(x.shape[1]):
            total += x[:, k] * m.logistic[k]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


_scorers: dict[str, Scorer] = {}  # of the model met last, kept from task to task


def fitted(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0) -> Model | None:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), from FIT_ROWS of each label that aren't held out, and all of their texts.

    Labels of null doc_id or toxic, or of a doc_id that isn't in docs, are ignored; of a doc_id with several labels each counts.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & (checksum_rest(divisor) != held_out)).select("doc_id", "toxic")
    shares = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    chosen = balanced(rows, "toxic", FIT_ROWS).drop("place")
    texts = written(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text"), "fit")  # 2 * FIT_ROWS ids

    def words(batches):
        for batch in batches:
            for at, some in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(at, len(some)), pa.array(vocabulary(some), pa.list_(pa.string()))], names=["toxic", "words"])

    found = sorted(map(tuple, texts.select("toxic", "text").mapInArrow(tidy(words), "toxic int, words array<string>").collect()))
    model = learn([w for _, w in found], [y for y, _ in found])
    if model is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for at, some in slices(batch):
                x = scorer.describe(some)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(at, len(some)), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["toxic", *(f"x{k}" for k in range(x.shape[1]))])

    told = np.array(sorted(map(tuple, texts.select("toxic", "text").mapInArrow(tidy(describe), "toxic int, " + ", ".join(f"x{k} double" for k in range(5))).collect())))
    calibrate(model, told[:, 1:], told[:, 0].astype(int), shares.get(1, 0) / max(1, sum(shares.values())))
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) of every row of docs (doc_id, text; other columns are ignored).

    A null text is scored as an empty one. Repeated rows get a row each, of the same score. A null doc_id counts as held out. If the labels
    hold no two classes, every score is 0. An empty table gives no rows.
    """
    model = fitted(docs, labels)
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(batches):
        found = _scorers.get(name) if sent.value else None
        if sent.value and found is None:
            _scorers.clear()
            found = _scorers[name] = Scorer(sent.value)
        for batch in batches:
            for at, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(found(texts) if found else np.zeros(len(texts)), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(score), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(checksum_rest(5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
