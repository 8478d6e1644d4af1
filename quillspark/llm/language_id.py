"""Language identification with a string kernel.

A text is cut into windows of WINDOW characters. Two windows have the blended-spectrum presence kernel: the number of n-grams (n = 1 to 3,
of lower-cased letters, all that is no letter being one symbol) that both hold, divided by the root of the product of how many different
ones each holds. N-grams are told apart by 22 bits of a hash. A text's kernel with a landmark is the mean over all its windows, each counting
with its letters. Nyström landmarks (windows of labelled texts) map a text to K(text, landmarks) K_mm^(-1/2); kernel ridge regression against
+1 and -1, one language versus the rest, is solved in that space. Scoring is a product of the presence matrix of a batch of windows with that of
the landmarks, and a product of the kernels with the weights.

No n-gram reaches from one text into another, and sums are of multiples of a power of two that fit a double's mantissa, so a text's result is
the same to the last bit whatever texts stand beside it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import written
from ._sample import balanced, checksum_rest
from ._text import code_points, groups, slices, tidy

WINDOW = 1000
#: Labelled texts of each language to fit on, all their windows, and how many of the commonest languages are learned. Bounds of the sample only.
FIT_ROWS = 400
LANGUAGES = 256
#: Landmarks of all languages together.
LANDMARKS = 160
RIDGE = 1e-3
SHARPNESS = 6.0
#: Windows of one matrix product.
BATCH = 128
UNKNOWN = "und"
_BITS = 22
_KERNEL_BITS, _MEAN_BITS = 20, 18


@cache
def _symbols() -> np.ndarray:
    """Of each code point: a letter's lower case (itself, where that is no single letter), and 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(symbols: np.ndarray) -> list[np.ndarray]:
    """Codes of _BITS bits of the 1-, 2- and 3-grams that begin at each place but the last two."""
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    one = a * np.uint32(0x9E3779B1)
    two = one + b * np.uint32(0x85EBCA77)
    three = two + c * np.uint32(0xC2B2AE3D)
    out = []
    for n, x in enumerate((one, two, three)):
        x = x + np.uint32(0x27D4EB2F * (n + 1) & 0xFFFFFFFF)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - _BITS))
    return out


def _windows(texts: list[str]):
    """Of some texts at a time: (first text, texts, window's text, letters in it, [(first window, windows, keys)]); a key is a window's place << _BITS | n-gram."""
    for lo, hi in groups([len(t) for t in texts]):
        codes, start = code_points(texts[lo:hi])
        symbols = np.append(_symbols()[codes], np.zeros(2, np.uint32))
        lengths = np.diff(start)
        left = np.repeat(start[1:] - 1, lengths) - np.arange(len(codes))  # places to the text's end, which is an edge like any other
        windows = (lengths + WINDOW - 1) // WINDOW
        first = np.cumsum(windows) - windows
        of = np.repeat(first, lengths) + (np.arange(len(codes)) - np.repeat(start[:-1], lengths)) // WINDOW
        n = int(windows.sum())
        letters = np.bincount(of, weights=symbols[:-2] > 0, minlength=n)

        def batches():
            at = np.searchsorted(of, np.arange(0, n + BATCH, BATCH))
            for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                if a < b:
                    window = (of[a:b] - BATCH * k).astype(np.uint32) << np.uint32(_BITS)
                    keys = np.sort(np.concatenate([(window | g)[left[a:b] >= i] for i, g in enumerate(_grams(symbols[a : b + 2]))]))
                    yield BATCH * k, min(BATCH, n - BATCH * k), keys[np.concatenate(([True], keys[1:] != keys[:-1]))]

        yield lo, hi - lo, np.repeat(np.arange(hi - lo), windows), letters, batches()


@dataclass
class Model:
    grams: np.ndarray  # codes of the landmarks' n-grams
    landmarks: np.ndarray  # presence, grams x landmarks
    size: np.ndarray  # root of the n-grams that each landmark holds
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # landmarks x languages, multiples of 2 ** -bits
    bias: np.ndarray | None = None
    bits: int = 0

    def column(self) -> np.ndarray:
        """Of each n-gram code its row in landmarks, or the number of rows."""
        if not hasattr(self, "_column"):
            self._column = np.full(1 << _BITS, len(self.grams), np.int32)
            self._column[self.grams] = np.arange(len(self.grams))
        return self._column

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_column"}


def landmarks(texts: list[str]) -> Model:
    """A model without weights, of windows."""
    held, sizes = [], []
    for text in texts:
        for *_, batches in _windows([text[: WINDOW - 1]]):  # one window with its edge
            for _, _, keys in batches:
                held.append(keys)
                sizes.append(len(keys))
    grams = np.unique(np.concatenate([*held, np.zeros(0, np.uint32)]))
    table = np.zeros((len(grams), len(held)), np.float32)
    for i, keys in enumerate(held):
        table[np.searchsorted(grams, keys), i] = 1
    return Model(grams, table, np.sqrt(np.maximum(sizes, 1)))


def kernels(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x landmarks, letters of each text); rows of texts without a letter are 0."""
    out, count = np.zeros((len(texts), len(model.size))), np.zeros(len(texts))
    column, width = model.column(), len(model.grams)
    for lo, n, text, letters, batches in _windows(texts):
        total = np.zeros((n, len(model.size)))
        for first, some, keys in batches:
            window, place = keys >> np.uint32(_BITS), column[keys & np.uint32((1 << _BITS) - 1)]
            own = np.bincount(window, minlength=some)
            held = np.zeros((some, width + 1), np.float32)
            held[window, place] = 1
            # Whole numbers up to this point, so the product is exact.
            each = (held[:, :width] @ model.landmarks).astype(np.float64) / np.sqrt(np.maximum(own, 1))[:, None] / model.size
            at = np.s_[first : first + some]
            np.add.at(total, text[at], np.rint(each * (1 << _KERNEL_BITS)) * letters[at, None])
        sums = np.bincount(text, weights=letters, minlength=n)
        out[lo : lo + n], count[lo : lo + n] = total / np.maximum(sums, 1)[:, None] / (1 << _KERNEL_BITS), sums
    return out, count


def solve(model: Model, rows: np.ndarray, languages: list[str]) -> Model:
    """The model with weights, from the kernels of labelled texts: ridge regression in the Nyström space, each language of the same weight."""
    names = sorted(set(languages))
    k_mm = (model.landmarks.T @ model.landmarks).astype(np.float64) / model.size[:, None] / model.size
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.column_stack((rows @ root, np.ones(len(rows))))
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    share = 1 / np.array([languages.count(x) for x in languages])
    w = np.linalg.solve(z.T @ (z * share[:, None]) + RIDGE * np.eye(z.shape[1]), z.T @ (target * share[:, None]))
    weights = root @ w[:-1]
    bits = int(52 - _MEAN_BITS - np.ceil(np.log2(max(1.0, abs(weights).sum(0).max()))))
    return Model(model.grams, model.landmarks, model.size, names, np.rint(weights * 2.0**bits), w[-1], bits)


def decide(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1, the share that the best language has in the softmax of the decisions) of whole texts."""
    rows, letters = kernels(model, texts)
    decision = (np.rint(rows * (1 << _MEAN_BITS)) @ model.weights) * 2.0 ** (-model.bits - _MEAN_BITS) + model.bias
    best = decision.argmax(1)
    rest = np.zeros(len(texts))
    for c in range(decision.shape[1]):
        rest += np.exp(SHARPNESS * (decision[:, c] - decision[np.arange(len(texts)), best]))
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters)], np.where(letters > 0, 1 / np.maximum(rest, 1), 0.0)


def _embedded(rows: DataFrame, model: Model) -> tuple[list[str], np.ndarray]:
    """Languages and kernels of the texts (lang, text) that have a letter, in an order of their own."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def embed(batches):
        for batch in batches:
            for at, texts in slices(batch):
                found, letters = kernels(sent.value, texts)
                keep = np.flatnonzero(letters)
                flat = pa.array(found[keep].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * found.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, len(texts)).take(pa.array(keep)), lists], names=["lang", "kernels"])

    # FIT_ROWS rows of LANDMARKS numbers a language.
    found = sorted(rows.select("lang", "text").mapInArrow(tidy(embed), "lang string, kernels array<double>").collect(), key=lambda r: (r["lang"], r["kernels"]))
    return [r["lang"] for r in found], np.array([r["kernels"] for r in found]).reshape(len(found), len(model.size))


def fitted(docs: DataFrame, divisor: int = 4, held_out: int = 2) -> Model | None:
    """A model of docs (doc_id, text, lang): of each lang FIT_ROWS whole texts that aren't held out. None if none of them has a letter."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (checksum_rest(divisor) != held_out))
    common = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not common:
        return None
    chosen = balanced(rows.where(F.col("lang").isin(common)), "lang", FIT_ROWS)
    texts = written(rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]), "fit")
    each = max(1, LANDMARKS // len(common))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    marks = texts.where((F.col("place") <= 2 * each) & F.col("text").rlike(r"\p{L}")).select("lang", "place", "doc_id", F.substring("text", at, F.lit(WINDOW)).alias("text")).collect()
    marks = sorted((r for r in marks if any(map(str.isalpha, r["text"]))), key=lambda r: (r["lang"], r["place"], r["doc_id"], r["text"]))
    marks = [t for name in common for t in [r["text"] for r in marks if r["lang"] == name][:each]]
    if not marks:
        return None
    model = landmarks(marks)
    names, found = _embedded(texts, model)
    return solve(model, found, names) if names else None


def predicted(docs: DataFrame, model: Model | None, keep: list[str] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs, with the language (``und`` if the text is null or has no letter, or nothing could be learned) and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for at, texts in slices(batch):
                found, scores = decide(sent.value, texts) if sent.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(texts)) for k in keep), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(tidy(score), f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang; other columns are ignored).

    Repeated rows get a row each, of the same prediction. A null doc_id counts as held out. Ties go to the first name. An empty table gives
    no rows.
    """
    out = predicted(docs, fitted(docs))
    return out.select("doc_id", F.coalesce(checksum_rest(4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of docs with a language of at least this score, with all their columns.

    Rows without a letter go, so rows of null text do. Repeated rows share their fate. An empty table gives no rows.
    """
    kept = predicted(docs, fitted(docs), docs.columns, ("_language", "_certainty"))
    return kept.where((F.col("_language") != UNKNOWN) & (F.col("_certainty") >= least)).select(docs.columns)
