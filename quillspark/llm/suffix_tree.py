"""Language-model scores of a probabilistic suffix tree.

A text is its words (runs without white space, A-Z lower-cased), each spelt out and followed by a space, the last by the end symbol. The
most frequent letters have a symbol each; the others are spelt with a lead and tails, as in UTF-8, so every letter has a probability of its
own. A context is the string of up to DEPTH symbols before a symbol. Counts of all contexts come from all training texts. A context is a
state if its next-symbol counts diverge from those of the context without its oldest symbol: the log likelihood that it gains exceeds
PENALTY * ln(symbols) for each distinct next symbol. Substrings of states are states too. Distributions are smoothed with those of the
parent, down to the uniform one. All states are kept, and a symbol's score depends on it and the DEPTH symbols before it only (a gram).

The tree is worked out by parts. Contexts of up to ROOT symbols, of which there can be 2 ** (_BITS * ROOT), are the driver's. All longer contexts
that share their latest _SHARED symbols meet in one group, of at most 2 ** 24 grams, where counts, gains and smoothed distributions of all levels are
sums over sorted arrays; only states go between groups, since substrings of states belong to other groups.

The scores of the most frequent grams (at most HEAVY_GRAMS, a fixed bound) go to every task; the other grams of a text meet theirs in a
join. Beside it stands a unigram score of words, whose counts reach the texts in the same way (HEAVY words go to every task).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import written
from ._sample import checksum_rest
from ._text import Words, code_points, lower_ascii, slices, tidy, white

DEPTH = 5
ROOT = 2
_SHARED = ROOT + 1
PENALTY = 0.5
#: Weight of the parent's distribution, in counts.
SMOOTH = 2.0
HEAVY = 1 << 18
HEAVY_GRAMS = 1 << 19
_BITS = 8
_START, _END, _SPACE, _LEAD, _TAIL, _FIRST = 0, 1, 2, 3, 56, 120
_LETTERS = (1 << _BITS) - _FIRST
_SLOT_BITS = 20
#: Grams whose groups are worked out together, and symbols that are counted together.
_ROWS, _GATHERED = 1 << 19, 1 << 21
#: Characters handled together: workers share an executor's memory with its joins.
_CHUNK = 1 << 17


def _spelled(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, with 1 for the end and 2 for the space between words, and how many there are of each text."""
    n_texts = len(w.text_start) - 1
    keep = np.zeros(len(w.codes), bool)
    codes = w.codes
    gap = (codes == 32) | ((codes - np.uint32(9)) < 5)
    codes = np.where(codes < 3, 3, codes)
    keep[~gap] = True
    last = np.zeros(len(w.start), bool)
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    inner = w.end[~last]
    keep[inner] = True
    codes[inner] = _SPACE
    ends = w.text_start[1:] - 1
    keep[ends] = True
    codes[ends] = _END
    at = np.cumsum(keep)
    counts = np.diff(np.concatenate(([0], at[ends]))) if n_texts else np.zeros(0, np.int64)
    return codes[keep], counts


def _symbols(codes: np.ndarray, counts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the code points, and how many there are of each text. A letter without a symbol is a lead and one to three tails of 6 bits."""
    symbols = np.where(codes < 1 << 16, table[np.minimum(codes, (1 << 16) - 1)], 0).astype(np.uint64)
    other = np.flatnonzero(symbols == 0)
    if not len(other):
        return symbols, counts
    c = codes[other].astype(np.int64)
    tails = 1 + (c >= 0x800) + (c >= 0x10000)
    size = np.ones(len(codes), np.int64)
    size[other] += tails
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint64)
    out[at] = symbols
    out[at[other]] = _LEAD + np.select([c < 0x800, c < 0x10000], [c >> 6, 32 + (c >> 12)], 48 + (c >> 18))
    for k in (1, 2, 3):
        has = tails >= k
        out[at[other[has]] + k] = _TAIL + (c[has] >> 6 * (tails[has] - k) & 63)
    return out, np.add.reduceat(size, np.cumsum(counts) - counts)


def _table(letters: list[int]) -> np.ndarray:
    """Symbol of each code point below 2**16, 0 if it has none."""
    table = np.zeros(1 << 16, np.uint8)
    table[letters] = np.arange(_FIRST, _FIRST + len(letters))
    table[_END], table[_SPACE] = _END, _SPACE
    return table


def _grams(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each symbol the DEPTH symbols before it in its text (the start symbol where there are fewer) and itself, packed."""
    n = len(counts)
    place = np.arange(len(symbols)) + np.repeat(DEPTH * np.arange(1, n + 1), counts)
    one = np.full(len(symbols) + DEPTH * n, _START, np.uint64)
    one[place] = symbols
    two = one.copy()
    two[1:] |= one[:-1] << np.uint64(_BITS)
    out = two.copy()
    out[2:] |= two[:-2] << np.uint64(2 * _BITS)
    out[4:] |= two[:-4] << np.uint64(4 * _BITS)
    # What reaches before a text's starts is cut off by its DEPTH starts: DEPTH + 1 symbols are packed.
    return out[place]


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)


class _Counter:
    """Counts of 64-bit keys, merged whenever much has gathered."""

    def __init__(self):
        self.keys, self.counts, self.raw, self.size, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, []

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.size += len(keys)
        if self.size > _GATHERED:
            self._count()

    def _count(self) -> None:
        if self.size:
            keys = np.sort(np.concatenate(self.raw))
            first = _runs(keys)
            self.waiting.append((keys[first], np.diff(np.append(first, len(keys)))))
            self.raw, self.size = [], 0
            if sum(len(k) for k, _ in self.waiting) > max(_GATHERED, len(self.keys)):
                self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = _runs(keys)
        self.keys, self.counts, self.waiting = keys[first], np.add.reduceat(counts, first) if len(first) else counts, []

    def batches(self, kind: int, zero: bool = False):
        """Rows (kind, key, n); zero: of no count."""
        self._count()
        self._merge()
        for at in range(0, len(self.keys), 100_000):
            part = np.s_[at : at + 100_000]
            n = len(self.keys[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(self.keys[part].view(np.int64)), pa.array(np.zeros(n, np.int64) if zero else self.counts[part])], names=["kind", "key", "n"])


def _letters(batches):
    """Rows (key, n): letters as _spelled has them, below 2**16."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for _, found in slices(batch, _CHUNK):
            codes = lower_ascii(code_points(found)[0])
            total += np.bincount(codes[codes < 1 << 16], minlength=1 << 16)
    total[white(np.arange(1 << 16))] = 0
    total[3] += total[:3].sum()
    total[:3] = 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["key", "n"])


class _Level:
    """Grams of one length: pair (context << _BITS | symbol, ascending, different), n, and of each its context's place, count and kinds of symbols."""

    def __init__(self, pair: np.ndarray, n: np.ndarray):
        self.pair, self.n = pair, n
        first = _runs(pair >> np.uint64(_BITS))
        self.context = pair[first] >> np.uint64(_BITS)
        self.place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        self.of = np.add.reduceat(n, first) if len(first) else n
        self.kinds = np.add.reduceat((n > 0).astype(np.int64), first) if len(first) else n

    @staticmethod
    def summed(pair: np.ndarray, n: np.ndarray) -> tuple[_Level, np.ndarray]:
        """The level of pairs that may repeat, and the place in it of each."""
        pair, at = np.unique(pair, return_inverse=True)
        return _Level(pair, np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64)), at

    def share(self) -> np.ndarray:
        return self.n / np.maximum(self.of, 1)[self.place]

    def kept(self, parent: np.ndarray, price: float) -> np.ndarray:
        """Contexts that diverge from their parents, whose shares of each pair are given."""
        seen = self.n > 0
        gain = self.n[seen] * np.log(self.share()[seen] / parent[seen])
        return self.context[np.bincount(self.place[seen], weights=gain, minlength=len(self.context)) > self.kinds * price]

    def smoothed(self, parent: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Probability of each pair: the parent's, unless the context is a state."""
        state = np.isin(self.context, states)[self.place]
        return np.where(state, (self.n + SMOOTH * parent) / (self.of[self.place] + SMOOTH), parent)


class _Group:
    """All grams whose latest _SHARED context symbols are among some: levels _SHARED to DEPTH, and of each pair its parent's place."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n
        self.levels, self.parent = {}, {}
        self.levels[DEPTH], self.at = _Level.summed(key, n)
        for d in range(DEPTH - 1, _SHARED - 1, -1):
            above = self.levels[d + 1]
            self.levels[d], self.parent[d + 1] = _Level.summed(above.pair & np.uint64((1 << _BITS * (d + 1)) - 1), above.n)

    def root(self) -> np.ndarray:
        """Pairs of ROOT context symbols above the lowest level."""
        return self.levels[_SHARED].pair & np.uint64((1 << _BITS * (ROOT + 1)) - 1)


def _whole_groups(batches, columns: list[str]):
    """Columns of rows in order of the column group, some whole groups at a time."""
    held: list[list[np.ndarray]] = []
    size, enough = 0, _ROWS
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", *columns)])
        size += batch.num_rows
        if size >= enough:
            group, *rest = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield [x[:cut] for x in rest]
            held, size = [[group[cut:], *(x[cut:] for x in rest)]], len(group) - cut
            enough = max(_ROWS, 2 * size)
    if size:
        yield [np.concatenate(x) for x in zip(*held)][1:]


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (key, ...) with the groups of key's context together and in order."""
    return rows.withColumn("group", F.shiftright("key", _BITS).bitwiseAND((1 << _BITS * _SHARED) - 1)).repartition("group").sortWithinPartitions("group")


def gram_scores(grams: DataFrame, letters: int) -> DataFrame:
    """key, n, log10 (of the last symbol's probability after the others) of the grams (key, n: count in training, which may be 0)."""
    spark = grams.sparkSession
    low = (1 << _BITS * (ROOT + 1)) - 1
    # At most 2 ** (_BITS * (ROOT + 1)) rows.
    top = grams.groupBy(F.col("key").bitwiseAND(low).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = top.column("key").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(key)
    levels, parent = {ROOT: _Level(key[order], n[order])}, {}
    for d in range(ROOT - 1, -1, -1):
        levels[d], parent[d + 1] = _Level.summed(levels[d + 1].pair & np.uint64((1 << _BITS * (d + 1)) - 1), levels[d + 1].n)
    total = int(levels[0].n.sum())
    price = PENALTY * float(np.log(total + 1))
    own = [(d, int(c)) for d in range(1, ROOT + 1) for c in levels[d].kept(levels[d - 1].share()[parent[d]], price)]
    shares = spark.sparkContext.broadcast((levels[ROOT].pair, levels[ROOT].share()))

    def keep(batches):
        pairs, share = shares.value
        for key, n in _whole_groups(batches, ["key", "n"]):
            g = _Group(key.view(np.uint64), n)
            above = share[np.searchsorted(pairs, g.root())]
            for d in range(_SHARED, DEPTH + 1):
                found = g.levels[d].kept(above if d == _SHARED else g.levels[d - 1].share()[g.parent[d]], price)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), d, np.int32)), pa.array(found.view(np.int64))], names=["d", "context"])

    kept = _grouped(grams).select("group", "key", "n").mapInArrow(tidy(keep), "d int, context bigint").unionByName(spark.createDataFrame(own, "d int, context bigint"))
    parts = F.expr(f"explode(flatten(transform(sequence(1, d), k -> transform(sequence(0, d - k), low -> struct(k AS d, shiftright(context, {_BITS} * low) & (shiftleft(1L, {_BITS} * k) - 1) AS context)))))")
    states = written(kept.select(parts.alias("x")).select("x.d", "x.context").distinct(), "states")

    near = states.where(F.col("d") <= ROOT).toArrow()  # at most 2 ** (_BITS * ROOT) and the shorter ones
    d_of, context_of = near.column("d").to_numpy(), near.column("context").to_numpy().astype(np.uint64)
    symbols = _FIRST - _END + letters
    p = (levels[0].n + 0.5) / (total + 0.5 * symbols)
    for d in range(1, ROOT + 1):
        p = levels[d].smoothed(p[parent[d]], context_of[d_of == d])
    roots = spark.sparkContext.broadcast((levels[ROOT].pair, p))

    def score(batches):
        pairs, p_root = roots.value
        for depth, key, n in _whole_groups(batches, ["d", "key", "n"]):
            gram = depth == 0
            g = _Group(key[gram].view(np.uint64), n[gram])
            p = p_root[np.searchsorted(pairs, g.root())]
            for d in range(_SHARED, DEPTH + 1):
                p = g.levels[d].smoothed(p if d == _SHARED else p[g.parent[d]], key[depth == d].view(np.uint64) >> np.uint64(_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(g.key.view(np.int64)), pa.array(g.n), pa.array(np.log10(p)[g.at])], names=["key", "n", "log10"])

    # A state stands among the grams as its context with symbol 0.
    both = grams.select(F.lit(0).alias("d"), "key", "n").unionByName(states.where(F.col("d") > ROOT).select("d", F.shiftleft("context", _BITS).alias("key"), F.lit(0).cast("long").alias("n")))
    return written(_grouped(both).select("group", "d", "key", "n").mapInArrow(tidy(score), "key bigint, n bigint, log10 double"), "scores")


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the largest counts n, at most ``most``."""
    level = F.floor(16 * F.log2(F.col("n") + F.lit(1.0))).cast("int")
    least, sofar = 1 << 30, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        sofar += r["count"]
        if sofar > most:
            break
        least = r["level"]
    return counted.where(level >= least)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _slotted(keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, value) of each slot; of keys of the same slot the most frequent, the others are left to the join."""
    held, found = np.full(1 << _SLOT_BITS, ~np.uint64(0)), np.zeros(1 << _SLOT_BITS)
    order = np.argsort(counts, kind="stable")
    keys, values = keys.view(np.uint64)[order], values[order]
    held[_slots(keys)] = keys
    placed = held[_slots(keys)] == keys
    found[_slots(keys[placed])] = values[placed]
    return held, found


def _counted(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, times) of the distinct pairs."""
    pair = np.lexsort((keys, owner))
    keys, owner = keys[pair], owner[pair]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], owner[first], np.diff(np.append(first, len(keys)))


def scores(docs: DataFrame, divisor: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text; other columns are ignored).

    Learns from the rows whose checksum isn't held_out. A null text counts as empty: its only token is the end. Repeated rows count and get
    a row each. A null doc_id counts as held out. Without training rows every token is unknown and the tree has its root only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(checksum_rest(divisor) == held_out, F.lit(True)))
    train = rows.where(~F.col("held_out")).select("text")
    spelt = train.mapInArrow(tidy(_letters), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    letters = sorted(int(r["key"]) for r in spelt.orderBy(F.desc("n"), "key").limit(_LETTERS).collect())
    table = _table(letters)

    def gather(batches):
        words, learned, others, texts = _Counter(), _Counter(), _Counter(), 0
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for lo, found in slices(batch, _CHUNK):
                w = Words(found)
                apart = held[lo : lo + len(found)]
                texts += int(np.count_nonzero(~apart))
                words.add(w.hash[np.repeat(~apart, np.diff(w.first))])
                symbols, counts = _symbols(*_spelled(w), table)
                keys, apart = _grams(symbols, counts), np.repeat(apart, counts)
                learned.add(keys[~apart])
                others.add(keys[apart])
        yield from words.batches(0)
        yield from learned.batches(1)
        yield from others.batches(1, zero=True)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])

    gathered = written(rows.select("held_out", "text").mapInArrow(tidy(gather), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    told = gathered.agg(F.sum(F.expr("if(kind = 0, n, 0)")), F.sum(F.expr("if(kind = 0, 1, 0)")), F.sum(F.expr("if(kind = 2, n, 0)"))).first()
    texts = int(told[2] or 0)
    total, distinct = int(told[0] or 0) + texts, int(told[1] or 0) + (texts > 0)
    words = gathered.where("kind = 0").select("key", "n")
    heavy = _frequent(words, HEAVY).toArrow()
    scored = gram_scores(gathered.where("kind = 1").select("key", "n"), len(letters))
    often = _frequent(scored, HEAVY_GRAMS).toArrow()
    columns = lambda t, *names: (t.column(c).to_numpy() for c in names)
    sent = spark.sparkContext.broadcast((_slotted(*columns(often, "key", "n", "log10")), _slotted(*columns(heavy, "key", "n", "n"))))

    schema = pa.schema([("row", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("part", pa.float64()), ("score", pa.float64())])

    def apply(batches):
        (slot_keys, slot_scores), (word_keys, word_counts) = sent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, found in slices(batch, _CHUNK):
                w = Words(found)
                n = len(found)
                text = np.repeat(np.arange(n), np.diff(w.first))
                at = _slots(w.hash)
                hit = word_keys[at] == w.hash
                c = np.where(hit, word_counts[at], 0.0)
                part = np.bincount(text, weights=np.log10(c + 1.0), minlength=n) + np.log10(texts + 1.0)
                known = np.bincount(text[hit], minlength=n) + (texts > 0)
                symbols, of = _symbols(*_spelled(w), table)
                gram = _grams(symbols, of)
                slot = _slots(gram)
                there = slot_keys[slot] == gram
                score = np.add.reduceat(np.where(there, slot_scores[slot], 0.0), np.cumsum(of) - of) if n else np.zeros(0)
                rows = row + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(n, -1, np.int32)), pa.array(rows), pa.array(np.zeros(n, np.int64)), batch.column("doc_id").slice(lo, n), batch.column("held_out").slice(lo, n), pa.array(np.diff(w.first) + 1), pa.array(known), pa.array(part), pa.array(score)], schema=schema)
                rare = np.flatnonzero(~there)
                for kind, (rest, owner, times) in enumerate((_counted(w.hash[~hit], text[~hit]), _counted(gram[rare], np.searchsorted(np.cumsum(of), rare, "right")))):
                    none = [pa.nulls(len(rest), f.type) for f in list(schema)[4:]]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[owner]), pa.array(np.full(len(rest), kind, np.int32)), pa.array(rest.view(np.int64)), pa.array(times), *none], schema=schema)
                row += n

    made = rows.select("doc_id", "held_out", "text").mapInArrow(tidy(apply), "row bigint, kind int, key bigint, times bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, part double, score double")
    rare = words.select(F.lit(0).alias("kind"), "key", F.col("n").cast("double").alias("c")).unionByName(scored.select(F.lit(1).alias("kind"), "key", F.col("log10").alias("c")))
    word, times = F.col("kind") == 0, F.col("times")
    met = made.join(rare, ["kind", "key"], "left").groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "known", "part", "score")),
        F.sum(F.when(word & F.col("c").isNotNull(), times).otherwise(0)).alias("more"), F.sum(F.when(word, times * F.log10(F.coalesce("c", F.lit(0.0)) + F.lit(1.0))).otherwise(0.0)).alias("rest"),
        F.sum(F.when(F.col("kind") == 1, times * F.col("c")).otherwise(0.0)).alias("grams"))
    return met.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.col("rest") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"), (F.col("score") + F.col("grams")).alias("score"))
