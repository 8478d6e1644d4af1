"""Benchmark decontamination by template canonicalisation.

A text becomes tokens: runs of letters, lower-cased, and numbers. Numbers, units after numbers, and names (capitalised words that don't begin
a sentence) are replaced by typed placeholders; numbers side by side, and parts of a name, are one. The values replaced are the slots. As a
passage may begin in the middle of a sentence elsewhere, a second reading keeps names as words. Windows of WINDOW tokens (a shorter
item: all its tokens) are joined by hash with those of the benchmark, after a bit table of fixed size has dropped the windows that can't
match. Matches of one item at one shift form a hit if they cover RUN tokens in all (or the whole item) and their slots are consistent: each value of the item
stands for one value of the document and the reverse. A document with a hit is contaminated, also if it asks the item with other numbers,
names or units.

A third reading keeps every token as it is. It looks for items of fewer than SHORTEST tokens after replacing, whose template would be met by
chance, and, if asked to, for so many tokens of any item word for word, whatever was changed beside them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import written
from ._text import _powers, code_points, mix, slices, tidy

WINDOW = 8
RUN = 13
#: An item of fewer tokens is looked for word for word only: so short a template occurs by chance.
SHORTEST = 4
BITS = 22
# Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft feet yd yard yards mi mile miles meter meters metre metres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ton tons tonne tonnes "
    "ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent kmh mph hz khz mhz ghz kb mb gb tb w kw v a j kj kcal cal k c f pa bar degrees degree points times").split()
_NUMBER, _UNIT, _NAME = (np.uint64(0x1000000000000001 + k) for k in range(3))
ROW = "row bigint, reading int, size int, at int, hash bigint, slots array<bigint>"


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of code points below 2**16: 1 letter, 2 digit, 3 end of a sentence, 0 other; lower case; whether it is upper case."""
    kind = np.zeros(1 << 16, np.uint8)
    lower = np.arange(1 << 16, dtype=np.uint32)
    upper = np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        x = chr(c)
        kind[c] = 1 if x.isalpha() else 2 if x.isdigit() else 0
        if len(y := x.lower()) == 1 and y != x:
            lower[c], upper[c] = ord(y), True
    kind[[ord(x) for x in ".!?\n|:;"]] = 3
    return kind, lower, upper


def _hash_of(word: str) -> np.uint64:
    return Tokens([word]).hash[0]


class Tokens:
    """Tokens of texts: hash, kind (1 word, 2 number), whether capitalised and whether it begins a sentence; first: of each text."""

    def __init__(self, texts: list[str]):
        codes, starts = code_points(texts)
        kind_of, lower_of, upper_of = _classes()
        small = np.minimum(codes, (1 << 16) - 1)
        kind = kind_of[small]
        kind[codes >= 1 << 16] = 0
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        edges = np.concatenate(([0], change, [len(codes)])) if len(codes) else np.zeros(1, np.int64)
        run = kind[edges[:-1]] if len(codes) else kind
        keep = (run == 1) | (run == 2)
        self.start, self.end, self.kind = edges[:-1][keep], edges[1:][keep], run[keep]
        power, inverse = _powers(max(int(len(codes)).bit_length(), 16))
        low = lower_of[small]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((low + np.uint32(1)) * power[: len(codes)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        first_upper = upper_of[small[self.start]]
        second = np.minimum(self.start + 1, max(len(codes) - 1, 0))
        self.capital = (self.kind == 1) & first_upper & (self.end - self.start > 1) & ~upper_of[small[second]] if len(codes) else np.zeros(0, bool)
        stops = np.concatenate(([0], np.cumsum(kind == 3)))
        before = np.concatenate(([0], self.end[:-1])) if len(self.end) else self.end
        self.begins = stops[self.start] > stops[before]
        self.first = np.searchsorted(self.start, starts)
        self.begins[self.first[:-1][self.first[:-1] < len(self.start)]] = True


@cache
def _units() -> np.ndarray:
    return np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))


def readings(t: Tokens):
    """For names replaced (0), names kept (1) and everything kept (2): (hash of each token, slot of each token or 0, text of each token)."""
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    new = np.ones(len(text), bool)
    new[1:] = text[1:] != text[:-1]
    number = t.kind == 2
    units = _units()
    at = np.minimum(np.searchsorted(units, t.hash), len(units) - 1)
    after_number = np.concatenate(([False], number[:-1])) & ~new
    unit = (units[at] == t.hash) & after_number & (t.kind == 1)
    name = t.capital & ~t.begins & ~unit
    for reading in (0, 1):
        kind = np.where(number, 1, np.where(unit, 2, np.where(name & (reading == 0), 3, 0)))
        joined = np.zeros(len(kind), bool)
        joined[1:] = ((kind[1:] == 1) | (kind[1:] == 3)) & (kind[1:] == kind[:-1]) & ~new[1:]
        keep = ~joined
        group = np.flatnonzero(keep)
        place = np.arange(len(kind)) - np.repeat(group, np.diff(np.append(group, len(kind))))
        slot = np.add.reduceat(mix(t.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), group) if len(group) else t.hash
        kind = kind[keep]
        token = np.where(kind == 0, t.hash[keep], np.array([0, _NUMBER, _UNIT, _NAME], np.uint64)[kind])
        yield token, np.where(kind > 0, slot, np.uint64(0)), text[keep]
    yield t.hash, np.zeros(len(t.hash), np.uint64), text


def _windows(token: np.ndarray, size: int) -> np.ndarray:
    power, inverse = _powers(max(int(len(token) + 1).bit_length(), 16))
    sums = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(token * power[: len(token)], out=sums[1:])
    n = max(len(token) - size + 1, 0)
    return mix((sums[size:] - sums[:n]) * inverse[:n] + np.uint64(size)) if n else np.zeros(0, np.uint64)


def _found(texts: list[str], sizes: dict[int, list[int]], table: np.ndarray | None = None, verbatim: bool = False):
    """Windows of texts: (text, reading, size, place in the text, hash, slots), of the sizes of each reading.

    Without a table, texts are items, and have windows of their own size (WINDOW at most); only short ones, or all if verbatim, have those of reading 2.
    """
    short = np.zeros(len(texts), bool)
    for reading, (token, slot, text) in enumerate(readings(Tokens(texts))):
        lengths = np.bincount(text, minlength=len(texts))
        short = lengths < SHORTEST if reading == 0 else short
        begin = np.cumsum(lengths) - lengths
        for size in sizes.get(reading, ()):
            h = _windows(token, size)
            n = len(h)
            good = text[:n] == text[size - 1 : size - 1 + n]
            if table is None:
                good &= (np.minimum(lengths, WINDOW) == size)[text[:n]] & (short | (reading < 2) | verbatim)[text[:n]]
            else:
                good &= table[(h >> np.uint64(64 - BITS)).astype(np.int64)]
            at = np.flatnonzero(good)
            slots = slot.view(np.int64)
            yield text[at], reading, size, at - begin[text[at]], h[at], [slots[a : a + size] for a in at]


def _rows(row: np.ndarray, found) -> pa.RecordBatch:
    text, reading, size, place, h, slots = found
    n = len(text)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * size)
    values = pa.array(np.concatenate(slots) if n else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(row[text]), pa.array(np.full(n, reading, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(offsets, values)],
        names=["row", "reading", "size", "at", "hash", "slots"])


def item_windows(benchmark: DataFrame, verbatim: int | None = None) -> DataFrame:
    """item, reading, size, at, hash, slots, need (matches that make a hit)."""
    sizes = {0: list(range(SHORTEST, WINDOW + 1)), 1: list(range(SHORTEST, WINDOW + 1)), 2: list(range(1, WINDOW + 1))}

    def cut(batches):
        for batch in batches:
            row = np.array(batch.column("row").to_pylist(), np.int64)
            for at, texts in slices(batch):
                for found in _found(texts, sizes, None, verbatim is not None):
                    yield _rows(row[at : at + len(texts)], found)

    rows = written(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("row"), "text").mapInArrow(tidy(cut), ROW), "windows")
    counts = rows.groupBy("row", "reading").agg(F.count_distinct("at").alias("windows"))
    run = F.when(F.col("reading") == 2, verbatim or RUN).otherwise(RUN)
    need = F.when(F.col("size") < WINDOW, 1).otherwise(F.greatest(F.lit(1), F.least(F.col("windows"), run - WINDOW + 1)))
    return written(rows.join(counts, ["row", "reading"]).select(F.col("row").alias("item"), "reading", "size", "at", "hash", "slots", need.cast("int").alias("need")), "items", [rows])


def hits(docs: DataFrame, benchmark: DataFrame, verbatim: int | None = None) -> DataFrame:
    """doc_id, item_id, tokens (covered at the best shift), exact (whether all slots are equal), a row for each document and item that it holds.

    verbatim: so many tokens of an item word for word (or the whole item) make a hit whatever its slots. Rows of null doc_id, text, item_id or item text
    hold nothing, nor do texts without a letter or digit. Rows that repeat a doc_id count together, as do those that repeat an item_id.
    """
    items = item_windows(benchmark, verbatim)
    # At most 2**BITS buckets reach the driver, whatever the benchmark's size.
    buckets = items.select(F.shiftrightunsigned("hash", 64 - BITS).alias("b")).distinct().toArrow().column("b").to_numpy()
    table = np.zeros(1 << BITS, bool)
    table[buckets.astype(np.int64)] = True
    sizes: dict[int, list[int]] = {}
    for r in items.select("reading", "size").distinct().orderBy("reading", "size").collect():
        sizes.setdefault(r["reading"], []).append(r["size"])
    sent = docs.sparkSession.sparkContext.broadcast((np.packbits(table), sizes))

    def cut(batches):
        packed, sizes = sent.value
        table = np.unpackbits(packed).astype(bool)
        for batch in batches:
            row = np.array(batch.column("row").to_pylist(), np.int64)
            for at, texts in slices(batch):
                for found in _found(texts, sizes, table):
                    if len(found[0]):
                        yield _rows(row[at : at + len(texts)], found)

    mine = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("row"), "text").mapInArrow(tidy(cut), ROW)
    met = mine.withColumnRenamed("at", "place").withColumnRenamed("slots", "values").join(items, ["reading", "size", "hash"])
    met = met.withColumn("shift", F.col("place") - F.col("at"))
    key = ["row", "item", "reading", "size", "shift"]
    # Slots of one shift in one document: at most the item's tokens.
    pairs = F.array_distinct(F.flatten(F.collect_set(F.filter(F.arrays_zip(F.col("slots").alias("a"), F.col("values").alias("b")), lambda x: x["a"] != 0))))
    runs = met.groupBy(*key).agg(F.count_distinct("at").alias("m"), F.first("need").alias("need"), pairs.alias("pairs")).where("m >= need")
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda x: x[side])))
    consistent = (F.size("pairs") == distinct("a")) & (F.size("pairs") == distinct("b"))
    same = F.forall("pairs", lambda x: x["a"] == x["b"])
    good = runs.where(consistent).select("row", "item", (F.col("m") + F.col("size") - 1).alias("tokens"), same.alias("exact"))
    return good.groupBy("row", "item").agg(F.max("tokens").cast("long").alias("tokens"), F.max("exact").alias("exact")).select(F.col("row").alias("doc_id"), F.col("item").alias("item_id"), "tokens", "exact")


def contamination(docs: DataFrame, benchmark: DataFrame, verbatim: int | None = None) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids of the items it holds, ascending, comma-joined) for each row of docs (doc_id, text; others ignored).

    Documents without text, and all if the benchmark is empty, are clean. Rows that repeat a doc_id get a row each with the same values. verbatim:
    as for hits. Empty docs give no rows.
    """
    found = hits(docs, benchmark, verbatim).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return joined.select("doc_id", F.col("ids").isNotNull().alias("contaminated"), F.when(F.col("ids").isNull(), 0).otherwise(n).cast("long").alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, verbatim: int | None = None) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; rows of null doc_id or text stay, rows that repeat a doc_id share their fate."""
    return docs.join(hits(docs, benchmark, verbatim).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
