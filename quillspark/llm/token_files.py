"""Token ids in files of canonical length-limited Huffman code.

A file set is a folder with two Parquet tables. ``code``: (id, length), the canonical code, of at most LIMIT bits, from global counts.
``blocks``: shard and block (the order), at (ids of the shard before the block), doc_ids and counts (the documents in it), steps (bits of
each STEP ids: the checkpoints) and bits. Shards, blocks and documents ascend by doc_id. A block is decoded by itself: its checkpoints give
the bit offset of every STEP-th id, and all these runs are decoded side by side with one table look-up an id.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import new_folder, written
from ._text import slices, tidy

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 16
STEP = 128
#: Ids that a block holds at least, except a shard's last. A document isn't divided.
BLOCK = 1 << 18
#: Pieces whose ids a worker remembers.
REMEMBERED = 250_000
#: How the tokenizers that are encoded piece by piece normalise and part texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same parting for lower-cased Latin-1, whose white space, digits and letters are these.
_WHITE, _DIGITS, _LETTERS = r"\t-\r \x85\xa0", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
PIECES = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_DIGITS}]|[^{_WHITE}{_DIGITS}{_LETTERS}]+")
BLOCKS = "shard int, block int, at bigint, doc_ids array<bigint>, counts array<bigint>, steps binary, bits binary"


class Memory(dict):
    """Remembers what was asked for lately: MOST entries, and those of the MOST before them while they are asked for again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: set) -> list:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new, older = [k for k in keys if k not in self], self.older
        self.update([(k, older[k]) for k in new if k in older])
        return [k for k in new if k not in older] if older else new


class Encoder:
    """Ids of texts. Where the tokenizer's file states the parting above, each piece has its ids, whatever is beside it.

    The pieces of Latin-1 texts are found here, remembered, and those not met lately encoded many at a time by the library, by the file's
    model without its parting. Other texts of such a tokenizer are encoded by words, and texts of any other tokenizer as a whole.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.type).tobytes()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces, self.words = Memory(REMEMBERED), Memory(REMEMBERED // 8)
        stated = json.loads(self.tokenizer.to_str())
        parting = stated["pre_tokenizer"] or {}
        first, *others = parting.get("pretokenizers", [{}])
        self.by_piece = stated["normalizer"] == NORMALIZER and first.get("pattern") == {"Regex": PARTING} and [x["type"] for x in others] == ["ByteLevel"] and stated["model"].get("end_of_word_suffix") == "</w>"
        if self.by_piece:
            self.plain = Tokenizer.from_str(json.dumps(stated | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *others]}}))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.type).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces, many in one text, parted at the ids that end a piece."""
        runs = [new[i : i + 400] for i in range(0, len(new), 400)]
        for run, found in zip(runs, self.plain.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(found.ids, self.type)
            at = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(at) != len(run) or at[-1] != ids.nbytes:
                self.pieces.update(zip(run, self._whole(run)))
                continue
            raw, at = ids.tobytes(), at.tolist()
            self.pieces.update(zip(run, [raw[a:b] for a, b in zip([0, *at], at)]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [x + self.end for x in self._whole(texts)]
        latin = [t.isascii() or _is_latin(t) for t in texts]
        latin = [ok and "<|" not in t for ok, t in zip(latin, texts)]
        split = [PIECES.findall(t.lower()) if ok else t.replace("\n", " ").split(" ") for ok, t in zip(latin, texts)]
        self._learn(self.pieces.missing(set().union(*(s for ok, s in zip(latin, split) if ok))))
        new = self.words.missing(set().union(*(s for ok, s in zip(latin, split) if not ok)))
        self.words.update(zip(new, self._whole(new)))
        of_piece, of_word = self.pieces.__getitem__, self.words.__getitem__
        return [b"".join(map(of_piece if ok else of_word, s)) + self.end for ok, s in zip(latin, split)]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoder: Encoder | None = None


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's own, kept from task to task."""
    global _encoder
    if _encoder is None or (_encoder.path, _encoder.end_id) != (path, end_id):
        _encoder = Encoder(path, end_id)
        _encoder.end_id = end_id
    return _encoder


def encoded(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, ids (little-endian, of 2 bytes if the vocabulary fits, else of 4)."""

    def encode(batches):
        code = encoder(path, end_id)
        for batch in batches:
            for at, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(code(texts), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(encode), "doc_id bigint, ids binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most limit bits (package-merge); 0 if it doesn't occur.

    2 ** limit symbols can have a code; more are an error.
    """
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    leaves = counts[used].astype(np.float64)
    merged, is_leaf = leaves, []
    for _ in range(limit):
        is_leaf.append(None)
        if len(is_leaf) > 1:
            packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate((leaves, packages))
            order = np.argsort(both, kind="stable")
            merged, is_leaf[-1] = both[order], order < len(leaves)
    take = 2 * len(used) - 2
    for flags in reversed(is_leaf):
        of_leaves = take if flags is None else int(np.count_nonzero(flags[:take]))
        lengths[used[:of_leaves]] += 1
        take = 2 * (take - of_leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by symbol."""
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0]:
        code <<= int(lengths[s]) - last
        last, codes[s] = int(lengths[s]), code
        code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(steps, bits) of one block."""
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    word = codes[ids] << (40 - (at & 7) - n)
    size = int(ends[-1] + 7 >> 3) + 5 if len(ids) else 5
    out = sum(np.bincount((at >> 3) + k, weights=(word >> (32 - 8 * k)) & 255, minlength=size)[:size] for k in range(5 if lengths.max() > 17 else 3))
    steps = np.diff(np.append(at[::STEP], ends[-1] if len(ids) else 0))
    return steps.astype("<u2").tobytes(), out.astype(np.uint8).tobytes()


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    width = int(lengths.max()) if len(lengths) else 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    repeats = 1 << (width - lengths[order])
    symbols = np.repeat(order, repeats)
    bits = np.repeat(lengths[order], repeats)
    rest = (1 << width) - len(symbols)
    return width, np.append(symbols, np.zeros(rest, np.int64)).astype(np.uint32), np.append(bits, np.zeros(rest, np.int64)).astype(np.int64)


def unpack(steps: bytes, bits: bytes, n: int, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of one block."""
    width, symbols, lengths = table
    length = np.frombuffer(steps, "<u2").astype(np.int64)
    at = np.cumsum(length) - length
    raw = np.frombuffer(bits + bytes(STEP * width // 8 + 8), np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    out = np.empty((STEP, len(at)), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(STEP):
        peek = window[at >> 3] >> (32 - width - (at & 7)).astype(np.uint32) & mask
        out[k] = symbols[peek]
        at = at + lengths[peek]
    return out.T.reshape(-1)[:n]


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int | None = 1) -> None:
    """Writes docs (doc_id, text) as a file set in ascending doc_id order, each text followed by end_id.

    A null text counts as empty. Rows that repeat a doc_id follow each other, ordered by their ids; rows of null doc_id come first. An empty
    table gives an empty file set. Other columns are ignored.
    """
    spark = docs.sparkSession
    ids = written(encoded(docs, tokenizer, end_id), "ids")
    own = Encoder(tokenizer, end_id)
    kind, vocabulary = own.type, own.tokenizer.get_vocab_size() + 1

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at.astype(np.int32), "n": total[at]})

    rows = ids.select("ids").mapInArrow(tidy(count), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    # 2**LIMIT codes are enough for this vocabulary; a tokenizer of more ids gets the fewest bits that are.
    lengths = code_lengths(counts, max(LIMIT, int(np.count_nonzero(counts) - 1).bit_length()))
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast((lengths, codes))

    def blocks(batches):
        shard, block, at = TaskContext.get().partitionId(), 0, 0
        lengths, codes = sent.value

        def one(names, texts):
            data = np.frombuffer(b"".join(texts), kind)
            steps, bits = pack(data, lengths, codes)
            row = {"shard": [shard], "block": [block], "at": [at], "doc_ids": [names], "counts": [[len(t) // kind.itemsize for t in texts]], "steps": [steps], "bits": [bits]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("steps", pa.binary()), ("bits", pa.binary())])), len(data)

        names, texts, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                names.append(name)
                texts.append(text)
                size += len(text) // kind.itemsize
                if size >= BLOCK:
                    made, n = one(names, texts)
                    yield made
                    names, texts, size, block, at = [], [], 0, block + 1, at + n
        if names:
            yield one(names, texts)[0]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(tidy(blocks), BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    code = spark.read.schema("id int, length int").parquet(f"{path}/code").toArrow()
    ids = code.column("id").to_numpy()
    lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    lengths[ids] = code.column("length").to_numpy()
    table = decoding_table(lengths)
    sent = spark.sparkContext.broadcast(table)
    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    # One number for each shard, of which there are as many as the writer had tasks.
    totals = rows.select("shard", F.expr("at + aggregate(counts, 0L, (a, b) -> a + b)").alias("n")).groupBy("shard").agg(F.max("n").alias("n")).orderBy("shard").collect()
    before = spark.sparkContext.broadcast(dict(zip([r[0] for r in totals], np.cumsum([0, *(r[1] for r in totals)]).tolist())))

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                ids = unpack(row["steps"], row["bits"], int(ends[-1]), sent.value).astype("<u4")
                raw = ids.tobytes()
                starts = ends - counts + row["at"] + before.value[row["shard"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts), pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(tidy(decode), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digests(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int | None = 1) -> DataFrame:
    """Writes docs to a new file set and reads it back: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    path = new_folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
