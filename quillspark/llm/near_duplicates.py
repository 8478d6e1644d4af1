"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links make.

A document is the set of its distinct shingles (``size`` words; of a shorter text, all its words). Two documents link when
``100 * |x & y| >= percent * |x | y|``. All shingles have one global order, rare ones first. With o = ceil(percent/100 |x|), a set x
shares at least l shingles of its first |x| - o + l with the first |y| - o' + l of any y that it links with, for every l. Each document
takes the l for which the estimated work (postings read, and expected candidates to verify) is least, and a pair must share
min(l_x, l_y) shingles of the prefixes of that l; so a document whose prefix is common is only verified against those that match it often.

The order comes from a count sketch of document frequencies over all documents (2**SKETCH counters, a fixed 2 MB). Any order gives the
same result; a good one keeps hot shingles out of the prefixes.

Only classes are wanted, so the pairs of a class aren't all made. Documents of equal sets share one representative. In round one each
representative is verified against one document of its postings (each posting has one anchor), the anchor that it meets most often; while
much is left, again with other anchors. Round two takes the postings that still hold different classes and verifies every pair across
classes that matches often enough, which leaves no link out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import stars
from ._io import sweep, written
from ._text import Words, groups, mix, slices, tidy

SKETCH = 18
MOST_MATCHES = 4
SENT_IDS = 1_000_000
#: Work of verifying one candidate, in postings read.
VERIFY = 40.0
#: Chance that a document that shares one prefix shingle by accident shares one more.
AGAIN = 0.25
#: A shingle that the sketch finds in 2**(HOT_LEVEL - 1) documents or more has its posting dealt to tasks in round one, of 2**SALT_LEVEL documents
#: each, however many these are.
HOT_LEVEL, SALT_LEVEL = 15, 11
#: Characters of the texts that are compared at once.
COMPARED = 1 << 21
#: Round one is repeated with other anchors, at most TURNS times, while more pairs than this a document would be left for round two.
PAIRS_A_DOCUMENT = 200
TURNS = 6
#: ... and while a turn links at least this share of the documents.
WORTH = 0.01


def _sets_of(texts: list[str], size: int) -> Iterator[np.ndarray]:
    for lo, hi in groups([len(t) for t in texts]):
        words = Words(texts[lo:hi])
        rolled, count = words.shingles(size)
        for at, n in zip(words.first, count):
            yield np.unique(rolled[at : at + n])


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for _, texts in slices(batch):
        yield from _sets_of(texts, size)


def document_frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """The sketch: how many documents hold a shingle of each bucket."""

    def count(batches):
        total = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for s in _sets(batch, size):
                total += np.bincount((s >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH) if len(s) > 1 << 14 else 0
                if len(s) <= 1 << 14:
                    np.add.at(total, (s >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": total[at]})

    rows = docs.select("text").mapInArrow(tidy(count), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH, np.int64)
    sketch[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return sketch


def _least_overlap(n, percent: int):
    return (n * percent + 99) // 100


def prefix(s: np.ndarray, sketch: np.ndarray, base: float, percent: int, hot_level: int = HOT_LEVEL) -> tuple[int, np.ndarray, np.ndarray]:
    """The l that costs least, the levels of the hot shingles (those at the end), and the shingles of the prefix, in the global order."""
    n = len(s)
    over = sketch[(s >> np.uint64(64 - SKETCH)).astype(np.int64)] - base
    seen = np.where(over > 6 * np.sqrt(base + 1), over, 0.0)
    level = np.ceil(np.log2(seen + 1)).astype(np.uint64)
    order = np.argsort((level << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
    o = _least_overlap(n, percent)
    most = min(MOST_MATCHES, o)
    reads = np.cumsum(seen[order[: n - o + most]] + 1)
    cost = [reads[n - o + k - 1] * (1 + VERIFY * AGAIN ** (k - 1)) for k in range(1, most + 1)]
    ell = int(np.argmin(cost)) + 1 if reads[n - o] > n - o + 1 else 1
    chosen = order[: n - o + ell]
    levels = level[chosen]
    return ell, levels[levels >= hot_level].astype(np.int32), s[chosen]


def _summaries(docs: DataFrame, size: int, percent: int, hot_level: int) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (128 bits of it), ell, tokens (its prefix), levels (of its last tokens, the hot ones)."""
    sketch = document_frequencies(docs, size)
    base = float(np.median(sketch))
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def summarise(batches):
        for batch in batches:
            for at, texts in slices(batch):
                rows = {k: [] for k in ("n", "s1", "s2", "ell", "levels", "tokens")}
                for s in _sets_of(texts, size):
                    ell, levels, tokens = prefix(s, sent.value, base, percent, hot_level) if len(s) else (0, np.zeros(0, np.int32), s)
                    for k, v in zip(rows, (len(s), mix(s).sum(dtype=np.uint64).astype(np.int64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64), ell, levels, tokens.view(np.int64))):
                        rows[k].append(v)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows[k])], dtype=np.int32)), pa.array(np.concatenate([*rows[k], np.zeros(0, t)]))) for k, t in (("levels", np.int32), ("tokens", np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *(pa.array(rows[k], pa.int64()) for k in ("n", "s1", "s2")), pa.array(rows["ell"], pa.int32()), *lists], names=["doc_id", "n", "s1", "s2", "ell", "levels", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return written(rows.mapInArrow(tidy(summarise), "doc_id bigint, n bigint, s1 bigint, s2 bigint, ell int, levels array<int>, tokens array<bigint>"), "summaries")


def _postings(summaries: DataFrame, copies: DataFrame, percent: int, salt_level: int) -> DataFrame:
    """token, doc, n, ell, g (the least l whose prefix has the token), salt, spread (whether the token's posting is dealt to several salts)."""
    one = summaries.where("n > 0").join(copies.select(F.col("rep").alias("doc_id"), "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"], "left_semi").withColumn("from", F.size("tokens") - F.size("levels"))
    each = one.select(F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), "ell", "levels", "from", F.posexplode("tokens").alias("at", "token"))
    o = F.expr(f"(n * {percent} + 99) div 100")
    spread = F.col("at") >= F.col("from")
    salts = F.expr(f"shiftleft(1L, get(levels, at - from) - {salt_level})")
    return each.select(
        "token", "doc", "n", "ell", F.col("at").cast("int").alias("at"), F.greatest(F.lit(1), F.col("at") - F.col("n") + o + 1).cast("int").alias("g"),
        F.when(spread, F.pmod(F.xxhash64("doc"), salts)).otherwise(0).cast("long").alias("salt"), spread.alias("spread"))


def _starred(rows: DataFrame, turn: int) -> DataFrame:
    """rows with anchor, one document of the posting's salt (another each turn)."""
    w = Window.partitionBy("token", "salt")
    first = F.struct(F.xxhash64("doc", F.lit(turn)).alias("h") if turn else F.col("doc").alias("h"), "doc", "n", "ell", "g", "at", "kept", "class")
    return rows.withColumn("anchor", F.min(first).over(w))


def _star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y): each document with the anchor of another class that it meets most often; anchors of salts with the first of them."""
    top = rows.where("spread").groupBy("token").agg(F.min("anchor").alias("anchor"))
    upper = rows.where("spread and doc = anchor.doc").drop("anchor").join(top, "token")
    met = rows.unionByName(upper.select(rows.columns)).where("class <> anchor.class")
    pairs = met.select(
        F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("ell").alias("lx"), F.col("g").alias("gx"),
        F.col("anchor.doc").alias("y"), F.col("anchor.n").alias("ny"), F.col("anchor.ell").alias("ly"), F.col("anchor.g").alias("gy"),
        F.col("at").alias("ax"), F.col("kept").alias("kx"), F.col("anchor.at").alias("ay"), F.col("anchor.kept").alias("ky")).where(_may_reach(percent))
    best = _matching(pairs, percent).groupBy("x").agg(F.max(F.struct("m", (-F.col("y")).alias("y"))).alias("best"))
    return best.select("x", (-F.col("best.y")).alias("y"))


def _matching(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows a token (x, nx, lx, gx, y, ny, ly, gy), the pairs that share min(lx, ly) and can still reach the overlap."""
    both = F.least("lx", "ly")
    counted = pairs.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).groupBy("x", "y").agg(
        F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.first(both).alias("l"), F.sum(F.when((F.col("gx") <= both) & (F.col("gy") <= both), 1).otherwise(0)).alias("m"))
    return counted.where(F.col("m") >= F.col("l"))


def _can_reach(percent: int):
    """All that lies behind the prefix that ends first may be shared, and of the prefixes only what was."""
    rest = F.greatest(F.expr(f"(nx * {percent} + 99) div 100"), F.expr(f"(ny * {percent} + 99) div 100")) - F.col("l")
    return (100 + percent) * (F.col("m") + rest) >= percent * (F.col("nx") + F.col("ny"))


def _may_reach(percent: int):
    """A bound from one shared shingle, at the places ax and ay: what lies before it was shared only if others have it in their prefixes too."""
    most = 1 + F.least("kx", "ky") + F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) - 1
    return (100 + percent) * most >= percent * (F.col("nx") + F.col("ny"))


def _sent(ids: DataFrame) -> DataFrame:
    """Up to SENT_IDS ids go to every task, so that what is joined with them stays where it is; more are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int, used: Iterable[DataFrame] = ()) -> DataFrame:
    """Of pairs (x, y) of doc_ids, those whose whole sets link, written as (a, b). The folders of used, from which pairs come, go."""
    pairs = written(pairs, "candidates", used)
    ids = written(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(), "ids")
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_sent(ids), "doc_id", "left_semi"), "compared", [ids])
    full = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y")

    def compare(batches):
        for batch in batches:
            lengths = [pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False) for k in ("tx", "ty")]
            for lo, hi in groups((lengths[0] + lengths[1]).tolist(), COMPARED):
                part = batch.slice(lo, hi - lo)
                tx, ty = ([t or "" for t in part.column(k).to_pylist()] for k in ("tx", "ty"))
                every = list(dict.fromkeys((*tx, *ty)))
                known = dict(zip(every, _sets_of(every, size)))
                keep = []
                for a, b in zip(tx, ty):
                    a, b = known[a], known[b]
                    shared = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                    keep.append(bool(shared) and 100 * shared >= percent * (len(a) + len(b) - shared))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y")], names=["a", "b"]).filter(pa.array(keep))

    return written(full.select("x", "y", "tx", "ty").mapInArrow(tidy(compare), "a bigint, b bigint"), "linked", [pairs, texts])


def _pairs_across(rows: DataFrame) -> float:
    of_class = rows.groupBy("token", "class").agg(F.count("*").cast("double").alias("k"))
    a_token = of_class.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
    return a_token.agg(F.sum((F.col("k") * F.col("k") - F.col("own")) / 2)).first()[0] or 0.0


def classes(docs: DataFrame, size: int = 5, percent: int = 80, hot_level: int = HOT_LEVEL, salt_level: int = SALT_LEVEL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    docs: doc_id, text; other columns are ignored. A null or empty text has no shingles and links with nothing. Rows that repeat a doc_id
    are one node: each gets a row, and their links are united. A row of null doc_id gets the size of its set and a null component. An empty table gives no rows.
    """
    summaries = _summaries(docs, size, percent, hot_level)
    # One row for each different set. Written, so that joins with it have no aggregate beside them and the runtime can divide a group of copies.
    copies = written(summaries.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "copies")
    every, of = _postings(summaries, copies, percent, salt_level), Window.partitionBy("token", "salt")
    shared = every.withColumn("together", F.count("*").over(of)).where("together > 1 or spread").drop("together")
    # kept: how many shingles of the document's prefix before this one others have too.
    shared = written(shared, "postings")
    rows = written(shared.withColumns({"kept": (F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1).cast("int"), "class": F.col("doc")}), "open", [shared])
    sweep(docs.sparkSession)
    links, turn, documents = None, 0, max(1, summaries.count())
    while True:
        starred = written(_starred(rows, turn), "starred")
        found = verified(docs, _star_pairs(starred, percent), size, percent, [starred])
        new = found.count()
        links = stars(found if links is None else links.unionByName(found), [found] if links is None else [found, links])
        known = links.select(F.col("a").alias("doc"), F.col("b").alias("class"))
        classed = written(rows.drop("class").join(known, "doc", "left").withColumn("class", F.coalesce("class", "doc")), "classed", [rows])
        mixed = classed.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("token")
        rows = written(classed.join(mixed, "token", "left_semi"), "open", [classed])
        sweep(docs.sparkSession)
        turn += 1
        if turn == TURNS or new <= WORTH * documents or _pairs_across(rows) <= PAIRS_A_DOCUMENT * documents:
            break
    # Both sides are read from the shared folder, so the runtime divides the posting of a hot shingle on either side (a skewed join).
    side = lambda k, token: rows.select(F.col("token").alias(token), F.col("doc").alias(k), *(F.col(c).alias(f"{c[0]}{k}") for c in ("n", "g", "at", "kept")), F.col("ell").alias(f"l{k}"), F.col("class").alias(f"c{k}"))
    # All columns of both are renamed, so that the plan sees one exchange of the same rows and makes it once.
    x, y = side("x", "held"), side("y", "other")
    across = x.join(y, (F.col("held") == F.col("other")) & (F.col("cx") < F.col("cy")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & _may_reach(percent))
    second = verified(docs, _matching(across, percent).where(_can_reach(percent)).select("x", "y"), size, percent)

    named = summaries.where("n > 0").select("doc_id", "n", "s1", "s2").join(copies, ["n", "s1", "s2"]).select("doc_id", "n", "rep")
    nodes = written(named.unionByName(summaries.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))), "nodes", [rows])
    least = nodes.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    repeated = nodes.join(least, "doc_id").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct()
    final = stars(links.unionByName(second).unionByName(repeated), [links, second]).select(F.col("a").alias("rep"), F.col("b").alias("class"))
    out = nodes.join(final, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "rep").alias("component_id"))
    return out.unionByName(_nameless(docs, size))


def _nameless(docs: DataFrame, size: int) -> DataFrame:
    """Rows of null doc_id with the sizes of their sets: no links lead to or from them, so they have no class."""

    def count(batches):
        for batch in batches:
            n = pa.array([len(s) for s in _sets(batch, size)], pa.int64())
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, n, none], names=["doc_id", "n_shingles", "component_id"])

    return docs.where("doc_id is null").select("text").mapInArrow(tidy(count), "doc_id bigint, n_shingles bigint, component_id bigint")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each class, that of its smallest doc_id (of rows that repeat it, that of the least text); rows of null doc_id stay."""
    found = written(classes(docs, size, percent), "classes")
    # Texts stay where they are while the ids are few, and are shuffled once otherwise (again if ids that repeat are many too). Rows of null
    # doc_id never are.
    marks = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), (F.count("*") > 1).alias("again")).where("gone or again")
    marks = written(marks, "marks", [found])
    named = docs.where("doc_id is not null")
    once = named.join(_sent(marks.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    again = named.join(_sent(marks.where("again and not gone").select("doc_id")), "doc_id", "left_semi").select(docs.columns)
    rest = F.to_json(F.struct(*docs.columns))
    first = again.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", rest))).where("_at = 1")
    return once.unionByName(first.select(docs.columns)).unionByName(docs.where("doc_id is null"))
