"""Source divergence audit: how far the term shares of each source are from those of other sources of its language, and by which terms from the language's.

Counts of terms are summed in Spark by language, source and term. Kept terms are dealt to blocks, and sources to tiles, of their language. A task
holds the counts of one block of terms for two tiles of sources as dense int64 matrices, works out all pairs of rows by broadcasting, and adds
their values up over the block; these partial matrices are summed by pair. Tasks whose tiles are the same one also keep a heap of each source's terms
of largest value, and the heaps of all blocks are merged.

All arithmetic is exact: shares are whole billionths, at least 1, so a value is at most about 1e18.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import written

LEAST_DOCS = 3
UNIT = 10**9
TERMS = 200
#: Terms of a block and sources of a tile, about.
BLOCK = 512
TILE = 64
#: Sums that a task holds, and bytes of text that it has read, before it passes them on.
HELD = 500_000
READ = 1 << 26
#: Elements of a matrix of differences.
CELLS = 1 << 20

#: For bytes.translate: A-Z in lower case, other bytes of terms (letters, and all beyond ASCII) as they are, the rest spaces.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, all characters beyond ASCII being letters, of UTF-8 text, with A-Z in lower case."""
    return text.translate(_BYTES).split()


def sums(batches):
    """Batches of lang, source, term, n, docs from ones of text, lang, source, all binary: what is held at a time has one row each."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = read = 0

    def out():
        rows: list[list] = [[], [], [], [], []]
        for (lang, source), (n, of) in held.items():
            own = [lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *n], [0, *n.values()], [of[None], *map(of.__getitem__, n)]
            for column, more in zip(rows, own):
                column += more
        held.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()).cast(pa.string()) for x in rows[:3]), *(pa.array(x, pa.int64()) for x in rows[3:])], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
            n, of = held[lang, source]
            before = len(n)
            found = terms(text)
            n.update(found)
            of.update({None, *found})
            size += len(n) - before + 1
            read += len(text)
            if size > HELD or read > READ:
                yield out()
                size = read = 0
    yield out()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents. Each source also has a row of null term, with all its documents."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in ("text", "lang", "source")))
    parts = read.mapInArrow(sums, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), three digits at a time so that nothing leaves 64 bits."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of p and each row of q, the sum of floor((p - q)^2 / q) over the columns."""
    out = np.zeros((len(p), len(q)), np.int64)
    width = max(1, CELLS // max(1, p.shape[1] * len(q)))
    for at in range(0, len(p), width):
        gap = p[at : at + width, None, :] - q[None]
        out[at : at + width] = (gap * gap // q[None]).sum(2)
    return out


def audit(docs: DataFrame, most: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: see the module.

    Null text, lang and source count as ''. A row is a document, also one that repeats another. A source without kept terms has pairs all the same, and
    a source alone in its language none. Ties go to the item that is first in UTF-8. Other columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    counted = written(counts(docs), "counts")
    in_lang = Window.partitionBy("lang", "term")
    kept = counted.where("term is not null").withColumns({"_docs": F.sum("docs").over(in_lang), "total": F.sum("n").over(in_lang)}).where(F.col("_docs") >= LEAST_DOCS)
    kept = written(kept.select("lang", "source", "term", "n", "total"), "kept")
    vocabulary = kept.groupBy("lang", "term").agg(F.first("total").alias("n"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counted.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(groups, "groups")
    size = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.max("v") / BLOCK)).cast("long").alias("blocks"))
    size = written(size, "sizes")

    # A tile meets every tile, itself included, in the task of the pair (low, high); the language's own counts go to all.
    all_tiles, all_blocks = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    in_tile, in_block = F.pmod(F.xxhash64("source"), F.col("tiles")), F.pmod(F.xxhash64("term"), F.col("blocks"))
    pairs = lambda frame: frame.withColumn("_tile", in_tile).withColumn("_other", F.explode(all_tiles)).withColumns({"low": F.least("_tile", "_other"), "high": F.greatest("_tile", "_other")})
    each = pairs(groups.join(size, "lang")).select("lang", "low", "high", F.explode(all_blocks).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("n"), F.col("_tile").alias("tile"), "v", "total")
    cells = pairs(kept.join(size, "lang")).select("lang", "low", "high", in_block.alias("block"), "source", "term", "n", F.col("_tile").alias("tile"))
    whole = vocabulary.join(size, "lang").withColumn("low", F.explode(all_tiles)).withColumn("high", F.explode(F.sequence("low", F.col("tiles") - 1))).select("lang", "low", "high", in_block.alias("block"), F.lit(None).cast("string").alias("source"), "term", "n", F.lit(None).cast("long").alias("tile"))

    def tile(key, members: pa.Table, cells: pa.Table) -> pa.Table:
        lang, low, high, _ = (k.as_py() for k in key)
        members = members.sort_by("source").to_pydict()
        names = members["source"]
        in_lang = pc.is_null(cells["source"])
        whole, own = cells.filter(in_lang), cells.filter(pc.invert(in_lang))
        column = whole["term"].combine_chunks()
        place = lambda found, among: pc.index_in(found, value_set=among).to_numpy()
        of_group, of_lang = np.zeros((len(names), len(column)), np.int64), whole["n"].to_numpy()[None]
        if len(own):
            of_group[place(own["source"], pa.array(names, own["source"].type)), place(own["term"], column)] = own["n"].to_numpy()
        v = np.array(members["v"], np.int64)[:, None]
        p = shares(of_group, np.maximum(np.array(members["n"], np.int64)[:, None] + v, 1))
        tiles = np.array(members["tile"], np.int64)
        out: list[tuple] = []
        a, b = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
        for mine, other in [(a, b)] if low == high else [(a, b), (b, a)]:
            sums = pair_sums(p[mine], p[other])
            out += [(names[i], "pair", names[j], int(sums[x, y])) for x, i in enumerate(mine) for y, j in enumerate(other) if i != j]
        if low == high and len(column):
            q = shares(of_lang, np.maximum(np.array(members["total"][:1], np.int64)[:, None] + v[:1], 1))
            gap = p - q
            value = gap * gap // q
            words = column.to_pylist()
            for i, name in enumerate(names):
                over = np.flatnonzero((of_group[i] > 0) & (gap[i] > 0))
                out += [(name, "term", t, -x) for x, t in _least(((-int(value[i, c]), words[c]) for c in over), most)]
        source, part, item, value = zip(*out) if out else ((),) * 4
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    by = lambda frame: frame.groupBy("lang", "low", "high", "block")
    partial = written(by(each).cogroup(by(cells.unionByName(whole))).applyInArrow(tile, "lang string, source string, part string, item string, value bigint"), "partial")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    summed = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", place)
    heaps = partial.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= most)
    return summed.unionByName(heaps).select("lang", "source", "part", "item", "value", "rank")


def _least(pairs, most: int) -> list[tuple[int, str]]:
    """The smallest pairs, in order of number and then UTF-8 (code points order alike)."""
    return heapq.nsmallest(most, pairs)


SQL = r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
found as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
cells as (select lang, source, term, count(*) as n, count(distinct r) as docs from found group by all),
vocabulary as (select lang, term, sum(n)::hugeint as n from cells group by all having sum(docs) >= 3),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from vocabulary group by lang),
kept as (select c.lang, c.source, c.term, c.n::hugeint as n from cells c join vocabulary using (lang, term)),
groups as (select g.lang, g.source, coalesce(sum(k.n), 0)::hugeint as total from (select distinct lang, source from docs) g left join kept k using (lang, source) group by all),
dense as (select g.lang, g.source, v.term, coalesce(k.n, 0) as n, 1 + (1000000000 * (coalesce(k.n, 0) + 1)) // (g.total + l.v) as p, 1 + (1000000000 * (v.n + 1)) // (l.total + l.v) as q
  from groups g join vocabulary v using (lang) join langs l using (lang) left join kept k on k.lang = g.lang and k.source = g.source and k.term = v.term),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q)) // q from dense where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from every
qualify part = 'pair' or rank <= 200
"""
