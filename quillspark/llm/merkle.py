"""Merkle dataset manifest: a hash tree for each tree key of a table, and a tree over their roots.

A level's nodes are taken in runs of ``fanout``, the last run as it is, even if it is one node, and a run's digests, concatenated as hex, give their
parent's: nothing is padded. The last node left is the root, so a lone leaf is its own.

Leaves are dealt out by ranges of (tree, order), and the sums of the ranges before give each its place, so a tree may fill many tasks and ranges begin
and end anywhere within a run. Each range pushes its leaves on a stack of its own. A leaf that ends a run is a carry: the run goes, its parent is
recorded and pushed, which may carry again. A run that begins in another range stays on the stack, a mountain range of peaks of falling height
between its unaligned edges. Peaks of MERGED neighbouring ranges are pushed on one stack in turn, with the same carries, until a range holds whole
trees. For proofs each range asks only for the siblings beyond its edges, a few a level, which are peaks or nodes made by a merge, and works
out the rest from its own leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import written

FANOUT = 2
#: Leaves of a range, about.
LEAVES = 1 << 15
#: Ranges whose peaks are merged by one task.
MERGED = 64

_NODES = "tree string, block bigint, total bigint, level int, at bigint, digest string, made boolean, peak boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its value, or a hyphen if it is null."""
    each = (F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields)
    return F.sha2(F.concat(*each), 256)


def tree_key(name: Column) -> Column:
    """Text for a tree's name that tells null from empty and orders null first."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def sizes(total: int, fanout: int) -> list[int]:
    """Nodes of each level, from leaves to root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Peaks:
    """The stack of a range: open has the nodes whose runs aren't complete, left to right, as (level, at, digest); made the nodes carried to."""

    def __init__(self, total: int, fanout: int):
        self.sizes, self.fanout = sizes(total, fanout), fanout
        self.open: list[tuple[int, int, str]] = []
        self.made: list[tuple[int, int, str]] = []

    def push(self, level: int, at: int, text: str) -> None:
        self.open.append((level, at, text))
        while level + 1 < len(self.sizes) and (at % self.fanout == self.fanout - 1 or at == self.sizes[level] - 1):
            run = self.open[-(at % self.fanout + 1) :]
            if run[0][:2] != (level, at - at % self.fanout):
                break  # it begins in another range
            del self.open[-len(run) :]
            level, at, text = level + 1, at // self.fanout, digest("".join(x[2] for x in run))
            self.made.append((level, at, text))
            self.open.append((level, at, text))

    def rows(self, tree: str, block: int) -> pa.Table:
        open_, made = set(self.open), set(self.made)
        out = [(*x, True, x in open_) for x in self.made] + [(*x, False, True) for x in self.open if x not in made]
        level, at, text, new, peak = zip(*out) if out else ((), (), (), (), ())
        n = len(out)
        return pa.table({"tree": pa.array([tree] * n, pa.string()), "block": pa.array([block] * n, pa.int64()), "total": pa.array([self.sizes[0]] * n, pa.int64()), "level": pa.array(level, pa.int32()), "at": pa.array(at, pa.int64()), "digest": pa.array(text, pa.string()), "made": pa.array(new, pa.bool_()), "peak": pa.array(peak, pa.bool_())})


@dataclass
class Forest:
    placed: DataFrame  # the leaves: tree, block and what was given
    blocks: DataFrame  # tree, block, start, total: where the leaves of a range begin in their tree, and the tree's leaves
    nodes: DataFrame  # tree, level (from 1), at, digest: every node above the leaves
    edges: DataFrame  # tree, level, at, digest: peaks of ranges and nodes made by merges
    roots: DataFrame  # tree, total, subroot
    order: list[str]
    fanout: int


def forest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Forest:
    """The trees of leaves: tree (string), leaf (string), the columns of order, and any others, which are kept with the leaves."""
    held = written(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = [*order, "leaf", "_row"]
    ranges = max(1, -(-held.count() // LEAVES))
    placed = written(held.repartitionByRange(ranges, "tree", *order).withColumn("block", F.spark_partition_id().cast("long")), "placed", [held])
    ranges = max(ranges, (placed.agg(F.max("block")).first()[0] or 0) + 1)
    before = Window.partitionBy("tree").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("tree", "block").agg(F.count("*").alias("_n"))
    blocks = written(counts.select("tree", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("start"), F.sum("_n").over(Window.partitionBy("tree")).alias("total"), F.col("_n").alias("rows")), "blocks")

    def climb(key, mine: pa.Table, told: pa.Table) -> pa.Table:
        stack = Peaks(told.column("total")[0].as_py(), fanout)
        start = told.column("start")[0].as_py()
        for k, text in enumerate(_sorted(mine, order).column("leaf").to_pylist()):
            stack.push(0, start + k, text)
        return stack.rows(key[0].as_py(), key[1].as_py())

    def merge(key, peaks):  # without hints: Spark reads them here, and cannot resolve those of a closure
        stack = Peaks(peaks.column("total")[0].as_py(), fanout)
        each = zip(peaks.column("level").to_pylist(), peaks.column("at").to_pylist(), peaks.column("digest").to_pylist())
        for x in sorted(each, key=lambda x: x[1] * fanout ** x[0]):
            stack.push(*x)
        return stack.rows(key[0].as_py(), key[1].as_py())

    by = lambda frame: frame.groupBy("tree", "block")
    first = written(by(placed.select("tree", "block", *order)).cogroup(by(blocks)).applyInArrow(climb, _NODES), "nodes")
    peaks, nodes, edges = first.where("peak"), first.where("made"), first.where("peak")
    while ranges > 1:
        merged = written(by(peaks.withColumn("block", F.floor(F.col("block") / MERGED))).applyInArrow(merge, _NODES), "nodes")
        peaks, nodes, edges = merged.where("peak"), nodes.union(merged.where("made")), edges.union(merged.where("made"))
        ranges = -(-ranges // MERGED)
    node = ("tree", "level", "at", "digest")
    return Forest(placed, blocks, nodes.select(*node), edges.select(*node), peaks.select("tree", "total", F.col("digest").alias("subroot")), order, fanout)


def _sorted(rows: pa.Table, order: list[str]) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))


def _levels(start: int, leaves: list[str], total: int, fanout: int, outside: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """For each level but the root's: the place of the first node, and the digests, of the whole runs that nodes above these leaves stand in."""
    out, at, row = [], start, leaves
    for level, size in enumerate(sizes(total, fanout)[:-1]):
        low, end = at - at % fanout, at + len(row)
        row = [outside[level, x] for x in range(low, at)] + row + [outside[level, x] for x in range(end, min(-(-end // fanout) * fanout, size))]
        out.append((low, row))
        at, row = low // fanout, [digest("".join(row[x : x + fanout])) for x in range(0, len(row), fanout)]
    return out


def _path(levels: list[tuple[int, list[str]]], at: int, fanout: int) -> Iterator[tuple[str, str]]:
    """Siblings of a leaf and of each node above it: those to its left and those to its right, concatenated."""
    for low, row in levels:
        k = at - low
        run = k - k % fanout
        yield "".join(row[run:k]), "".join(row[k + 1 : run + fanout])
        at //= fanout


def fold(text: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its siblings give."""
    for left, right in path:
        text = digest(left + text + right)
    return text


def _asked(trees: Forest) -> DataFrame:
    """blocks with subroot and outside: the siblings that a range needs from others."""
    fanout = trees.fanout

    def want(batches):
        for batch in batches:
            out = []
            for tree, block, start, total, rows in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "start", "total", "rows"))):
                at, end = start, start + rows
                for level, size in enumerate(sizes(total, fanout)[:-1]):
                    high = min(-(-end // fanout) * fanout, size)
                    out += [(tree, block, level, x) for x in [*range(at - at % fanout, at), *range(end, high)]]
                    at, end = at // fanout, -(-end // fanout)
            tree, block, level, at = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(block, pa.int64()), pa.array(level, pa.int32()), pa.array(at, pa.int64())], names=["tree", "block", "level", "at"])

    wanted = trees.blocks.mapInArrow(want, "tree string, block bigint, level int, at bigint")
    found = written(wanted.join(trees.edges, ["tree", "level", "at"]), "siblings")
    outside = found.groupBy("tree", "block").agg(F.collect_list(F.struct("level", "at", "digest")).alias("outside"))
    return trees.blocks.join(trees.roots.select("tree", "subroot"), "tree").join(outside, ["tree", "block"], "left")


def _of_range(mine: pa.Table, told: pa.Table, order: list[str], fanout: int) -> tuple[pa.Table, int, list[tuple[int, list[str]]]]:
    """The leaves in order, the first one's place, and the runs above them."""
    mine, first = _sorted(mine, order), told.slice(0, 1).to_pylist()[0]
    outside = {(x["level"], x["at"]): x["digest"] for x in first["outside"] or ()}
    return mine, first["start"], _levels(first["start"], mine.column("leaf").to_pylist(), first["total"], fanout, outside)


def paths(trees: Forest, name: str) -> DataFrame:
    """name (a string column of the leaves), root and path: siblings left and right, level by level. For small trees: a path has a digest or more a level."""
    fanout, order = trees.fanout, trees.order

    def walk(key, mine: pa.Table, told: pa.Table) -> pa.Table:
        mine, start, levels = _of_range(mine, told, order, fanout)
        path = [[{"left": a, "right": b} for a, b in _path(levels, start + k, fanout)] for k in range(len(mine))]
        return pa.table({name: mine.column(name).cast(pa.string()), "root": pa.array([told.column("subroot")[0].as_py()] * len(mine), pa.string()), "path": pa.array(path, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})

    by = lambda frame: frame.groupBy("tree", "block")
    return by(trees.placed).cogroup(by(_asked(trees))).applyInArrow(walk, f"{name} string, root string, path array<struct<left string, right string>>")


@dataclass
class Manifest:
    below: Forest  # a tree for each key
    above: Forest  # one tree, whose leaves are the roots of those below

    @property
    def nodes(self) -> DataFrame:
        return self.below.nodes

    @property
    def subroots(self) -> DataFrame:
        return self.below.roots

    @property
    def root(self) -> DataFrame:
        """One row, root; none if there are no leaves."""
        return self.above.roots.select(F.col("subroot").alias("root"))


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Manifest:
    """The trees of leaves (see forest) and the tree over their roots, by tree key."""
    below = forest(leaves, order, fanout)
    above = forest(below.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf")), ["name"], fanout)
    return Manifest(below, above)


def proofs(of: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each leaf.

    The leaves need doc_id (bigint) and changed (string): the digest to be folded in place of leaf, or null. proof_sha256 is the digest of all siblings
    up to the root, folded_root what these give with the digest folded, verified whether that is the root.
    """
    fanout, order = of.below.fanout, of.below.order
    upper = written(paths(of.above, "name").withColumnRenamed("name", "tree"), "paths")
    told = _asked(of.below).join(upper, "tree")

    def prove(key, mine: pa.Table, told: pa.Table) -> pa.Table:
        mine, start, levels = _of_range(mine, told, order, fanout)
        first = told.slice(0, 1).to_pylist()[0]
        rest = [(x["left"], x["right"]) for x in first["path"]]
        proof, folded = [], []
        for k, (own, other) in enumerate(zip(mine.column("leaf").to_pylist(), mine.column("changed").to_pylist())):
            path = [*_path(levels, start + k, fanout), *rest]
            proof.append(digest("".join(a + b for a, b in path)))
            folded.append(fold(own if other is None else other, path))
        same = lambda text: pa.array([text] * len(mine), pa.string())
        return pa.table({"doc_id": mine.column("doc_id"), "leaf": mine.column("leaf"), "subroot": same(first["subroot"]), "root": same(first["root"]), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == first["root"] for x in folded], pa.bool_())})

    by = lambda frame: frame.groupBy("tree", "block")
    cut = of.below.placed.select("tree", "block", "doc_id", "changed", *(c for c in order if c != "doc_id"))
    return by(cut).cogroup(by(told)).applyInArrow(prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def documents_manifest(docs: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The manifest of documents: a tree for each language, its leaves by doc_id.

    Nulls: a null field is a hyphen in its leaf, null languages are a tree of their own, the first, and null ids come first in their tree. Rows that
    repeat a doc_id are leaves by the order of their digests, equal rows one leaf each. Other columns are ignored. No rows give no trees.
    A tampered copy of a leaf (one more of n_chars, where 7 divides the crc32 of the id) goes with it as changed; null n_chars stay.
    """
    one_more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    of = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    return manifest(docs.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), of(F.col("n_chars")).alias("leaf"), F.when(tampered, of(one_more)).alias("changed")), ["doc_id"], fanout)


#: The same trees by recursion over levels, for fanout 2.
SQL = """
with recursive rows as (
  select row_number() over () as r, doc_id, lang, n_chars, text, source,
    list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, 3988292384 * (a & 1)) end) as state
  from documents),
leaves as (
  select r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when xor(state, 4294967295) % 7 = 0 then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail)
      else sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) end as used
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail from rows)),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as i, count(*) over (partition by lang) as n, coalesce('=' || lang, '') as tree from leaves),
below as (
  select tree, 0 as level, i, leaf as h, n from placed
  union all
  select tree, level + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from below where n > 1 group by tree, level, i // 2, n),
subroots as (select tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from below where n = 1),
above as (
  select 0 as level, i, h, n from subroots
  union all
  select level + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from above where n > 1 group by level, i // 2, n),
climb as (
  select r, tree, 0 as level, i, n, used as h, '' as seen from placed
  union all
  select c.r, c.tree, c.level + 1, c.i // 2, (c.n + 1) // 2, sha256(case when s.h is null then c.h when s.i < c.i then s.h || c.h else c.h || s.h end), c.seen || coalesce(s.h, '')
  from climb c left join below s on s.tree = c.tree and s.level = c.level and s.i = xor(c.i, 1) where c.n > 1),
higher as (
  select c.r, 0 as level, s.i, s.n, c.h, c.seen from climb c join subroots s on s.tree = c.tree where c.n = 1
  union all
  select c.r, c.level + 1, c.i // 2, (c.n + 1) // 2, sha256(case when s.h is null then c.h when s.i < c.i then s.h || c.h else c.h || s.h end), c.seen || coalesce(s.h, '')
  from higher c left join above s on s.level = c.level and s.i = xor(c.i, 1) where c.n > 1)
select p.doc_id, p.leaf, s.h as subroot, t.h as root, sha256(c.seen) as proof_sha256, c.h as folded_root, c.h = t.h as verified
from placed p join subroots s on s.tree = p.tree join higher c on c.r = p.r and c.n = 1 join above t on t.n = 1
"""
