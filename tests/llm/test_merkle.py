"""The manifest against a plain tree, with odd rows, several fanouts and ranges that begin and end anywhere."""

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(leaves, fanout):
    """(root, path of each leaf: its siblings left and right, level by level)."""
    paths, at, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for i, k in enumerate(at):
            run = k - k % fanout
            paths[i].append(("".join(row[run:k]), "".join(row[k + 1 : run + fanout])))
            at[i] = k // fanout
        row = [sha("".join(row[k : k + fanout])) for k in range(0, len(row), fanout)]
    return row[0], paths


def plain(rows, fanout=2):
    of = lambda r, n: sha("".join(field(x) for x in (r[0], r[3], r[2], n, r[1])))
    trees = {}
    for r in rows:
        crc = None if r[0] is None else zlib.crc32(str(r[0]).encode())
        used = of(r, r[4] + 1) if crc is not None and crc % 7 == 0 and r[4] is not None else of(r, r[4])
        trees.setdefault(r[2], []).append((r[0], of(r, r[4]), used))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    below = [plain_tree([x[1] for x in trees[name]], fanout) for name in names]
    root, above = plain_tree([x[0] for x in below], fanout)
    out = []
    for name, (subroot, paths), upper in zip(names, below, above):
        for (i, leaf, used), path in zip(trees[name], paths):
            whole = path + upper
            for left, right in whole:
                used = sha(left + used + right)
            out.append((i, leaf, subroot, root, sha("".join(a + b for a, b in whole)), used, used == root))
    return sorted(map(str, out))


ROWS = [(i, f"text {i} é", ["en", "fr", "", None, "日本"][0 if i % 3 else i % 5], f"s{i % 4}", i * 7) for i in range(230)]
ROWS += [(None, None, None, None, None), (None, "x", "en", None, 1), (5, "other", "en", "s", None), (14, "a" * 3_000_000, "en", "s", 3_000_000), (600, "", "alone", "", 0)]
ROWS += [(77, "same", "en", "s", 4)] * 40 + [(-3, "\n", "zz", "é", -8)]


@pytest.mark.parametrize(("fanout", "leaves"), [(2, 1 << 15), (2, 7), (3, 10), (5, 3)])
def test_manifest(spark, monkeypatch, fanout, leaves):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "MERGED", 3)
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3).withColumns({"leaf": F.lit("clash"), "tree": F.lit(1), "block": F.lit(2), "digest": F.lit(3)})
    made = merkle.documents_manifest(docs, fanout)
    got = merkle.proofs(made).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(ROWS, fanout)
    assert made.root.collect()[0][0] == got[0]["root"]
    assert {r["verified"] for r in got} == {True, False}
    # Every node above the leaves is recorded once.
    want = sum(sum(merkle.sizes(r["total"], fanout)[1:]) for r in made.subroots.collect())
    assert made.nodes.distinct().count() == made.nodes.count() == want


def test_empty(spark):
    made = merkle.documents_manifest(spark.createDataFrame([], DOCS))
    assert merkle.proofs(made).count() == made.nodes.count() == made.subroots.count() == made.root.count() == 0


def test_stack_of_unaligned_ranges():
    """Whatever the ranges, merging their peaks gives the same root, and no stack grows beyond a few nodes a level."""
    for total, fanout in itertools.product((1, 2, 3, 13, 64, 100), (2, 3, 4)):
        leaves = [sha(str(k)) for k in range(total)]
        root, _ = plain_tree(leaves, fanout)
        for width in (1, 3, 8, 200):
            open_ = []
            for at in range(0, total, width):
                stack = merkle.Peaks(total, fanout)
                for k in range(at, min(at + width, total)):
                    stack.push(0, k, leaves[k])
                assert len(stack.open) <= 2 * (fanout - 1) * len(stack.sizes)
                open_ += stack.open
            last = merkle.Peaks(total, fanout)
            for x in open_:
                last.push(*x)
            assert [x[2] for x in last.open] == [root]
