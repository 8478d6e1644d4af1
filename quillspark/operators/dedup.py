"""Keeping the first of several."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROVIDER_ORDER
from ..functions.text import squash
from ..functions.urls import canonical_url
from ..sources.shared import kept

#: (row, key) pairs that are walked one by one instead of in turns.
WALK = 100_000


def first_of_each(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def union_of_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources in the fixed order of providers, with ord: the provider's rank above 48 bits of pos, the place in its own frame."""
    found = None
    for rank, name in enumerate(PROVIDER_ORDER):
        if name in frames:
            part = frames[name].withColumn("ord", F.shiftleft(F.lit(rank).cast("long"), 48) + F.col("pos")).drop("pos")
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def title_key(title: Column) -> Column:
    """ASCII letters and digits of a title; titles without any share one key."""
    return F.concat(F.lit("t:"), F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^A-Za-z0-9_]+", " ")))


def two_keys(url: Column, title: Column) -> Column:
    """The keys that a source takes: its address, or its title in lower case where it has none, and the letters and digits of its title."""
    return F.array_distinct(F.array(F.coalesce(F.nullif(canonical_url(url), F.lit("")), F.lower(F.coalesce(title, F.lit("")))), title_key(title)))


def first_independent(rows: DataFrame, topic: list[str], order: str, keys: Column, walk: int = WALK) -> DataFrame:
    """topic, order of the rows that go if a topic's rows are walked in order and one is kept only if none of its keys is a kept one's.

    That is the first independent set of the rows in order, two rows being neighbours if they share a key. It is found in turns. A row that is the least
    undecided one of all its keys is kept, since nothing before it can take them; the undecided rows that share a key with it go; what is left is
    written, and the next turn begins. Rows that share no key are never looked at. Keys are counted and reduced before each shuffle, so
    a key may hold any share of the rows. When at most ``walk`` rows are left, as where long chains settle one link a turn, they are walked.

    order must tell a topic's rows apart.
    """
    each = rows.select(*topic, order, F.explode(keys).alias("_key"))
    shared = each.groupBy(*topic, "_key").agg(F.count("*").alias("_n")).where("_n > 1")
    open_ = kept(each.join(shared, [*topic, "_key"], "left_semi"), "open")
    gone, of_row = [], Window.partitionBy(*topic, order)
    while (left := open_.count()) > walk:
        least = open_.groupBy(*topic, "_key").agg(F.min(order).alias("_least"))
        told = open_.join(least, [*topic, "_key"]).withColumn("_wins", F.min(F.col(order) == F.col("_least")).over(of_row))
        told = kept(told.drop("_least"), "turn")
        taken = told.where("_wins").select(*topic, "_key", F.lit(True).alias("_taken"))
        settled = told.join(taken, [*topic, "_key"], "left").withColumn("_done", F.max(F.coalesce("_taken", F.lit(False))).over(of_row)).drop("_taken")
        settled = kept(settled, "settled", [open_, told])
        gone.append(kept(settled.where("_done and not _wins").select(*topic, order).distinct(), "gone"))
        open_ = kept(settled.where("not _done").select(*topic, order, "_key"), "open", [settled])
    if left or not gone:
        gone.append(kept(_walked(open_, topic, order), "gone", [open_]))
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return out


def _walked(edges: DataFrame, topic: list[str], order: str) -> DataFrame:
    """The same, row by row. edges: topic, order, _key; a bounded number in all."""

    def walk(found):  # one batch of all edges of a topic, in order
        taken, out = set(), []
        for at, keys in groupby(sorted(zip(found.column(order).to_pylist(), found.column("_key").to_pylist())), key=lambda e: e[0]):
            keys = {k for _, k in keys}
            if taken & keys:
                out.append(at)
            else:
                taken |= keys
        return pa.table({**{c: pa.array([found.column(c)[0].as_py()] * len(out), found.schema.field(c).type) for c in topic}, order: pa.array(out, found.schema.field(order).type)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select(*topic, order).schema)
    return edges.groupBy(*topic).applyInArrow(walk, kinds)


def greedy_two_key(rows: DataFrame, topic: list[str], order: str = "ord", walk: int = WALK) -> DataFrame:
    """Walks a topic's rows in order and keeps a row if neither its address nor its title is that of a row kept before.

    Rows that aren't kept leave no keys, so this isn't two distincts: with A(u1, t1), B(u2, t1), C(u2, t2), A and C stay.
    """
    gone = first_independent(rows, topic, order, two_keys(F.col("url"), F.col("title")), walk)
    return rows.join(gone, [*topic, order], "left_anti")


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def distinct_paragraphs(text: Column) -> Column:
    """Paragraphs of a page, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(text, r"\n\n"), squash), lambda p: p != "")), "\n\n")
