"""Splitting texts to passages, and transcripts to timed lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import fmt_timestamp
from ..sources.shared import kept

# What parts blocks, and what a heading looks like.
_BREAK = re.compile(r"\n\s*\n|\n(?==+ )")
_HEADING = re.compile(r"=+ .+ =+")
_SPACE = re.compile(r"\s*")


def _pieces(text: str, most: int, least: int) -> Iterator[tuple[str, str]]:
    """(piece, kind) of a text in order: a "head" joins any open passage, a "block" if there is room, and a "full" piece, cut from a longer block, is a passage of its own."""
    sentence = rf".{{{least + 1},{most}}}\.(?= )|" if least < most else ""
    full = re.compile(rf"(?s){sentence}.{{{most}}}")
    for block in map(str.strip, _BREAK.split(text)):
        if _HEADING.fullmatch(block):
            yield block, "head"
            continue
        at = 0
        while len(block) - at > most:
            cut = full.match(block, at)
            yield cut.group().rstrip(), "full"
            at = _SPACE.match(block, cut.end()).end()
        if block[at:]:
            yield block[at:], "block"


def split_passages(text: str | None, most: int = 900, least: int = 120) -> list[str]:
    """Blocks packed to passages of at most ``most`` characters; longer blocks are cut at the end of a sentence.

    A heading joins what is open whatever its length. Passages under ``least`` go, unless there is one only.
    """
    groups: list[list[str]] = []
    room: int | None = None  # of the last group; None: closed
    for piece, kind in _pieces(text or "", most, least):
        if room is None or kind == "full" or (kind == "block" and len(piece) > room):
            groups.append([])
            room = most
        groups[-1].append(piece)
        room = None if kind == "full" else room - len(piece) - 1
    made = ["\n".join(g) for g in groups]
    return [m for m in made if len(m) >= least or len(made) == 1]


def passages(rows: DataFrame, keys: list[str], text: str = "text", most: int = 900, least: int = 120) -> DataFrame:
    """keys, idx, text: a row for each passage; made once, whatever the number of queries over them."""

    def cut(batches):
        for batch in batches:
            found = [split_passages(t, most, least) for t in batch.column(text).to_pylist()]
            at = [i for i, ps in enumerate(found) for _ in ps]
            names = [*keys, "idx", "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), pa.array([j for ps in found for j in range(len(ps))], pa.int32()), pa.array([p for ps in found for p in ps], pa.string())], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.select(*keys, text).mapInArrow(cut, f"{kinds}, idx int, text string")


def timed_lines(segments: DataFrame, keys: list[str], seconds: int = 30) -> DataFrame:
    """keys, line (from 1), start, text, segments: segments (keys, pos, start, text) joined to lines, as windows() joins those of an array.

    A line ends with the first segment that starts ``seconds`` or more after it, in whole microseconds; the next segment begins another. So each
    segment points at the line that would follow one begun by it, and the lines of a transcript are what its first segment reaches. Pointers are
    doubled in turns: turn r takes all of the first 2**r lines as many lines further, and a transcript needs as many turns as its number of lines
    has bits, whatever its length. Transcripts whose starts go back are folded as arrays. Missing starts count as 0, missing texts as empty.
    """
    of = Window.partitionBy(*keys)
    rows = segments.select(*keys, "pos", F.coalesce(F.col("start").cast("double"), F.lit(0.0)).alias("start"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_m", F.round(F.col("start") * 1_000_000).cast("long"))
    in_order = of.orderBy("pos", "start", "text")
    placed = rows.withColumns({"at": F.row_number().over(in_order), "_back": F.coalesce(F.col("_m") < F.lag("_m").over(in_order), F.lit(False))})
    placed = kept(placed.withColumns({"_back": F.max("_back").over(of), "_n": F.count("*").over(of)}), "segments")
    onward = placed.where("not _back")
    # From the last segment on, so that the frame grows; one that shrinks is summed up anew for each row.
    after = F.min("at").over(of.orderBy(F.desc("_m")).rangeBetween(Window.unboundedPreceding, -seconds * 1_000_000)) + 1
    pointers = kept(onward.select(*keys, "at", after.alias("to"), "_n").where("to <= _n").drop("_n"), "pointers")
    reached = kept(onward.where("at = 1").select(*keys, "at"), "reached")
    found = [reached]
    while True:
        new = kept(reached.join(pointers, [*keys, "at"]).select(*keys, F.col("to").alias("at")), "reached")
        if new.isEmpty():
            break
        found.append(new)
        reached = kept(reached.unionByName(new), "reached")
        further = pointers.select(*keys, F.col("at").alias("to"), F.col("to").alias("_to"))
        pointers = kept(pointers.join(further, [*keys, "to"]).select(*keys, "at", F.col("_to").alias("to")), "pointers", [pointers])
    begins = found[0]
    for more in found[1:]:
        begins = begins.unionByName(more)
    told = onward.join(begins.withColumn("_begins", F.lit(1)), [*keys, "at"], "left").withColumn("line", F.count("_begins").over(of.orderBy("at")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    lines = told.groupBy(*keys, "line").agg(F.min_by("start", "at").alias("start"), F.array_join(parts, " ").alias("text"), F.count("*").alias("segments"))
    folded = placed.where("_back").groupBy(*keys).agg(windows(F.transform(F.array_sort(F.collect_list(F.struct("at", "start", "text"))), lambda x: F.struct(x["start"], x["text"])), seconds).alias("_l"))
    return lines.unionByName(folded.select(*keys, F.posexplode("_l").alias("_p", "_x")).select(*keys, (F.col("_p") + 1).cast("long").alias("line"), "_x.start", "_x.text", F.lit(None).cast("long").alias("segments")))


def timed_text(segments: DataFrame, keys: list[str], max_chars: int = 9000, seconds: int = 30) -> DataFrame:
    """keys, text: what timestamped_text() makes of an array, of segments as rows: timed lines, every n-th of them if they are too long."""
    lines = timed_lines(segments, keys, seconds).withColumn("_line", F.concat(F.lit("["), fmt_timestamp(F.col("start")), F.lit("] "), "text"))
    sized = lines.withColumn("_total", F.sum(F.length("_line") + 1).over(Window.partitionBy(*keys)))
    step = F.greatest(F.lit(1), F.ceil(F.col("_total") / max_chars))
    rest = sized.where((F.col("line") - 1) % step == 0).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "_line"))), lambda x: x["_line"]).alias("_l"))
    return rest.select(*keys, F.substring(F.array_join("_l", "\n"), 1, max_chars).alias("text"))


def windows(segments: Column, seconds: int = 30) -> Column:
    """Segments (start, text) joined to lines of at least ``seconds``; the segment that passes the mark belongs to the line."""
    state = "struct<start:double,parts:array<string>,lines:array<struct<start:double,text:string>>>"
    line = lambda start, parts: F.struct(start.alias("start"), F.array_join(parts, " ").alias("text"))

    def step(a: Column, x: Column) -> Column:
        start = F.coalesce(a["start"], x["start"].cast("double"))
        parts = F.concat(a["parts"], F.array(x["text"]))
        full = x["start"] - start >= seconds
        closed = F.struct(F.lit(None).cast("double").alias("start"), F.array().cast("array<string>").alias("parts"), F.concat(a["lines"], F.array(line(start, parts))).alias("lines"))
        return F.when(full, closed).otherwise(F.struct(start.alias("start"), parts.alias("parts"), a["lines"].alias("lines"))).cast(state)

    begin = F.struct(F.lit(None).cast("double").alias("start"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<start:double,text:string>>").alias("lines")).cast(state)
    return F.aggregate(segments, begin, step, lambda a: F.when(F.size(a["parts"]) > 0, F.concat(a["lines"], F.array(line(a["start"], a["parts"])))).otherwise(a["lines"]))


def thin_step(lines: Column, max_chars: int) -> Column:
    """1, or how many lines stand for one where all of them, with their line ends, are longer than max_chars."""
    total = F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x) + 1)
    return F.greatest(F.lit(1), F.ceil(total / max_chars)).cast("int")


def thinned(lines: Column, max_chars: int) -> Column:
    """Every n-th of the lines, from the first."""
    step = thin_step(lines, max_chars)
    return F.filter(lines, lambda x, i: i % step == 0)


def timestamped_text(segments: Column, max_chars: int = 9000, seconds: int = 30) -> Column:
    """Timed lines of a transcript; if they are too long, every n-th of them."""
    lines = F.transform(windows(segments, seconds), lambda w: F.concat(F.lit("["), fmt_timestamp(w["start"]), F.lit("] "), w["text"]))
    return F.substring(F.array_join(thinned(lines, max_chars), "\n"), 1, max_chars)
