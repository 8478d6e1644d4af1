"""Mixing sources to target weights with hierarchical budgets.

Documents are leaves of a tree domain - language - source. A token budget goes down the tree by weight. A leaf can give its tokens at most
EPOCHS times; what a node can't use goes to its siblings by their weights, and only what all of them can't use goes to the siblings of
their parent. A leaf of budget b and a tokens gives b // a whole epochs, and of the next epoch a prefix of b % a tokens: documents in the
order of a hash of the seed, the epoch and doc_id, the last of them in part.

Of the documents only sums reach one place: tokens of each leaf, and of the 256 ranges of the hash in each, three times over, each time within the
range in which the leaf's prefix ends. Only the documents of the last such range, one in 2 ** 24 of the leaf, are ordered, and a leaf's cut is one row.
Budgets of at most TREE leaves are dealt by the driver. Those of more are dealt level by level over tables of the tree's nodes, whose running sums are
taken in ranges (_scan.py), so a node may have any number of children, and nothing but a few totals reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import sweep, written
from ._scan import running

EPOCHS = 4
#: Bits of the hash that are looked at in each turn, and turns.
BITS, TURNS = 8, 3
#: Exponent of a child's tokens, where no weight is given.
TEMPERATURE = 0.5
SEED = 17
LEVELS = ("domain", "lang", "source")
#: Leaves of a tree whose budgets the driver deals, of some hundred bytes each; those of more are dealt level by level in Spark, to the same result.
TREE = 20_000
_P = "_mix_"


def n_tokens() -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_domain(docs: DataFrame) -> Column:
    """The column domain, where docs have one; else the source's name without a number at its end (``news3``: news). ``other`` if there is no name."""
    named = F.col("domain").cast("string") if "domain" in docs.columns else F.regexp_replace("source", r"[-_ ]?[0-9]+$", "")
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("other"))


def share(total: int, weights: list[float], most: list[int]) -> list[int]:
    """total dealt by weight, to no one more than its most; whole numbers whose sum is total or all that can be taken."""
    given = [0] * len(weights)
    left, open_ = min(total, sum(most)), [i for i in range(len(weights)) if most[i] > 0]
    while left and open_:
        w = [max(weights[i], 0.0) for i in open_]
        if not sum(w):
            w = [1.0] * len(open_)
        parts = [left * x / sum(w) for x in w]
        full = [i for i, p in zip(open_, parts) if p >= most[i] - given[i]]
        if full:
            for i in full:
                left -= most[i] - given[i]
                given[i] = most[i]
            open_ = [i for i in open_ if i not in set(full)]
            continue
        whole = [int(p) for p in parts]
        rest = left - sum(whole)
        for k in sorted(range(len(open_)), key=lambda k: (whole[k] - parts[k], k)):
            if rest and whole[k] < most[open_[k]] - given[open_[k]]:
                whole[k] += 1
                rest -= 1
        for i, n in zip(open_, whole):
            given[i] += n
        left = rest
        open_ = [i for i in open_ if given[i] < most[i]]
    return given


def budgets(tokens: Mapping[tuple[str, ...], int], total: int, weights: Mapping[tuple[str, ...], float], epochs: int = EPOCHS) -> dict[tuple[str, ...], int]:
    """Budget of each leaf, for trees that fit one process: what _budgets deals out in Spark.

    tokens: of each leaf; weights: of any nodes, by path; a node without one weighs its tokens ** TEMPERATURE.
    """
    below: dict[tuple[str, ...], int] = defaultdict(int)
    kids: dict[tuple[str, ...], set] = defaultdict(set)
    for path, n in tokens.items():
        for k in range(len(path) + 1):
            below[path[:k]] += n
            if k < len(path):
                kids[path[:k]].add(path[: k + 1])
    out: dict[tuple[str, ...], int] = {}
    todo = [((), min(total, epochs * below[()]))]
    while todo:
        node, budget = todo.pop()
        if node not in kids:
            out[node] = budget
            continue
        own = sorted(kids[node])
        todo += zip(own, share(budget, [weights.get(p, below[p] ** TEMPERATURE) for p in own], [epochs * below[p] for p in own]))
    return {p: out[p] for p in tokens}


def _dealt(rows: DataFrame, parent: list[str], key: str) -> DataFrame:
    """rows with given: of each parent's budget what each child gets by weight, as share() deals it. rows: parent, key, budget, weight, most."""
    able = rows.where("most > 0").withColumn("_free", (F.col("weight") <= 0).cast("int"))  # children without weight share what the others leave, evenly
    sums = able.groupBy(*parent).agg(F.sum(F.when(F.col("_free") == 0, F.col("most")).otherwise(0)).alias("_m"), F.sum("most").alias("_all"))
    open_ = able.join(sums, parent).withColumn("_w", F.when(F.col("_free") == 1, 1.0).otherwise(F.col("weight")))
    open_ = open_.withColumn("_b", F.when(F.col("_free") == 0, F.least("budget", "_m")).otherwise(F.least("budget", "_all") - F.least("budget", "_m")))
    group = [*parent, "_free"]
    whole = open_.groupBy(*group).agg(F.sum("_w").alias("_of"))
    ranked = running(open_.drop("_m", "_all").withColumn("_ratio", F.col("most") / F.col("_w")), group, [F.col("_ratio"), F.col(key)], _m0="most", _w0="_w").join(whole, group)
    full = ranked.withColumn("_full", F.col("_ratio") * (F.col("_of") - F.col("_w0")) <= F.col("_b") - F.col("_m0"))
    left = full.groupBy(*group).agg((F.first("_b") - F.sum(F.when(F.col("_full"), F.col("most")).otherwise(0))).alias("_left"), F.sum(F.when(~F.col("_full"), F.col("_w"))).alias("_wl"))
    parts = full.join(left, group).withColumn("_part", F.when(F.col("_full"), F.col("most").cast("double")).otherwise(F.greatest(F.lit(0.0), F.col("_left") * F.col("_w") / F.col("_wl"))))
    parts = parts.withColumns({"_whole": F.floor("_part").cast("long"), "_one": F.when(F.col("_full"), 0).otherwise(1).cast("long")})
    rest = parts.groupBy(*group).agg((F.first("_b") - F.sum("_whole")).alias("_rest"))
    placed = running(parts.drop("_left", "_wl", "_ratio"), group, [F.col("_full"), (F.col("_whole") - F.col("_part")).asc(), F.col(key)], _at="_one").join(rest, group)
    extra = F.when(~F.col("_full") & (F.col("_at") < F.col("_rest")) & (F.col("_whole") < F.col("most")), 1).otherwise(0)
    given = placed.select(*parent, key, (F.col("_whole") + extra).alias("given"))
    return rows.join(given, [*parent, key], "left").withColumn("given", F.coalesce("given", F.lit(0)))


def _budgets(leaves: DataFrame, ratio: float, weights: Mapping[tuple[str, ...], float], epochs: int) -> DataFrame:
    """leaves (the three levels, n: tokens) with budget."""
    spark = leaves.sparkSession
    path = [f"{_P}{k}" for k in LEVELS]
    count, total = leaves.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= TREE:
        tree = {tuple(r[k] for k in path): r["n"] for r in leaves.collect()}
        dealt = budgets(tree, min(round(ratio * total), epochs * total), weights, epochs)
        named = spark.createDataFrame([(*p, n) for p, n in dealt.items()], ", ".join(f"{c} string" for c in path) + ", budget bigint")
        return leaves.join(F.broadcast(named), path)  # TREE rows at most
    above = leaves.select(F.lit(0).alias(f"{_P}root")).limit(1).withColumn("budget", F.lit(min(round(ratio * total), epochs * total)).cast("long"))
    for depth, key in enumerate(path):
        parent = [f"{_P}root", *path[:depth]]
        nodes = leaves.withColumn(f"{_P}root", F.lit(0)).groupBy(*parent, key).agg(F.sum("n").alias("n"))
        told = [(*p, float(w)) for p, w in weights.items() if len(p) == depth + 1]
        if told:
            nodes = nodes.join(F.broadcast(spark.createDataFrame(told, ", ".join(f"{c} string" for c in path[: depth + 1]) + ", weight double")), path[: depth + 1], "left")  # as many rows as the caller states
        else:
            nodes = nodes.withColumn("weight", F.lit(None).cast("double"))
        rows = nodes.join(above, parent).withColumns({"weight": F.coalesce("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))), "most": epochs * F.col("n")})
        above = written(_dealt(rows, parent, key).select(*parent, key, F.col("given").alias("budget")), "budgets")
        sweep(spark)
    return leaves.join(above.drop(f"{_P}root"), path)


def _cuts(light: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaves (whole, rest) with where the prefix of rest tokens ends: cut_h, cut_id, cut_n, the document that is the last to be taken.

    part: tokens taken of it; twins: how many documents are equal in these three; same: how many of them are taken whole. Null if rest is 0.
    """
    path = [f"{_P}{k}" for k in LEVELS]
    left = light.join(leaves.where("rest > 0").select(*path, "whole", "rest"), path).withColumn("h", _hash(F.col("seed"), F.col("whole"), F.col("id"))).select(*path, "id", "n", "h", "rest")
    for turn in range(TURNS):
        bucket = F.shiftright("h", 63 - BITS * (turn + 1)).bitwiseAND((1 << BITS) - 1)
        sums = left.withColumn("bucket", bucket).groupBy(*path, "rest", "bucket").agg(F.sum("n").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 2 ** BITS rows a leaf
        end = sums.withColumn("before", before).where("before < rest and before + n >= rest").select(*path, F.col("bucket").alias("end"), "before")
        left = written(left.join(end, path).where(bucket == F.col("end")).withColumn("rest", F.col("rest") - F.col("before")).drop("end", "before"), "edge")
        sweep(light.sparkSession)
    order = Window.partitionBy(*path).orderBy("h", "id", "n")
    equal = Window.partitionBy(*path, "h", "id", "n")
    run = left.withColumn("_done", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.withColumns({"same": F.row_number().over(equal.orderBy("_done")) - 1, "twins": F.count("*").over(equal)})
    last = run.where("_done < rest and _done + n >= rest and n > 0").select(*path, F.col("h").alias("cut_h"), F.col("id").alias("cut_id"), F.col("n").alias("cut_n"), "same", "twins", (F.col("rest") - F.col("_done")).alias("part"))
    return written(leaves.join(last, path, "left"), "cuts")


def _hash(seed: Column, epoch: Column, doc_id: Column) -> Column:
    """63 bits, the order in which a leaf's documents are taken in an epoch."""
    return F.xxhash64(seed, epoch, doc_id).bitwiseAND((1 << 63) - 1)


def selection(docs: DataFrame, ratio: float = 1.0, weights: Mapping[tuple[str, ...], float] | None = None, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None, prefix: str = "") -> DataFrame:
    """docs with domain, n_tokens, epochs (how often the document is taken) and tokens (taken in all), named with prefix in front.

    docs: doc_id, text, lang, source and any others; columns of the names added are replaced. ratio: the budget, in shares of all tokens. domain: see
    default_domain. A null lang or source is a branch of its own, named ``none``; a null text has no tokens; documents without tokens are taken in whole
    epochs only. Rows that repeat a doc_id are documents of their own; equal rows are interchangeable. An empty table gives no rows.
    """
    path = [f"{_P}{k}" for k in LEVELS]
    # A document without an id comes before all others.
    rows = docs.withColumns({path[0]: domain if domain is not None else default_domain(docs), path[1]: F.coalesce("lang", F.lit("none")), path[2]: F.coalesce("source", F.lit("none")), f"{_P}id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), f"{_P}n": n_tokens()})
    light = written(rows.select(*path, F.col(f"{_P}id").alias("id"), F.col(f"{_P}n").alias("n")), "light").withColumn("seed", F.lit(seed))
    dealt = _budgets(written(light.groupBy(*path).agg(F.sum("n").alias("n")), "leaves"), ratio, weights or {}, epochs)
    whole = F.expr("if(n > 0, budget div n, 0L)")
    cuts = _cuts(light, dealt.select(*path, whole.alias("whole"), (F.col("budget") - whole * F.col("n")).alias("rest")))
    repeated = cuts.where("twins > 1").limit(1).count() > 0
    cuts = cuts.withColumnsRenamed({c: f"{_P}{c}" for c in ("whole", "rest", "cut_h", "cut_id", "cut_n", "same", "twins", "part")})
    c = lambda name: F.col(f"{_P}{name}")
    joined = rows.join(cuts, path).withColumn(f"{_P}h", _hash(F.lit(seed), c("whole"), c("id")))
    at_cut = F.coalesce((c("h") == c("cut_h")) & (c("id") == c("cut_id")) & (c("n") == c("cut_n")), F.lit(False))
    before = F.coalesce((c("h") < c("cut_h")) | (c("h") == c("cut_h")) & ((c("id") < c("cut_id")) | (c("id") == c("cut_id")) & (c("n") < c("cut_n"))), F.lit(False))
    if repeated:  # only documents that are equal to the one at a cut are numbered
        equal = joined.where(at_cut).withColumn(f"{_P}place", F.row_number().over(Window.partitionBy(*path).orderBy(F.xxhash64("text"))))
        joined = joined.where(~at_cut).withColumn(f"{_P}place", F.lit(1)).unionByName(equal)
    else:
        joined = joined.withColumn(f"{_P}place", F.lit(1))
    own = F.when(c("place") <= c("same"), c("n")).when(c("place") == c("same") + 1, c("part")).otherwise(0)
    taken = joined.withColumn(f"{_P}take", F.when(at_cut, own).when(before, c("n")).otherwise(0))
    added = {f"{prefix}domain": c("domain"), f"{prefix}n_tokens": c("n"), f"{prefix}epochs": c("whole") + F.when(c("take") > 0, 1).otherwise(0), f"{prefix}tokens": c("whole") * c("n") + c("take")}
    return taken.select(*(x for x in docs.columns if x not in added), *(v.alias(k) for k, v in added.items()))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs, each as often as it is taken, with its columns; a document taken in part is kept whole, one without tokens in whole epochs only.

    Rows of null lang, source or text and rows that repeat a doc_id are treated as by selection. An empty table gives no rows.
    """
    chosen = selection(docs, prefix="_mixed_", **how).where("_mixed_epochs > 0")
    return chosen.withColumn("_mixed_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mixed_epochs")))).select(docs.columns)
