"""The whole pipeline, stage by stage, against plain versions on documents with odd rows; each stage on what its predecessor kept."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import language_id, mixing, token_files

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A train leaves Boston at 5 pm with 120 passengers and travels 300 km to Chicago while John eats 7 apples on the way home."


def made():
    rng = random.Random(11)
    parts = {"en": "the er in on th an re at st".split(), "fr": "ré eau que ment ou ai elle les".split()}
    rows = []
    for i in range(140):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 90))), lang, f"s{i % 4}"))
    near = rows[10][1].split()
    near[3] = "changed"
    rows += [(200, rows[10][1], "en", "s1"), (201, " ".join(near), "en", "s9"), (202, rows[30][1], "fr", None), (203, f"{rows[40][1]} {ITEM}", "en", "s2"), (204, ITEM.replace("Boston", "Paris").replace("120", "77"), "en", "s2")]
    rows += [(300, None, "en", "s1"), (301, "", "en", "s1"), (302, "12 34 !!", None, None), (303, "the in on " * 4000, "en", "s3"), (304, rows[5][1] + " thin", None, "s5"), (None, rows[7][1] + " an an an", "en", "s1"), (50, rows[50][1], rows[50][2], rows[50][3])]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(made(), COLUMNS).repartition(3).withColumns({"score": F.lit("clash"), "tokens": F.lit(1), "component_id": F.lit("clash")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def listed(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "text", "lang", "source").collect()), key=str)


def plain_copies(rows):
    """One row of each group that links of 80 of 100 shingles make, that of its smallest id; rows without an id stay."""
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
            sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    first, out = set(), []
    for r in sorted(rows, key=str):
        if r[0] is None or find(r[0]) == r[0] and r[0] not in first:
            first.add(r[0])
            out.append(r)
    return out


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = given = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == given.columns
        kept[name] = listed(docs)
    told = {(r["doc_id"], r["text"]) for r in given.join(language_id.languages(given).where("lang_pred <> 'und' and score >= 0.35").select("doc_id").distinct(), "doc_id", "left_semi").collect()}
    assert {r[:2] for r in kept["language"] if r[0] is not None} == told and not {300, 301, 302} & {r[0] for r in kept["language"]}
    assert {r[0] for r in kept["language"]} >= set(range(140)) | {303, None}

    assert kept["duplicates"] == sorted(plain_copies(kept["language"]), key=str)
    assert not {200, 201, 202} & {r[0] for r in kept["duplicates"]}

    gone = {r[0] for r in kept["duplicates"]} - {r[0] for r in kept["benchmark"]}
    assert gone == {203, 204} and [r for r in kept["duplicates"] if r[0] not in gone] == kept["benchmark"]

    times = Counter({(r["doc_id"], r["text"], r["lang"], r["source"]): r["epochs"] for r in mixing.selection(spark.read.parquet(f"{folder}/benchmark").drop("tokens")).collect()})
    assert Counter(kept["mixture"]) == +times

    t, at, want = Tokenizer.from_file(token_files.TOKENIZER), 0, []
    ids = lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
    for i, own in sorted(((r[0], ids(r[1])) for r in kept["mixture"]), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    assert sorted(map(tuple, corpus_pipeline.tokens(spark, docs, folder).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1]) == want


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
