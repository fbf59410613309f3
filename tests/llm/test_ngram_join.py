import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_join as nj
from quarry.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n_docs):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60))
    line = [word() for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "one two"), (5, "two one"), (6, " \n")]
    bases = [[word() for _ in range(rng.choice([3, 8, 30, 120, 300]))] for _ in range(12)]
    while len(rows) < n_docs:
        w = list(rng.choice(bases)) if rng.random() < 0.75 else [word() for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 20])):
            if w:
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + line
        if rng.random() < 0.2:
            w = w[: int(len(w) * rng.uniform(0.8, 1))]
        rows.append((len(rows), " ".join(x.upper() if rng.random() < 0.05 else x for x in w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, n, num, den, monkeypatch):
    rows = corpus(n, 400)
    monkeypatch.setattr(nj, "TILE_MIN", 8)  # components are cut into several tiles
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, node string, n int")
    got = sorted(map(tuple, nj.link_components(df, n, num, den).collect()))
    assert got == brute(rows, n, num, den)
    assert len({c for _, s, c in got if s}) < len(rows) - 50


@pytest.mark.parametrize("paired", [2, 5])
def test_pairs_and_tiles_together(spark, monkeypatch, paired):
    rows = corpus(11, 250)
    monkeypatch.setattr(nj, "TILE_MIN", 8)
    monkeypatch.setattr(nj, "PAIRED", paired)  # some shingles give pairs, others ties
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.link_components(df).collect())) == brute(rows, 5, 80, 100)


def test_chance_meetings_make_no_chain(spark, monkeypatch):
    rng = random.Random(5)
    words = [[f"{rng.getrandbits(40):x}" for _ in range(30)] for _ in range(60)]
    rows = [(i, " ".join(w + words[(i + 1) % 60][:6])) for i, w in enumerate(words)]  # each document holds the next one's first words
    edges = []
    monkeypatch.setattr(nj, "connected_components", lambda e: edges.append(e.count()) or connected_components(e))
    got = sorted(map(tuple, nj.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows, 5, 80, 100) and edges == [0, 0]


def test_long_sets_that_meet_by_chance_are_told_apart():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2**63, size, dtype=np.uint64)) for size in (9000, 8100, 9500, 300, 320)]
    sets.append(np.sort(np.concatenate([sets[0][:8900], sets[1][:50]])))  # links with the first
    table = pa.table({
        "bin": [0] * 6, "cell": [0] * 6, "side": [2] * 6, "node": list(range(6)), "n": [len(x) for x in sets],
        "bitmap": pa.array([nj._bitmaps([x], nj._screen_bits(len(x))).tobytes() for x in sets], pa.binary()),
    })
    assert nj._screen(85, 100)(table).column("node").to_pylist() == [0, 5]
    assert (nj._folded(table.column("bitmap")[0].as_py(), 256) == nj._bitmaps([sets[0]], 2048)[0]).all()


def test_texts_asked_for_alone_travel(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = {r.doc_id for r in nj._asked(rows, rows.where("doc_id % 100 = 7").select("doc_id")).collect()}
    assert got >= set(range(7, 4000, 100)) and len(got) < 60


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f"), (5, None), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, nj.link_components(df).collect()), key=str)
    assert got == sorted([(3, 2, 3), (4, 2, 3), (5, 0, 5), (5, 0, 5), (None, 2, None)], key=str)
    assert nj.link_components(df.limit(0)).collect() == []


def test_components_of_chains(spark):
    rng = random.Random(9)
    ids = rng.sample(range(10**6), 3000)
    edges = [(ids[i], ids[i + 1]) for i in range(2999) if i % 500 != 499] + [(ids[0], ids[0])]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {x: min(ids[i - i % 500 : i - i % 500 + 500]) for i, x in enumerate(ids)}
    assert got == want


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, nj.op8_ngram_jaccard(spark, sf_dir).collect()))
    assert got == brute(rows, 4, 85, 100)
