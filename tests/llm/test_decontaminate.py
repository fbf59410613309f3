import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate as dc

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def nearest(item, doc):
    """Least edits between the item and any part of the document, by the plain table."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, words, edits, word):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        move = rng.random()
        if move < 0.6:
            w[k] = word()
        elif move < 0.8:
            w.insert(k, word())
        elif len(w) > 1:
            del w[k]
    return w


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 12))]
        got, end = dc.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == nearest(a, b)
        back, n = dc.edit_distance(np.array(a[::-1], np.uint64), np.array(b[:end][::-1], np.uint64))
        assert back == got and 0 <= n <= end


def test_seed_runs_are_lossless():
    rng = random.Random(3)
    for length in range(1, 70):
        e = dc.allowed_edits(length, 0.8)
        cuts = sorted(rng.sample(range(length), e))
        runs = [b - a - 1 for a, b in zip([-1, *cuts], [*cuts, length])]
        assert max(runs) >= dc.seed_words(length, e)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(10, 60)))) for k in range(60)]
    docs = []
    for i in range(600):
        w = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(60)
            own = tokens(items[k][1])
            w += edited(rng, own, rng.randint(0, int(0.25 * len(own))), word) + [word() for _ in range(rng.randint(0, 30))]
        docs.append((i, ", ".join(w) if rng.random() < 0.2 else " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return items, docs


def test_against_brute_force(spark, corpus):
    items, docs = corpus
    want = {}
    for i, t in docs:
        d = tokens(t)
        for k, x in items:
            it = tokens(x)
            n = nearest(it, d)
            if n <= dc.allowed_edits(len(it), 0.8):
                want[i, k] = n
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.find(df, bench).collect()}
    assert set(got) <= set(want) and len(want) > 300
    assert len(got) >= 0.97 * len(want)
    assert all(r.edits >= want[key] for key, r in got.items()) and sum(r.edits == want[key] for key, r in got.items()) >= 0.97 * len(got)
    few = [key for key, n in want.items() if n <= 2]
    assert all(key in got for key in few)
    for (i, k), r in got.items():
        part = tokens(dict(docs)[i])[r.first_word : r.end_word]
        assert nearest(tokens(dict(items)[k]), part) == r.edits
    kept = {r.doc_id for r in dc.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_samples_follow_the_recall():
    asked = [dc.samples_for(k, 0.8, 0.99) for k in range(2, 9)]
    assert asked == sorted(asked) and asked[-1] > asked[0] and dc.samples_for(6, 0.8, 0.9) < dc.samples_for(6, 0.8, 0.9999)


def test_one_long_item_among_many_takes_little_memory():
    import tracemalloc

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(10_000)] + [(-1, " ".join(word() for _ in range(20_000)))]
    long = items[-1][1].split()
    edits = edited(rng, long, 3000, word)
    tracemalloc.start()
    index = dc.build_index(items, 0.8)
    found = dc.matches(pa.array(["x y z", " ".join(edits), items[7][1]], pa.string()), index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and {(r, index.ids[i]) for r, i, *_ in found} == {(1, -1), (2, 7)}


def test_slices_give_the_same(spark, corpus, monkeypatch):
    items, docs = corpus
    df = spark.createDataFrame(docs[:150], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.find(df, bench).collect()))
    monkeypatch.setattr(dc, "SLICE_BYTES", 4000)
    assert len(list(dc._slices(bench, "item_id", "text"))) > 3
    assert sorted(map(tuple, dc.find(df, bench).collect())) == whole


def test_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "a b"), (5, "a b"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x A, b y"), (3, "x A, b y"), (None, "a b"), (4, "a c b"), (5, "w1 w2 w3 w4 w5 w6 w7 w8"), (6, "w2 " * 200000)], "doc_id long, text string")
    got = sorted([(r.doc_id, r.item_id, r.edits) for r in dc.find(docs, bench).collect()], key=str)
    assert got == sorted([(3, 4, 0), (3, 4, 0), (3, 5, 0), (3, 5, 0), (None, 4, 0), (None, 5, 0), (5, 6, 2)], key=str)
    assert dc.find(docs.limit(0), bench).collect() == [] and dc.find(docs, bench.limit(0)).collect() == []
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 8


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in dc.op6_decontamination(spark, sf_dir).collect()}
    plain = {(i, k) for i, t in docs.items() for k, x in items.items() if " ".join(tokens(x)) in " ".join(tokens(t))}
    assert plain and plain <= {key for key, n in got.items() if n == 0}


def test_samples_reach_the_target_or_raise():
    assert dc.samples_for(8, 0.8, 0.99) <= 64 < dc.samples_for(8, 0.6, 0.99)
    with pytest.raises(ValueError, match="samples a walk"):
        dc.samples_for(8, 0.05, 0.999999)
