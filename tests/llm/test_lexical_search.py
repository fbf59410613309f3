import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarry.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    known = [(i, split(t)) for i, t in docs]
    known = [(i, len(t), Counter(t)) for i, t in known if t]
    n_docs, n_terms, df = len(known), sum(n for _, n, _ in known), Counter(w for _, _, c in known for w in c)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        scored = []
        for doc, n, tf in known:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in set(split(text)) if w in tf)
            if doc is not None and score > 0:
                scored.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(rng, n):
    words = ["the", "The", "of", "été", "ÉTÉ", "x1", "日本", "İ", *(f"w{i}" for i in range(40))]
    share = 1 / np.arange(1, len(words) + 1)
    text = lambda size: rng.choice([" ", ", ", "-"]).join(rng.choice(words, size, p=share / share.sum()))
    docs = [(int(i), text(rng.integers(0, 40))) for i in rng.permutation(n)]
    docs += [(5000 + i, "copy of w7 w9 the") for i in range(200)] + [(9000, None), (9001, ""), (9002, "the w3 " * 30_000), (None, "w7 x1"), (3, "w7"), (3, "w7")]
    items = [(i, text(rng.integers(1, 25))) for i in range(12)] + [(12, "w7 W7 w9!"), (13, None), (14, ""), (15, "unseen words"), (None, "w7"), (16, "w8"), (16, "w5")]
    return docs, items


@pytest.mark.parametrize(("k", "block", "batch", "seeds"), [(1, 4_000_000, 512, 64), (7, 300, 4, 1), (50, 1000, 32, 3), (500, 4_000_000, 512, 64)])
def test_against_brute_force(spark, monkeypatch, k, block, batch, seeds):
    monkeypatch.setattr(ls, "BATCH", batch)
    monkeypatch.setattr(ls, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(ls, "SEED_BUCKETS", seeds)
    docs, items = corpus(np.random.default_rng(k), 400)
    df = spark.createDataFrame([(*r, 1, [2]) for r in docs], "doc_id long, text string, score int, terms array<int>").repartition(3)
    got = ls.rank(df, spark.createDataFrame([(*r, 0.5) for r in items], "item_id long, text string, rank double"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, items, k)


def test_slices_of_items(spark, monkeypatch):
    monkeypatch.setattr(ls, "SLICE_BYTES", 400)
    docs, items = corpus(np.random.default_rng(4), 60)
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(ls.item_slices(asked, "item_id", "text"))) > 2
    assert sorted(map(tuple, ls.rank(df, asked, 9).collect())) == brute(docs, items, 9)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ls.rank(none, some).collect() == []
    assert ls.rank(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), some.limit(0)).collect() == []
    assert ls.rank(spark.createDataFrame([(1, "?"), (2, None)], "doc_id long, text string"), some).collect() == []


def block(rng, n_docs, n_terms, ties):
    docs, words = np.divmod(np.flatnonzero(rng.random(n_docs * n_terms) < 0.2), n_terms)
    impacts = np.full(len(docs), 500) if ties else rng.integers(1, 1_000_000, len(docs))
    return ls.Treaps(rng.permutation(n_docs) * 3, docs, words, impacts, n_terms)


@pytest.mark.parametrize("ties", [False, True])
def test_treaps_are_search_trees_and_heaps(ties):
    t = block(np.random.default_rng(1), 900, 6, ties)
    deepest = 0
    for root in t.root.tolist():
        todo, seen = [(root, -1, 10**9, 10**9, 1)], 0
        while todo:
            node, low, high, above, depth = todo.pop()
            if node == t.none:
                continue
            assert low < t.doc[node] < high and t.impact[node] <= above
            seen, deepest = seen + 1, max(deepest, depth)
            todo += [(t.left[node], low, t.doc[node], t.impact[node], depth + 1), (t.right[node], t.doc[node], high, t.impact[node], depth + 1)]
        assert seen == np.count_nonzero(t.keys // len(t.ids) == t.root.tolist().index(root))
    assert deepest < 40  # equal impacts make no chain


def test_search_prunes():
    t = block(np.random.default_rng(2), 20_000, 4, False)
    ids, scores, scored = t.search(np.arange(4), np.array([9, 5, 2, 1]), 10)
    every = t.scores(np.arange(20_000), np.arange(4), np.array([9, 5, 2, 1]))
    top = np.lexsort((t.ids, -every))[:10]
    assert scores.tolist() == every[top].tolist() and ids.tolist() == t.ids[top].tolist()
    assert scored < 3_000


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    rows = con.execute(ls.OP12_SQL).fetchall()
    assert rows and sorted(rows) == sorted(map(tuple, ls.op12_lexical_search(spark, sf_dir).collect()))
