import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from quarry.llm import importance as im

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_features(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in brute_features(t, n)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows, stands = [], []
    for i, text in docs:
        f, words = brute_features(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None])
        if words >= least:
            stands.append(rows[-1])
    stands.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(stands[: len(stands) * percent // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    words = ["Ab", "été", "ÉTÉ", "x1", "the", "to-morrow", "日本", "a_b", "\x7f", "z" * 300, "İ", "k\u0000k"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in rng.permutation(300)]
    docs += [(900, None), (901, ""), (902, "!? ."), (903, "the to " * 40_000), (None, "the x1 " * 15), (904, "one"), (905, "two")]
    target = [" ".join(rng.choice(words[3:7], 12)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, counts string").repartition(5)
    got = im.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, n)


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert im.resample(none, none).collect() == []
    assert im.bucket_counts(none).sum() == 0
    docs = [(1, "a b " * 12)] * 25 + [(2, "b c " * 12)] * 25
    got = im.resample(spark.createDataFrame(docs, "doc_id long, text string"), none, percent=40).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21)) and len({r.score for r in got}) == 2
    assert {tuple(r)[:4] for r in got} == {r[:4] for r in brute(docs, [])}


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    got = im.op11_importance(spark, sf_dir)
    want = con.execute(im.OP11_SQL)
    rows, names = want.fetchall(), [d[0] for d in want.description]
    assert rows and sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
