import math
import random

import duckdb
import pytest

from quarry.llm import topk_search as tk


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], {}
    for i, v in good:
        if i % 50 == 0:
            seen[i] = min(seen.get(i, v), v)
    for i, q in seen.items():
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("drop", [0, 3])
@pytest.mark.parametrize("dim", [1, 7])
def test_against_brute_force(spark, drop, dim):
    rng = random.Random(dim)
    vec = lambda: [rng.choice([0.0, rng.gauss(0, 0.3), rng.gauss(0, 2)]) for _ in range(dim)]
    rows = [(i, vec()) for i in range(300)]
    hot = vec()
    rows += [(i, hot) for i in range(300, 420)] + [(7, vec()), (0, vec()), (None, vec()), (500, None), (501, [None] * dim), (502, [math.nan] * dim), (503, [math.inf] * dim), (550, [0.1] * (dim + 1))]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, v string, score double")
    got = sorted(map(tuple, tk.top_k(df, df.where("vec_id % 50 = 0"), 5, drop_bits=drop).collect()))
    assert got == brute(rows, 5)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in tk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert tk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = tk.op10_topk_search(spark, sf_dir)
    want = con.execute(tk.OP10_SQL)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows and sorted(map(tuple, got.select(*names).collect())) == sorted(rows)


@pytest.mark.parametrize("x", [2.0**22, 2.0**30, 2.0**41, -1e300, 1.7e308])
def test_large_finite_components_rank_exactly(spark, x):
    rows = [(0, [x, 1.0]), (1, [x, 1.5]), (2, [-x, 1.0]), (3, [0.5, 1.0]), (4, [x / 2, -3.0]), (5, [x, 1.5]), (50, [-x, x]), (7, [math.inf, 1.0]), (8, [x, None])]
    rows += [(100 + i, [i / 3, -i / 7]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, tk.top_k(df, df.where("vec_id % 50 = 0"), 4).collect()))
    q = {i: [tk._scaled([c], 256)[0] for c in v] for i, v in rows if all(c is not None and math.isfinite(c) for c in v)}
    want = []
    for i in (0, 50):
        s = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i)[:4]
        want += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -n))) for r, (n, j) in enumerate(s)]
    assert got == sorted(want)


def test_many_repeats_of_one_row(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [1.0, 1.0])] * 500 + [(8, [0.5, 0.0])] * 3 + [(9, [float(i % 7), 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, tk.top_k(df, df.where("vec_id = 0")).collect())) == brute(rows, 5)
