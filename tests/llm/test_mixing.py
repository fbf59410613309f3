import hashlib
import json
import math
from collections import Counter

import duckdb

from quarry.llm import mixing


def u(seed, i, k):
    return (int(hashlib.sha256(f"{seed}|{i}|{k}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)


def identity(i, text, **others):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parts = ["null" if i is None else str(i), "null" if text is None else sha(text)]
    if others:
        parts.append(sha(json.dumps({k: v for k, v in others.items() if v is not None}, separators=(",", ":"))))
    return sha("|".join(parts))


def brute(seed, i, rate):
    slices = max(1, math.ceil(rate / 16))
    total = 0
    for s in range(1, slices + 1):
        r, k = rate / slices, 0
        p = c = math.exp(-r)
        while c < u(seed, i, s):
            k += 1
            p *= r / k
            c += p
        total += k
    return total


def test_counts_follow_the_inverse_distribution(spark):
    rows = [(i, f"t{i}", "a" if i < 700 else "b" if i < 995 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copy": mixing.F.lit(7), "rate": mixing.F.lit("r"), "doc": mixing.F.lit("d"), "k": mixing.F.lit(1)})
    got = {r.doc.doc_id: (r.rate, r.n_copies) for r in mixing.copies(df, {"a": 1.0, "b": 2.0}, 3.0, 1.0).collect()}
    # the operator's own columns are no part of a row's identity
    assert all(n == brute(mixing.SEED, identity(i, f"t{i}", source=rows[i][2], rate="r", doc="d", k=1), rate) for i, (rate, n) in got.items())
    assert math.isclose(got[0][0], 1 / 4 * 3000 / 700) and math.isclose(got[999][0], 1 / 4 * 3000 / 5)  # rate 150: many slices
    by = Counter()
    for i, _, s in rows:
        by[s] += got[i][1]
    assert abs(by["b"] - 1500) < 200 and abs(by["a"] - 750) < 150 and abs(by[None] - 750) < 150
    out = mixing.mix(df, {"a": 1.0, "b": 2.0}, 3.0)
    assert out.columns == ["doc_id", "text", "source", "rate", "doc", "k", "copy", "mix_key"] and out.first().rate == "r"
    keys = [r.mix_key for r in out.collect()]
    assert keys == sorted(keys) and len(keys) == sum(by.values())


def test_zero_weight_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "x", "b")], "doc_id long, text string, source string")
    rows = mixing.mix(df, {"a": 0.0}, 2.0).collect()
    assert {r.source for r in rows} <= {"b"}
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix(df, {"a": 0.0, "b": 0.0}).collect() == []


def test_null_and_repeated_ids_draw_by_text(spark):
    rows = [(None, f"n{i}", "a") for i in range(400)] + [(7, f"s{i}", "b" if i % 2 else None) for i in range(400)] + [(8, "only", "a"), (None, None, "a"), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc.doc_id, r.doc.text): r for r in mixing.copies(df, {}, 1.0).collect()}
    assert len(got) == len(rows) == len({r.identity for r in got.values()})
    for i, prefix in ((None, "n"), (7, "s")):
        mine = [got[i, f"{prefix}{k}"] for k in range(400)]
        assert len({r.n_copies for r in mine}) > 2 and abs(sum(r.n_copies - r.rate for r in mine)) < 100
    for i, t, source in rows:
        r = got[i, t]
        assert (r.identity, r.n_copies) == (who := identity(i, t, source=source), brute(mixing.SEED, who, r.rate))
    keys = [r.mix_key for r in mixing.mix(df, {}, 1.0).collect()]
    assert len(set(keys)) == len(keys) == sum(r.n_copies for r in got.values())


def test_equal_rows_draw_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 64)
    rows = [(None, "same", "a", 1)] * 500 + [(3, "same", "a", 1)] * 2 + [(3, "same", "a", 2), (4, "x", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    got = mixing.copies(df, {}, 1.0).collect()
    assert len(got) == len(rows) == len({r.identity for r in got})
    assert all(r.n_copies == brute(mixing.SEED, r.identity, r.rate) for r in got)
    same = [r.n_copies for r in got if r.doc.doc_id is None]
    who = identity(None, "same", source="a", extra=1)
    assert {r.identity for r in got if r.doc.doc_id is None} == {who} | {f"{who}|{k}" for k in range(1, 500)}
    assert len(same) == 500 and len(set(same)) > 2 and abs(sum(same) - 500) < 120
    keys = [r.mix_key for r in mixing.mix(df, {}, 1.0).collect()]
    assert keys == sorted(set(keys)) and len(keys) == sum(r.n_copies for r in got)


def test_sources_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}", f"s{i % 40}" if i % 3 else None) for i in range(300)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted(map(tuple, mixing.mix(df).collect())) == want


def test_sql_on_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, f"n{i % 30}", "src0" if i % 5 else None) for i in range(200)] + [(7, f"s{i % 9}", "b") for i in range(60)] + [(None, None, "a"), (None, "", "a"), (9, "q\"\\z", 'o"d')]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = mixing.op7_mixing(spark, str(tmp_path))
    names = ["doc_id", "source", "copy", "mix_key", "text_sha256"]
    key = lambda r: r[3]
    want = con.execute(f"select {', '.join(names)} from ({mixing.OP7_SQL})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want, key=key)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = mixing.op7_mixing(spark, sf_dir)
    want = con.execute(mixing.OP7_SQL)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows and sorted(map(tuple, got.select(*names).collect())) == sorted(rows)
