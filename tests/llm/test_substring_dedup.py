import hashlib
import random
import re

import pytest

from quarry.llm import repeat_ladder
from quarry.llm.substring_dedup import dedup_substrings, op1_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [5, 8, 50])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    vocabulary = [f"wörd{k}" for k in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(n - 1, 3 * n))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t "), (None, " ".join(passages[0])), (4, " ".join(passages[0])), (4, " ".join(passages[1] + passages[0]))]
    for i in range(5, 60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, n))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, rows[20][1]), (101, rows[20][1]), (102, "x " * 7000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, h string, pos int")
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df, n).collect()], key=str)
    assert got == brute(rows, n)


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in op1_substring_dedup(spark, sf_dir).collect()], key=str)
    assert got == brute(rows, 50)
    assert any(r[2] for r in got)


def test_the_least_id_is_no_null(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(-(1 << 63), text), (5, text), (None, text), (None, text)]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 0, 0), (False, 0, 0), (True, -(1 << 63), 0), (True, 5, 60)]
    assert {(r.doc_id, r.longest) for r in repeat_ladder.longest_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()} == {(-(1 << 63), 50), (5, 50)}
