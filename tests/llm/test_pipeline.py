import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests_llm_helpers import brute_components, brute_leaks, brute_windows


CLASHING = ["n", "node", "rest", "did", "score", "tox_score", "n_words", "n_removed", "gone_id", "rate", "doc", "k", "marks", "anchors", "kept_text"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic texts, near copies, shared passages and benchmark leaks."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(12, 40)))) for k in range(12)]
    passage = text(70)
    docs, labels = [], []
    for i in range(400):
        w = text(rng.randint(30, 160))
        kind = rng.choice(["plain", "plain", "toxic", "copy", "passage", "leak"])
        if kind == "toxic":
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "r0tten", "stinker"]))
        elif kind == "copy" and docs:
            w = rng.choice(docs)[1].split()
            w[rng.randrange(len(w))] = word()
        elif kind == "passage":
            w[10:10] = passage
        elif kind == "leak":
            own = rng.choice(items)[1].split()
            own[rng.randrange(len(own))] = word()
            w[5:5] = own
        docs.append((i, " ".join(w), "en", f"src{rng.randint(0, 3)}", 0))
        labels.append((i, 1, int(any(x in docs[-1][1] for x in ("vilest", "r0tten", "stinker")))))
    docs += [(400, None, None, None, None), (401, "", "en", "src1", 0), (402, " ".join(passage), "en", "src1", 0), (403, " ".join(passage), "en", "src2", 0), (404, "word " * 60000, "en", "src1", 0)]
    path = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.char_length("text").cast("long"))
    # other columns whose names the operators use themselves
    df = df.withColumns({c: F.lit(c) for c in CLASHING})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {i: x[2] for i, *x in ((l[0], l[1], l[1], l[2]) for l in labels)}


def test_stages_against_brute_force(spark, folder):
    path, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, path)
        if name != "mixing":
            assert out.dtypes == docs.dtypes and out.columns == columns
        docs = cp.written(out, "test")
        after = {}
        rows = docs.collect()
        for r in rows:
            after[r.doc_id] = r
        if name == "toxicity":
            assert set(after) == {i for i in before if not toxic.get(i)}
        elif name == "near_duplicates":
            assert set(after) == {i for i, c in brute_components([(i, r.text) for i, r in before.items()], 5, 80, 100).items() if i == c}
        elif name == "substring_dedup":
            want = brute_windows([(i, r.text) for i, r in before.items()], 50)
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        elif name == "decontamination":
            assert set(after) == set(before) - brute_leaks([(i, r.text) for i, r in before.items()], items, 0.8)
        if name not in ("mixing", "substring_dedup"):
            assert all(after[i] == before[i] for i in after)
    assert set(after) <= set(before) and docs.columns == [*columns, "copy", "mix_key"]
    assert sorted(map(str, rows)) == sorted(map(str, cp.run(spark, path).collect()))


def test_null_ids_and_repeated_rows(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id in (400, 401)")
    null = docs.where("doc_id = 401").withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("plain words of a row without an id")})
    docs = docs.union(docs).union(null).union(null)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, path).collect()} <= {None, 400, 401}


def test_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0
        docs = cp.written(out, "empty")
