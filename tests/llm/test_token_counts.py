import random
import re

from pyspark.sql import functions as F

from quarry.llm import token_counts as tc

ENCODE = tc.encoder(tc.TOKENIZER).encode_ordinary
PIECES = ["the", "It's", "don't", " ", "  ", "\n", "\n\n", "\t", "été", "über", "x" * 40, "123", "4 5", "!?", "…", "日本語", "a.b", "'ll", "'", " '", " ", "\x1c", "_", "a_b", "😀"]


def sample(rng, n):
    return "".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(n))


def test_leaves_keep_tokens(monkeypatch):
    rng = random.Random(1)
    for _ in range(400):
        text = sample(rng, rng.randint(0, 60))
        pieces = tc.cut_leaves(text, rng.randint(1, 20))
        assert "".join(pieces) == text
        assert [t for p in pieces for t in ENCODE(p)] == ENCODE(text)


def test_edits_against_full_recount(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(tc, "LEAF_CHARS", 8)
    monkeypatch.setattr(tc, "cut_leaves", lambda text, f=tc.cut_leaves: f(text, 8))
    for _ in range(150):
        doc = tc.Document(sample(rng, rng.randint(0, 120)), ENCODE)
        for _ in range(12):
            a = rng.randint(0, len(doc.text))
            b = min(len(doc.text), a + rng.choice([0, 0, 1, 3, 30, 500]))
            new = rng.choice(["", sample(rng, rng.randint(0, 20)), "x"])
            want = doc.text[:a] + new + doc.text[b:]
            doc.edit(a, b, new)
            assert doc.text == want and doc.n_tokens == len(ENCODE(want))
            leaves = tc.leaves_of(doc.root) if doc.root else []
            assert sum(x.chars for x in leaves) == len(want) and sum(x.tokens for x in leaves) == doc.n_tokens


def test_only_touched_leaves_are_encoded():
    text = "some plain words here " * 5000
    doc = tc.Document(text, ENCODE)
    before = doc.encoded
    doc.edit(50_000, 50_004, "thing")
    assert before > 190 and doc.encoded - before <= 3 and doc.n_tokens == len(ENCODE(doc.text))


def test_stored_trees_and_edges(spark):
    rows = [
        (1, "mail a.b@c.org now, password=abc123 and more", [(0, 4, "post"), (2, 8, "X"), (None, 3, "n"), (400, 500, "!")]), (2, None, None), (2, None, [(0, 0, "new text")]),
        (None, "", []), (3, "word " * 60000, [(5, 9, None)]), (4, "abc", [(0, 3, "")]),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, leaf_chars int")
    got = tc.count_edited(tc.build_trees(df)).collect()
    texts = ["postX@c.org now, password=abc123 and more!", "", "new text", "", "word  " + "word " * 59998, ""]
    assert [r.text or "" for r in got] == texts
    assert [r.tokens_after for r in got] == [len(ENCODE(t)) for t in texts]
    assert [r.tokens_before for r in got] == [len(ENCODE(t or "")) for _, t, _ in rows]
    again = tc.count_edited(spark.createDataFrame(got).withColumn("edits", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("So ").alias("text"))))).collect()
    assert [r.tokens_after for r in again] == [len(ENCODE("So " + t)) for t in texts] and again[4].reencoded_leaves < 4
    assert tc.count_edited(tc.build_trees(df.limit(0))).collect() == []


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = tc.op3_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r.n_edits for r in got)
    for r in got:
        edited, n = OLD.subn("[redacted]", docs[r.doc_id])
        assert (r.n_edits, r.tokens_before, r.tokens_after) == (n, len(ENCODE(docs[r.doc_id])), len(ENCODE(edited)))


OLD = re.compile(
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*\S+|(?<![\w+])\+?\d[\d ()./-]{7,}\d(?!\w)", re.I
)


def test_redactions_are_those_of_one_pattern():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", "x@y.z", "+", "-", " ", "password=", "token: ", "0", "123 456-789", ".", "é", "@@", "api_key=k@l.m"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert tc.redacted(text) == [m.span() for m in OLD.finditer(text)], text


def test_long_texts_without_spaces_are_linear():
    import time

    for text, leaves in (("a" * 1_000_000, 1), ("a.b-" * 250_000, 100), ("a@" * 300_000, 100), ("漢字、文章。" * 160_000, 100), ("http://a.example/b?c=d&e;" * 40_000, 100), ("1 " * 300_000, 100)):
        began = time.process_time()
        tc.redacted(text)
        assert len(tc.cut_leaves(text)) >= leaves and time.process_time() - began < 2


def test_many_edits_at_once():
    rng = random.Random(9)
    for _ in range(120):
        doc = tc.Document(sample(rng, rng.randint(0, 400)), ENCODE)
        edits = tc.tidy([(a := rng.randint(0, len(doc.text)), a + rng.choice([0, 1, 5, 900]), rng.choice(["", "x", " new words "])) for _ in range(rng.randint(0, 12))], len(doc.text))
        want = doc.text
        for a, b, new in reversed(edits):
            want = want[:a] + new + want[b:]
        doc.apply(edits)
        leaves = tc.leaves_of(doc.root) if doc.root else []
        assert doc.text == want and doc.n_tokens == len(ENCODE(want)) == sum(x.tokens for x in leaves) and sum(x.chars for x in leaves) == len(want)
