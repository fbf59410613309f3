import math
import random
import zlib

import pytest

from quarry.llm import toxicity as tx


def test_fold():
    assert tx.fold("1D10T").split() == ["idiot"] and tx.fold("ídïöt, l0ser!").split() == ["idiot", "loser"]
    assert tx.fold("іdіоt").split() == ["idiot"] and tx.fold("id​iot").split() == ["idiot"] and tx.fold("ＩＤＩＯＴ").split() == ["idiot"]
    for odd in ("idiot。", "idiot😀", "idiot،", "𝐢𝐝𝐢𝐨𝐭", "i̇d⃝iot", "🅘 ⓘⓓⓘⓞⓣ", "a\U000e0001 idiot\u200d"):
        assert "idiot" in tx.fold(odd).split(), odd
    assert tx.fold("हिन्दी 中文").split() != [] and tx.fold("x\ud7a4y\u3000z").split()[-1] == "z"
    assert tx.fold(None) == "  " and tx.fold("").strip() == ""


@pytest.mark.parametrize("exceptions", [["bad luck", "not worse"], ["bad luck", "not bad", "not bad luck", "luck worse", "bad bad"], []])
def test_weigh_matches_brute_force(exceptions):
    model = tx.Model({" bad ": 2.0, " worse": 3.0}, exceptions)
    automaton = model.automaton()

    def brute(text):
        folded = " " + " ".join(tx.fold(text).split()) + " "
        places = lambda p: [(i, i + len(p)) for i in range(len(folded)) if folded.startswith(p, i)]
        covers = [x for e in exceptions for x in places(f" {e} ")]
        return sum(w for p, w in model.lexicon.items() for a, b in places(p) if not any(c <= a and b <= d for c, d in covers))

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["bad", "luck", "not", "worse", "worsening", "b4d", "fine", "x."]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    totals, words = tx.weigh(automaton, [*texts, None])
    assert list(totals) == [brute(t) for t in texts] + [0.0]
    assert words[0] == len(texts[0].split()) and words[-1] == 0


def test_overlapping_exceptions_cover_a_match_once():
    model = tx.Model({" idiot ": 5.0, " moron ": 5.0}, ["harmless idiot", "idiot savant"])
    assert tx.weigh(model.automaton(), ["harmless idiot savant moron", "idiot savant", "idiot"])[0].tolist() == [5.0, 0.0, 5.0]


def _corpus(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "r0tten", "stinks" + word()]))
        elif i % 32 == 1:
            w.insert(0, "rotten apple")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_learns_words_beginnings_and_exceptions(spark):
    docs, labels, truth = _corpus(spark)
    model = tx.fit(docs, labels)
    assert " vilest " in model.lexicon or any(p.startswith(" vile") for p in model.lexicon)
    assert any(p.startswith(" stin") for p in model.lexicon)
    got = tx.score(docs, model).collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 600 and sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)


def test_fit_against_brute_force(spark):
    docs, labels, truth = _corpus(spark)
    # near copies of one toxic document count once
    copied = spark.createDataFrame([(10_000 + i, "zork " + " ".join(f"w{k}" for k in range(100)) + f" c{i}") for i in range(30)], "doc_id long, text string")
    model = tx.fit(docs.union(copied), labels.union(spark.createDataFrame([(10_000 + i, 1) for i in range(30)], "doc_id long, toxic int")))
    rows = [(r.doc_id, truth[r.doc_id], r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert model.rows == (sum(1 - y for _, y, _ in rows), sum(y for _, y, _ in rows) + 1) and not any("zork" in p for p in model.lexicon)
    counts = {}
    for _, y, text in rows:
        for f in {f" {w} " for w in tx.fold(text).split() if len(w) > 2} | {f" {w[:n]}" for w in tx.fold(text).split() for n in tx.PREFIXES if len(w) > n}:
            counts.setdefault(f, [0, 0])[y] += 1
    n0, n1 = model.rows
    for p, w in model.lexicon.items():
        c, t = counts[p]
        want = math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1)) - 1.96 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        assert t >= 3 and want >= 1.2 and math.isclose(w, want)


def test_sample_bound_and_repeated_ids(spark):
    docs, labels, _ = _corpus(spark)
    assert tx.fit(docs, labels, sample_rows=50).rows[0] <= 50
    assert tx.fit(docs.union(docs), labels) == tx.fit(docs, labels)


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = _corpus(spark)
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out(tx.F.col("doc_id")), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    assert tx.fit(docs, labels) == tx.fit(docs, flipped)


def test_edges(spark):
    docs, labels, _ = _corpus(spark)
    model = tx.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "vilest " * 3, "c"), (3, "plain " * 100000, "d")], "doc_id long, text string, score string")
    got = tx.score(odd, model).collect()
    assert len(got) == 5 and [r.predicted for r in got] == [0, 0, 0, 1, 0] and all(0 <= r.score <= 1 for r in got)
    assert not tx.fit(docs, labels.limit(0)).fitted and tx.score(odd, tx.Model()).agg({"score": "max"}).collect()[0][0] == 0
    assert tx.score(docs.limit(0), model).collect() == []
    kept = tx.drop_toxic(odd, model)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [1, 1, None, 3]
