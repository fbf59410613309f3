import random

from quarry.llm.repeat_ladder import ladder, longest_repeats, spans


def test_levels_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 9, 12, 23, 45, 90)]
    texts = []
    for _ in range(40):
        w = []
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(None, " ".join(passages[5])), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, n = set(), 5
    while True:
        seen = {}
        for i, w in enumerate(texts):
            for p in range(len(w) - n + 1):
                seen.setdefault(tuple(w[p : p + n]), set()).add((i, p))
        level = {(i, n, p) for s in seen.values() if len({i for i, _ in s}) > 1 for i, p in s}
        if not level:
            break
        want |= level
        n *= 2
    got = ladder(df, 5)
    assert {(r.doc_id, r.length, r.pos) for r in got.collect()} == want and n > 40
    longest = {}
    for i, n, _ in want:
        longest[i] = max(n, longest.get(i, 0))
    assert {r.doc_id: r.longest for r in longest_repeats(df, 5).collect()} == longest
    for r in spans(got.where("length = 5"), 5).collect():
        cover = {p + k for i, n, p in want if n == 5 and i == r.doc_id for k in range(5)}
        assert set(range(r.first_word, r.end_word)) <= cover
    assert ladder(df.limit(0), 5).collect() == []
