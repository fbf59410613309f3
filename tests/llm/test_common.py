from quarry.llm.common import most_frequent


def test_most_frequent(spark):
    df = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(300)], "token string, n long")
    got = most_frequent(df, 40)
    counts = sorted((r.n for r in df.collect()), reverse=True)
    assert 30 <= len(got) <= 44 and min(r.n for r in got) >= counts[50]
    assert len(most_frequent(df, 10_000)) == 300 and most_frequent(df.limit(0), 5) == [] and most_frequent(df, 0) == []


def test_one_large_class_gives_its_share(spark):
    df = spark.range(1000).selectExpr("id as token", "7L as n")
    assert 400 < len(most_frequent(df, 500)) < 600
