import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import lexer
from quarry.operators.expectations import Violation
from quarry.plans import builds
from quarry.sources import schemas


def raw_rows():
    span = lambda n: {"start": {"line": n, "column": 1}, "end": {"line": n + 1, "column": 1}}
    rows = []
    for i in range(60):
        rows.append(dict(
            file_path=f"Mathlib/F{i % 20}.lean", declaration_name=f"n{i}", declaration_kind="theorem", source_span=span(i + 1), declaration_span=span(i + 1), proof_span=span(i + 1),
            declaration=f"theorem n{i} (x : Nat) : p{i if i % 15 else 0} x :=", proof="by sorry" if i == 7 else "by simp", premises=[f"n{i + 20}", "zz"], is_private=i == 5,
        ))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(raw_rows(), schemas.ddl(schemas.RAW))
    contaminated = spark.createDataFrame([(lexer.statement_fingerprint("theorem q (x : Nat) : p3 x"),)], "statement_fingerprint string")
    return builds.build_corpus(df, contaminated, {"train": 0.8, "validation": 0.1, "heldout": 0.1}, "s", "repo", "rev")


def test_build(corpus):
    rec = corpus["records"].collect()
    assert len(rec) == 57 and {r.filter_reason: r.n for r in corpus["reasons"].collect()} == {"private": 1, "proof_placeholder": 1, "contaminated": 1}
    shared = {r.component_id for r in rec if r.declaration.endswith("p0 x")}
    assert len(shared) == 1  # files that share a statement are one component
    assert [r.split for r in corpus["statistics"].collect()] == list(schemas.SPLITS) and sum(r.records for r in corpus["statistics"].collect()) == 57
    keys = [(schemas.SPLITS.index(r.split), r.file_path, r.source_span.start.line) for r in rec]
    assert keys == sorted(keys) and rec[0].token_lengths.declaration > 5


def test_specialise(spark, corpus):
    fams = spark.createDataFrame([("a", [f"Mathlib/F{i}.lean" for i in range(1, 9)], None)], "family_id string, paths array<string>, patterns array<string>")
    bounds = dict(window=1, depth=2, fan_out=64, ring=100, source_limit=100, control_prefix="Mathlib/F9", most_selected=0.9)
    out = builds.specialise(corpus["records"], fams, **bounds)
    assert out["nodes"].count() == 57 and {r.corpus for r in out["corpora"].select("corpus").distinct().collect()} >= {"core", "bubble", "wide"}
    assert all(r.n == 0 for r in out["leakage"].collect())


def test_evaluate(spark):
    tasks = spark.createDataFrame([("a", "x"), ("b", "y")], "task_id string, kind string")
    rows = [(t, i, "verified" if (t, i) == ("a", 1) else "lean_rejected", "eos", 1.0, 1.0, 2.0, 3) for t in "ab" for i in range(4)]
    res = spark.createDataFrame(rows, "task_id string, candidate_index int, category string, finish_reason string, generation_latency_seconds double, verification_latency_seconds double, total_latency_seconds double, generated_token_count int")
    out = builds.evaluate(res, tasks, 4, (1, 4), ["kind"])
    s = out["summary"].collect()[0]
    assert s.complete and s["pass@1"] == 0.125 and s["pass@4"] == 0.5
    assert {(r.value, r.solved) for r in out["breakdowns"].collect()} == {("x", 1), ("y", 0)} and out["differences"].collect() == []
    stray = builds.evaluate(res.union(res.limit(1).withColumn("task_id", F.lit("q"))), tasks, 4)["summary"].collect()[0]
    assert not stray.complete and stray.unexpected_tasks == 1 and stray.infrastructure_errors == 1


def test_corpus_v2_reader(spark, tmp_path):
    decl = "theorem a (x : Nat) : x = x"
    fp = lexer.sha(lexer.alpha_normalized(decl))
    row = {"schema_version": "v2", "statement_id": "s", "canonical_declaration": decl, "normalized_statement_fingerprint": fp, "role": "training", "sampling_group_id": "s", "provenance": "real",
           "proof_variants": [{"proof_variant_id": "v", "canonical_proof": "by rfl", "verification": {"status": "accepted"}}], "topic_tags": [], "memberships": []}
    (tmp_path / "r.jsonl").write_text(json.dumps(row))
    assert builds.read_corpus_v2(spark, f"{tmp_path}/r.jsonl", "v2").count() == 1
    for change in ({"normalized_statement_fingerprint": "0"}, {"sampling_group_id": "t"}):
        (tmp_path / "bad.jsonl").write_text(json.dumps({**row, **change}))
        with pytest.raises(Violation):
            builds.read_corpus_v2(spark, f"{tmp_path}/bad.jsonl", "v2")
    assert builds.compact(spark.range(1).withColumn("b", F.lit(1)), ["b", "zz"]).columns == ["b"]
