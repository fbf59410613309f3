import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import readers, schemas, sinks

ROW = {"schema_version": "v1", "id": "a", "split": "train", "declaration_name": "n"}


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows))


def test_jsonl_and_versions(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [ROW, "", dict(ROW, id="b", schema_version="v0")])
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps(dict(ROW, id="c")))
    df = readers.jsonl(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl.gz"], schemas.RECORD)
    assert sorted(r.id for r in df.collect()) == ["a", "b", "c"] and df.schema == schemas.ddl(schemas.RECORD)
    with pytest.raises(Exception, match="schema version v0"):
        readers.versioned(df, "v1").collect()
    lines(tmp_path / "bad.jsonl", ["{nope"])
    with pytest.raises(Exception):
        readers.jsonl(spark, f"{tmp_path}/bad.jsonl", schemas.RECORD).collect()


def test_split_files_and_snapshot(spark, tmp_path):
    rows = [dict(ROW, id=f"{s}{i}", split=s) for s in schemas.SPLITS for i in range(3)]
    df = spark.createDataFrame([(r["id"], r["split"], None) for r in rows], "id string, split string, note string")
    manifest = sinks.snapshot(df, f"{tmp_path}/snap", "v1")
    (tmp_path / "snap" / "stale.txt").write_text("x")
    again = sinks.snapshot(df.repartition(5), f"{tmp_path}/snap", "v1")
    assert manifest == again and not (tmp_path / "snap" / "stale.txt").exists()  # byte-equal, stale files gone
    schema = "id string, split string, note string"
    assert readers.split_files(spark, f"{tmp_path}/snap", schema, suffix=".jsonl.gz").count() == 9
    assert readers.frozen_snapshot(spark, f"{tmp_path}/snap", manifest["files"], schema).count() == 9
    wrong = {**manifest["files"], "train.jsonl.gz": {**manifest["files"]["train.jsonl.gz"], "sha256": "0"}}
    with pytest.raises(ValueError, match="frozen"):
        readers.frozen_snapshot(spark, f"{tmp_path}/snap", wrong, schema)
    short = {k: {**v, "rows": 2} for k, v in manifest["files"].items()}
    with pytest.raises(ValueError, match="rows"):
        readers.frozen_snapshot(spark, f"{tmp_path}/snap", short, schema)
    assert sinks.jsonl_by_split(df, f"{tmp_path}/by") == {s: 3 for s in schemas.SPLITS}
    lines(tmp_path / "x" / "train.jsonl", [dict(ROW, split="heldout")])
    with pytest.raises(Exception, match="split differs"):
        readers.split_files(spark, f"{tmp_path}/x", schemas.RECORD, ["train"]).collect()
    assert '"note":null' in gzip.open(f"{tmp_path}/snap/train.jsonl.gz", "rt").read()


def test_globs_manifests_and_fixtures(spark, tmp_path):
    for name in ("one", "two"):
        lines(tmp_path / "corpora" / name / "membership.jsonl", [{"record_id": name}])
    got = readers.parent_keyed(spark, f"{tmp_path}/corpora/*/membership.jsonl", schemas.MEMBERSHIP, "corpus").collect()
    assert sorted((r.record_id, r.corpus) for r in got) == [("one", "one"), ("two", "two")]
    (tmp_path / "ids.txt").write_text("# c\n\n a \nb\n")
    assert [r.value for r in readers.manifest_lines(spark, f"{tmp_path}/ids.txt").collect()] == ["a", "b"]
    (tmp_path / "f.json").write_text(json.dumps({"tasks": [{"id": "t"}], "candidates": [{"task_id": "t", "candidate_id": "c"}]}, indent=1))
    f = readers.fixture_arrays(spark, f"{tmp_path}/f.json", {"tasks": schemas.TASK, "candidates": schemas.PROVIDED})
    assert f["tasks"].collect()[0].id == "t" and f["candidates"].collect()[0].candidate_id == "c"


def test_declarations(spark):
    src = "import X\ntheorem a (x : Nat) : x = x := by\n  sorry\n\ntheorem a.variants.b : p := by\n  sorry\ntheorem c\n  : q := by\n  sorry\n"
    df = spark.createDataFrame([(src,)], "value string")
    got = readers.declarations(df).collect()
    assert [(r.name, r.declaration, r.primary) for r in got] == [("a", "theorem a (x : Nat) : x = x", True), ("a.variants.b", "theorem a.variants.b : p", False), ("c", "theorem c\n  : q", True)]
    assert readers.benchmark_tasks(df, 2).count() == 2
    with pytest.raises(ValueError, match="expected 3"):
        readers.benchmark_tasks(df, 3)
    with pytest.raises(ValueError, match="duplicate"):
        readers.benchmark_tasks(df.union(df))
    ext = spark.createDataFrame([("r", "f.lean", "theorem k1 : p := by\n  simp\nlemma k2 : q := by\n  sorry\nend", "mit")], "repository string, file_path string, value string, licence string")
    known = spark.createDataFrame([], "fingerprint string")
    out = readers.external_declarations(ext, known, r"k\d", F.col("licence") == "mit", F.lit(True)).collect()
    assert [(r.name, r.overlaps) for r in out] == [("k1", False)]
    assert readers.external_declarations(ext, spark.createDataFrame([(out[0].fingerprint,)], "fingerprint string"), r"k\d", F.lit(True), F.lit(True)).collect()[0].overlaps


def test_steps_and_siblings(spark, tmp_path):
    for n in (100, 200):
        lines(tmp_path / f"step-{n}.json", [{"optimizer_step": n, "mean_target_token_cross_entropy": 1.0}])
    assert readers.step_files(spark, f"{tmp_path}/step-*.json", schemas.PROBE).count() == 2
    lines(tmp_path / "step-400.json", [{"optimizer_step": 400}])
    with pytest.raises(ValueError, match="steps"):
        readers.step_files(spark, f"{tmp_path}/step-*.json", schemas.PROBE)
    files = spark.createDataFrame([("a.lean",), ("a.trace",), ("b.lean",)], "path string")
    assert [r.want for r in readers.missing_siblings(files, [".trace"]).collect()] == ["b.trace"]
    with pytest.raises(ValueError, match="1 files"):
        readers.require_siblings(files, [".trace"])


def test_tree_cache_and_views(spark, tmp_path):
    (tmp_path / "t" / "s").mkdir(parents=True)
    (tmp_path / "t" / "s" / "x.txt").write_text("hi")
    m = {r.path: {"sha256": r.sha256, "bytes": r.bytes} for r in sinks.tree_manifest(spark, f"{tmp_path}/t").collect()}
    assert list(m) == ["s/x.txt"] and m["s/x.txt"]["sha256"] == readers.text_sha256("hi")
    sinks.require_tree(spark, f"{tmp_path}/t", m)
    (tmp_path / "t" / "y.txt").write_text("more")
    with pytest.raises(ValueError):
        sinks.require_tree(spark, f"{tmp_path}/t", m)
    readers.require_digests(readers.digests(spark, f"{tmp_path}/t"), {"x.txt": readers.text_sha256("hi")})
    with pytest.raises(ValueError):
        readers.require_digests(readers.digests(spark, f"{tmp_path}/t"), {"x.txt": "0"})
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.stage_cache(spark, f"{tmp_path}/cache", sinks.content_key("a", "b"), build).count() == 3
    assert len(calls) == 1
    recs = spark.createDataFrame([("s1", [("v1",), ("v2",)], "training"), ("s2", [("v3",)], "training")], "statement_id string, proof_variants array<struct<proof_variant_id:string>>, role string")
    view = sinks.membership_view(recs, "w")
    assert sinks.read_view(view, recs, "training").count() == 2
    for bad in (view.union(view), view.withColumn("variant_ids", F.reverse("variant_ids")), view.withColumn("statement_id", F.lit("zz"))):
        with pytest.raises(ValueError):
            sinks.read_view(bad, recs, "training")
    with pytest.raises(ValueError):
        sinks.read_view(view, recs, "test")
    done = spark.range(2)
    assert sinks.work_left(spark.range(4), done, ["id"]).count() == 2
    tasks = spark.createDataFrame([("t", "c", "x", "verified")], schemas.PROVIDED)
    assert sinks.checked_stage(tasks, f"{tmp_path}/stage", schemas.PROVIDED, ["task_id"]).count() == 1
    with pytest.raises(ValueError):
        sinks.checked_stage(tasks.union(tasks), f"{tmp_path}/stage2", schemas.PROVIDED, ["task_id"])
    assert sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string"), "T").endswith("| 1 |  |\n")
    run = spark.createDataFrame([("r", "v", "m", 4, None, None, None)], schemas.RUN)
    res = spark.createDataFrame([], schemas.RESULT)
    sinks.run_artifacts(run, res, f"{tmp_path}/run")
    assert readers.jsonl(spark, f"{tmp_path}/run/run.json", schemas.RUN).collect()[0].candidates_per_task == 4


def test_gzip_members_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MEMBER_LINES", 70)
    df = spark.createDataFrame([(f"{i:04d}", "é" * (i % 5), i % 3 == 0) for i in range(500)], "id string, note string, flag boolean")
    made = []
    for k, n in enumerate((1, 4, 9)):
        assert sinks.stable_gzip(df.repartition(n), f"{tmp_path}/{k}.gz", ["id"]) == 500
        made.append((tmp_path / f"{k}.gz").read_bytes())
    assert made[0] == made[1] == made[2] and made[0][4:8] == bytes(4) and not made[0][3]  # no time, no name
    text = gzip.decompress(made[0]).decode().splitlines()
    assert [json.loads(x)["id"] for x in text] == [f"{i:04d}" for i in range(500)] and made[0].count(b"\x1f\x8b\x08") >= 8
    assert spark.read.json(f"{tmp_path}/0.gz").count() == 500
    assert sinks.stable_gzip(df.limit(0), f"{tmp_path}/none.gz", ["id"]) == 0 and gzip.decompress((tmp_path / "none.gz").read_bytes()) == b""


def test_stage_cache_with_two_writers(spark, tmp_path):
    def late():
        # another writer of the key ends while this one builds
        assert sinks.stage_cache(spark, str(tmp_path), "k", lambda: spark.range(3)).count() == 3
        return spark.range(50)

    assert sinks.stage_cache(spark, str(tmp_path), "k", late).count() == 3 and spark.read.parquet(f"{tmp_path}/k").count() == 3
    with pytest.raises(Exception, match="no rows today"):
        sinks.stage_cache(spark, str(tmp_path), "bad", lambda: spark.range(9).selectExpr("id", "raise_error('no rows today') as x"))
    assert not (tmp_path / "bad").exists() and sinks.stage_cache(spark, str(tmp_path), "bad", lambda: spark.range(2)).count() == 2
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith((".", "_"))} == {"k", "bad"}
