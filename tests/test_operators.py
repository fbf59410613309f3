import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.operators import components, composition, dedup, expectations, filters, graph, joins, metrics, sampling, stats
from quarry.sources import schemas


def results(spark, rows):
    return spark.createDataFrame(
        [(t, i, c, f, None, 0.5, 1.0, n) for t, i, c, f, n in rows],
        "task_id string, candidate_index int, category string, finish_reason string, generation_latency_seconds double, verification_latency_seconds double, total_latency_seconds double, generated_token_count int",
    )


def test_pass_at_k(spark):
    cases = [(8, 0, 1, 0.0), (8, 8, 4, 1.0), (8, 1, 1, 1 / 8), (8, 1, 4, 0.5), (8, 1, 8, 1.0), (8, 5, 4, 1.0), (3, 1, 4, None), (4, 5, 1, None)]
    for n, c, k, want in cases:
        got = spark.range(1).select(x.pass_at_k(F.lit(n), F.lit(c), k).alias("p")).collect()[0].p
        assert got == want if want is None else abs(got - want) < 1e-12


@pytest.mark.parametrize("n", [1, 2, 3, 10, 19, 20, 21, 40, 100, 101])
def test_percentile_definitions(spark, n):
    import math

    df = spark.range(1, n + 1).select((F.col("id") * 10).alias("v"))
    for p in (0.5, 0.9, 0.95, 0.99):
        r = df.agg(x.nearest_rank("v", p).alias("a"), x.nearest_rank(F.col("v"), p).alias("b"), x.fudged_rank("v", p).alias("c"), x.interpolated("v", p).alias("d")).collect()[0]
        nearest = 10 * max(1, math.ceil(round(p * n, 9)))
        assert (r.a, r.b, r.c) == (nearest, nearest, 10 * max(1, min(n, int(p * n + 0.999999)))) and r.d == pytest.approx(10 * (1 + (n - 1) * p))


def test_mcnemar(spark):
    p = lambda a, b: spark.range(1).select(x.mcnemar_exact(F.lit(a), F.lit(b)).alias("p")).collect()[0].p
    assert p(166, 3) == pytest.approx(2.1505332133872815e-45, rel=1e-12) and p(171, 0) == pytest.approx(6.68e-52, rel=1e-3) and p(1, 1) == 1.0 and p(0, 0) == 1.0


def test_run_summary(spark):
    full = results(spark, [("t", i, "verified" if i == 3 else "lean_rejected", "eos", 5) for i in range(8)])
    want = spark.createDataFrame([("t",)], "task_id string")
    r = metrics.run_summary(full, want, 8).collect()[0]
    assert r.complete and r["pass@1"] == 1 / 8 and r["pass@8"] == 1.0 and r.finish_eos == 8 and r.finish_token_limit == 0 and r.generation_latency_sum == 0.0 and r.generation_latency_mean is None and r.tokens == 40
    assert [c for c in metrics.run_summary(full.where("candidate_index = 0"), want, 1).columns if c.startswith("pass@")] == ["pass@1"]
    broken = full.withColumn("category", F.when(F.col("candidate_index") == 0, "generation_error").otherwise(F.col("category")))
    for bad in (broken, full.where("candidate_index <> 2"), full.withColumn("candidate_index", F.lit(0)), full.withColumn("task_id", F.lit("u"))):
        b = metrics.run_summary(bad, want, 8).collect()[0]
        assert not b.complete and b["pass@1"] is None
    nulls = full.withColumn("generated_token_count", F.lit(None).cast("int"))
    assert metrics.run_summary(nulls, want, 8, null_policy="zero").collect()[0].tokens == 0
    with pytest.raises(Exception, match="null token"):
        metrics.run_summary(nulls, want, 8, null_policy="fail").collect()


def test_breakdown(spark):
    t = spark.createDataFrame([("a", 1), ("a", 0)], "d string, verified int")
    got = {r.d: (r.tasks, r.solved, r.pass_at_1) for r in metrics.breakdown(t, "d", ["a", "b"], 2, [1]).collect()}
    assert got == {"a": (2, 1, 0.25), "b": (0, 0, None)}
    with pytest.raises(ValueError):
        metrics.breakdown(t, "d", ["b"], 2, [1])


SPAN = {"start": {"line": 1, "column": 1}, "end": {"line": 2, "column": 1}}


def raw(**kw):
    base = dict(file_path="Mathlib/A.lean", declaration_name="N.a", declaration_kind="theorem", source_span=SPAN, declaration_span=SPAN, proof_span=SPAN, declaration="theorem a : p :=", proof="by simp", premises=["x", "", "b", "x"], is_private=False)
    return {**base, **kw}


@pytest.mark.parametrize(("change", "reason"), [
    ({}, None), ({"is_private": True}, "private"), ({"declaration": "private theorem a : p :="}, "private"), ({"declaration_name": "_private.x"}, "unstable_name"), ({"declaration_name": ""}, "unstable_name"),
    ({"declaration_kind": "def"}, "unsupported_kind"), ({"file_path": "Other/A.lean"}, "outside_source_scope"), ({"proof_span": None}, "ambiguous_source_span"), ({"declaration": None}, "missing_declaration"),
    ({"declaration": "def a : p :="}, "ambiguous_declaration"), ({"proof": None}, "non_tactic_proof"), ({"proof": "fun x => x"}, "non_by_proof"), ({"proof": "by   "}, "empty_completion"), ({"proof": "by sorry"}, "proof_placeholder"),
    ({"proof": "by admit"}, "proof_placeholder"), ({"proof": "by exact sorryish"}, None), ({"declaration": "theorem a : p where"}, "unsupported_proof_delimiter"),
])
def test_reject_cascade(spark, change, reason):
    df = spark.createDataFrame([raw(**change)], schemas.ddl(schemas.RAW))
    r = filters.evaluate_raw(df, "repo", "rev").collect()[0]
    assert r.filter_reason == reason and (r.id is None) == (reason is not None)
    if reason is None:
        assert r.declaration == "theorem a : p" and r.premises == ["b", "x"] and len(r.statement_fingerprint) == 64


def test_canonical_proofs(spark):
    def one(p):
        r = spark.createDataFrame([(p,)], "p string").select(x.canonical_proof("p").alias("c"), x.completion_of("p").alias("k")).collect()[0]
        return (r.c.proof, r.c.transformation) if r.c else None

    assert one("by simp\r\n") == ("by simp", "none") and one("by") is None and one("") is None
    assert one("h.1\n\n  h.2") == ("by\n  exact (\n    h.1\n\n      h.2\n  )", "term-to-exact")
    assert one("| 0 => a\n| n => b") == ("by\n  exact (\n    @fun\n      | 0 => a\n      | n => b\n  )", "equations-to-fun-exact")
    assert one("where\n  a := 1") == ("by\n  exact {\n    a := 1\n  }", "where-to-structure-exact") and one("where ") is None
    src = spark.createDataFrame([("theorem t (n : Nat) : p n where\n  a := 1", False), ("theorem t : p := x", False), ("theorem t : Nat → p\n| 0 => a", False), ("theorem t : p", False), ("theorem t : p := sorry", False)], "source string, is_private boolean")
    assert [(r.form, r.filter_reason) for r in filters.reslice(src).collect()] == [("where", None), ("term", None), ("equations", None), (None, "ambiguous_declaration"), ("term", "proof_placeholder")]


def test_result_category(spark):
    rows = [("", None, False, 0, "", "empty_candidate"), (" \n", None, False, 0, "", "empty_candidate"), ("x", "verifier_error", False, 0, "", "verifier_error"), ("x", None, True, None, "", "verifier_timeout"), ("x", None, False, 0, "ok", "verified"), ("x", None, False, 0, "a\nF.lean:1:2: error: no", "lean_rejected"), ("x", None, False, 1, "", "lean_rejected")]
    df = spark.createDataFrame(rows, "t string, p string, o boolean, e int, out string, want string")
    assert all(r.got == r.want for r in df.select("want", x.result_category(F.col("t"), F.col("p"), F.col("o"), F.col("e"), F.col("out")).alias("got")).collect())


def test_spans(spark):
    s = spark.createDataFrame([("abc\ndef\n",)], "s string")
    at = lambda l, c: F.struct(F.lit(l).alias("line"), F.lit(c).alias("column"))  # noqa: E731, E741
    got = s.select(x.position_offset("s", at(2, 1)).alias("a"), x.position_offset("s", at(3, 1)).alias("b"), x.position_offset("s", at(4, 1)).alias("c"), x.position_offset("s", at(1, 5)).alias("d")).collect()[0]
    assert tuple(got) == (4, 8, None, None)
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in [(4, 7, "X"), (0, 1, "YY")]])
    assert s.select(x.substitute_spans("s", edits).alias("t")).collect()[0].t == "YYbc\nX\n"
    bad = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("text")) for a, b in [(0, 3), (2, 4)]])
    assert s.select(x.substitute_spans("s", bad).alias("t")).collect()[0].t is None


def test_components_and_splits(spark):
    rec = spark.createDataFrame([("A", "f1"), ("B", "f1"), ("C", "f2"), ("D", "f3"), ("B", "f3")], "file_path string, statement_fingerprint string")
    c = {r.file_path: r.component_id for r in components.file_components(rec).collect()}
    assert c["A"] == c["B"] == c["D"] != c["C"]
    sizes = spark.createDataFrame([(f"c{i}", 1) for i in range(20)], "component_id string, size long")
    prop = {"train": 0.9, "validation": 0.05, "heldout": 0.05}
    a = {r.component_id: r.split for r in components.assign_splits(sizes, prop, "s").collect()}
    b = {r.component_id: r.split for r in components.assign_splits(sizes.orderBy(F.desc("component_id")).repartition(7), prop, "s").collect()}
    assert a == b and sorted(a.values()).count("train") == 18 and sorted(a.values()).count("validation") == 1
    with pytest.raises(ValueError):
        components.assign_splits(sizes, {"train": 1.0}, "s")


def graph_records(spark):
    rows = [(f"{i:03d}", f"n{i}", "NT/a.lean" if i < 8 else "NT/b.lean", i, 1, p, s, f"c{i}", f"f{i}") for i, p, s in [
        (1, ["n2"], "train"), (2, ["n3"], "train"), (3, [], "train"), (4, ["n1"], "train"), (5, ["n4"], "train"), (6, [], "train"), (7, [], "validation"), (9, ["n1"], "heldout"), (10, ["zz", "n10"], "heldout"), (11, [], "train"), (12, [], "train"), (13, [], "train")]]
    return spark.createDataFrame(rows, "id string, declaration_name string, file_path string, line int, col int, premises array<string>, split string, component_id string, statement_fingerprint string")


def test_internal_graph_and_partitions(spark):
    rec = graph_records(spark)
    fams = spark.createDataFrame([("z", ["NT/a.lean"], ["^n1$"])], "family_id string, paths array<string>, patterns array<string>")
    seeds = filters.seed_families(rec, fams).select("id", "family_id")
    g = graph.internal_graph(rec, fams, seed_matches=seeds, window=1, depth=2, fan_out=8, ring=100, source_limit=10, control_prefix="Other/", most_selected=0.9)
    cls = {r.record_id: r.relevance_class for r in g["classes"].collect()}
    assert cls == {"001": "core", "002": "premise-1", "003": "premise-2", "004": "user-1", "009": "user-1", "005": "user-2"}
    assert {r.type for r in g["edges"].collect()} == set(schemas.EDGE_TYPES)
    d = g["diagnostics"].collect()[0]
    assert (d.premises_total, d.premises_resolved) == (7, 5)
    nodes = g["nodes"]
    m = graph.specialist_partitions(nodes, schemas.BUBBLE, "NT/")
    got = {}
    for r in m.collect():
        got.setdefault(r.corpus, set()).add(r.id)
    assert got["near-holdout"] == {"009"} and got["far-holdout"] == {"010"} and got["core"] == {"001"} and got["validation"] == {"007"}
    assert all(r.n == 0 for r in graph.leakage(m, nodes).collect())
    with pytest.raises(ValueError):
        graph.internal_graph(rec, fams.union(fams.withColumn("family_id", F.lit("none"))), seed_matches=seeds, window=1, depth=2, fan_out=8, ring=100, source_limit=10, control_prefix="Other/")
    with pytest.raises(ValueError):
        graph.internal_graph(rec, fams, seed_matches=seeds, window=1, depth=2, fan_out=8, ring=100, source_limit=10, control_prefix="NT/")


def test_bootstrap(spark):
    t = spark.createDataFrame([(i, v, v) for i, v in enumerate([0, 1, 0, 2])], "pos long, base int, adapter int")
    a = {r.metric: (r.low, r.high) for r in stats.paired_bootstrap(t, 8, 1, 50, "s").collect()}
    assert a["delta"] == (0.0, 0.0) and a == {r.metric: (r.low, r.high) for r in stats.paired_bootstrap(t.repartition(5), 8, 1, 50, "s").collect()}
    m = {r.metric: r for r in stats.twister_bootstrap(t, 8, 1, 50, 7).collect()}
    assert m["delta"].low == 0.0 and m["base"].mean == pytest.approx(3 / 32) and m["base"].low <= m["base"].high


def brute_means(rows, replicates, seed):
    """Means of resamples, drawing places in the rows sorted by value."""
    import xxhash

    rows, n, out = sorted(rows), len(rows), []
    start = xxhash.xxh64_intdigest(seed.encode(), 42)
    place = lambda i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), start) ^ (1 << 63)) - (1 << 63)
    for r in range(replicates):
        drawn = [rows[place(r * n + i) % n] for i in range(n)]
        out.append([sum(v[k] for v in drawn) / n for k in range(len(rows[0]))])
    return out


def test_bootstraps_against_brute_force(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(3)
    rows = sorted((rng.randint(0, 1), rng.randint(0, 1)) for _ in range(41))
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "pos long, base int, adapter int")
    plain = np.array(brute_means([(b, a, a - b) for b, a in rows], 2000, "s"))
    # counts of outcomes are distributed as naive resampling distributes them
    counted = stats.paired_bootstrap(df, 1, 1, 2000, "s").collect()
    for k, name in enumerate(("base", "adapter", "delta")):
        (got,) = [r for r in counted if r.metric == name]
        low, high = np.percentile(plain[:, k], [2.5, 97.5])
        assert abs(got.mean - plain[:, k].mean()) < 0.01 and abs(got.low - low) < 0.04 and abs(got.high - high) < 0.04
    again = np.array([[r.base, r.adapter] for r in stats.bootstrap_means(df, 500, "s", ["base", "adapter"]).orderBy("r").collect()])
    key = int(hashlib.sha256(b"s").hexdigest()[:16], 16)
    kinds = sorted(set(rows))
    share = [rows.count(v) / 41 for v in kinds]
    want = [np.random.Generator(np.random.PCG64([key, r])).multinomial(41, share) @ np.array(kinds) / 41 for r in range(500)]
    assert np.allclose(again, want)
    # beyond the bound of outcomes rows are drawn by position
    monkeypatch.setattr(stats, "OUTCOMES", 2)
    got = {r.metric: r for r in stats.paired_bootstrap(df, 1, 1, 2000, "s").collect()}
    for k, name in enumerate(("base", "adapter", "delta")):
        low, high = np.percentile(plain[:, k], [2.5, 97.5])
        assert (got[name].mean, got[name].low, got[name].high) == (pytest.approx(plain[:, k].mean()), pytest.approx(low), pytest.approx(high)) and got[name].spans_zero == (low <= 0 <= high)
    deltas = sorted(a - b for b, a in rows)
    flat = spark.createDataFrame([(i, 0 if v >= 0 else 1, 1 if v > 0 else 0) for i, v in enumerate(deltas)], "pos long, base int, adapter int")
    gaps = np.array(brute_means([(v,) for v in deltas], 400, "g-train")) - np.array(brute_means([(v,) for v in deltas], 400, "g-heldout"))
    (gap,) = stats.gap_bootstrap(flat, flat, 1, 1, 400, "g").collect()
    assert (gap.low, gap.high) == tuple(map(pytest.approx, np.percentile(gaps, [2.5, 97.5])))


def test_twister_gap_draws_both_workloads_from_one_generator(spark):
    import random

    import numpy as np

    sides = {"train": [(0, 1), (2, 4), (1, 1), (0, 3)], "heldout": [(1, 0), (4, 4), (0, 2)]}
    frames = [spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "pos long, base int, adapter int").repartition(3) for rows in sides.values()]
    got = {r.k: (r.low, r.high) for r in stats.twister_gap_bootstrap(*frames, 4, (1, 4), 200, 11).collect()}
    rng, gaps = random.Random(11), {1: [], 4: []}
    for _ in range(200):
        lift = {}
        for side, rows in sides.items():
            picked = [rows[rng.randrange(len(rows))] for _ in range(len(rows))]
            lift[side] = {1: np.mean([(a - b) / 4 for b, a in picked]), 4: np.mean([float(a > 0) - float(b > 0) for b, a in picked])}
        for k in gaps:
            gaps[k].append(lift["train"][k] - lift["heldout"][k])
    assert got == {k: tuple(map(pytest.approx, np.percentile(v, [2.5, 97.5]))) for k, v in gaps.items()}


def test_gaps_and_checkpoints(spark):
    g = spark.createDataFrame([("base", "train", 0.1), ("base", "heldout", 0.05), ("adapter", "train", 0.4), ("adapter", "heldout", 0.15)], "model string, split string, score double")
    r = stats.generalisation_gaps(g).collect()[0]
    assert [round(v, 9) for v in (r.base_gap, r.adapter_gap, r.train_delta, r.heldout_delta, r.gap_change)] == [0.05, 0.25, 0.3, 0.1, 0.2]
    p = spark.createDataFrame([(100, 2.0), (200, 1.0), (300, 1.0)], schemas.PROBE)
    assert stats.best_checkpoint(p, [100, 200, 300]).collect()[0].optimizer_step == 200
    for bad in (p.where("optimizer_step <> 200"), p.withColumn("mean_target_token_cross_entropy", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            stats.best_checkpoint(bad, [100, 200, 300])
    log = spark.createDataFrame([(i, float(i), 1.0) for i in range(1, 6)], "step int, loss double, grad_norm double")
    assert stats.log_coverage(log, 5).collect()[0].complete and not stats.log_coverage(log.where("step <> 3"), 5).collect()[0].complete


def test_joins_fail_closed(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    with pytest.raises(ValueError):
        joins.paired(a, a.where("id = 1"), "id", "v")
    with pytest.raises(ValueError):
        joins.cross_checked(a, a.withColumn("v", F.lit("x")), "id", ["v"])
    with pytest.raises(ValueError):
        joins.overlay(a, a.withColumn("id", F.lit(9).cast("long")).limit(1), ["id"])
    with pytest.raises(ValueError):
        joins.positional(a, a.limit(1), "id")
    with pytest.raises(ValueError):
        filters.in_order(a.withColumn("id", F.col("id").cast("string")), ["1", "7"])
    with pytest.raises(ValueError):
        dedup.keep_first(a.union(a.withColumn("v", F.lit("z"))), ["id"], ["v"], payload=["v"])
    with pytest.raises(ValueError):
        sampling.hash_sample(a, 3, "p")
    with pytest.raises(ValueError):
        sampling.stratified(a, "v", 1, "s", wanted=["x", "q"])


def test_crosswalk(spark):
    src = spark.createDataFrame([("f", "a", 1, 1, "included"), ("f", "b", 5, 1, "blocked"), ("g", "c", 2, 1, "included")], "file_path string, declaration_name string, line int, col int, disposition string")
    rows = spark.createDataFrame([("1", "f", "a", None, None), ("2", "", "c", None, None), ("3", "f", "wrong", 1, 1), ("4", "f", "wrong", 9, 9)], "row_id string, file_path string, declaration_name string, line int, col int")
    got = {r.row_id: (r.disposition, r.resolution) for r in joins.fallback_crosswalk(rows, src).collect()}
    assert got == {"1": ("included", "exact-file-and-declaration-name"), "2": ("included", "unique-declaration-name"), "3": ("included", "immutable-source-span-start"), "4": ("source-integrity-blocked", "unresolved")}
    assert joins.crosswalk_summary(joins.fallback_crosswalk(rows, src)).where("resolution = 'unresolved'").collect()[0].examples == ["4"]


def test_merge_rejects_crossings(spark):
    base = spark.createDataFrame([("s", 0, "training", "e", "real"), ("s", 1, "test", "e", "real")], "statement_id string, pos int, role string, environment_id string, provenance string")
    df = base.withColumns({"declaration": F.lit("d"), "tags": F.array(F.lit("t")), "memberships": F.array(F.lit("m")), "variants": F.array(F.struct(F.lit("f").alias("fingerprint"), F.concat(F.lit("v"), "pos").alias("variant_id"), F.lit("p").alias("proof")))})
    with pytest.raises(ValueError):
        dedup.merge_statements(df)
    ok = dedup.merge_statements(df.withColumn("role", F.lit("training"))).collect()[0]
    assert [v.variant_id for v in ok.variants] == ["v0"]  # the first of a fingerprint


def brute_neighbours(pool):
    """The neighbours of each declaration, by comparing all pairs of a family."""
    out = {}
    tags = lambda r: {t for t in r["topic_tags"] if t.startswith(graph.RELEVANCE_TAGS)}
    for a in pool:
        for b in pool:
            if a is b or a["family"] != b["family"]:
                continue
            both = set(a["resolved_dependencies"]) & set(b["resolved_dependencies"])
            users = {d: sum(d in r["resolved_dependencies"] for r in pool if r["family"] == a["family"]) for d in both}
            met, name = a["source_module"] == b["source_module"] or tags(a) & tags(b), (a["family"], a["declaration_name"], b["declaration_name"])
            if b["declaration_name"] in a["resolved_dependencies"]:
                out[name] = "direct-dependency"
            elif any(n <= 3 for n in users.values()):
                out[name] = "shared-dependency-neighborhood"
            elif met:
                out[name] = "direct-dependency" if a["declaration_name"] in b["resolved_dependencies"] else "shared-dependency-neighborhood" if both else "same-source-module" if a["source_module"] == b["source_module"] else "shared-relevance-neighborhood"
    return out


def test_neighbours_and_walks(spark, monkeypatch):
    import hashlib
    import random

    rng = random.Random(8)
    names = [f"N{i:02d}" for i in range(24)]
    pool = [
        dict(family=f, declaration_name=n, statement_id=f"s-{f}-{n}", source_module=f"M{rng.randint(0, 9)}", type_head=rng.choice(["iff", "and", "other"]),
             resolved_dependencies=rng.sample([*names, "x", "y"], rng.randint(0, 3)), topic_tags=rng.sample(["prime-family:q", "riemann-seed:z", "other:t", "riemann-relevance:c"], rng.randint(0, 1)))
        for f in ("f", "g") for n in names
    ]
    for r in pool:
        r["resolved_dependencies"] = [d for d in r["resolved_dependencies"] if d != r["declaration_name"]]
    kind = "family string, declaration_name string, statement_id string, source_module string, type_head string, resolved_dependencies array<string>, topic_tags array<string>"
    df = spark.createDataFrame([tuple(r.values()) for r in pool], kind)
    near = graph.neighbours(df, 3)
    want = brute_neighbours(pool)
    assert {(r.family, r.a, r.b): r.relation for r in near.collect()} == want and set(want.values()) == set(graph.RELATIONS)
    counts = {"f": 13, "g": 12}
    near.cache()
    got = sorted(composition.walk_plans(df.repartition(5), near, counts, "seed").collect(), key=lambda r: r.pos)
    assert sorted(composition.walk_plans(df, near, counts, "seed", ahead=12, lags=1).collect(), key=lambda r: r.pos) == got
    # each plan again, from its own seed: attempts are counted until the set is new and whole
    taken, pos = set(), 0
    for family in ("f", "g"):
        attempt = 0
        for r in [r for r in got if r.family == family]:
            size, members = [2, 3, 4][pos % 3], []
            while len(members) < size or frozenset(members) in taken:
                attempt += 1
                rand = random.Random(int(hashlib.sha256("\0".join(["seed", family, str(attempt), str(pos)]).encode()).hexdigest(), 16))
                members, steps = [names[rand.randrange(24)]], []
                for _ in range(size - 1):
                    edges = [(m, b, want[family, m, b]) for m in members for b in names if b not in members and (family, m, b) in want]
                    if edges:
                        steps.append(edges[rand.randrange(len(edges))])
                        members.append(steps[-1][1])
                members = [f"s-{family}-{m}" for m in members]
            taken.add(frozenset(members))
            assert (r.pos, r.members, r.structural_class, r.final_only, [tuple(s) for s in r.steps]) == (pos, members, ["direct", "branching", "deep"][pos % 3], pos % 10 == 0, steps)
            pos += 1
    assert pos == 25
    plans = spark.createDataFrame(got)
    made = {r.pos: r for r in composition.described(plans).collect()}
    a, b = got[0].members
    assert made[0].normalized_proof_dag == f"iff(forward:leaf:{b},backward:leaf:{a});path=2" and made[0].generator_family == "final-only:direct-graph-iff-v2"
    a, b, c, e = got[2].members
    assert made[2].normalized_proof_dag == f"and(iff(forward:leaf:{b},backward:leaf:{a}),iff(forward:leaf:{e},backward:leaf:{c}));path>=3" and made[2].generator_family == "deep-graph-logic-v2"
    rows = composition.retrieval(plans, df, near, "seed").collect()
    for r in got:
        origins = {}
        for m in r.names:
            for b in names:
                if (r.family, m, b) in want:
                    origins.setdefault(b, set()).add(f"dependency-relevance-neighborhood:{want[r.family, m, b]}")
        head = "iff" if r.final_only else "and"
        for p in pool:
            if p["family"] == r.family and p["type_head"] == head:
                origins.setdefault(p["declaration_name"], set()).add(f"type-head:{head}")
        order = sorted((n for n in origins if n not in r.names), key=lambda n: hashlib.sha256(f"seed\0{r.pos}\0retrieval\0{n}".encode()).hexdigest())[:4]
        assert [(x.declaration_name, x.origins) for x in sorted((x for x in rows if x.pos == r.pos), key=lambda x: x.rank)] == [(n, ",".join(sorted(origins[n]))) for n in order]
    monkeypatch.setattr(composition, "LEAST_ATTEMPTS", 60)
    monkeypatch.setattr(composition, "ATTEMPTS", 1)
    with pytest.raises(ValueError, match="fewer than"):
        composition.walk_plans(df, near.limit(3), {"f": 13}, "seed").collect()


def test_walks_look_up_what_they_reach(spark):
    kind = "family string, declaration_name string, statement_id string, source_module string, resolved_dependencies array<string>, topic_tags array<string>"
    deps = lambda i: [f"N{(i * 7 + 1) % 40:02d}", "x", f"d{i // 3}"]
    pool = spark.createDataFrame([("f", f"N{i:02d}", f"s{i}", f"M{i // 5}" if i % 9 else None, deps(i), ["riemann-seed:z"] if i % 8 == 0 else []) for i in range(40)], kind).cache()
    whole = {tuple(r) for r in graph.neighbours(pool, 3).collect()}
    look, asked = graph.neighbour_lookup(pool, 3), []
    some = spark.createDataFrame([("f", "N08"), ("f", "N09"), ("f", "N33"), ("f", "none"), ("g", "N01")], "family string, a string")
    assert {tuple(r) for r in look(some).collect()} == {r for r in whole if r[1] in ("N08", "N09", "N33")} and {r[3] for r in whole} >= set(graph.RELATIONS[:2])

    def noted(wanted):
        asked.extend(r.a for r in wanted.collect())
        return look(wanted)

    near = spark.createDataFrame(list(whole), "family string, a string, b string, relation string")
    got = composition.walk_plans(pool, noted, {"f": 3}, "seed", ahead=4, lags=0).collect()
    assert sorted(got) == sorted(composition.walk_plans(pool, near, {"f": 3}, "seed", ahead=4, lags=0).collect())
    assert len(asked) == len(set(asked)) < 20  # each name once, and only those that walks reach


def test_namespaces(spark):
    lines = ["namespace A", "section", "theorem x", "namespace B.C", "theorem y", "end B.C", "end", "end A", "theorem _root_.z"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file_path string, line int, text string")
    s = {r.line: r.namespace for r in filters.namespace_scopes(df).collect()}
    assert (s[2], s[4], s[6], s[8]) == ("A", "A.B.C", "A", "")
    d = spark.createDataFrame([("f", 2, "x"), ("f", 4, "y"), ("f", 8, "_root_.z")], "file_path string, line int, declaration_name string")
    assert {r.full_name for r in filters.repaired_names(d, filters.namespace_scopes(df)).collect()} == {"A.x", "A.B.C.y", "z"}


def test_composition(spark):
    pool = spark.createDataFrame([("f", c) for c in "abcd"], "family string, statement_id string")
    rel = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    plans = {(r.structural_class, tuple(r.members)) for r in composition.connected_plans(pool, rel, "s", 10).collect()}
    assert plans == {("direct", ("a", "b")), ("direct", ("b", "c")), ("branching", ("a", "b", "c"))}
    cases = spark.createDataFrame([("p", "direct", ["x"], ["x", "y"], ["a", "b"], [("a", "b")]), ("q", "branching", ["x"], [], ["a", "b", "c"], [("b", "c"), ("a", "b")]), ("r", "branching", [], [], ["a", "b", "c"], [("a", "b")])], "plan_id string, structural_class string, planned array<string>, actual array<string>, members array<string>, edges array<struct<src:string,dst:string>>")
    assert {r.plan_id: (r.ok, r.connected) for r in composition.audit(cases).collect()} == {"p": (True, True), "q": (False, True), "r": (False, False)}
    batch = spark.createDataFrame([("g", str(i)) for i in range(9)] + [("h", "1"), ("h", None), ("i", "3"), ("j", "a"), ("j", "b")], "g string, item string")
    seen = spark.sparkContext.accumulator(0)

    def fails(xs):
        seen.add(1)
        return any(v in ("3", "7") for v in xs) or xs == ["a", "b"]

    judge = F.udf(fails, "boolean")
    bad, verdicts = composition.failing_members(batch, "g", "item", judge)
    assert {tuple(r) for r in bad.collect()} == {("g", "3"), ("g", "7"), ("i", "3")}  # a and b fail only together
    judged = seen.value
    again, same = composition.failing_members(batch, "g", "item", judge, verdicts)
    assert sorted(again.collect()) == sorted(bad.collect()) and seen.value == judged and same.count() == verdicts.count() == judged


def test_groups_move_without_their_items(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(composition, "cut", lambda df: kept.append(set(df.columns)) or df.checkpoint())
    rows = [(g, str(i)) for g in ("g", "h", None) for i in range(6)] + [("k", "4"), ("e", None)]
    bad, verdicts = composition.failing_members(spark.createDataFrame(rows, "g string, item string"), "g", "item", lambda items: F.array_contains(items, "4"))
    assert {tuple(r) for r in bad.collect()} == {(g, "4") for g in ("g", "h", None, "k")} and len(bad.collect()) == 4
    assert sum({"_group", "items"} <= c for c in kept) == 1  # the batches that it begins with
    assert {(len(r.key), r.fails) for r in verdicts.collect()} == {(64, True), (64, False)} and verdicts.count() == 7  # 0-5, 4, 012, 345, 3, 45, 5


def fold_first_fit(rows, requested, forbidden=()):
    """The greedy picks one after the other."""
    used, out = set(), []
    for family, number in requested.items():
        n = 0
        for r in sorted((r for r in rows if r[1] == family), key=lambda r: r[0]):
            marks = {m for m in (("s", r[2]), ("l", tuple(sorted(r[3] or []))), ("d", r[4])) if m[1] is not None}
            if n < number and r[2] not in forbidden and not marks & used:
                used |= marks
                out.append(r[0])
                n += 1
    return out


PLANS = "pos int, family string, statement_id string, source_ids array<string>, derivation string"


def test_greedy_first_fit_equals_the_fold(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 7)
    rows = [(0, "f", "s1", ["a", "b"], "d1"), (1, "f", "s1", ["c"], "d2"), (2, "f", "s2", ["b", "a"], "d3"), (3, "f", "s3", ["e"], "d1"), (4, "f", "s4", ["g"], "d4"), (5, "f", "s5", ["h"], "d5"), (6, "k", "bad", ["i"], "d6")]
    no = spark.createDataFrame([("bad",)], "statement_id string")
    assert [r.pos for r in sampling.greedy_first_fit(spark.createDataFrame(rows, PLANS), {"f": 2}, no).collect()] == [0, 4]
    with pytest.raises(ValueError, match="k has 0 of 1"):
        sampling.greedy_first_fit(spark.createDataFrame(rows, PLANS), {"k": 1, "f": 1}, no)
    # a later family sees what an earlier one took, whatever the positions say
    order = [(0, "k", "x", ["1"], "d"), (1, "f", "x", ["2"], "e"), (2, "k", "y", ["3"], "g"), (3, "f", "z", None, None), (4, "f", None, [], None), (5, "f", None, ["4"], None)]
    asked = {"f": 9, "k": 2}
    assert sorted(r.pos for r in sampling.greedy_first_fit(spark.createDataFrame(order, PLANS), asked, strict=False).collect()) == sorted(fold_first_fit(order, asked)) == [1, 2, 3, 5]
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, rng.choice("abc"), rng.choice([None, *map(str, range(25))]), rng.sample("pqrstuvw", rng.choice([0, 1, 2, 3])), rng.choice([None, *map(str, range(40))])) for i in range(120)]
        asked = {"b": rng.choice([3, 50]), "a": 6, "c": rng.choice([2, 9])}
        got = sampling.greedy_first_fit(spark.createDataFrame(rows, PLANS).repartition(5), asked, spark.createDataFrame([("3",)], "statement_id string"), strict=False)
        assert sorted(r.pos for r in got.collect()) == sorted(fold_first_fit(rows, asked, {"3"}))


def fold_splits(sizes, prop, seed):
    total, counts, out = sum(sizes.values()), dict.fromkeys(prop, 0), {}
    for c in sorted(sizes, key=lambda c: (-sizes[c], hashlib.sha256(f"{seed}\0{c}".encode()).hexdigest(), c)):
        out[c] = min(prop, key=lambda n: (counts[n] / (total * prop[n]), list(prop).index(n)))
        counts[out[c]] += sizes[c]
    return out


@pytest.mark.parametrize("prop", [(0.9, 0.05, 0.05), (0.34, 0.33, 0.33), (0.999, 0.0005, 0.0005)])
def test_proportional_assignment_equals_the_fold(spark, prop):
    prop = dict(zip(("train", "validation", "heldout"), prop))
    rng = random.Random(5)
    for sizes in ([1] * 900, [rng.choice([1, 1, 1, 2, 3, 50]) for _ in range(700)], [5000, 300] + [7] * 400 + [rng.randint(1, 40) for _ in range(200)], [4]):
        sizes = {f"c{i}": n for i, n in enumerate(sizes)}
        df = spark.createDataFrame(list(sizes.items()), "component_id string, size long").repartition(6)
        assert {r.component_id: r.split for r in components.assign_splits(df, prop, "s").collect()} == fold_splits(sizes, prop, "s")
    assert components.assign_splits(spark.createDataFrame([], "component_id string, size long"), prop, "s").collect() == []


def test_least_full_at_any_rank():
    rng = random.Random(7)
    for _ in range(300):
        targets = [rng.uniform(0.1, 1000) for _ in range(3)]
        counts, size = [rng.randint(0, 500) * rng.choice([0, 1]) for _ in range(3)], rng.randint(1, 30)
        held = [0, 0, 0]
        for n in range(rng.choice([5, 60, 400])):
            if n % 7 == 0:
                assert components._least_full(counts, targets, size, n) == held
            held[min(range(3), key=lambda i: ((counts[i] + held[i] * size) / targets[i], i))] += 1
    assert sum(components._least_full([0, 0, 0], [9e9, 5e8, 5e8], 1, 10**10 - 3)) == 10**10 - 3


def test_expectations(spark):
    V = expectations.Violation
    ok = spark.createDataFrame([("f", "f", "c", "train", "p")], "file_path string, file_group string, component_id string, split string, statement_fingerprint string")
    assert set(expectations.split_hygiene(ok).values()) == {0}
    other = ok.withColumn("split", F.lit("heldout"))
    for bad in (ok.union(other), ok.withColumn("file_group", F.lit("g"))):
        with pytest.raises(V):
            expectations.split_hygiene(bad)
    rec = spark.createDataFrame([("s", "training", None, [("v",)])], "statement_id string, role string, derivation_family_fingerprint string, proof_variants array<struct<proof_variant_id:string>>")
    assert set(expectations.role_isolation(rec).values()) == {0}
    with pytest.raises(V):
        expectations.role_isolation(rec.union(rec.withColumns({"role": F.lit("test"), "statement_id": F.lit("t")})))
    ctx = spark.createDataFrame([("synthetic", ["x"], ["M.a"])], "provenance string, topic_tags array<string>, imports array<string>")
    expectations.import_contexts(ctx, "pnt", ["P"], "M.")
    for imports in (["P"], []):
        with pytest.raises(V):
            expectations.import_contexts(ctx.withColumn("imports", F.array(*map(F.lit, imports)).cast("array<string>")), "pnt", ["P"], "M.")
    with pytest.raises(V):
        expectations.import_contexts(ctx.withColumn("topic_tags", F.array(F.lit("pnt"))), "pnt", ["P"], "M.")
    df = spark.createDataFrame([("a", "train", "v1"), ("b", "test", "v1")], "id string, split string, schema_version string")
    expectations.loaded(df, {"train": 1, "test": 1}, "v1")
    for counts, version, rows in (({"train": 2}, "v1", df), ({"train": 1, "test": 1}, "v2", df), ({"train": 1, "test": 1}, "v1", df.withColumn("id", F.lit("a")))):
        with pytest.raises(V):
            expectations.loaded(rows, counts, version)
    row = spark.createDataFrame([(True, False, None)], "a boolean, b boolean, c boolean")
    expectations.gates(row, ["a"])
    with pytest.raises(V, match="b.*c"):
        expectations.gates(row, ["a", "b", "c"])
    with pytest.raises(V):
        expectations.same_summary(row, row.withColumn("b", F.lit(True)), ["a", "b"])
    art = spark.createDataFrame([("m", True, "raw", "raw")], "model string, accepted boolean, raw_text string, candidate_text string").withColumn("raw_sha256", F.sha2("raw_text", 256))
    expectations.resumable(art, {"model": "m"})
    for bad in (art.withColumn("model", F.lit("n")), art.withColumn("candidate_text", F.lit("fixed")), art.withColumn("accepted", F.lit(None).cast("boolean"))):
        with pytest.raises(V):
            expectations.resumable(bad, {"model": "m"})
    entries = spark.createDataFrame([("1", "included", ["s"], True, True, True), ("2", "blocked", [], False, True, True)], "coverage_id string, disposition string, statement_ids array<string>, verified_lean boolean, legally_usable boolean, target_compatible boolean")
    train = spark.createDataFrame([("s",)], "statement_id string")
    assert expectations.prime_coverage(entries, train, ["included", "blocked"], "included").count() == 2
    for bad in (entries.union(entries), entries.withColumn("verified_lean", F.lit(True)), entries.withColumn("disposition", F.lit("odd")), entries.withColumn("statement_ids", F.array(F.lit("zz")))):
        with pytest.raises(V):
            expectations.prime_coverage(bad, train, ["included", "blocked"], "included")
    src = spark.createDataFrame([("r",)], "k string")
    expectations.dispositions_complete(src, src.withColumn("disposition", F.lit("x")), ["k"], ["later"])
    for bad in (src.limit(0), src.union(src)):
        with pytest.raises(V):
            expectations.dispositions_complete(src, bad.withColumn("disposition", F.lit("x")), ["k"], ["later"])
    with pytest.raises(V):
        expectations.dispositions_complete(src, src.withColumn("disposition", F.lit("later")), ["k"], ["later"])
    with pytest.raises(V):
        expectations.disjoint({"a": src, "b": src}, "k")
    with pytest.raises(V):
        expectations.subset(src, src.limit(0), "k", "members")
    with pytest.raises(V):
        expectations.partition_accounts(src, [src, src])
    plan = spark.createDataFrame([("s", "s", "training", [("v",)], (9,))], "statement_id string, sampling_group_id string, role string, proof_variants array<struct<proof_variant_id:string>>, length struct<utf8_bytes:int>")
    assert expectations.training_plan(plan, 8).collect()[0].context_status == "long-context"
    with pytest.raises(V):
        expectations.training_plan(plan, 8, strict=True)
    e = spark.createDataFrame([("a", "literature-only", ["src"], "RH-implies", ["src"])], "id string, formalization_status string, source_ids array<string>, relationship_class string, relationship_sources array<string>")
    edge = spark.createDataFrame([("a", "a", "implies", ["src"])], "source string, target string, type string, source_ids array<string>")
    src = spark.createDataFrame([("src",)], "id string")
    expectations.atlas(e, edge, src)
    no = F.array().cast("array<string>")
    for be, bd, bs in (
        (e.union(e), edge, src), (e, edge.withColumn("type", F.lit("?")), src), (e, edge.withColumn("target", F.lit("zz")), src), (e.withColumn("relationship_sources", no), edge, src), (e, edge, src.limit(0)),
        (e, edge.withColumn("source_ids", no), src), (e, edge.withColumn("type", F.lit("Lean-counterpart-of")), src), (e.withColumn("formalization_status", F.lit("partial")), edge, src),
    ):
        with pytest.raises(V):
            expectations.atlas(be, bd, bs)
    v2 = spark.createDataFrame([("s", "s", "real", [("v", ("accepted",))], None, None)], "statement_id string, sampling_group_id string, provenance string, proof_variants array<struct<proof_variant_id:string,verification:struct<status:string>>>, derivation_family_fingerprint string, source_lemma_ids array<string>")
    expectations.v2_invariants(v2)
    for bad in (v2.withColumn("sampling_group_id", F.lit("t")), v2.withColumn("provenance", F.lit("synthetic")), v2.withColumn("proof_variants", F.concat("proof_variants", "proof_variants"))):
        with pytest.raises(V):
            expectations.v2_invariants(bad)


def test_source_text(spark):
    from quarry.functions import lexer

    text = "theorem N.a : p :=\nby simp -- done\n"
    point = lambda l, c: {"line": l, "column": c}  # noqa: E731, E741
    row = dict(id="i", declaration_name="M.N.a", source_text=text, proof="by simp", statement_fingerprint=lexer.statement_fingerprint("lemma q : p"),
               source_span={"start": point(1, 1), "end": point(2, 16)}, declaration_span={"start": point(1, 1), "end": point(2, 1)}, proof_span={"start": point(2, 1), "end": point(2, 16)})
    schema = f"id string, declaration_name string, source_text string, proof string, statement_fingerprint string, source_span {schemas.SPAN}, declaration_span {schemas.SPAN}, proof_span {schemas.SPAN}"
    why = lambda **kw: expectations.source_text(spark.createDataFrame([{**row, **kw}], schemas.ddl(schema))).collect()[0].mismatch
    assert why() is None and why(proof="by ring") == "proof" and why(declaration_name="N.b") == "name" and why(statement_fingerprint="0") == "fingerprint" and why(declaration_span={"start": point(1, 2), "end": point(2, 1)}) == "declaration start"


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, partitions):
    from quarry.plans import catalog

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("passk_summary", "component_splits", "bounded_rings", "role_bands", "greedy_first_fit", "merge_statements"):
            got = sorted(map(str, catalog.QUERIES[name](spark, sf_dir).collect()))
            assert RESULTS.setdefault(name, got) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


RESULTS: dict = {}


def test_rings_against_walks_of_each_seed(spark, monkeypatch):
    rng = random.Random(3)
    edges = sorted({(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(110)})
    seeds, fan_out, depth = ["n01", "n07", "n11", "n39"], 3, 3
    near = {a: sorted(t for s, t in edges if s == a) for a, _ in edges}
    found, lost = {}, 0
    for s in seeds:
        seen, frontier = {s}, {s}
        for d in range(1, depth + 1):
            lost += sum(len(near.get(n, ())) > fan_out for n in frontier)
            frontier = {t for n in frontier for t in near.get(n, ())[:fan_out]} - seen
            seen |= frontier
            for n in frontier - set(seeds):
                found.setdefault(n, {}).setdefault(d, []).append(s)
    want = sorted((min(v), n, v[min(v)]) for n, v in found.items())
    args = spark.createDataFrame([(s,) for s in seeds], "seed string"), spark.createDataFrame(edges, "source string, target string"), depth, fan_out
    for most in (None, 9):
        ring, diag = graph.bounded_rings(*args, most)
        assert sorted((r.distance, r.record_id, r.seeds) for r in ring.collect()) == want[:most]
        kept = len(want[:most])
        assert tuple(diag.collect()[0]) == (len(want), kept, len(want) - kept, lost)
    # many seeds around a hub: no frame of (seed, node) is kept
    sizes = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: sizes.append(df.count()) or keep(df))
    star = [(f"s{i}", "hub") for i in range(50)] + [("hub", f"t{i}") for i in range(40)]
    ring, diag = graph.bounded_rings(spark.createDataFrame([(f"s{i}",) for i in range(50)], "seed string"), spark.createDataFrame(star, "source string, target string"), 2, 64, 30)
    assert max(sizes) <= 91 and {len(r.seeds) for r in ring.collect()} == {50} and tuple(diag.collect()[0]) == (41, 30, 11, 0)


def test_order_statistics_against_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(stats, "PARTS", 256)
    monkeypatch.setattr(stats, "FEW", 60)
    rng = random.Random(6)
    groups = {
        "hot": [7.0] * 500 + [rng.gauss(0, 1) for _ in range(200)], "far": [-1.7e308, 1.7e308, 0.0, 1e-300, -5.0, 3.0], "one": [2.5], "equal": [1.0] * 9, None: [float(i) for i in range(21)],
        "skew": [10.0 ** rng.randint(-20, 20) for _ in range(100)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None), ("hot", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    low, high, weight = stats.around(0.5)
    got = stats.order_statistics(df, "v", ["g"], {"low": low, "high": high, "p95": stats.nearest(0.95), "f": stats.fudged(0.95), "last": F.col("n")}).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        s = sorted(groups[r.g])
        n = len(s)
        assert (r.n, r.min, r.max, r.last) == (n, s[0], s[-1], s[-1])
        assert (r.low, r.high) == (s[(n - 1) // 2], s[n // 2]) and r.p95 == s[-(-95 * n // 100) - 1] and r.f == s[max(1, min(n, int(0.95 * n + 0.999999))) - 1], r.g
    whole = stats.numeric_summary(df.where("g = 'skew' or g = 'none'"), "v", ["g"], "nearest").collect()
    assert {r.g: (r["count"], r.p95) for r in whole} == {"skew": (100, sorted(groups["skew"])[94]), "none": (0, None)}


@pytest.mark.parametrize("n", [1, 20, 101])
def test_ranks_are_those_of_the_aggregates(spark, n):
    df = spark.range(1, n + 1).select((F.col("id") * 10).alias("v"))
    a = stats.order_statistics(df, "v", [], {f"p{round(p * 100)}": stats.nearest(p) for p in (0.5, 0.9, 0.95, 0.99)}).collect()[0]
    b = df.agg(*[x.nearest_rank("v", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]).collect()[0]
    assert all(a[k] == b[k] for k in b.asDict())
