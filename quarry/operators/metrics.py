"""Run summaries, breakdowns and ratios over candidate results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.operators import stats
from quarry.operators.lineage import join_grouped
from quarry.sources.schemas import CATEGORIES, FINISH_REASONS, INFRASTRUCTURE


def per_task(results: DataFrame, expected: DataFrame, n: int | None, task: str = "task_id", index: str = "candidate_index", correct: Column | None = None) -> DataFrame:
    """A row for each expected task: candidates, verified, whether indices are 0..n-1 (n null: as many as there are).

    One partial aggregation; contiguity needs no sort: distinct indices, least 0 and greatest count - 1.
    """
    correct = F.col("category") == "verified" if correct is None else correct
    got = results.groupBy(task).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(correct).alias("verified"), F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.count_distinct(index).alias("_d")
    )
    want = F.lit(n) if n is not None else F.col("candidates")
    contiguous = F.coalesce((F.col("candidates") == want) & (F.col("_d") == F.col("candidates")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("candidates") - 1), F.lit(False))
    return (
        expected.select(task).distinct().join(got, task, "left")
        .select(task, F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("verified", F.lit(0)).alias("verified"), contiguous.alias("contiguous"))
    )


def run_summary(results: DataFrame, expected: DataFrame, n: int, ks: Sequence[int] = (1, 4, 8), task: str = "task_id", null_policy: str = "skip") -> DataFrame:
    """One row: completeness, pass@k (null unless complete), histograms with zeros, latencies.

    Histograms and latencies take all rows, those of unexpected tasks too; per-task figures and the solved
    fraction take expected tasks only.  ``null_policy`` for token counts: fail, skip or zero.
    """
    tasks = per_task(results, expected, n, task)
    usable = [k for k in ks if k <= n]
    t = tasks.agg(
        F.count(F.lit(1)).alias("task_count"), F.count_if(F.col("candidates") == 0).alias("missing_tasks"), F.count_if((F.col("candidates") > 0) & ~F.col("contiguous")).alias("broken_tasks"),
        F.count_if(F.col("verified") > 0).alias("solved"), *[F.avg(x.pass_at_k(F.lit(n), F.least("verified", F.lit(n)), k)).alias(f"_p{k}") for k in usable],
    )
    stray = results.select(task).distinct().join(expected.select(task).distinct(), task, "left_anti").agg(F.count(F.lit(1)).alias("unexpected_tasks"))
    tokens = F.col("generated_token_count")
    if null_policy == "zero":
        tokens = F.coalesce(tokens, F.lit(0))
    elif null_policy == "fail":
        tokens = F.when(tokens.isNull(), F.raise_error(F.lit("null token count"))).otherwise(tokens)
    totals = results.agg(
        F.count(F.lit(1)).alias("candidate_count"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES], *[F.count_if(F.col("finish_reason") == r).alias(f"finish_{r}") for r in FINISH_REASONS],
        F.count_if(F.col("category").isin(*INFRASTRUCTURE)).alias("infrastructure_errors"),
        *[e for c in ("generation", "verification", "total") for e in (F.coalesce(F.sum(f"{c}_latency_seconds"), F.lit(0.0)).alias(f"{c}_latency_sum"), F.avg(f"{c}_latency_seconds").alias(f"{c}_latency_mean"))],
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
    )
    out = t.crossJoin(stray).crossJoin(totals)  # one row each
    complete = (F.col("missing_tasks") == 0) & (F.col("broken_tasks") == 0) & (F.col("unexpected_tasks") == 0) & (F.col("infrastructure_errors") == 0)
    out = out.withColumn("complete", complete).withColumn("solved_fraction", F.coalesce(x.ratio("solved", "task_count"), F.lit(0.0)))
    return out.withColumns({f"pass@{k}": F.when(F.col("complete"), F.col(f"_p{k}")) for k in usable}).drop(*[f"_p{k}" for k in usable])


def id_differences(results: DataFrame, expected: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, status) of missing and unexpected ids."""
    a, b = expected.select(task).distinct(), results.select(task).distinct()
    return a.join(b, task, "left_anti").withColumn("status", F.lit("missing")).union(b.join(a, task, "left_anti").withColumn("status", F.lit("unexpected")))


def exact_target_summary(results: DataFrame) -> DataFrame:
    """Exact-target variant: exact, verified but not exact, exact but rejected, token statistics, integrity."""
    v, e = F.col("category") == "verified", F.col("target_exact")
    return results.agg(
        F.count_if(e).alias("exact"), F.count_if(v & ~e).alias("verified_not_exact"), F.count_if(e & ~v).alias("exact_not_verified"), F.min("generated_token_count").alias("tokens_min"),
        F.max("generated_token_count").alias("tokens_max"), F.avg("generated_token_count").alias("tokens_mean"), F.sum("generated_token_count").alias("tokens_sum"), (F.count_if(e & (F.col("category") == "lean_rejected")) == 0).alias("integrity"),
    )


def semantic_summary(results: DataFrame, minimum: int, timeout_is_failure: bool = True) -> DataFrame:
    """Accepted and exact, accepted and not exact, rejected, timed out, infrastructure; and the gate on a minimum accepted.

    Whether timeouts break integrity differs by phase, so it is a parameter.
    """
    v, e, t = F.col("category") == "verified", F.col("target_exact"), F.col("category") == "verifier_timeout"
    infra = F.col("category").isin(*INFRASTRUCTURE)
    out = results.agg(
        F.count_if(v & e).alias("accepted_exact"), F.count_if(v & ~e).alias("accepted_not_exact"), F.count_if(F.col("category") == "lean_rejected").alias("rejected"), F.count_if(t).alias("timeouts"), F.count_if(infra).alias("infrastructure"), F.count(F.lit(1)).alias("candidates"),
    )
    sound = (F.col("infrastructure") == 0) & ((F.col("timeouts") == 0) if timeout_is_failure else F.lit(True))
    return out.withColumns({"integrity": sound, "passed": sound & (F.col("accepted_exact") + F.col("accepted_not_exact") >= minimum)})


def memorisation(results: DataFrame, minimum: float) -> DataFrame:
    infra = F.col("category").isin(*INFRASTRUCTURE)
    out = results.agg(F.count_if("target_exact").alias("exact"), F.count(F.lit(1)).alias("n"), F.avg(F.col("target_exact").cast("int")).alias("rate"), F.count_if(infra).alias("infrastructure"))
    return out.withColumn("passed", (F.col("infrastructure") == 0) & F.coalesce(F.col("rate") >= minimum, F.lit(False)))


def breakdown(tasks: DataFrame, key: str, values: Sequence[str] | None, n: int, ks: Sequence[int], strict: bool = True) -> DataFrame:
    """A row for each known value, zero rows included; pass@k is null on an empty group; unknown values raise.

    tasks: per-task rows with ``key`` and ``verified``.
    """
    got = tasks.groupBy(key).agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("verified") > 0).alias("solved"), *[F.avg(x.pass_at_k(F.lit(n), "verified", k)).alias(f"pass_at_{k}") for k in ks])
    if values is None:
        return got
    known = tasks.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    if strict:
        odd = [r[key] for r in got.join(known, key, "left_anti").select(key).limit(5).collect()]
        if odd:
            raise ValueError(f"unknown values of {key}: {odd}")
    return known.join(F.broadcast(got.join(known, key, "left_semi")), key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tasks", "solved")})


def breakdowns(tasks: DataFrame, keys: Sequence[str], n_col: str = "candidates", k: int = 1) -> DataFrame:
    """Several independent breakdowns in one pass: (dimension, value, tasks, solved, pass_at_k) by grouping sets."""
    sets = ", ".join(f"({c})" for c in keys)
    dim = "case " + " ".join(f"when grouping({c}) = 0 then '{c}'" for c in keys) + " end"
    grouped = tasks.withColumn("_p", x.pass_at_k(n_col, "verified", k))
    grouped = grouped.sparkSession.sql(
        f"select {dim} as dimension, coalesce({', '.join(keys)}) as value, count(1) as tasks, count_if(verified > 0) as solved, avg(_p) as pass_at_{k} from {{t}} group by grouping sets ({sets})", t=grouped
    )
    return grouped


def outcome_rows(results: DataFrame, task: str = "task_id") -> DataFrame:
    """Per task: categories in order of index, verified indices, solved."""
    held = F.array_sort(F.collect_list(F.struct("candidate_index", "category")))
    return results.groupBy(task).agg(held.alias("h")).select(
        task, F.transform("h", lambda s: s["category"]).alias("categories"), F.transform(F.filter("h", lambda s: s["category"] == "verified"), lambda s: s["candidate_index"]).alias("verified_indices"),
        F.exists("h", lambda s: s["category"] == "verified").alias("solved"),
    )


def component_aggregate(records: DataFrame, component: str = "component_id", cls: str = "relevance_class") -> DataFrame:
    """Component facts copied to each member: classes, basis, size.  Components are grouped and joined back, so a large one can be split."""
    keyed = records.withColumn("_k", F.to_json(F.struct(F.col(component).alias("c")), {"ignoreNullFields": "false"}))
    basis = F.when(F.max(F.col(cls) == "core"), "core").when(F.max(F.col(cls).isNotNull()), "related").otherwise("unrelated")
    facts = keyed.groupBy("_k").agg(F.array_sort(F.collect_set(cls)).alias("component_classes"), basis.alias("component_basis"), F.count(F.lit(1)).alias("component_size"))
    return join_grouped(keyed, facts, ["_k"]).drop("_k")


def relevance_views(records: DataFrame, lists: dict[str, Column], id_col: str = "id") -> DataFrame:
    """(view, id): a row can be in several lists."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in lists.items()]), lambda v: v.isNotNull())
    return records.select(F.explode(names).alias("view"), id_col)


def efficiency(df: DataFrame) -> DataFrame:
    """Ratios with null on a zero denominator; df: tokens, generation_seconds, run_seconds, solved, verified."""
    return df.withColumns({
        "tokens_per_second": x.ratio("tokens", "generation_seconds"), "seconds_per_solved": x.ratio("run_seconds", "solved"), "tokens_per_solved": x.ratio("tokens", "solved"),
        "proofs_per_million_tokens": x.ratio(F.col("verified") * 1_000_000, "tokens"), "candidates_per_second": x.ratio("candidates", "generation_seconds"),
    })


def usage_totals(executions: DataFrame) -> DataFrame:
    """Per usage key, the sum over accepted attempts: attempts[accepted - 1]; and the retries before them.

    executions: (execution_id, accepted int, attempts array<struct<usage: map<string,bigint>>>).
    """
    picked = executions.withColumn("a", F.try_element_at("attempts", "accepted")).withColumn("retries", F.size("attempts") - F.col("accepted"))
    return picked.select("retries", F.explode(F.map_entries("a.usage")).alias("u")).groupBy(F.col("u.key").alias("usage_key")).agg(F.sum("u.value").alias("total"), F.count(F.lit(1)).alias("executions"))


def arm_summary(usage: DataFrame) -> DataFrame:
    """Distribution of each usage key; usage: (usage_key, value)."""
    out = stats.numeric_summary(usage, "value", ["usage_key"], "fudged")
    return out.select("usage_key", F.col("count").alias("n"), F.when(F.col("count") > 0, F.col("total")).alias("total"), "min", "max", "mean", "median", "p95")


def family_rates(tasks: DataFrame, name: str = "task_id") -> DataFrame:
    """Solved rates by the task name's family, the text before its first underscore or digit."""
    return tasks.groupBy(F.regexp_extract(name, r"^([a-zA-Z]+)", 1).alias("family")).agg(F.count(F.lit(1)).alias("tasks"), F.avg((F.col("verified") > 0).cast("int")).alias("solved_rate"))


def solved_jaccard(a: DataFrame, b: DataFrame, task: str = "task_id") -> DataFrame:
    """Jaccard similarity of two solved sets."""
    both = a.select(task, F.lit(True).alias("l")).join(b.select(task, F.lit(True).alias("r")), task, "full_outer")
    return both.agg(F.count_if(F.col("l") & F.col("r")).alias("common"), F.count(F.lit(1)).alias("either")).withColumn("jaccard", x.ratio("common", "either"))


def peak(samples: DataFrame, group: str, value: str, ts: str) -> DataFrame:
    """Peak, count and increment over the first sample."""
    return samples.groupBy(group).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("samples"), (F.max(value) - F.min_by(value, ts)).alias("increment"))
