"""Distributions, paired tests, bootstraps, training-log aggregates."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from quarry.functions import expressions as x
from quarry.operators.lineage import cut, numbered


#: Parts into which a range of values is cut in each round of a selection by rank, rows of a range up to which they are sorted instead, and rounds at most.
PARTS, FEW, ROUNDS = 1024, 50_000, 200


def order_statistics(df: DataFrame, value: str, by: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """(by, n, min, max, a column for each name): the values of ranks, from 1, of each group; ranks are columns over the group's number of values ``n``.

    All ranks are selected together: a range of values that holds a wanted rank is cut into ``PARTS``, their rows are counted, and the part with the
    rank is the next range, from the least to the largest value it holds, until all its values are equal or its rows are ``FEW``, which are sorted.  All
    other rows are only counted, with partial sums before the exchange, so no task holds a group or its distinct values.  Nulls and NaN are left out; groups without values are too.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v")).where("_v is not null")
    if isinstance(rows.schema["_v"].dataType, (FloatType, DoubleType)):
        rows = rows.where(~F.isnan("_v"))
    rows = cut(rows)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    state = cut(groups.select(*keys, "n", F.col("_lo").alias("least"), F.col("_hi").alias("most"), "_lo", "_hi", F.col("n").alias("_rows"), named.alias("_w")).select("*", "_w.name", "_w.rank").drop("_w"))
    same = lambda a, b, cols: functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in cols], F.lit(True))
    fixed = ["n", "least", "most", "name"]

    def inside(wanted: DataFrame) -> DataFrame:
        """The rows of the wanted ranges: keys, _lo, _hi, _v."""
        ranges = wanted.select(*keys, "_lo", "_hi").distinct()
        ranges = ranges.alias("s") if keys else F.broadcast(ranges).alias("s")  # a range a rank
        met = rows.alias("r").join(ranges, same("r", "s", keys) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        return met.select(*[F.col(f"s.{k}") for k in keys], "_lo", "_hi", "_v")

    for _ in range(ROUNDS):
        wide = state.where("_lo < _hi")
        if wide.isEmpty():
            break
        few, many = wide.where(F.col("_rows") <= FEW), wide.where(F.col("_rows") > FEW)
        placed = inside(few).withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_lo").orderBy("_v")))  # over FEW rows at most
        known = few.alias("s").join(placed.alias("c"), same("s", "c", [*keys, "_lo"]) & (F.col("rank") == F.col("_at")))
        known = known.select(*[F.col(f"s.{k}") for k in keys], *fixed, F.col("_v").alias("_lo"), F.col("_v").alias("_hi"), F.lit(1).cast("bigint").alias("_rows"), F.lit(1).cast("bigint").alias("rank"))
        # halves, as the range of two numbers may be beyond the largest one
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).alias("_part")
        counted = inside(many).select(*keys, "_lo", "_v", part).groupBy(*keys, "_lo", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = Window.partitionBy(*keys, "_lo").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)  # over PARTS rows at most
        counted = counted.withColumn("_upto", F.sum("_n").over(upto))
        found = many.alias("s").join(counted.alias("c"), same("s", "c", [*keys, "_lo"]) & (F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
        found = found.select(*[F.col(f"s.{k}") for k in keys], *fixed, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_n").alias("_rows"), (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank"))
        columns = [*keys, *fixed, "_lo", "_hi", "_rows", "rank"]
        state = cut(state.where("_lo = _hi").select(*columns).unionByName(known).unionByName(found))
    else:
        raise ValueError(f"ranks of {value} were not told apart in {ROUNDS} rounds")
    out = state.groupBy(*keys, "n", "least", "most").agg(*[F.max(F.when(F.col("name") == name, F.col("_lo"))).alias(name) for name in ranks])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "n", F.col("least").alias("min"), F.col("most").alias("max"), *ranks)


def nearest(p: float) -> Column:
    """The rank of a percentile by the nearest-rank rule."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p) - F.lit(1e-9)))


def fudged(p: float) -> Column:
    """The rank int(p n + 0.999999), at least one and at most n."""
    return F.greatest(F.lit(1), F.least(F.col("n"), (F.lit(p) * F.col("n") + F.lit(0.999999)).cast("bigint")))


def around(p: float) -> tuple[Column, Column, Column]:
    """The two ranks around an interpolated percentile, and the weight of the upper one."""
    at = (F.col("n") - 1) * F.lit(p)
    return F.floor(at) + 1, F.ceil(at) + 1, at - F.floor(at)


def between(low: str, high: str, weight: Column) -> Column:
    return F.col(low) + (F.col(high) - F.col(low)) * weight


def length_stats(df: DataFrame, fields: Sequence[str], thresholds: Sequence[int] = (1024, 2048, 4096, 8192)) -> DataFrame:
    """A row for each field: min, true median, nearest ranks, max, counts at thresholds."""
    long = df.select(*[F.col(f).cast("long").alias(f) for f in fields]).unpivot([], list(fields), "field", "value").where("value is not null")
    low, high, weight = around(0.5)
    ranks = order_statistics(long, "value", ["field"], {"_low": low, "_high": high, **{f"p{round(p * 100)}": nearest(p) for p in (0.9, 0.95, 0.99)}})
    counts = long.groupBy(F.col("field").alias("_f")).agg(*[F.count_if(F.col("value") >= t).alias(f"at_or_above_{t}") for t in thresholds])
    return ranks.withColumn("median", between("_low", "_high", weight)).join(counts, F.col("field") == F.col("_f")).select("field", "min", "median", "p90", "p95", "p99", "max", *[f"at_or_above_{t}" for t in thresholds])


def numeric_summary(df: DataFrame, value: str, by: Sequence[str] = (), rank: str = "fudged") -> DataFrame:
    """count, total, min, max, mean, median and p95 in the rank definition asked for; a group without values has count 0."""
    low, high, weight = around(0.5)
    low95, high95, weight95 = around(0.95)
    p95 = {"nearest": {"p95": nearest(0.95)}, "fudged": {"p95": fudged(0.95)}, "interpolated": {"_low95": low95, "_high95": high95}}[rank]
    ranks = order_statistics(df, value, by, {"_low": low, "_high": high, **p95}).withColumn("median", between("_low", "_high", weight))
    if rank == "interpolated":
        ranks = ranks.withColumn("p95", between("_low95", "_high95", weight95))
    sums = df.groupBy(*by).agg(F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.avg(value).alias("mean"))
    ranks = ranks.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by)})
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.lit(True))
    return sums.join(ranks, same, "left").select(*by, "count", "total", "min", "max", "mean", "median", "p95")


def contingency(pairs: DataFrame, left: str = "left_solved", right: str = "right_solved") -> DataFrame:
    """The four counts of paired outcomes, discordant pairs and the exact McNemar p-value."""
    a, b = F.col(left), F.col(right)
    t = pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"))
    return t.withColumn("discordant", F.col("left_only") + F.col("right_only")).withColumn("p_value", x.mcnemar_exact("left_only", "right_only"))


#: Distinct outcomes up to which a resample is drawn as their counts.
OUTCOMES = 10_000


def bootstrap_means(values: DataFrame, replicates: int, seed: str, columns: Sequence[str]) -> DataFrame:
    """(r, mean of each column) of ``replicates`` resamples with replacement.

    How often each distinct outcome is in a resample of n rows is one multinomial draw, so only outcomes and their counts are needed,
    and the work does not grow with n; each replicate has a generator of its own, seeded by (seed, r).  Beyond ``OUTCOMES`` outcomes
    n positions in the order of the values are drawn by a hash of (seed, draw) and meet the rows there.
    """
    spark = values.sparkSession
    outcomes = values.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).orderBy(*columns).limit(OUTCOMES + 1).collect()
    if not outcomes:
        raise ValueError("nothing to resample")
    if len(outcomes) > OUTCOMES:
        placed = numbered(values.select(*columns), list(columns))
        n = placed.count()
        draws = spark.range(replicates * n).select((F.col("id") / n).cast("bigint").alias("r"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("pos"))
        return draws.join(placed, "pos").groupBy("r").agg(*[F.avg(c).alias(c) for c in columns])
    held = [r["_n"] for r in outcomes]
    table = [[float(r[c]) for c in columns] for r in outcomes]
    key = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, of = np.array(held), np.array(table)
        n = counts.sum()
        for batch in batches:
            drawn = [np.random.Generator(np.random.PCG64([key, r])).multinomial(n, counts / n) for r in batch.column("id").to_pylist()]
            means = np.array(drawn).reshape(len(drawn), len(counts)) @ of / n
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(means[:, k]) for k in range(len(columns)))], ["r", *columns])

    return spark.range(replicates).mapInArrow(run, ", ".join(["r long", *(f"{c} double" for c in columns)]))


def interval(means: DataFrame, column: str) -> DataFrame:
    """2.5 and 97.5 percentiles by linear interpolation, the mean, and whether the interval spans zero."""
    out = means.agg(F.avg(column).alias("mean"), F.percentile(column, 0.025).alias("low"), F.percentile(column, 0.975).alias("high"))
    return out.withColumn("spans_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def paired_bootstrap(tasks: DataFrame, n: int, k: int, replicates: int, seed: str) -> DataFrame:
    """Intervals of base, adapter and delta mean pass@k under task resampling; tasks: (base, adapter) verified counts."""
    scored = tasks.select(x.pass_at_k(F.lit(n), "base", k).alias("base"), x.pass_at_k(F.lit(n), "adapter", k).alias("adapter")).withColumn("delta", F.col("adapter") - F.col("base"))
    means = bootstrap_means(scored, replicates, seed, ["base", "adapter", "delta"])
    names = ["base", "adapter", "delta"]
    # one pass over the resamples: a row each metric
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])).alias("m")).select("m.metric", "m.v")
    out = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    return out.withColumn("spans_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def gap_bootstrap(train: DataFrame, heldout: DataFrame, n: int, k: int, replicates: int, seed: str) -> DataFrame:
    """Interval of the change of the train-to-held-out gap: two independent workloads, models paired in each."""
    parts = []
    for label, df in (("train", train), ("heldout", heldout)):
        scored = df.select((x.pass_at_k(F.lit(n), "adapter", k) - x.pass_at_k(F.lit(n), "base", k)).alias(label))
        parts.append(bootstrap_means(scored, replicates, f"{seed}-{label}", [label]))
    return interval(parts[0].join(parts[1], "r").withColumn("gap", F.col("train") - F.col("heldout")), "gap")


def twister_bootstrap(tasks: DataFrame, n: int, k: int, replicates: int, seed: int) -> DataFrame:
    """The paired bootstrap drawn by Python's Mersenne Twister, for parity with recorded intervals: one sequential generator, so one task over the task table."""
    schema = "metric string, mean double, low double, high double"
    scored = tasks.select("pos", x.pass_at_k(F.lit(n), "base", k).alias("base"), x.pass_at_k(F.lit(n), "adapter", k).alias("adapter"))

    def run(pdf):
        import random

        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        both = np.stack([pdf.base.to_numpy(), pdf.adapter.to_numpy(), (pdf.adapter - pdf.base).to_numpy()])
        rng = random.Random(seed)
        size = both.shape[1]
        means = np.array([both[:, [rng.randrange(size) for _ in range(size)]].mean(1) for _ in range(replicates)])
        low, high = np.percentile(means, [2.5, 97.5], axis=0)
        return pd.DataFrame({"metric": ["base", "adapter", "delta"], "mean": both.mean(1), "low": low, "high": high})

    return scored.groupBy().applyInPandas(run, schema)


def twister_gap_bootstrap(train: DataFrame, heldout: DataFrame, n: int, ks: Sequence[int], replicates: int, seed: int) -> DataFrame:
    """(k, low, high) of the gap bootstrap drawn by Python's Mersenne Twister, for parity with recorded intervals.

    One generator draws the train workload, then the held-out one, for each resample, whatever the number of ks; so it is one task
    over both task tables.  train and heldout: (pos, base, adapter) verified counts.
    """
    sides = [df.select(F.lit(side).alias("side"), "pos", *[(x.pass_at_k(F.lit(n), "adapter", k) - x.pass_at_k(F.lit(n), "base", k)).alias(f"lift_{k}") for k in ks]) for side, df in enumerate((train, heldout))]

    def run(pdf):
        import random

        import numpy as np
        import pandas as pd

        lifts = [pdf[pdf.side == side].sort_values("pos")[[f"lift_{k}" for k in ks]].to_numpy() for side in (0, 1)]
        if not all(map(len, lifts)):
            raise ValueError("nothing to resample")
        draw = random.Random(seed).randrange
        gaps = np.array([np.subtract(*(own[[draw(len(own)) for _ in own]].mean(0) for own in lifts)) for _ in range(replicates)])
        low, high = np.percentile(gaps, [2.5, 97.5], axis=0)
        return pd.DataFrame({"k": list(ks), "low": low, "high": high})

    return sides[0].union(sides[1]).groupBy().applyInPandas(run, "k int, low double, high double")


def generalisation_gaps(cells: DataFrame) -> DataFrame:
    """Gaps from one row per (model, split, score): base and adapter train-to-held-out gaps, deltas on either split, and the change of the gap."""
    pivoted = cells.groupBy().agg(*[F.max(F.when((F.col("model") == m) & (F.col("split") == s), F.col("score"))).alias(f"{m}_{s}") for m in ("base", "adapter") for s in ("train", "heldout")])
    return pivoted.withColumns({
        "base_gap": F.col("base_train") - F.col("base_heldout"), "adapter_gap": F.col("adapter_train") - F.col("adapter_heldout"), "train_delta": F.col("adapter_train") - F.col("base_train"), "heldout_delta": F.col("adapter_heldout") - F.col("base_heldout"),
    }).withColumn("gap_change", F.col("adapter_gap") - F.col("base_gap"))


def token_weighted(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Loss and accuracy weighted by tokens."""
    return df.groupBy(*by).agg(x.ratio(F.sum("loss_sum"), F.sum("tokens")).alias("loss"), x.ratio(F.sum("correct"), F.sum("tokens")).alias("accuracy"))


def best_checkpoint(probes: DataFrame, steps: Sequence[int] | None = None) -> DataFrame:
    """The probe of least cross-entropy, the earlier step on ties; steps must be exactly those expected and values finite."""
    ce = F.col("mean_target_token_cross_entropy")
    facts = probes.agg(F.array_sort(F.collect_list("optimizer_step")).alias("steps"), F.count_if(ce.isNull() | F.isnan(ce) | (F.abs(ce) == float("inf"))).alias("bad")).collect()[0]
    if facts.bad or (steps is not None and facts.steps != sorted(steps)):
        raise ValueError(f"probes at {facts.steps}, {facts.bad} not finite")
    return probes.agg(F.min_by("optimizer_step", F.struct(ce, F.col("optimizer_step"))).alias("optimizer_step"), F.min(ce).alias("cross_entropy"))


def log_coverage(log: DataFrame, last: int) -> DataFrame:
    """Steps must be exactly 1..last; extremes and means of loss and gradient norm; counts that are not finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return log.agg(
        (F.count(F.lit(1)) == last).alias("_n"), (F.count_distinct("step") == last).alias("_d"), (F.min("step") == 1).alias("_lo"), (F.max("step") == last).alias("_hi"),
        *[f(c).alias(f"{c}_{n}") for c in ("loss", "grad_norm") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))], F.count_if(bad("loss") | bad("grad_norm")).alias("not_finite"),
    ).withColumn("complete", F.col("_n") & F.col("_d") & F.col("_lo") & F.col("_hi")).drop("_n", "_d", "_lo", "_hi")


def trajectory(df: DataFrame, examples: str, batch: str) -> DataFrame:
    """Steps of an epoch, quarter points, warm-up steps, the last batch's size."""
    steps = F.ceil(F.col(examples) / F.col(batch))
    return df.withColumns({
        "steps": steps, "quarters": F.array(*[F.ceil(steps * q / 4) for q in (1, 2, 3, 4)]), "warmup": F.ceil(steps / 32), "tail": F.col(examples) - (steps - 1) * F.col(batch),
    })
