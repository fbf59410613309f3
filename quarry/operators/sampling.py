"""Deterministic samples: hash order, strata, diversity, greedy picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.operators.lineage import cut, join_grouped, numbered, release


def hash_sample(df: DataFrame, n: int, prefix: str, key: str = "id", strict: bool = True) -> tuple[DataFrame, int]:
    """(the n rows of least hash, number of eligible rows); fewer than n raise.  A top-n, never a global sort."""
    eligible = df.count()
    if strict and eligible < n:
        raise ValueError(f"{eligible} rows, {n} wanted")
    return df.withColumn("_h", x.hash_order(prefix, key)).orderBy("_h", key).limit(n).drop("_h"), eligible


def stratified(df: DataFrame, stratum: str, n: int, seed: str, key: str = "id", strict: bool = True, wanted: Sequence[str] | None = None) -> DataFrame:
    """n rows of least hash from each stratum; a short stratum raises."""
    if strict:
        held = {r[stratum]: r.n for r in df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
        short = {s: held.get(s, 0) for s in (wanted or held) if held.get(s, 0) < n}
        if short:
            raise ValueError(f"short strata: {short}")
    h = x.nul_sha(F.lit(seed), F.col(stratum), F.col(key).cast("string"))
    w = Window.partitionBy(stratum).orderBy(h, key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def diverse(df: DataFrame, n: int, prefix: str, group: str, key: str = "id", within: str | None = None) -> DataFrame:
    """n rows in hash order, the first of each group before any second; per ``within`` value if given."""
    df = df.withColumn("_h", x.hash_order(prefix, key))
    first = Window.partitionBy(*([within] if within else []), group).orderBy("_h", key)
    ranked = df.withColumn("repeat", F.row_number().over(first) > 1)
    if within is None:
        return ranked.orderBy("repeat", "_h", key).limit(n).drop("_h")
    w = Window.partitionBy(within).orderBy("repeat", "_h", key)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_h")


def role_bands(df: DataFrame, stratum: Sequence[str], key: Sequence[str], seed: str, reserved: str) -> DataFrame:
    """Roles by position in a stratum's hash order: a tenth validation, the next tenth test, the rest training.

    Reserved rows are test; they count in the total and are taken off the tenth.  From ten rows on there is at least
    one validation row, and one test row if none is reserved.
    """
    h = F.sha2(F.concat_ws(x.NUL, F.lit(seed), *[F.col(c).cast("string") for c in (*stratum, *key)]), 256)
    # strata may be few and large: rows are numbered in a global order and each (stratum, reserved) begins at its least number
    df = df.withColumns({"_h": h, "_s": F.to_json(F.struct(*stratum), {"ignoreNullFields": "false"}), "_r": F.coalesce(F.col(reserved), F.lit(False)).cast("int")})
    rows = numbered(df, ["_s", "_r", "_h", *key], "_at")
    strata = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_total"), F.sum("_r").alias("_res"), F.min(F.when(F.col("_r") == 1, F.col("_at"))).alias("_first_reserved"), F.min(F.when(F.col("_r") == 0, F.col("_at"))).alias("_first"))
    df = join_grouped(rows, strata, ["_s"]).withColumn("_pos", F.col("_at") - F.when(F.col("_r") == 1, F.col("_first_reserved")).otherwise(F.col("_first")))
    tenth = F.floor(F.col("_total") / 10)
    validation = F.when(F.col("_total") >= 10, F.greatest(F.lit(1), tenth)).otherwise(tenth)
    test = F.greatest(F.lit(0), tenth - F.col("_res"))
    test = F.when((F.col("_total") >= 10) & (F.col("_res") == 0), F.greatest(F.lit(1), test)).otherwise(test)
    role = F.when(F.col(reserved), "test").when(F.col("_pos") < validation, "validation").when(F.col("_pos") < validation + test, "test").otherwise("training")
    return df.withColumn("role", role).drop("_h", "_s", "_r", "_at", "_first", "_first_reserved", "_total", "_res", "_pos")


def top_ranked(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first n rows with rank labels 1..n."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over n rows


def first_occurrences(events: DataFrame, types: Sequence[str], pos: str = "pos", required: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The first event of each wanted type; a missing required type raises."""
    wanted = events.where(F.col("type").isin(*types))
    if required is not None and not wanted.where(F.col("type") == required).limit(1).count():
        raise ValueError(f"no {required} event")
    w = Window.partitionBy(*keys, "type").orderBy(pos)
    return wanted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_reserve(df: DataFrame, n: int, reserve: int, prefix: str, accepted, key: str = "id") -> DataFrame:
    """The first n accepted of the n + reserve rows of least hash."""
    pool = df.withColumn("_h", x.hash_order(prefix, key)).orderBy("_h", key).limit(n + reserve)
    return pool.where(accepted).orderBy("_h", key).limit(n).drop("_h")


def negatives(selected: DataFrame, m: int, order: Sequence[str]) -> DataFrame:
    """The selected rows with a flag on the first m, which are checked with a broken proof."""
    return selected.withColumn("negative", F.row_number().over(Window.orderBy(*order)) <= m)  # over a bounded sample


def even_quota(groups: DataFrame, total: int, order: str) -> DataFrame:
    """An even share for each group, the remainder to the first ones."""
    w = Window.partitionBy()  # a table of groups
    pos = F.row_number().over(Window.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(w)
    return groups.withColumns({"_p": pos, "_n": n}).withColumn("quota", (F.floor(F.lit(total) / F.col("_n")) + (F.col("_p") < F.lit(total) % F.col("_n")).cast("int")).cast("int")).drop("_p", "_n")


#: Plans of a family that are counted together in the prefix counts of greedy picks.
CHUNK = 100_000


def _prefix(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """df with, for each flag, how many earlier rows of the family have it: within chunks by a window, over chunks by their sums."""
    inside = Window.partitionBy("family", "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    held = df.withColumns({f"_in_{k}": F.coalesce(F.sum(c.cast("bigint")).over(inside), F.lit(0)) for k, c in flags.items()})
    earlier = Window.partitionBy("family").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # over chunks, not rows
    sums = df.groupBy("family", "_chunk").agg(*[F.sum(c.cast("bigint")).alias(f"_{k}") for k, c in flags.items()])
    sums = sums.select("family", "_chunk", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_of_{k}") for k in flags])
    out = held.join(sums, ["family", "_chunk"])
    return out.withColumns({k: F.col(f"_in_{k}") + F.col(f"_of_{k}") for k in flags}).drop(*[f"_{w}_{k}" for w in ("in", "of") for k in flags])


def greedy_first_fit(plans: DataFrame, requested: dict[str, int], forbidden: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Plans taken in order of the requested families, then of ``pos``, each unless a plan taken before has its statement, its set of sources or its
    derivation, its statement is forbidden, or its family has its number.

    plans: (pos, family, statement_id, source_ids array, derivation, ...); other columns are carried along.  A null statement or derivation
    conflicts with nothing, null sources are the empty set; plans of other families are not taken; equal pos are ordered by statement,
    sources and derivation.  With ``strict``, a family that falls short raises, naming what it has.

    The order's outcome is found in rounds.  A plan that is the first undecided one at each of its marks can be stopped by its family's
    number alone: with T taken, F first and U undecided plans before it in its family it is taken if T + U is below the number, and out if T + F
    reaches it; so is every later plan.  Plans that share a mark with a taken one are out.  Rounds cut their lineage; a few numbers a round
    reach the driver.
    """
    spark = plans.sparkSession
    families = spark.createDataFrame([(f, i, n) for i, (f, n) in enumerate(requested.items())], "family string, _rank int, _number bigint")
    own = plans.join(F.broadcast(families), "family")  # a row a requested family
    if forbidden is not None:
        own = own.join(forbidden.select(F.col("statement_id").alias("_no")).distinct(), F.col("statement_id") == F.col("_no"), "left_anti")
    sources = F.array_join(F.array_sort(F.coalesce("source_ids", F.array().cast("array<string>"))), x.NUL)
    own = numbered(own.withColumns({"_sources": sources}), ["_rank", "pos", "statement_id", "_sources", "derivation"], "_at")
    marks = F.filter(F.array(F.concat(F.lit("s"), "statement_id"), F.concat(F.lit("l"), "_sources"), F.concat(F.lit("d"), "derivation")), lambda m: m.isNotNull())
    rows = own.select("_at", "family", "_number", marks.alias("marks"), F.floor(F.col("_at") / CHUNK).alias("_chunk"), F.lit(False).alias("taken"))
    rows = cut(rows)
    while rows.where(~F.col("taken")).limit(1).count():
        open_marks = rows.where(~F.col("taken")).select("_at", F.explode("marks").alias("mark"))
        leads = open_marks.groupBy("mark").agg(F.min("_at").alias("_at")).groupBy("_at").agg(F.count(F.lit(1)).alias("_leads"))
        now = rows.join(leads, "_at", "left").withColumn("_first", ~F.col("taken") & (F.coalesce("_leads", F.lit(0)) == F.size("marks"))).drop("_leads")
        now = _prefix(now, {"_t": F.col("taken"), "_f": F.col("_first"), "_u": ~F.col("taken")})
        now = cut(now.where(F.col("taken") | (F.col("_t") + F.col("_f") < F.col("_number"))).withColumn("_new", F.col("_first") & (F.col("_t") + F.col("_u") < F.col("_number"))))
        gone = now.where("_new").select(F.explode("marks").alias("mark")).distinct()
        left = now.where(~F.col("taken") & ~F.col("_new"))
        hit = left.select("_at", F.explode("marks").alias("mark")).join(gone, "mark").select("_at").distinct()
        still = left.join(hit, "_at", "left_anti")
        rows = cut(now.where(F.col("taken") | F.col("_new")).withColumn("taken", F.lit(True)).unionByName(still).select(*rows.columns))
        release(rows)
    if strict:
        held = {r["family"]: r["n"] for r in rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = {f: (held.get(f, 0), n) for f, n in requested.items() if held.get(f, 0) < n}
        if short:
            raise ValueError("too few plans: " + ", ".join(f"{f} has {a} of {n}" for f, (a, n) in short.items()))
    return own.join(rows.select("_at"), "_at", "left_semi").select(*plans.columns)
