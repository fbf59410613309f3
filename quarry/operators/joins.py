"""Lookup, fallback, band, overlay and paired joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def task_candidates(candidates: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Candidates with their task; a missing task gives an error row instead of none."""
    t = tasks.withColumn("_known", F.lit(True))
    return candidates.join(t, key, "left").withColumn("task_missing", F.col("_known").isNull()).drop("_known")


def unique_lookup(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has."""
    once = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_k")
    return df.join(once, F.col(key) == F.col("_k"), "left_semi")


def premise_edges(records: DataFrame, id_col: str = "id", name: str = "declaration_name", premises: str = "premises") -> DataFrame:
    """Distinct (source, target) edges: premises resolved to names that one record owns, itself excepted."""
    owners = records.groupBy(F.col(name).alias("premise")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("target")).where("n = 1").select("premise", "target")
    return (
        records.select(F.col(id_col).alias("source"), F.explode(F.array_distinct(premises)).alias("premise")).join(owners, "premise")
        .where("source <> target").select("source", "target").distinct()
    )


def band_edges(df: DataFrame, group: str, order: Sequence[str], id_col: str = "id", width: int = 2) -> DataFrame:
    """Undirected edges (low id, high id) between a row and the next ``width`` of its group."""
    w = Window.partitionBy(group).orderBy(*order)
    nexts = F.array(*[F.lead(id_col, i).over(w) for i in range(1, width + 1)])
    pairs = df.select(F.col(id_col).alias("a"), nexts.alias("n")).select("a", F.explode("n").alias("b")).where("b is not null and a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.col(a).alias("source"), F.col(b).alias("target")).union(edges.select(F.col(b), F.col(a))).distinct()


def cross_checked(store: DataFrame, members: DataFrame, key: str, shared: Sequence[str]) -> DataFrame:
    """Members' rows of the store; any shared column that differs, or a missing row, raises."""
    m = members.select(F.col(key), *[F.col(c).alias(f"_m_{c}") for c in shared])
    both = m.join(store.withColumn("_in", F.lit(True)), key, "left")
    bad = F.col("_in").isNull()
    for c in shared:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    n = both.where(bad).count()
    if n:
        raise ValueError(f"{n} members differ from the store")
    return both.drop("_in", *[f"_m_{c}" for c in shared])


def fallback_crosswalk(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Dispositions by exact (file, name); else by a span start that is unique within its file; else, without a file, by a unique name.

    rows: (row_id, file_path, declaration_name, line, col); sources: (file_path, declaration_name, line, col, disposition).
    """
    named = sources.where("declaration_name is not null")
    exact = named.groupBy("file_path", "declaration_name").agg(F.max("disposition").alias("d_exact"))
    spans = sources.where("line is not null").groupBy("file_path", "line", "col").agg(F.count(F.lit(1)).alias("n"), F.min("disposition").alias("d_span")).where("n = 1").drop("n")
    names = named.groupBy("declaration_name").agg(F.count(F.lit(1)).alias("n"), F.min("disposition").alias("d_name")).where("n = 1").drop("n")
    has_file = F.coalesce("file_path", F.lit("")) != ""
    joined = rows.join(exact, ["file_path", "declaration_name"], "left").join(spans, ["file_path", "line", "col"], "left").join(names, "declaration_name", "left")
    found = F.when(has_file, F.coalesce("d_exact", "d_span")).otherwise(F.col("d_name"))
    label = (
        F.when(has_file & F.col("d_exact").isNotNull(), "exact-file-and-declaration-name").when(has_file & F.col("d_span").isNotNull(), "immutable-source-span-start")
        .when(~has_file & F.col("d_name").isNotNull(), "unique-declaration-name").otherwise("unresolved")
    )
    return joined.select("row_id", F.coalesce(found, F.lit("source-integrity-blocked")).alias("disposition"), label.alias("resolution"))


def crosswalk_summary(walked: DataFrame, examples: int = 100) -> DataFrame:
    return walked.groupBy("disposition", "resolution").agg(F.count(F.lit(1)).alias("records"), F.slice(F.array_sort(F.collect_set(F.when(F.col("resolution") == "unresolved", F.col("row_id")))), 1, examples).alias("examples"))


def enriched(df: DataFrame, extra: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Left join of a keyed table whose arrays are empty where it has no row."""
    out = df.join(extra, list(keys), "left")
    return out.withColumns({a: F.coalesce(F.col(a), F.array().cast(extra.schema[a].dataType)) for a in arrays})


def verdict_transfer(work: DataFrame, previous: DataFrame, keys: Sequence[str], transient: Column) -> tuple[DataFrame, DataFrame]:
    """(settled, to do): earlier verdicts by span key; missing or transient ones are to be done, rows of kind ``none`` excepted."""
    prev = previous.select(*keys, "verdict").withColumn("_had", F.lit(True))
    both = work.join(prev, list(keys), "left")
    todo = (F.col("_had").isNull() & (F.col("kind") != "none")) | F.coalesce(transient, F.lit(False))
    return both.where(~todo).drop("_had"), both.where(todo).drop("_had", "verdict")


def overlay(base: DataFrame, changed: DataFrame, key: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """Rows of ``changed`` replace those of ``base``; their keys must exist and, if given, equal ``expected``'s."""
    keys = list(key)
    stray = changed.join(base, keys, "left_anti").limit(1).count()
    if expected is not None:
        stray += changed.join(expected, keys, "left_anti").limit(1).count() + expected.select(*keys).distinct().join(changed, keys, "left_anti").limit(1).count()
    if stray:
        raise ValueError("replacement keys differ from those expected")
    return base.join(changed.select(*keys), keys, "left_anti").unionByName(changed)


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right) of two runs over exactly the same keys; any difference raises."""
    a = left.select(F.col(key), F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(F.col(key), F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, key, "full_outer")
    bad = both.agg(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unpaired"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated")).collect()[0]
    if bad.unpaired or bad.repeated:
        raise ValueError(f"{bad.unpaired} ids are in one run only, {bad.repeated} repeat")
    return both.drop("_l", "_r")


def contract_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> list[str]:
    """Names of contract columns on which two one-row runs differ."""
    both = a.select(*[F.col(k).alias(f"a_{k}") for k in keys]).crossJoin(b.select(*[F.col(k).alias(f"b_{k}") for k in keys]))  # one row each
    row = both.select(*[F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")).alias(k) for k in keys]).collect()
    if len(row) != 1:
        raise ValueError("a run has other than one row")
    return [k for k in keys if not row[0][k]]


def unresolved_references(df: DataFrame, array: str, targets: DataFrame, target: str, id_col: str) -> DataFrame:
    """(id, reference) of array elements that no target has."""
    refs = df.select(F.col(id_col), F.explode(array).alias("reference"))
    return refs.join(targets.select(F.col(target).alias("reference")).distinct(), "reference", "left_anti").select(id_col, "reference")


def support_closure(records: DataFrame, variants: DataFrame, dependency: str = "dependency", name: str = "source_declaration_name") -> DataFrame:
    """(statement_id, supports): statements one dependency hop away, by source declaration name."""
    owners = variants.select(F.col("statement_id").alias("supports"), F.col(name).alias("dep")).distinct()
    return records.select("statement_id", F.col(dependency).alias("dep")).join(owners, "dep").select("statement_id", "supports").where("statement_id <> supports").distinct()


def coverage(atlas: DataFrame, dispositions: DataFrame, streams: Sequence[DataFrame] = ()) -> DataFrame:
    """Atlas entries with dispositions (default not-formalised), united with further entry streams."""
    d = dispositions.select("id", "disposition", "statement_ids")
    out = atlas.join(d, "id", "left").select(F.concat(F.lit("atlas:"), "id").alias("coverage_id"), F.coalesce("disposition", F.lit("not-formalised")).alias("disposition"), F.coalesce("statement_ids", F.array().cast("array<string>")).alias("statement_ids"))
    for s in streams:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def set_overlaps(members: DataFrame, name: str = "name", member: str = "member") -> DataFrame:
    """(left, right, n) for pairs of named sets that share members, names in order.

    Pairs come from each member's own sorted list of sets, which is as long as the number of sets.
    """
    sets = members.select(name, member).distinct().groupBy(member).agg(F.array_sort(F.collect_set(name)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.posexplode("s").alias("i", "left"), "s").select("left", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def crossing_edges(edges: DataFrame, nodes: DataFrame, id_col: str = "id", split: str = "split") -> DataFrame:
    """(label, n): edges whose ends are in different splits."""
    n = nodes.select(F.col(id_col).alias("_id"), F.col(split).alias("_s"))
    out = edges.join(n.withColumnsRenamed({"_id": "source", "_s": "s"}), "source").join(n.withColumnsRenamed({"_id": "target", "_s": "t"}), "target")
    return out.where("s <> t").groupBy(F.concat("s", F.lit("->"), "t").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def expected_vs_observed(expected: DataFrame, observed: DataFrame, key: str = "candidate_id") -> DataFrame:
    return expected.join(observed, key).withColumn("agrees", F.col("expected_category").eqNullSafe(F.col("category")))


def positional(left: DataFrame, right: DataFrame, ordinal: str = "pos") -> DataFrame:
    """Strict zip on an explicit ordinal; lengths must be equal."""
    if left.count() != right.count() or left.join(right, ordinal, "left_anti").limit(1).count():
        raise ValueError("sequences differ in length or positions")
    return left.join(right, ordinal)
