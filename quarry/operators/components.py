"""Duplicate-connected components, proportional splits and their hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.operators.lineage import cut, join_grouped, numbered, release
from quarry.sources.schemas import SPLITS


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b); root is the smallest node of the component.

    Alternating large and small stars; a round's lineage is cut, and only a row count and a checksum
    reach the driver.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(stars)
    while mark[0]:
        both = stars.union(stars.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_grouped(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_grouped(large, low, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        stars = cut(small)
        del both, low, large, small
        release(stars)
        now = _mark(stars)
        if now == mark:
            break
        mark = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())


def _mark(stars: DataFrame) -> tuple:
    r = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return r[0], r[1]


def file_components(records: DataFrame, file: str = "file_path", fingerprint: str = "statement_fingerprint") -> DataFrame:
    """(file, component_id, members): files that share a fingerprint, transitively; the id is the SHA-256 of the NUL-joined sorted files.

    Ties go from each fingerprint's first file to its others, so a hot fingerprint gives one edge a file.  The id is a digest of all of a
    component's file names in order, so these (names only, not rows) meet in one row: some 100 bytes a file, up to the 2 GB of a row.
    """
    pairs = records.select(F.col(file).alias("file"), F.col(fingerprint).alias("fp")).distinct()
    lead = pairs.groupBy("fp").agg(F.min("file").alias("lead"))
    edges = join_grouped(pairs, lead, ["fp"]).where("file <> lead").select(F.col("lead").alias("a"), F.col("file").alias("b")).distinct()
    linked = connected(edges)
    rooted = pairs.select("file").distinct().join(linked, F.col("file") == F.col("node"), "left").select("file", F.coalesce("root", "file").alias("root"))
    named = rooted.groupBy("root").agg(F.array_sort(F.collect_list("file")).alias("members"))
    named = named.select("root", F.sha2(F.array_join("members", x.NUL), 256).alias("component_id"), F.size("members").alias("files"))
    return join_grouped(rooted, named, ["root"]).select(F.col("file").alias(file), "component_id", "files")


def _least_full(counts: list[int], targets: list[float], size: int, n: int) -> list[int]:
    """How many of the next n components of one size each split gets when each goes to the split that is least full for its target.

    A split's fullness before its j-th component is (count + j * size) / target, which grows with j, so the n choices are the n smallest of
    these fractions.  A bisection on fullness finds a level below which there are at most n, and the rest are chosen one by one.
    """
    def below(level: float) -> list[int]:
        # one to three fewer than there are below the level, whatever the rounding
        return [max(0, min(n, int((level * t - c) / size) - 1)) for c, t in zip(counts, targets, strict=True)]

    if not size:
        first = min(range(len(targets)), key=lambda i: (counts[i] / targets[i], i))
        return [n if i == first else 0 for i in range(len(targets))]
    low, high = 0.0, max((c + n * size) / t for c, t in zip(counts, targets, strict=True)) + 1
    for _ in range(80):
        middle = (low + high) / 2
        if sum(below(middle)) + 3 * len(targets) <= n:
            low = middle
        else:
            high = middle
    held = below(low) if low else [0] * len(targets)
    for _ in range(n - sum(held)):
        held[min(range(len(targets)), key=lambda i: ((counts[i] + held[i] * size) / targets[i], i))] += 1
    return held


def assign_splits(sizes: DataFrame, proportions: dict[str, float], seed: str) -> DataFrame:
    """(component_id, split): components by falling size, then hash, each to the split that is least full for its target.

    The rule is sequential, but components of one size make a run whose outcome follows from the counters at its start.  The driver walks the
    distinct sizes (fewer than the square root of twice the rows); components are numbered by a range partition, and each task finds the
    counters at its first row of a run and goes on from there.
    """
    names = list(SPLITS)
    if set(proportions) != set(names) or abs(sum(proportions.values()) - 1) > 1e-9 or min(proportions.values()) <= 0:
        raise ValueError(f"proportions must be positive, sum to one and name {names}")
    own = sizes.select(F.col("component_id").cast("string").alias("component_id"), F.col("size").cast("bigint").alias("size"))
    histogram = sorted(((r["size"], r["n"]) for r in own.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total = sum(size * n for size, n in histogram)
    if total <= 0:
        return own.select("component_id", F.lit(None).cast("string").alias("split")).limit(0)
    targets = [total * proportions[n] for n in names]
    runs, at, counts = {}, 0, [0] * len(names)
    for size, n in histogram:
        runs[size] = (at, counts)
        at, counts = at + n, [c + size * k for c, k in zip(counts, _least_full(counts, targets, size, n), strict=True)]
    held = sizes.sparkSession.sparkContext.broadcast(runs)

    def run(batches):
        import pyarrow as pa

        size, counts, due = None, [], -1
        for batch in batches:
            chosen = []
            for now, pos in zip(batch.column("size").to_pylist(), batch.column("pos").to_pylist(), strict=True):
                if now != size or pos != due:  # a run begins, or this task's part of it
                    size, (start, counts) = now, held.value[now]
                    counts = [c + size * k for c, k in zip(counts, _least_full(counts, targets, size, pos - start), strict=True)]
                pick = min(range(len(names)), key=lambda i: (counts[i] / targets[i], i))
                counts[pick] += size
                chosen.append(names[pick])
                due = pos + 1
            yield pa.RecordBatch.from_arrays([batch.column("component_id"), pa.array(chosen, pa.string())], ["component_id", "split"])

    order = {"_low": -F.col("size"), "_h": x.nul_sha(F.lit(seed), "component_id")}
    ordered = numbered(own.withColumns(order), [*order, "component_id"])
    return ordered.select("component_id", "size", "pos").mapInArrow(run, "component_id string, split string")


def split_statistics(records: DataFrame, proportions: dict[str, float]) -> DataFrame:
    """A row for each known split, zero rows included."""
    spark = records.sparkSession
    known = spark.createDataFrame([(i, s, float(p)) for i, (s, p) in enumerate((s, proportions[s]) for s in SPLITS)], "ord int, split string, target_proportion double")
    held = records.where(F.col("split").isin(*SPLITS)).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("file_path").alias("files"), F.count_distinct("component_id").alias("components"))
    total = F.sum(F.coalesce("records", F.lit(0))).over(Window.partitionBy())  # three rows
    return known.join(F.broadcast(held), "split", "left").select(
        "ord", "split", "target_proportion", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / F.nullif(total, F.lit(0))).alias("proportion"),
        F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("components", F.lit(0)).alias("components"),
    ).orderBy("ord").drop("ord")


def diagnostics(components: DataFrame, stats: DataFrame, tolerance: float = 0.02, floor: int = 50_000) -> DataFrame:
    """Largest component, largest deviation from the targets, and the two gates."""
    big = components.agg(F.max("size").alias("largest"), F.sum("size").alias("records"))
    dev = stats.agg(F.max(F.abs(F.col("proportion") - F.col("target_proportion"))).alias("deviation"))
    return big.crossJoin(dev).withColumns({"within_tolerance": F.col("deviation") <= tolerance, "enough_records": F.col("records") >= floor})  # one row each
