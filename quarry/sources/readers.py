"""Scans: declared schemas, fail on bad rows, keys taken from paths."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources import schemas


def _schema(s: str | T.StructType) -> T.StructType:
    return schemas.ddl(s) if isinstance(s, str) else s


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Typed JSON lines; ``.gz`` by suffix; blank lines are skipped and a bad row fails the scan, naming its file."""
    return spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(path if isinstance(path, str) else list(path))


def versioned(df: DataFrame, version: str) -> DataFrame:
    """Rows of one schema version; any other raises when read."""
    ok = F.col("schema_version").eqNullSafe(F.lit(version))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.coalesce("schema_version", F.lit("null"))))))


def split_files(spark: SparkSession, folder: str, schema: str | T.StructType, splits: Sequence[str] = schemas.SPLITS, suffix: str = ".jsonl") -> DataFrame:
    """One file per split; the rows' split must be the file's."""
    rows = jsonl(spark, [f"{folder}/{s}{suffix}" for s in splits], schema)
    of_file = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?){suffix.replace('.', chr(92) + '.')}", 1)
    rows = rows.select("*", of_file.alias("_file_split"))
    ok = F.col("split").eqNullSafe(F.col("_file_split"))
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("split differs from file "), F.col("_file_split"))))).drop("_file_split")


def parent_keyed(spark: SparkSession, glob: str, schema: str | T.StructType, key: str) -> DataFrame:
    """JSON lines under many folders, the folder's name as a column."""
    return jsonl(spark, glob, schema).select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias(key))


def documents(spark: SparkSession, glob: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).option("mode", "FAILFAST").json(glob)


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one entry a line; blanks and # comments off."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("value")).where((line != "") & ~line.startswith("#"))


def run_artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(run, results) of a run's folder."""
    return documents(spark, f"{folder}/run.json", schemas.RUN), jsonl(spark, f"{folder}/results.jsonl", schemas.RESULT)


def fixture_arrays(spark: SparkSession, path: str, arrays: dict[str, str]) -> dict[str, DataFrame]:
    """A JSON document of several arrays, each as a table."""
    schema = ", ".join(f"{name} array<struct<{_angle(ddl)}>>" for name, ddl in arrays.items())
    whole = documents(spark, path, schema)
    return {name: whole.select(F.explode(name).alias("x")).select("x.*") for name in arrays}


def _angle(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.ddl(ddl).fields)


def declarations(sources: DataFrame, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Declarations of source texts: one row for each ``theorem`` at a line start whose proof is a placeholder.

    (name, declaration, position, primary); names with ``.variants.`` are not primary.
    """
    pattern = r"(?ms)^theorem\s+([^\s(:]+)(.*?)\s*:=\s*by\n\s+sorry\s*(?=\n|\z)"
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    rows = sources.select(*keep, F.posexplode(whole).alias("position", "match"))
    name = F.regexp_extract("match", pattern, 1)
    decl = F.regexp_replace(F.concat(F.lit("theorem "), name, F.regexp_extract("match", pattern, 2)), r"\s+\z", "")
    return rows.select(*keep, name.alias("name"), decl.alias("declaration"), "position", (~name.contains(".variants.")).alias("primary"))


def benchmark_tasks(sources: DataFrame, expected: int | None = None, text: str = "value") -> DataFrame:
    """Tasks of a benchmark source; duplicate names and a wrong count raise."""
    rows = declarations(sources, text).where("primary").select(F.col("name").alias("id"), "declaration", F.col("name").alias("declaration_name"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).collect()[0]
    if stats.n != stats.d:
        raise ValueError(f"{stats.n - stats.d} duplicate task names")
    if expected is not None and stats.n != expected:
        raise ValueError(f"expected {expected} tasks, found {stats.n}")
    return rows


def external_declarations(sources: DataFrame, known: DataFrame, name_pattern: str, licence_ok: Column, revision_ok: Column, forbidden: str = r"\b(sorry|admit|axiom)\b") -> DataFrame:
    """Declarations of external projects behind licence, revision and axiom gates, each with a flag: its fingerprint is known already.

    sources: (repository, file_path, value); known: (fingerprint).
    """
    pattern = rf"(?ms)^(?:theorem|lemma)\s+({name_pattern})\b(.*?)(?=^(?:theorem|lemma|def|end|namespace|section)\b|\z)"
    found = sources.where(licence_ok & revision_ok).select("repository", "file_path", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("text"))
    found = found.where(~F.col("text").rlike(forbidden))
    shape = F.regexp_replace(F.regexp_replace("text", r"\A\S+\s+\S+", "theorem _"), r"\s+", " ")
    found = found.withColumn("name", F.regexp_extract("text", pattern, 1)).withColumn("fingerprint", F.sha2(shape, 256))
    seen = known.select(F.col("fingerprint").alias("k")).distinct().withColumn("overlaps", F.lit(True))
    return found.join(seen, F.col("fingerprint") == F.col("k"), "left").drop("k").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def step_files(spark: SparkSession, glob: str, schema: str | T.StructType, step: int = 100) -> DataFrame:
    """Files named ...step-N...: N must be the rows' optimizer_step, and steps must be step, 2 step, ..., max."""
    rows = spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(glob)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"step-(\d+)", 1).cast("int")
    rows = rows.select("*", named.alias("file_step"))
    check = rows.agg(
        F.max(~F.col("file_step").eqNullSafe(F.col("optimizer_step"))).alias("differs"), F.array_sort(F.collect_set("file_step")).alias("steps")
    ).collect()[0]
    if check.differs:
        raise ValueError("a file's step differs from its rows'")
    if not check.steps or check.steps != list(range(step, max(check.steps) + 1, step)):
        raise ValueError(f"steps are not {step}, {2 * step}, ...: {check.steps}")
    return rows


def digests(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, sha256, bytes) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def missing_siblings(files: DataFrame, suffixes: Sequence[str], path: str = "path") -> DataFrame:
    """Sources (``.lean``) without one of their sibling files; ``first_missing`` gives the count and five names."""
    stem = F.regexp_replace(path, r"\.lean$", "")
    want = files.where(F.col(path).endswith(".lean")).select(F.explode(F.array(*[F.concat(stem, F.lit(s)) for s in suffixes])).alias("want"))
    return want.join(files.select(F.col(path).alias("want")), "want", "left_anti")


def require_siblings(files: DataFrame, suffixes: Sequence[str]) -> None:
    missing = missing_siblings(files, suffixes)
    n = missing.count()
    if n:
        raise ValueError(f"{n} files are missing, first {[r.want for r in missing.orderBy('want').limit(5).collect()]}")


def require_digests(found: DataFrame, pinned: dict[str, str]) -> None:
    """Files whose digest is pinned must have it."""
    have = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in found.where(F.element_at(F.split("path", "/"), -1).isin(*pinned)).collect()}
    wrong = sorted(k for k, v in pinned.items() if have.get(k) != v)
    if wrong:
        raise ValueError(f"digests differ: {wrong}")


def frozen_snapshot(spark: SparkSession, folder: str, manifest: dict[str, dict], schema: str | T.StructType) -> DataFrame:
    """Split files whose sizes, digests and row counts equal the manifest's {file: {sha256, bytes, rows}}."""
    found = {r.path.rsplit("/", 1)[-1]: r for r in digests(spark, folder, recursive=False).collect()}
    for name, want in manifest.items():
        if name not in found or found[name].sha256 != want["sha256"] or found[name].bytes != want["bytes"]:
            raise ValueError(f"{name} is not the frozen file")
    rows = jsonl(spark, [f"{folder}/{n}" for n in manifest], schema)
    counts = {r.f: r.n for r in rows.select("*", F.col("_metadata.file_name").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, want in manifest.items():
        if counts.get(name, 0) != want["rows"]:
            raise ValueError(f"{name} has {counts.get(name, 0)} rows, not {want['rows']}")
    return rows


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
