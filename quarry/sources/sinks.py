"""Sinks: per-split JSON lines, byte-stable files, membership views, manifests, caches."""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.expressions import canonical_json
from quarry.operators.lineage import numbered, scratch
from quarry.sources import readers, schemas


def jsonl_by_split(df: DataFrame, folder: str, split: str = "split", mode: str = "overwrite") -> dict[str, int]:
    """JSON lines partitioned by split; gives the rows of each.  Distributed: the split becomes a folder."""
    df.withColumn(f"_{split}", F.col(split)).write.mode(mode).partitionBy(f"_{split}").json(folder)
    return {r[split]: r.n for r in df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _create(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file."""
    _create(spark, path, text.encode())


#: Lines of one gzip member.
MEMBER_LINES = 100_000


def _joined(spark: SparkSession, folder: str, path: str) -> None:
    """The files of a folder, in order of their names, as one file: by the file system where it can, else as a stream of its bytes."""
    jvm, (fs, at) = spark._jvm, _file_system(spark, path)
    parts = sorted((f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    fs.delete(at, False)
    if len(parts) == 1:
        fs.rename(parts[0], at)
        return
    if fs.getScheme() in ("hdfs", "abfs", "abfss"):
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
        for i, p in enumerate(parts[1:]):
            rest[i] = p
        fs.rename(parts[0], at)
        fs.concat(at, rest)
        return
    out = fs.create(at, True)
    try:
        for p in parts:
            source = fs.open(p)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()


def stable_gzip(df: DataFrame, path: str, order: Sequence[str]) -> int:
    """One gzip file whose bytes depend on the rows alone: sorted rows, sorted keys, no name, no time.

    Lines are numbered in a global order; every ``MEMBER_LINES`` of them are one gzip member, which a task writes, so the bytes do not depend on
    partitions.  Members may follow one another in a gzip file; the file system puts them together, and the driver sees no rows.
    """
    spark = df.sparkSession
    keyed = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], canonical_json(*df.columns).alias("_line"))
    lines = numbered(keyed, [*[f"_o{i}" for i in range(len(order))], "_line"], "_at")
    n = lines.count()
    if not n:
        _create(spark, path, gzip.compress(b"", mtime=0))
        return 0
    members = -(-n // MEMBER_LINES)
    dealt = lines.select("_line", "_at", F.floor(F.col("_at") / MEMBER_LINES).cast("int").alias("_member")).repartitionById(members, "_member").sortWithinPartitions("_at")
    folder = scratch(spark, "members")
    dealt.select("_line").write.option("compression", "gzip").option("lineSep", "\n").text(folder)
    _joined(spark, folder, path)
    return n


def snapshot(df: DataFrame, folder: str, schema_version: str, splits: Sequence[str] = schemas.SPLITS) -> dict:
    """Per-split byte-stable files with a manifest; files of earlier snapshots are removed."""
    spark = df.sparkSession
    fs, at = _file_system(spark, folder)
    fs.mkdirs(at)
    wanted = {f"{s}.jsonl.gz" for s in splits} | {"manifest.json"}
    for found in fs.listStatus(at):
        if found.getPath().getName() not in wanted:
            fs.delete(found.getPath(), True)
    files = {}
    for s in splits:
        path = f"{folder}/{s}.jsonl.gz"
        rows = stable_gzip(df.where(F.col("split") == s), path, ["id"])
        digest = readers.digests(spark, path, False).collect()[0]
        files[f"{s}.jsonl.gz"] = {"rows": rows, "bytes": digest.bytes, "sha256": digest.sha256}
    manifest = {"schema_version": schema_version, "files": files}
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
    return manifest


def tree_manifest(spark: SparkSession, folder: str, root: str | None = None) -> DataFrame:
    """(path relative to the root, sha256, bytes) of every file under a folder."""
    base = (root or folder).rstrip("/")
    return readers.digests(spark, folder).withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{base}/", "")).orderBy("path")


def require_tree(spark: SparkSession, folder: str, manifest: dict[str, dict]) -> None:
    """Every file of the manifest is there with its digest and size, and no other file is."""
    found = {r.path: (r.sha256, r.bytes) for r in tree_manifest(spark, folder).collect() if not os.path.basename(r.path).startswith((".", "_"))}
    want = {k: (v["sha256"], v["bytes"]) for k, v in manifest.items()}
    if found != want:
        raise ValueError(f"tree differs in {sorted(set(found.items()) ^ set(want.items()))[:5]}")


def membership_view(records: DataFrame, view_id: str) -> DataFrame:
    """Ids only: statement_id and the ordered variant ids."""
    return records.select(F.lit(view_id).alias("view_id"), "statement_id", F.transform("proof_variants", lambda v: v["proof_variant_id"]).alias("variant_ids"), "role")


def read_view(view: DataFrame, records: DataFrame, role: str) -> DataFrame:
    """Records of a view, checked: no duplicates, ids exist, variant ids equal in order, one role."""
    if view.groupBy("statement_id").count().where("count > 1").limit(1).count():
        raise ValueError("a view lists a statement twice")
    both = view.select("statement_id", F.col("variant_ids").alias("v_ids")).join(records, "statement_id", "left")
    ok = F.col("v_ids").eqNullSafe(F.transform("proof_variants", lambda v: v["proof_variant_id"])) & F.col("role").eqNullSafe(F.lit(role))
    if both.where(~ok).limit(1).count():
        raise ValueError("a view differs from the records")
    return both.drop("v_ids")


def run_artifacts(run: DataFrame, results: DataFrame, folder: str) -> None:
    run.coalesce(1).write.mode("overwrite").json(f"{folder}/run.json")
    results.write.mode("overwrite").json(f"{folder}/results.jsonl")


def stage_cache(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table under its content key: built and written once, read afterwards.  A key of other inputs is another folder.

    A writer fills a folder of its own and then renames it, which fails if the key is there: of several writers the first to end wins,
    and one that fails leaves nothing under the key.  On stores without a rename of folders two writers must not share a key.
    """
    path, own = f"{folder.rstrip('/')}/{key}", f"{folder.rstrip('/')}/_{key}-{uuid.uuid4().hex}"
    jvm, (fs, at) = spark._jvm, _file_system(spark, path)
    if not fs.exists(at):
        made = jvm.org.apache.hadoop.fs.Path(own)
        fs.deleteOnExit(made)
        build().write.parquet(own)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(made, at, none)
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            fs.delete(made, True)
    return spark.read.parquet(path)


def content_key(*parts: str) -> str:
    return readers.text_sha256("\0".join(parts))


def work_left(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not done yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def checked_stage(df: DataFrame, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Write rows, read them again with their schema, and check count and key uniqueness before the next stage."""
    n = df.count()
    df.write.mode("overwrite").json(path)
    again = readers.jsonl(df.sparkSession, path, schema)
    stats = again.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("d")).collect()[0]
    if stats.n != n or stats.d != n:
        raise ValueError(f"stage wrote {n} rows, read {stats.n} with {stats.d} keys")
    return again


def markdown(df: DataFrame, title: str) -> str:
    """A small table as Markdown."""
    rows = df.collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
