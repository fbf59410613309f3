"""The three end-to-end flows: evaluation, corpus build, graph-derived corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexer
from quarry.operators import components, dedup, expectations, filters, graph, joins, metrics
from quarry.operators.lineage import written
from quarry.sources import readers, schemas
from quarry.sources.schemas import SPLITS


def evaluate(results: DataFrame, tasks: DataFrame, n: int, ks: Sequence[int] = (1, 4, 8), dimensions: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Candidate results against expected tasks: the run summary, per-task outcomes, and one breakdown for each dimension of the tasks."""
    joined = joins.task_candidates(results, tasks.select("task_id"))
    judged = joined.withColumn("category", F.when(F.col("task_missing"), "verifier_error").otherwise(F.col("category"))).drop("task_missing")
    out = {"summary": metrics.run_summary(judged, tasks, n, ks), "outcomes": metrics.outcome_rows(judged), "differences": metrics.id_differences(results, tasks)}
    if dimensions:
        per = metrics.per_task(judged, tasks, n).join(tasks.select("task_id", *dimensions), "task_id")
        out["breakdowns"] = metrics.breakdowns(per, list(dimensions))
    return out


def build_corpus(raw: DataFrame, contamination: DataFrame, proportions: dict[str, float], seed: str, repository: str, revision: str, count=filters.regex_tokens) -> dict[str, DataFrame]:
    """Raw declarations to split records: cascade, ambiguous identities, contamination, components, splits, token lengths, hygiene.

    contamination: (statement_fingerprint).  Gives records, rejects with reasons, reason counts and split statistics.
    """
    # the cascade runs Python once a row and feeds several branches
    judged = written(filters.evaluate_raw(raw, repository, revision), "judged")
    accepted = judged.where("filter_reason is null")
    unique, ambiguous = filters.exclude_ambiguous(accepted, "id")
    clean, contaminated = filters.partition_by_membership(unique, contamination, "statement_fingerprint")
    rejects = (
        judged.where("filter_reason is not null").unionByName(ambiguous.withColumn("filter_reason", F.lit("ambiguous_identity")))
        .unionByName(contaminated.withColumn("filter_reason", F.lit("contaminated")))
    )
    comp = written(components.file_components(clean), "components")
    sized = clean.join(comp, "file_path")
    splits = components.assign_splits(sized.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")), proportions, seed)
    records = filters.token_lengths(sized.join(splits, "component_id"), count).withColumns({"schema_version": F.lit(filters.RECORD_VERSION), "file_group": F.col("file_path")}).drop("filter_reason", "files", "is_private")
    records = written(records, "records")
    expectations.split_hygiene(records)
    order = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    return {
        "records": records.orderBy(order, "file_path", "source_span.start", "declaration_name"), "rejects": rejects, "reasons": filters.reason_counts(rejects), "statistics": components.split_statistics(records, proportions),
    }


def specialise(records: DataFrame, families: DataFrame, **bounds) -> dict[str, DataFrame]:
    """Graph-derived corpora of split records: nodes, edges, classes, six corpora, and their leakage, which must be zero."""
    flat = records.select("id", "declaration_name", "file_path", F.col("source_span.start.line").alias("line"), F.col("source_span.start.column").alias("col"), "premises", "split", "component_id", "statement_fingerprint")
    seeds = filters.seed_families(flat, families).select("id", "family_id").distinct()
    built = graph.internal_graph(flat, families, seed_matches=seeds, **bounds)
    nodes = written(built["nodes"], "nodes")
    corpora = written(graph.specialist_partitions(nodes, schemas.BUBBLE, bounds["control_prefix"]), "corpora")
    leaks = graph.leakage(corpora, nodes)
    expectations.none(leaks, F.col("n") > 0, "forbidden leakage")
    return {**built, "nodes": nodes, "corpora": corpora, "overlaps": joins.set_overlaps(corpora, "corpus", "id"), "crossing": joins.crossing_edges(built["premise_edges"], nodes), "leakage": leaks}


def read_corpus_v2(spark: SparkSession, path: str, version: str, check_identity: bool = True) -> DataFrame:
    """Corpus-v2 records, re-checked: version, invariants, role isolation, and fingerprints computed anew."""
    rows = readers.versioned(readers.jsonl(spark, path, schemas.RECORD_V2), version)
    expectations.v2_invariants(rows)
    expectations.role_isolation(rows)
    if check_identity:
        again = lexer.alpha_fingerprint_col(F.col("canonical_declaration"))
        expectations.none(rows.withColumn("_fp", again), ~F.col("_fp").eqNullSafe(F.col("normalized_statement_fingerprint")), "statement fingerprints")
    return rows


def merge_corpora(rows: Sequence[DataFrame], ordinal: str = "pos") -> DataFrame:
    """Several lanes of statements merged into one row a statement, in order of the lanes."""
    out = None
    for lane, df in enumerate(rows):
        part = df.withColumn("_pos", F.struct(F.lit(lane).alias("lane"), F.col(ordinal).alias("pos")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return dedup.merge_statements(out.drop(ordinal).withColumnRenamed("_pos", ordinal), ordinal)


def compact(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The evidence projection: named columns that are there, in order."""
    return df.select(*[c for c in keep if c in df.columns])
