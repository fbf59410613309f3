"""Checks that fail closed: each raises ``Violation`` instead of filtering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.functions import lexer
from quarry.operators import graph


class Violation(ValueError):
    pass


_COUNTED: ContextVar[list[tuple[str, int]] | None] = ContextVar("counted", default=None)


@contextmanager
def counted() -> Iterator[list[tuple[str, int]]]:
    """Within it the checks raise nothing: each adds (check, violations) to the list, zeros included."""
    found: list[tuple[str, int]] = []
    token = _COUNTED.set(found)
    try:
        yield found
    finally:
        _COUNTED.reset(token)


def report(found: dict[str, int], what: str) -> None:
    """Counts that must all be zero."""
    if (held := _COUNTED.get()) is not None:
        held.extend(found.items())
    elif any(found.values()):
        raise Violation(f"{what}: {found}")


def none(df: DataFrame, condition: Column, what: str) -> None:
    """No row may meet the condition."""
    bad = df.where(condition)
    if _COUNTED.get() is not None or bad.limit(1).count():
        report({what: bad.count()}, "rows")


def unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    report({what: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").count()}, "repeated keys")


def crossing(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each (key, value), the number of keys with more than one value."""
    out = None
    for k, v in pairs:
        part = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).agg(F.count_if(F.col("lo") < F.col("hi")).alias("n")).select(F.lit(f"{k}->{v}").alias("check"), "n")
        out = part if out is None else out.union(part)
    return out


HYGIENE = (("file_path", "split"), ("file_path", "component_id"), ("component_id", "split"), ("statement_fingerprint", "split"), ("statement_fingerprint", "component_id"))


def split_hygiene(records: DataFrame) -> dict[str, int]:
    """Five checks that a key has one value; any crossing raises with all counts."""
    none(records, ~F.col("file_group").eqNullSafe(F.col("file_path")), "records outside their file's group")
    found = {r.check: r.n for r in crossing(records, HYGIENE).collect()}
    report(found, "split hygiene")
    return found


def role_isolation(records: DataFrame) -> dict[str, int]:
    """Statements, derivation families and proofs may have one role each."""
    proofs = records.select("role", F.explode("proof_variants").alias("v")).select("role", F.col("v.proof_variant_id").alias("proof_variant_id"))
    found = {r.check: r.n for r in crossing(records, [("statement_id", "role"), ("derivation_family_fingerprint", "role")]).union(crossing(proofs, [("proof_variant_id", "role")])).collect()}
    report(found, "role leakage")
    return found


def identities(records: DataFrame, version: str, alpha: bool = False) -> None:
    """Stored fingerprints and ids must equal those computed anew."""
    again = lexer.alpha_fingerprint_col(F.col("declaration")) if alpha else lexer.fingerprint_col(F.col("declaration"))
    df = records.withColumn("_fp", again)
    none(df, ~F.col("_fp").eqNullSafe(F.col("statement_fingerprint")), "fingerprints differ")
    none(df, ~F.col("id").eqNullSafe(x.nul_sha(F.lit(version), "source_revision", "file_path", "declaration_name")), "ids differ")


def import_contexts(records: DataFrame, special_tag: str, special_imports: Sequence[str], prefix: str) -> None:
    """Synthetic rows need imports; those with the special tag exactly its imports, others only modules of the prefix."""
    special = F.array_contains("topic_tags", special_tag)
    wanted = F.array(*map(F.lit, special_imports))
    bad = (F.size("imports") == 0) | (special & (F.col("imports") != wanted)) | (~special & ~F.forall("imports", lambda m: m.startswith(prefix)))
    none(records.where("provenance = 'synthetic'"), F.coalesce(bad, F.lit(True)), "import contexts")


def loaded(df: DataFrame, counts: dict[str, int], version: str) -> None:
    """Counts by split, the schema version, and ids that are unique over all splits."""
    got = {r.split: r.n for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    report({f"rows of {k}": abs(got.get(k, 0) - counts.get(k, 0)) for k in sorted(got.keys() | counts.keys(), key=str)}, "rows by split")
    none(df, ~F.col("schema_version").eqNullSafe(F.lit(version)), "schema versions")
    unique(df, ["id"], "ids")


def prime_coverage(entries: DataFrame, training: DataFrame, known: Sequence[str], included: str) -> DataFrame:
    """Unique entries, known dispositions, included ones resolve to training, eligible ones are not left out; gives counts."""
    unique(entries, ["coverage_id"], "coverage ids")
    none(entries, ~F.coalesce(F.col("disposition").isin(*known), F.lit(False)), "unknown dispositions")
    inc = entries.where(F.col("disposition") == included)
    none(inc, F.coalesce(F.size("statement_ids"), F.lit(0)) <= 0, "included without statements")
    refs = inc.select("coverage_id", F.explode("statement_ids").alias("statement_id"))
    none(refs.join(training.select("statement_id").distinct(), "statement_id", "left_anti"), F.lit(True), "included outside training")
    eligible = F.coalesce(F.col("verified_lean") & F.col("legally_usable") & F.col("target_compatible"), F.lit(False))
    none(entries, (F.col("disposition") != included) & eligible, "eligible entries left out")
    return entries.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def dispositions_complete(sources: DataFrame, dispositions: DataFrame, keys: Sequence[str], transient: Sequence[str]) -> None:
    """Each source row has exactly one disposition; transient ones are fatal."""
    unique(dispositions, keys, "dispositions")
    none(sources.join(dispositions.select(*keys), list(keys), "left_anti"), F.lit(True), "sources without disposition")
    none(dispositions, F.col("disposition").isin(*transient), "transient dispositions")


def v2_invariants(records: DataFrame) -> None:
    """Variant ids unique and accepted, sampling group is the statement, synthetic rows and only they carry derivations."""
    variants = F.col("proof_variants")
    ids = F.transform(variants, lambda v: v["proof_variant_id"])
    derived = F.col("derivation_family_fingerprint").isNotNull() & (F.size(F.coalesce("source_lemma_ids", F.array().cast("array<string>"))) > 0)
    bad = (
        (F.size(variants) < 1) | (F.size(F.array_distinct(ids)) != F.size(ids)) | F.exists(variants, lambda v: v["verification"]["status"] != "accepted")
        | (F.col("sampling_group_id") != F.col("statement_id")) | ((F.col("provenance") == "synthetic") != derived)
    )
    none(records, F.coalesce(bad, F.lit(True)), "record invariants")


def source_text(records: DataFrame, source: str = "source_text") -> DataFrame:
    """Rows with the first way in which a record differs from its source text; null: it agrees."""
    decl, proof = x.source_slice(source, F.col("declaration_span")), x.source_slice(source, F.col("proof_span"))
    ident = F.regexp_replace(F.regexp_replace(lexer.column(lexer.declaration_name)(decl), "^«|»$", ""), r"^_root_\.", "")
    full = F.regexp_replace("declaration_name", r"^_root_\.", "")
    code = lexer.column(lexer.normalized_code)
    s, d, p = F.col("source_span"), F.col("declaration_span"), F.col("proof_span")
    why = (
        F.when(d["start"] != s["start"], "declaration start").when(d["end"] != p["start"], "declaration end").when(~((s["start"] <= p["start"]) & (p["end"] <= s["end"])), "proof outside")
        .when(~lexer.fingerprint_col(decl).eqNullSafe(F.col("statement_fingerprint")), "fingerprint").when(~((full == ident) | full.endswith(F.concat(F.lit("."), ident))), "name").when(~code(proof).eqNullSafe(code(F.col("proof"))), "proof")
    )
    return records.withColumn("mismatch", why)


def same_summary(stored: DataFrame, recomputed: DataFrame, columns: Sequence[str]) -> None:
    from quarry.operators.joins import contract_differences

    diff = contract_differences(stored, recomputed, columns)
    report({f"summary {c}": int(c in diff) for c in columns}, "stored and recomputed summaries differ")


def atlas(entries: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> None:
    """Ids, statuses, attributions, edge types and ends of an atlas.

    entries: (id, formalization_status, source_ids, and relationship_class with relationship_sources where there are any); edges: (source, target, type, source_ids); sources: (id).
    """
    unique(entries, ["id"], "atlas ids")
    listed = lambda c: F.coalesce(F.size(c), F.lit(0))
    none(entries, ~F.coalesce(F.col("formalization_status").isin(*graph.STATUSES), F.lit(False)), "unknown statuses")
    if "relationship_class" in entries.columns:
        none(entries, F.col("relationship_class").isin("equivalent-to-RH", "RH-implies", "implies-RH") & (listed("relationship_sources") <= 0), "directed relationships without attribution")
    if sources is not None:
        none(entries.select("id", F.explode("source_ids").alias("source")).join(sources.select(F.col("id").alias("source")), "source", "left_anti"), F.lit(True), "unknown sources")
    none(edges, ~F.coalesce(F.col("type").isin(*graph.EDGE_TYPES), F.lit(False)), "unknown edge types")
    for end in ("source", "target"):
        none(edges.join(entries.select(F.col("id").alias(end)), end, "left_anti"), F.lit(True), f"edge {end}s without entry")
    none(edges, F.col("type").isin(*graph.ATTRIBUTED_EDGES) & (listed("source_ids") <= 0), "directed edges without attribution")
    status = entries.select(F.col("id").alias("target"), "formalization_status")
    none(edges.join(status, "target"), (F.col("type") == graph.COUNTERPART) & (F.col("formalization_status") == "literature-only"), "counterparts of what only the literature has")


def training_plan(records: DataFrame, most_bytes: int | None, strict: bool = False) -> DataFrame:
    """Each training statement once with its context status; strict: long ones raise rather than being cut."""
    out = records.where("role = 'training'").select("statement_id", "sampling_group_id", F.transform("proof_variants", lambda v: v["proof_variant_id"]).alias("variant_ids"), F.col("length.utf8_bytes").alias("utf8_bytes"))
    fits = F.lit(True) if most_bytes is None else F.col("utf8_bytes") <= most_bytes
    out = out.withColumn("context_status", F.when(fits, "fits").otherwise("long-context"))
    unique(out, ["statement_id"], "planned statements")
    if strict:
        none(out, F.col("context_status") != "fits", "statements beyond the context")
    return out.orderBy("statement_id")


def gates(row: DataFrame, names: Sequence[str]) -> None:
    """A one-row frame of named conditions; every false or null one is reported."""
    r = row.select(*names).collect()
    if len(r) != 1:
        raise Violation(f"gates need one row, found {len(r)}")
    report({n: int(not r[0][n]) for n in names}, "gates failed")


def resumable(stored: DataFrame, contract: dict[str, object], raw: str = "raw_text", digest: str = "raw_sha256") -> None:
    """Stored artefacts match every contract key, were accepted, and still have their raw text unrepaired."""
    bad = F.lit(False)
    for k, v in contract.items():
        bad = bad | ~F.col(k).eqNullSafe(F.lit(v))
    bad = bad | ~F.coalesce("accepted", F.lit(False)) | ~F.sha2(raw, 256).eqNullSafe(F.col(digest)) | ~F.col("candidate_text").eqNullSafe(F.col(raw))
    none(stored, bad, "stored artefacts can't be resumed")


def subset(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    none(a.select(key).join(b.select(key).distinct(), key, "left_anti"), F.lit(True), what)


def disjoint(sets: dict[str, DataFrame], key: str) -> dict[str, int]:
    """Pairwise intersections of workloads must be empty."""
    names = sorted(sets)
    found = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            found[f"{a}|{b}"] = sets[a].select(key).join(sets[b].select(key).distinct(), key, "left_semi").count()
    report(found, "workloads overlap")
    return found


def partition_accounts(whole: DataFrame, parts: Sequence[DataFrame]) -> None:
    report({"rows beyond the parts": abs(whole.count() - sum(p.count() for p in parts))}, "parts do not add up")
