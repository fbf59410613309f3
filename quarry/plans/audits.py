"""Queries over the fail-closed checks: (check, violations), zeros included, over tables with planted faults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.functions import lexer
from quarry.operators import expectations, filters, graph
from quarry.plans import builds
from quarry.plans.bindings import SPLIT_SQL, split_of, table
from quarry.plans.registry import registry

QUERIES, ORACLES, query = registry()


def _counts(spark, run: Callable[[], object]) -> DataFrame:
    with expectations.counted() as found:
        run()
    return spark.createDataFrame([(k, int(n)) for k, n in found], "check string, violations bigint")


def _union(*parts: tuple[str, str]) -> str:
    return " union all ".join(f"select '{name}' as check, cast(({sql}) as bigint) as violations" for name, sql in parts)


_ROLE = "case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'validation' else 'training' end"
_CROSS = "select count(*) from (select {k} from r where {k} is not null group by {k} having min(role) < max(role))"


@query(f"with r as (select doc_id % 90 as statement_id, doc_id % 80 as derivation_family_fingerprint, 'v' || (doc_id % 70) as proof_variant_id, {_ROLE} as role from documents) " + _union(
    ("statement_id->role", _CROSS.format(k="statement_id")), ("derivation_family_fingerprint->role", _CROSS.format(k="derivation_family_fingerprint")), ("proof_variant_id->role", _CROSS.format(k="proof_variant_id"))))
def role_isolation(spark, d):
    """V3."""
    role = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("training")
    rows = table(spark, d, "documents").select(
        (F.col("doc_id") % 90).alias("statement_id"), (F.col("doc_id") % 80).alias("derivation_family_fingerprint"), role.alias("role"),
        F.array(F.struct(F.concat(F.lit("v"), F.col("doc_id") % 70).alias("proof_variant_id"))).alias("proof_variants"),
    )
    return _counts(spark, lambda: expectations.role_isolation(rows))


@query("select 'import contexts' as check, count(*) as violations from documents where doc_id % 2 = 0 and (doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0) and not (doc_id % 5 = 0 and doc_id % 3 <> 0 and doc_id % 7 <> 0 and doc_id % 10 = 0)")
def import_contexts(spark, d):
    """V4: synthetic rows without imports, special rows with others, ordinary rows with foreign ones."""
    k = F.col("doc_id")
    imports = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.lit("Other.A"))).when(k % 10 == 0, F.array(F.lit("Special"))).otherwise(F.array(F.lit("Base.A"), F.lit("Base.B")))
    rows = table(spark, d, "documents").select(F.when(k % 2 == 0, "synthetic").otherwise("real").alias("provenance"), F.when(k % 5 == 0, F.array(F.lit("special"))).otherwise(F.array().cast("array<string>")).alias("topic_tags"), imports.alias("imports"))
    return _counts(spark, lambda: expectations.import_contexts(rows, "special", ["Special"], "Base."))


@query(f"with r as (select {SPLIT_SQL} as split, doc_id from documents) " + _union(
    ("rows of heldout", "select abs(count(*) - 5) from r where split = 'heldout'"), ("rows of train", "select count(*) from r where split = 'train'"), ("rows of validation", "select count(*) from r where split = 'validation'"),
    ("schema versions", "select count(*) from r where doc_id % 9 = 0"), ("ids", "select count(*) from (select doc_id // 2 from r group by 1 having count(*) > 1)")))
def loader_consistency(spark, d):
    """V5: counts by split, versions and ids of what was loaded."""
    rows = table(spark, d, "documents").select(split_of().alias("split"), F.when(F.col("doc_id") % 9 == 0, "old").otherwise("v").alias("schema_version"), F.floor(F.col("doc_id") / 2).alias("id"))
    return _counts(spark, lambda: expectations.loaded(rows, {"heldout": 5}, "v"))


@query("with e as (select o_orderkey as k, o_orderkey % 4 as q from orders) " + _union(
    ("coverage ids", "select 0"), ("unknown dispositions", "select count(*) from e where q = 3"), ("included without statements", "select count(*) from e where q = 0 and k % 8 = 0"),
    ("included outside training", "select count(*) from e where q = 0 and k % 8 <> 0 and k % 3 = 0"), ("eligible entries left out", "select count(*) from e where q <> 0 and k % 5 = 0")))
def prime_coverage(spark, d):
    """V6."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    disposition = F.element_at(F.array(*map(F.lit, ("included", "excluded", "pending", "other"))), (k % 4 + 1).cast("int"))
    ok = (k % 5 == 0)
    entries = o.select(k.alias("coverage_id"), disposition.alias("disposition"), F.when(k % 8 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k)).alias("statement_ids"), ok.alias("verified_lean"), ok.alias("legally_usable"), ok.alias("target_compatible"))
    training = o.where("o_orderkey % 3 <> 0").select(k.alias("statement_id"))
    return _counts(spark, lambda: expectations.prime_coverage(entries, training, ["included", "excluded", "pending"], "included"))


@query(_union(("dispositions", "select count(*) from orders where o_orderkey % 6 = 1"), ("sources without disposition", "select count(*) from orders where o_orderkey % 6 = 0"), ("transient dispositions", "select count(*) from orders where o_orderkey % 6 = 2")))
def dispositions_complete(spark, d):
    """V7."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    one = o.where("k % 6 <> 0").select("k", F.when(F.col("k") % 6 == 2, "retry").otherwise("done").alias("disposition"))
    return _counts(spark, lambda: expectations.dispositions_complete(o, one.union(one.where("k % 6 = 1")), ["k"], ["retry"]))


@query("select 'record invariants' as check, count(*) as violations from orders where o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 13 = 0")
def record_invariants(spark, d):
    """V8."""
    k = F.col("o_orderkey")
    variant = lambda name, status: F.struct(name.alias("proof_variant_id"), F.struct(status.alias("status")).alias("verification"))
    status = F.when(k % 5 == 0, "rejected").otherwise("accepted")
    variants = F.array(variant(F.lit("a"), status), variant(F.when(k % 7 == 0, "a").otherwise("b"), F.lit("accepted")))
    rows = table(spark, d, "orders").select(
        k.alias("statement_id"), F.when(k % 11 == 0, F.lit(-1)).otherwise(k).alias("sampling_group_id"), F.when(k % 2 == 0, "synthetic").otherwise("real").alias("provenance"), variants.alias("proof_variants"),
        F.when((k % 2 == 0) != (k % 13 == 0), F.lit("d")).alias("derivation_family_fingerprint"), F.array(F.lit("l")).alias("source_lemma_ids"),
    )
    return _counts(spark, lambda: expectations.v2_invariants(rows))


@query("select o_orderkey, case o_orderkey % 5 when 0 then 'declaration start' when 1 then 'fingerprint' when 2 then 'name' when 3 then 'proof' end as mismatch from orders")
def source_identity(spark, d):
    """How records differ from their source text."""
    k = F.col("o_orderkey")
    at = lambda line, column: F.struct(F.lit(line).alias("line"), column.alias("column"))
    head = F.concat(F.lit("theorem t"), k, F.lit(" : p = q"))
    end, begin = F.char_length(head) + 1, F.when(k % 5 == 0, F.lit(2)).otherwise(F.lit(1))
    total = F.char_length(head) + F.lit(len(" := by simp")) + 1
    rows = table(spark, d, "orders").select(
        k, F.concat(F.lit("-- file\n"), head, F.lit(" := by simp\n")).alias("source_text"), F.struct(at(2, F.lit(1)).alias("start"), at(2, total).alias("end")).alias("source_span"),
        F.struct(at(2, begin).alias("start"), at(2, end).alias("end")).alias("declaration_span"), F.struct(at(2, end).alias("start"), at(2, total).alias("end")).alias("proof_span"),
        F.when(k % 5 == 1, "no").otherwise(lexer.fingerprint_col(head)).alias("statement_fingerprint"), F.concat(F.when(k % 5 == 2, "N.u").otherwise("N.t"), k).alias("declaration_name"),
        F.when(k % 5 == 3, " := by rfl").otherwise(" := by  simp -- same").alias("proof"),
    )
    return expectations.source_text(rows).select("o_orderkey", "mismatch")


@query(_union(("summary n", "select 0"), ("summary total", "select 1")))
def stored_summaries(spark, d):
    """Stored and recomputed summaries."""
    stored = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))
    return _counts(spark, lambda: expectations.same_summary(stored, stored.withColumn("total", F.col("total") + 1), ["n", "total"]))


@query("select l_orderkey as plan_id, l_orderkey % 3 <> 0 as arity_ok, l_orderkey % 5 <> 0 as connected, l_orderkey % 7 = 0 as unused, l_orderkey % 3 <> 0 and l_orderkey % 5 <> 0 and l_orderkey % 7 <> 0 as ok from (select distinct l_orderkey from lineitem)")
def composition_audit(spark, d):
    """Dependencies planned and unused, arity, connection of members."""
    from quarry.operators import composition

    k = F.col("l_orderkey")
    strings = lambda *v: F.array(*map(F.lit, v))
    edge = lambda a, b: F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"))
    plans = table(spark, d, "lineitem").select("l_orderkey").distinct().select(
        k.alias("plan_id"), F.when(k % 3 == 0, "deep").otherwise("branching").alias("structural_class"), F.when(k % 7 == 0, strings("a", "z")).otherwise(strings("a", "b")).alias("planned"), strings("a", "b", "c").alias("actual"),
        strings("a", "b", "c").alias("members"), F.when(k % 5 == 0, F.array(edge("a", "b"))).otherwise(F.array(edge("b", "c"), edge("a", "b"))).alias("edges"),
    )
    return composition.audit(plans).select("plan_id", "arity_ok", "connected", (F.size("unused") > 0).alias("unused"), "ok")


@query("with n as (select n_nationkey as k from nation) " + _union(
    ("atlas ids", "select 0"), ("unknown statuses", "select count(*) from n where k % 4 = 3"), ("directed relationships without attribution", "select count(*) from n where k % 5 = 1"), ("unknown sources", "select count(*) from n where k % 6 = 2"),
    ("unknown edge types", "select count(*) from n where k % 3 = 2"), ("edge sources without entry", "select 0"), ("edge targets without entry", "select count(*) from n where k = 24"),
    ("directed edges without attribution", "select count(*) from n where k % 3 = 0 and k % 2 = 0"), ("counterparts of what only the literature has", "select count(*) from n where k % 3 = 1 and k < 24 and (k + 1) % 4 = 2")))
def atlas_checks(spark, d):
    """V14."""
    k = F.col("n_nationkey")
    n, none = table(spark, d, "nation"), F.array().cast("array<string>")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    entries = n.select(
        k.alias("id"), pick(k % 4, "mathlib", "other-prover", "literature-only", "partial").alias("formalization_status"), F.array(F.when(k % 6 == 2, "gone").otherwise("src")).alias("source_ids"),
        F.when(k % 5 < 2, "implies-RH").otherwise("prerequisite").alias("relationship_class"), F.when(k % 5 == 0, F.array(F.lit("src"))).otherwise(none).alias("relationship_sources"),
    )
    edges = n.select(k.alias("source"), (k + 1).alias("target"), pick(k % 3, "implies", graph.COUNTERPART, "proves").alias("type"), F.when(k % 2 == 0, none).otherwise(F.array(F.lit("src"))).alias("source_ids"))
    return _counts(spark, lambda: expectations.atlas(entries, edges, spark.createDataFrame([("src",)], "id string")))


@query("select doc_id as statement_id, case when n_chars <= 500 then 'fits' else 'long-context' end as context_status from documents where doc_id % 3 = 0")
def training_plan(spark, d):
    """Each training statement once, long ones labelled."""
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("statement_id"), F.col("doc_id").alias("sampling_group_id"), F.when(F.col("doc_id") % 3 == 0, "training").otherwise("test").alias("role"),
        F.array(F.struct(F.col("doc_id").alias("proof_variant_id"))).alias("proof_variants"), F.struct(F.col("n_chars").alias("utf8_bytes")).alias("length"),
    )
    return expectations.training_plan(rows, 500).select("statement_id", "context_status")


@query(_union(("enough", "select case when count(*) > 0 then 0 else 1 end from orders"), ("even", "select 1"), ("known", "select 1")))
def named_gates(spark, d):
    """False and null gates."""
    row = table(spark, d, "orders").agg((F.count(F.lit(1)) > 0).alias("enough"), (F.count(F.lit(1)) < 0).alias("even"), F.lit(None).cast("boolean").alias("known"))
    return _counts(spark, lambda: expectations.gates(row, ["enough", "even", "known"]))


@query("select 'stored artefacts can''t be resumed' as check, count(*) as violations from documents where doc_id % 5 = 0 or doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 13 = 0")
def resume_guard(spark, d):
    """Artefacts of another contract, rejected ones, repaired ones, and those whose text changed."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        F.when(k % 5 == 0, "other").otherwise("m").alias("model"), (k % 7 != 0).alias("accepted"), F.col("text").alias("raw_text"), F.when(k % 11 == 0, "0").otherwise(F.sha2("text", 256)).alias("raw_sha256"),
        F.when(k % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("candidate_text"),
    )
    return _counts(spark, lambda: expectations.resumable(rows, {"model": "m"}))


@query(_union(
    ("view outside the corpus", "select count(*) from documents where doc_id % 4 = 0 and doc_id % 12 <> 0"), ("a|b", "select count(*) from documents where doc_id % 6 = 0"), ("a|c", "select count(*) from documents where doc_id % 2 = 0 and doc_id % 5 = 1"),
    ("b|c", "select count(*) from documents where doc_id % 3 = 0 and doc_id % 5 = 1"), ("rows beyond the parts", "select abs(count(*) - count(*) filter (where doc_id % 2 = 0) - count(*) filter (where doc_id % 3 = 0)) from documents")))
def set_checks(spark, d):
    """Subsets, disjoint workloads and parts that must add up."""
    docs = table(spark, d, "documents").select("doc_id")
    a, b, c = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), docs.where("doc_id % 5 = 1")

    def run():
        expectations.subset(docs.where("doc_id % 4 = 0"), b, "doc_id", "view outside the corpus")
        expectations.disjoint({"a": a, "b": b, "c": c}, "doc_id")
        expectations.partition_accounts(docs, [a, b])

    return _counts(spark, run)


@query("""select o_orderkey, o_orderkey % 4 in (0, 3) as valid from orders""")
def span_validity(spark, d):
    """F16: positions from 1, the end after the start."""
    k = F.col("o_orderkey")
    at = lambda line, column: F.struct(line.alias("line"), column.alias("column"))
    end = F.when(k % 4 == 0, at(F.lit(2), F.lit(1))).when(k % 4 == 1, at(F.lit(1), F.lit(5))).when(k % 4 == 2, at(F.lit(1), F.lit(0))).otherwise(at(F.lit(1), F.lit(9)))
    return table(spark, d, "orders").select(k, F.struct(at(F.lit(1), F.lit(5)).alias("start"), end.alias("end")).alias("s")).select("o_orderkey", x.valid_span("s").alias("valid"))


_LINES = ["namespace A{k}", "theorem x", "namespace B.C", "theorem y", "section", "end", "end B.C", "theorem z", "end A{k}", "theorem w"]


@query("""select 'f' || s_suppkey as file_path, cast(line as int) as line, case line when 1 then 'A' || s_suppkey when 3 then 'A' || s_suppkey || '.B.C' when 7 then 'A' || s_suppkey else '' end as namespace
  from supplier, unnest([1, 3, 7, 9]) t(line)""")
def namespace_scopes(spark, d):
    """The namespace in force at each declaration."""
    text = F.array(*[F.replace(F.lit(t), F.lit("{k}"), F.col("s_suppkey").cast("string")) for t in _LINES])
    lines = table(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("file_path"), F.posexplode(text).alias("line", "text"))
    return filters.namespace_scopes(lines).join(lines.where("text like 'theorem%'").select("file_path", "line"), ["file_path", "line"]).select("file_path", "line", "namespace")


@query("select doc_id, lang from documents")
def compact_evidence(spark, d):
    """named columns that are there."""
    return builds.compact(table(spark, d, "documents"), ["doc_id", "absent", "lang"])


_HEAD = "identifier:theorem_or_lemma identifier:__DECLARATION_NAME__ "
#: Declarations, their tokens, their tokens with bound names numbered, the class of their type, and whether they hold a placeholder.
_FIXTURES = [
    ("theorem a (x : Nat) : x = x := ", "symbol:( identifier:x symbol:: identifier:Nat symbol:) symbol:: identifier:x symbol:= identifier:x", "symbol:( identifier:__BOUND_0__ symbol:: identifier:Nat symbol:) symbol:: identifier:__BOUND_0__ symbol:= identifier:__BOUND_0__", "equality", False),
    ("lemma b.{u} : p ∧ q /- c -/ -- d", "symbol:. symbol:{ identifier:u symbol:} symbol:: identifier:p symbol:∧ identifier:q", "symbol:. symbol:{ identifier:__UNIVERSE_0__ symbol:} symbol:: identifier:p symbol:∧ identifier:q", "and", False),
    ("theorem c : ∀ x, x ↔ y", "symbol:: symbol:∀ identifier:x symbol:, identifier:x symbol:↔ identifier:y", "symbol:: symbol:∀ identifier:__BOUND_0__ symbol:, identifier:__BOUND_0__ symbol:↔ identifier:y", "iff", False),
    ("theorem d : (fun x => x) sorry → r", "symbol:: symbol:( identifier:fun identifier:x symbol:= symbol:> identifier:x symbol:) identifier:sorry symbol:→ identifier:r", "symbol:: symbol:( identifier:fun identifier:__BOUND_0__ symbol:= symbol:> identifier:__BOUND_0__ symbol:) identifier:sorry symbol:→ identifier:r", "implication", True),
]


@query("select s_suppkey, f.* exclude (k) from supplier join (values " + ", ".join(
    f"({i}, sha256(replace('{_HEAD + plain}', ' ', chr(31))), sha256(replace('{_HEAD + bound}', ' ', chr(31))), '{head}', {str(gap).lower()})" for i, (_, plain, bound, head, gap) in enumerate(_FIXTURES)
) + ") f(k, fingerprint, alpha_fingerprint, head, placeholder) on s_suppkey % 4 = k")
def lexer_fixtures(spark, d):
    """A declaration for each supplier, under its own name, against tokens written by hand."""
    fixture = F.element_at(F.array(*[F.lit(f[0]) for f in _FIXTURES]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit(r"$1 s"), F.col("s_suppkey").cast("string"), F.lit("."), F.lower(F.regexp_replace("s_name", "[^A-Za-z]", "")))
    df = table(spark, d, "supplier").select("s_suppkey", F.regexp_replace(fixture, F.lit(r"^(theorem|lemma) \w"), name).alias("declaration"))
    c = F.col("declaration")
    return df.select("s_suppkey", lexer.fingerprint_col(c).alias("fingerprint"), lexer.alpha_fingerprint_col(c).alias("alpha_fingerprint"), lexer.column(lexer.type_head)(c).alias("head"), lexer.column(lexer.has_placeholder, "boolean")(c).alias("placeholder"))
