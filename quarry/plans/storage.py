"""Queries over sources and sinks: each writes in the run, reads again, and must give what it wrote."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarry.functions import lexer
from quarry.functions.expressions import canonical_json
from quarry.operators.lineage import scratch
from quarry.plans import builds
from quarry.plans.bindings import SPLIT_SQL, split_of, table
from quarry.plans.registry import registry
from quarry.sources import readers, schemas, sinks

QUERIES, ORACLES, query = registry()

_DOCS = "doc_id bigint, text string, lang string, split string"


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", split_of().alias("split"))


def _digest(df):
    return df.select("doc_id", "lang", "split", F.sha2("text", 256).alias("digest"))


_DIGEST_SQL = f"select doc_id, lang, {SPLIT_SQL} as split, sha256(text) as digest from documents"


@query(_DIGEST_SQL)
def jsonl_by_split(spark, d):
    """JSON lines by split, read with a declared schema."""
    folder = scratch(spark, "jsonl")
    sinks.jsonl_by_split(_documents(spark, d), folder)
    return _digest(readers.jsonl(spark, f"{folder}/*", _DOCS))


@query(_DIGEST_SQL)
def jsonl_gzip(spark, d):
    """Compressed JSON lines, known by their suffix."""
    folder = scratch(spark, "gzip")
    _documents(spark, d).write.option("compression", "gzip").json(folder)
    return _digest(readers.jsonl(spark, f"{folder}/*.gz", _DOCS))


@query(_DIGEST_SQL + " where doc_id % 3 <> 0")
def versioned_rows(spark, d):
    """I4: rows of one schema version."""
    folder = scratch(spark, "versions")
    rows = _documents(spark, d).where("doc_id % 3 <> 0").withColumn("schema_version", F.lit("v2"))
    rows.write.json(folder)
    return _digest(readers.versioned(readers.jsonl(spark, folder, _DOCS + ", schema_version string"), "v2"))


_V2_SQL = """select 's' || doc_id as statement_id, case when doc_id % 10 = 0 then 'test' else 'training' end as role, case when doc_id % 4 = 0 then 'synthetic' else 'real' end as provenance from documents"""


def _records_v2(spark, d):
    """Documents as corpus-v2 records that keep all invariants; the declaration's tokens are fixed but for the number."""
    docs = table(spark, d, "documents")
    key, synthetic = F.col("doc_id").cast("string"), F.col("doc_id") % 4 == 0
    declaration = F.concat(F.lit("theorem t"), key, F.lit(" : p"), key, F.lit(" = q"))
    variant = F.struct(F.concat(F.lit("v"), key).alias("proof_variant_id"), F.struct(F.lit("accepted").alias("status")).alias("verification"))
    rows = docs.select(
        F.lit("v2").alias("schema_version"), F.concat(F.lit("s"), key).alias("statement_id"), declaration.alias("canonical_declaration"), lexer.alpha_fingerprint_col(declaration).alias("normalized_statement_fingerprint"),
        F.when(F.col("doc_id") % 10 == 0, "test").otherwise("training").alias("role"), F.concat(F.lit("s"), key).alias("sampling_group_id"), F.when(synthetic, "synthetic").otherwise("real").alias("provenance"),
        F.array(variant).alias("proof_variants"), F.when(synthetic, F.concat(F.lit("d"), key)).alias("derivation_family_fingerprint"), F.when(synthetic, F.array(key)).alias("source_lemma_ids"),
    )
    return rows


@query(_V2_SQL)
def corpus_v2_scan(spark, d):
    """I4, V1, V3, V8: corpus-v2 rows, re-checked as they are read."""
    folder = scratch(spark, "corpus-v2")
    _records_v2(spark, d).write.json(folder)
    return builds.read_corpus_v2(spark, folder, "v2").select("statement_id", "role", "provenance")


@query("select 's' || doc_id as statement_id, ['v' || doc_id] as variant_ids from documents where doc_id % 10 <> 0")
def membership_views(spark, d):
    """An ids-only view, written, read and resolved against the records."""
    records = _records_v2(spark, d).where("role = 'training'")
    folder = scratch(spark, "view")
    sinks.membership_view(records, "w").write.json(folder)
    view = readers.jsonl(spark, folder, "view_id string, statement_id string, variant_ids array<string>, role string")
    return sinks.read_view(view, records, "training").select("statement_id", F.transform("proof_variants", lambda v: v["proof_variant_id"]).alias("variant_ids"))


@query("select s_suppkey as id, s_name as name, case when s_suppkey % 3 = 0 then 'train' when s_suppkey % 3 = 1 then 'validation' else 'heldout' end as split from supplier")
def frozen_snapshot(spark, d):
    """A byte-stable snapshot by split; written twice it has the same bytes, and it reads only as its manifest says."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, schemas.SPLITS)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("split"))
    folder, again = scratch(spark, "snapshot"), scratch(spark, "snapshot")
    manifest = sinks.snapshot(s, folder, "v1")
    if sinks.snapshot(s.repartition(5), again, "v1") != manifest:
        raise ValueError("snapshots of the same rows differ")
    return readers.frozen_snapshot(spark, folder, manifest["files"], "id bigint, name string, split string")


@query("select doc_id, 'lang=' || lang as corpus from documents")
def parent_keyed_scan(spark, d):
    """The folder's name as a column."""
    folder = scratch(spark, "corpora")
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").json(folder)
    return readers.parent_keyed(spark, f"{folder}/*/*.json", "doc_id bigint", "corpus")


@query("select n_nationkey, n_name, [n_regionkey, n_nationkey] as keys from nation")
def one_document_a_file(spark, d):
    """I8: one JSON document a file."""
    folder = scratch(spark, "documents")
    for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():  # 25 rows
        sinks.write_text(spark, f"{folder}/c{r.n_nationkey}/candidate.json", json.dumps({"n_nationkey": r.n_nationkey, "n_name": r.n_name, "keys": [r.n_regionkey, r.n_nationkey]}, indent=1))
    return readers.documents(spark, f"{folder}/*/candidate.json", "n_nationkey bigint, n_name string, keys array<bigint>")


@query("select p_name as value from part where p_partkey % 3 = 2 and p_name <> ''")
def manifest_scan(spark, d):
    """A plain-text manifest without its comments and blanks."""
    folder = scratch(spark, "manifest")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" # "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    table(spark, d, "part").select(line.alias("value")).write.text(folder)
    return readers.manifest_lines(spark, folder)


@query("select 'o' || l_orderkey as task_id, cast(l_linenumber as int) as candidate_index, case l_returnflag when 'R' then 'verified' else 'lean_rejected' end as category, 'm' as model from lineitem")
def run_artifacts(spark, d):
    """A run's document and results."""
    li = table(spark, d, "lineitem")
    results = li.select(F.concat(F.lit("o"), "l_orderkey").alias("task_id"), F.col("l_linenumber").cast("int").alias("candidate_index"), F.when(F.col("l_returnflag") == "R", "verified").otherwise("lean_rejected").alias("category"))
    folder = scratch(spark, "run")
    sinks.run_artifacts(spark.createDataFrame([("r", "v", "m", 4, None, None, None)], schemas.RUN), results, folder)
    run, read = readers.jsonl(spark, f"{folder}/run.json", schemas.RUN), readers.jsonl(spark, f"{folder}/results.jsonl", schemas.RESULT)
    return read.crossJoin(run.select("model")).select("task_id", "candidate_index", "category", "model")  # one run


@query("select 'task' as kind, 'r' || r_regionkey as id, r_name as name from region union all select 'candidate', 'n' || n_nationkey, n_name from nation")
def fixture_scan(spark, d):
    """A document of several arrays."""
    tasks = [{"id": f"r{r.r_regionkey}", "declaration": r.r_name} for r in table(spark, d, "region").collect()]
    candidates = [{"candidate_id": f"n{r.n_nationkey}", "candidate_text": r.n_name} for r in table(spark, d, "nation").collect()]
    path = f"{scratch(spark, 'fixture')}/fixture.json"
    sinks.write_text(spark, path, json.dumps({"tasks": tasks, "candidates": candidates}))
    f = readers.fixture_arrays(spark, path, {"tasks": schemas.TASK, "candidates": schemas.PROVIDED})
    return f["tasks"].select(F.lit("task").alias("kind"), "id", F.col("declaration").alias("name")).union(f["candidates"].select(F.lit("candidate"), "candidate_id", "candidate_text"))


@query("""with s as (select s_suppkey as k, s_suppkey % 4 = 0 as sorry, s_suppkey % 6 = 1 as bad from supplier)
  select 'k' || k as name, sha256('theorem _ : p' || (k % 5) || ' := by simp ') as fingerprint, k % 5 = 2 as overlaps from s where not sorry and not bad""")
def external_declarations(spark, d):
    """Declarations of external projects behind their gates."""
    key = F.col("s_suppkey")
    proof = F.when(key % 4 == 0, "sorry").otherwise("simp")
    text = F.concat(F.lit("theorem k"), key, F.lit(" : p"), key % 5, F.lit(" := by\n  "), proof, F.lit("\nend"))
    sources = table(spark, d, "supplier").select(F.lit("r").alias("repository"), F.concat(F.lit("f"), key).alias("file_path"), text.alias("value"), F.when(key % 6 == 1, "unknown").otherwise("mit").alias("licence"))
    known = spark.createDataFrame([(readers.text_sha256("theorem _ : p2 := by simp "),)], "fingerprint string")
    return readers.external_declarations(sources, known, r"k\d+", F.col("licence") == "mit", F.lit(True)).select("name", "fingerprint", "overlaps")


@query("""select 't' || s_suppkey as id, 'theorem t' || s_suppkey || ' : p' || (s_suppkey % 7) || ' = q' as declaration,
  sha256(replace('identifier:theorem_or_lemma identifier:__DECLARATION_NAME__ symbol:: identifier:p' || (s_suppkey % 7) || ' symbol:= identifier:q', ' ', chr(31))) as fingerprint from supplier""")
def benchmark_fingerprints(spark, d):
    """Tasks of benchmark sources and the fingerprints that a corpus excludes."""
    key = F.col("s_suppkey")
    sources = table(spark, d, "supplier").select(F.concat(F.lit("import X\n\ntheorem t"), key, F.lit(" : p"), key % 7, F.lit(" = q := by\n  sorry\n\ntheorem t"), key, F.lit(".variants.a : r := by\n  sorry\n")).alias("value"))
    return readers.benchmark_tasks(sources).select("id", "declaration", lexer.fingerprint_col(F.col("declaration")).alias("fingerprint"))


@query("select n_name || '.txt' as path, sha256(n_name || chr(10)) as sha256, cast(length(n_name) + 1 as bigint) as bytes from nation")
def tree_manifest(spark, d):
    """Digests of a tree, which must be as its manifest says."""
    folder = scratch(spark, "tree")
    for r in table(spark, d, "nation").select("n_name").collect():
        sinks.write_text(spark, f"{folder}/{r.n_name}.txt", r.n_name + "\n")
    found = sinks.tree_manifest(spark, folder)
    manifest = {r.path: {"sha256": r.sha256, "bytes": r.bytes} for r in found.collect()}
    sinks.require_tree(spark, folder, manifest)
    readers.require_digests(readers.digests(spark, folder), {k: v["sha256"] for k, v in manifest.items()})
    return found


@query("""select o_orderkey, '{"a":' || (o_orderkey % 5) || ',"b":null,"z":"' || o_orderstatus || '"}' as line from orders""")
def canonical_lines(spark, d):
    """Compact JSON with sorted keys and nulls."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("z"), (F.col("o_orderkey") % 5).alias("a"), F.lit(None).cast("string").alias("b"))
    return o.select("o_orderkey", canonical_json("z", "b", "a").alias("line"))


@query("""select '# Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |' || chr(10), '' order by r_regionkey) as report from region""")
def markdown_report(spark, d):
    """A small table as Markdown."""
    return spark.createDataFrame([(sinks.markdown(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions"),)], "report string")


@query("select cast((n_nationkey + 1) * 100 as int) as optimizer_step, n_regionkey / 4.0 as mean_target_token_cross_entropy from nation")
def step_scan(spark, d):
    """Steps parsed from file names, which must be whole and equal to the rows'."""
    folder = scratch(spark, "steps")
    for r in table(spark, d, "nation").collect():
        step = (r.n_nationkey + 1) * 100
        sinks.write_text(spark, f"{folder}/probe-step-{step}.json", json.dumps({"optimizer_step": step, "mean_target_token_cross_entropy": r.n_regionkey / 4}))
    return readers.step_files(spark, f"{folder}/*.json", schemas.PROBE).drop("file_step")


@query("select 'f' || p_partkey || x as want from (select p_partkey, unnest(['.trace', '.ast']) as x from part) where (x = '.trace' and p_partkey % 4 = 1) or (x = '.ast' and p_partkey % 6 = 1)")
def missing_siblings(spark, d):
    """Sources without one of their siblings."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("f"), "p_partkey").alias("f"))
    files = p.select(F.concat("f", F.lit(".lean")).alias("path")).union(p.where("p_partkey % 4 <> 1").select(F.concat("f", F.lit(".trace")))).union(p.where("p_partkey % 6 <> 1").select(F.concat("f", F.lit(".ast"))))
    return readers.missing_siblings(files, [".trace", ".ast"])


@query("select 't' || o_orderkey as task_id, 'c' as candidate_id, o_orderpriority as candidate_text, 'verified' as expected_category from orders")
def checked_stage(spark, d):
    """A stage's rows, written and checked before the next one reads them."""
    rows = table(spark, d, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("task_id"), F.lit("c").alias("candidate_id"), F.col("o_orderpriority").alias("candidate_text"), F.lit("verified").alias("expected_category"))
    return sinks.checked_stage(rows, scratch(spark, "stage"), schemas.PROVIDED, ["task_id"])
