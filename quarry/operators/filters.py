"""Reject cascades, decontamination, length filters, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import expressions as x
from quarry.functions import lexer


def cascade(df: DataFrame, rules: Sequence[tuple[str, Column]], reason: str = "filter_reason") -> DataFrame:
    """The first rule that holds names the reason; null: accepted."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(list(rules)):
        out = F.when(condition, name).otherwise(out)
    return df.withColumn(reason, out)


def reason_counts(df: DataFrame, reason: str = "filter_reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


RECORD_VERSION = "proof-corpus-v1"


def evaluate_raw(raw: DataFrame, repository: str, revision: str, scope: str = "Mathlib/", version: str = RECORD_VERSION) -> DataFrame:
    """Raw declarations with ``filter_reason`` and, where it is null, the record's derived columns.

    One CASE, tested in a fixed order; the lexer's three verdicts are computed
    in one Arrow pass each.
    """
    proof = F.regexp_replace(x.unix_lines("proof"), r"\s+\z", "")
    df = raw.withColumns({
        "_proof": proof, "_completion": x.completion_of(proof),
        "_private": lexer.column(lexer.declared_private, "boolean")(F.col("declaration")),
        "_placeholder": lexer.column(lexer.has_placeholder, "boolean")(proof),
        "_fingerprint": lexer.fingerprint_col(F.col("declaration")),
    })
    spans = x.valid_span("source_span") & x.valid_span("declaration_span") & x.valid_span("proof_span")
    by = F.col("_proof").rlike(r"\Aby(\s|\z)")
    df = cascade(df, [
        ("private", F.coalesce("is_private", F.lit(False))),
        ("unstable_name", (F.coalesce("declaration_name", F.lit("")) == "") | F.col("declaration_name").startswith("_private.")),
        ("unsupported_kind", ~F.coalesce(F.col("declaration_kind").isin("theorem", "lemma"), F.lit(False))),
        ("outside_source_scope", ~(F.col("file_path").startswith(scope) & F.col("file_path").endswith(".lean"))),
        ("ambiguous_source_span", ~spans),
        ("missing_declaration", F.col("declaration").isNull()),
        ("ambiguous_declaration", F.col("_private").isNull()),
        ("private", F.col("_private")),
        ("non_tactic_proof", F.col("proof").isNull()),
        ("non_by_proof", ~by),
        ("empty_completion", F.col("_completion").isNull()),
        ("proof_placeholder", F.coalesce("_placeholder", F.lit(False))),
        ("unsupported_proof_delimiter", ~F.col("declaration").rlike(r":=\s*\z")),
        ("ambiguous_declaration", F.col("_fingerprint").isNull()),
    ])
    accepted = F.col("filter_reason").isNull()
    return df.withColumns({
        "id": F.when(accepted, x.nul_sha(F.lit(version), F.lit(revision), "file_path", "declaration_name")),
        "source_repository": F.lit(repository), "source_revision": F.lit(revision),
        "statement_fingerprint": F.when(accepted, F.col("_fingerprint")), "completion": F.when(accepted, F.col("_completion")),
        "declaration": F.when(accepted, x.canonical_declaration("declaration")).otherwise(F.col("declaration")), "proof": F.when(accepted, F.col("_proof")).otherwise(F.col("proof")),
        "premises": x.sorted_distinct(F.filter(F.coalesce("premises", F.array().cast("array<string>")), lambda p: p != "")),
    }).drop("_proof", "_completion", "_private", "_placeholder", "_fingerprint")


def reslice(traced: DataFrame) -> DataFrame:
    """Corpus-v2 candidates: declaration and proof cut anew where the proof is ``where`` fields, ``:=`` or equations, with reasons."""
    split = lexer.column(_proof_form, "string")(F.col("source"))
    df = traced.withColumn("_form", F.from_json(split, "form string, declaration string, proof string"))
    df = df.withColumns({"declaration": F.col("_form.declaration"), "transformed": x.canonical_proof(F.col("_form.proof")), "form": F.col("_form.form")})
    return cascade(df, [
        ("private", F.coalesce("is_private", F.lit(False))), ("ambiguous_declaration", F.col("_form").isNull() | F.col("declaration").isNull()),
        ("missing_proof", F.col("transformed").isNull()),
        ("proof_placeholder", F.coalesce(lexer.column(lexer.has_placeholder, "boolean")(F.col("_form.proof")), F.lit(False))),
    ]).drop("_form")


def _proof_form(source: str) -> str:
    """JSON of (form, declaration, proof): the first top-level ``:=``, ``where`` or ``|`` after the name divides a declaration."""
    import json

    clean = lexer.strip_comments(source)
    tokens = lexer.lex(source)
    lexer.name_position(tokens)
    depth, at = 0, 0
    for kind, token in tokens:
        at = clean.index(token, at)
        if kind == "symbol" and token in lexer.CLOSERS:
            depth += 1
        elif kind == "symbol" and token in lexer.CLOSERS.values():
            depth -= 1
        elif not depth:
            if token == ":" and clean.startswith(":=", at):
                return json.dumps({"form": "term", "declaration": source[:at].rstrip(), "proof": source[at + 2 :].strip()})
            if (kind, token) == ("identifier", "where"):
                return json.dumps({"form": "where", "declaration": source[:at].rstrip(), "proof": source[at:].strip()})
            if token == "|":
                return json.dumps({"form": "equations", "declaration": source[:at].rstrip(), "proof": source[at:].strip()})
        at += len(token)
    raise lexer.LexError("no proof")


def partition_by_membership(df: DataFrame, reference: DataFrame, key: str, ref_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(retained, excluded): rows whose key the reference lacks, and has.  Null keys are retained."""
    ref = reference.select(F.col(ref_key or key).alias(key)).distinct()
    return df.join(ref, key, "left_anti"), df.join(ref, key, "left_semi")


def exclude_ambiguous(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(retained, excluded): every row of a repeated key is excluded."""
    # only the repeated keys travel to the rows; a hot one can be split on the rows' side
    repeated = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k")
    same = F.col(key).eqNullSafe(F.col("_k"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def clean_benchmark(bench: DataFrame, training: DataFrame, fingerprint: str, family: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, excluded with reason): items that share a statement, or a derivation family, with training."""
    kept, gone = partition_by_membership(bench, training, fingerprint)
    gone = gone.withColumn("reason", F.lit("statement-overlap"))
    if family:
        kept, more = partition_by_membership(kept, training.where(F.col(family).isNotNull()), family)
        gone = gone.unionByName(more.withColumn("reason", F.lit("family-overlap")))
    return kept, gone


def length_split(df: DataFrame, length: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(fitting, overlong), the bound included."""
    sized = df.withColumn("sequence_length", length)
    return sized.where(F.col("sequence_length") <= most), sized.where(F.col("sequence_length") > most)


def length_range(df: DataFrame, completion: Column, sequence: Column, low: int, high: int, most: int) -> DataFrame:
    return df.where(completion.between(low, high) & (sequence <= most))


def in_order(df: DataFrame, ids: Sequence[str] | None, key: str = "id", expected: int | None = None) -> DataFrame:
    """All rows, or those of an explicit id list in its order; unknown ids and a wrong count raise."""
    if ids is None:
        out = df
    else:
        spark = df.sparkSession
        wanted = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "pos int, wanted string")
        out = wanted.join(df, wanted["wanted"] == df[key], "left")
        missing = [r.wanted for r in out.where(F.col(key).isNull()).select("wanted").limit(5).collect()]
        if missing:
            raise ValueError(f"unknown ids: {missing}")
        out = out.orderBy("pos").drop("wanted")
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"expected {expected} rows, found {n}")
    return out


def seed_families(records: DataFrame, families: DataFrame) -> DataFrame:
    """Records matched by family: their path is listed and any pattern is found in their name.

    families: (family_id, paths array, patterns array).  The path is an equi-join key, so
    patterns are tried only within a family's files.
    """
    by_path = families.select("family_id", F.explode(F.array_distinct("paths")).alias("file_path"), F.coalesce("patterns", F.array(F.lit(".*"))).alias("patterns"))
    hit = F.exists("patterns", lambda p: F.regexp_like(F.col("declaration_name"), p))
    return records.join(by_path, "file_path").where(hit).drop("patterns")


def namespace_scopes(lines: DataFrame, file: str = "file_path", line: str = "line", text: str = "text") -> DataFrame:
    """Lines with the namespace prefix open before them: a stack over each file's lines, section and end included."""
    from pyspark.sql import types as T

    schema = T.StructType([*lines.schema.fields, T.StructField("namespace", T.StringType())])

    def scan(pdf):
        import re

        stack: list[tuple[str, str]] = []
        out = []
        pdf = pdf.sort_values(line, kind="stable")
        for value in pdf[text].fillna(""):
            out.append(".".join(n for kind, n in stack if kind == "namespace" and n))
            if m := re.match(r"\s*(namespace|section)\b\s*([^\s]*)", value):
                stack.append((m[1], m[2]))
            elif (m := re.match(r"\s*end\b\s*([^\s]*)", value)) and stack:
                stack.pop()
        return pdf.assign(namespace=out)

    return lines.groupBy(file).applyInPandas(scan, schema)


def repaired_names(declarations: DataFrame, scopes: DataFrame) -> DataFrame:
    """Local declaration names with the namespace of their line; absolute names (``_root_.``) lose the mark."""
    joined = declarations.join(scopes.select("file_path", "line", "namespace"), ["file_path", "line"], "left")
    name = F.col("declaration_name")
    full = F.when(name.startswith("_root_."), F.regexp_replace(name, r"^_root_\.", "")).when(F.coalesce("namespace", F.lit("")) == "", name).otherwise(F.concat_ws(".", "namespace", name))
    return joined.withColumn("full_name", full)


def token_lengths(df: DataFrame, count) -> DataFrame:
    """Five token counts; ``count`` maps a text column to its number of tokens (regex words by default)."""
    both = F.concat("declaration", F.lit(" := "), "proof")
    rest = F.concat("declaration", F.lit(" := by\n"), "completion")
    return df.withColumn("token_lengths", F.struct(*[
        count(c).cast("long").alias(n) for n, c in (("declaration", F.col("declaration")), ("proof", F.col("proof")), ("completion", F.col("completion")), ("declaration_and_proof", both), ("declaration_and_completion", rest))
    ]))


def regex_tokens(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]"), F.lit(0)))
