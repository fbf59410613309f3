"""Duplicates, merging of statements, ordered digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import expressions as x


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str], payload: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key in an explicit order; with a payload, unequal duplicates raise."""
    if payload is not None:
        conflicts = df.groupBy(*key).agg(F.count_distinct(F.struct(*payload)).alias("n")).where("n > 1").count()
        if conflicts:
            raise ValueError(f"{conflicts} keys have unequal rows")
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def distinct_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct rows, one row with the number of duplicates)."""
    d = df.distinct()
    return d, df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(d.agg(F.count(F.lit(1)).alias("distinct_rows"))).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def merge_statements(df: DataFrame, ordinal: str = "pos") -> DataFrame:
    """One row a statement.

    df: statement_id, pos, role, environment_id, provenance, declaration, tags, memberships, variants
    array<struct<fingerprint,variant_id,proof>>.  The first variant of a fingerprint wins, in input order;
    variants are sorted by id; the longest by UTF-8 bytes (the first on ties) gives the lengths; tags and
    memberships are united; several provenances become ``mixed-real``.  A statement over two roles,
    environments, or the real and synthetic lanes raises.
    """
    bad = df.groupBy("statement_id").agg(
        F.count_distinct("role").alias("roles"), F.count_distinct("environment_id").alias("environments"), F.count_distinct("provenance").alias("lanes"), F.max(F.col("provenance") == "synthetic").alias("synthetic")
    ).where("roles > 1 or environments > 1 or (synthetic and lanes > 1)")
    if (n := bad.limit(5).count()):
        raise ValueError(f"{n} or more statements cross roles, environments or lanes")
    variants = df.select("statement_id", ordinal, F.posexplode("variants").alias("vpos", "v"))
    first = F.row_number().over(Window.partitionBy("statement_id", "v.fingerprint").orderBy(ordinal, "vpos"))
    kept = variants.withColumn("_rn", first).where("_rn = 1").groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("v.variant_id", "v.fingerprint", "v.proof"))).alias("variants"))
    head = df.groupBy("statement_id").agg(
        F.min_by("declaration", ordinal).alias("declaration"), F.min_by("role", ordinal).alias("role"), F.min_by("provenance", ordinal).alias("_p"), F.count_distinct("provenance").alias("_np"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("memberships")))).alias("memberships"),
    )
    out = head.join(kept, "statement_id").withColumn("provenance", F.when(F.col("_np") > 1, "mixed-real").otherwise(F.col("_p")))
    best = F.aggregate("variants", F.lit(None).cast("struct<variant_id:string,fingerprint:string,proof:string>"), lambda acc, v: F.when(acc.isNull() | (F.octet_length(v["proof"]) > F.octet_length(acc["proof"])), v).otherwise(acc))
    out = out.withColumn("_best", best).withColumns({
        "declaration_chars": F.char_length("declaration"), "proof_chars": F.char_length("_best.proof"), "utf8_bytes": F.octet_length(F.concat("declaration", F.lit(" := "), "_best.proof")),
    })
    return out.drop("_p", "_np", "_best")


def ordered_digest(df: DataFrame, value: str, order: Sequence[str], terminator: str = x.NUL, group: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over values in order, each followed by the terminator.

    The digest is over one text, so a group's values (ids) meet in one row: bounded by the 2 GB of a row.
    """
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    text = F.array_join(F.transform(held, lambda s: F.concat(s["_value"], F.lit(terminator))), "")
    return df.groupBy(*group).agg(F.sha2(text, 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def variant_choice(variants: DataFrame, seed: str) -> DataFrame:
    """One variant a statement: the least SHA-256 of (seed, statement, variant)."""
    h = x.nul_sha(F.lit(seed), "statement_id", "variant_id")
    return variants.groupBy("statement_id").agg(F.min_by("variant_id", F.struct(h, F.col("variant_id"))).alias("variant_id"))


def family_fingerprint(lemmas, dag, family, version: str = "derivation-family-v1"):
    """Fingerprint of a derivation family: version, family, template and the sorted, trimmed, distinct lemmas."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(lemmas, lambda s: F.trim(s)), lambda s: s != "")))
    return F.when((F.size(clean) > 0) & (F.trim(dag) != "") & (F.trim(family) != ""), F.sha2(F.concat_ws(x.NUL, F.lit(version), F.trim(family), F.trim(dag), clean), 256))
