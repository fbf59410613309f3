"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a repetition rate: its share of the weights times the wished
number of rows, over the rows it has.  Each document draws one uniform number
from a hash of the seed and its identity; inverting the Poisson distribution with that
rate gives its number of copies.  Documents are exploded by that count and
sorted by a hash of (seed, identity, copy), which shuffles them globally.

The identity is a hash of the id, the text and the other columns, and of a row's number among the rows that
are equal in all of them.  So null or repeated ids with different texts draw apart, and so do
the members of a group of equal rows: a group that holds a third of all rows gets about its
share instead of being dropped or multiplied as one block, and no two output rows share a sort key.

Scale: only source counts and identities are grouped before the draw (both with partial
aggregation); rates are broadcast up to ``BROADCAST_SOURCES`` sources, else joined with hot sources split.
Whole rows are exchanged once, to the place in the shuffle that their sort key gives them: keys are
uniform, so their first digits deal them evenly without a sampling pass.  Equal rows, which cannot be
told apart, are counted, and regenerated from one of them in blocks that spread over tasks.

The draws depend on the rows alone, not on partitions, so a lost executor repeats them exactly.

Defined results: a null source is a source of its own; null ids and texts are values like
others (null and empty texts differ); sources without a weight take ``default_weight``; a weight of 0 removes a
source; an empty table gives an empty mix.  Input columns of any names are kept; the operator's own columns are
``copy`` (from 0) and ``mix_key``, which replace input columns of these two names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, join_grouped, written

#: Relative weights of the production mix; other sources weigh 1.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}
SEED = "quarry-mix-1"
#: Sources up to which rates are broadcast (a few MB), and equal rows that one task regenerates.
BROADCAST_SOURCES, BLOCK_ROWS = 50_000, 100_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 12 hex digits of a SHA-256."""
    digits = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """Smallest k whose Poisson(rate) distribution function reaches u.

    The rate is split into slices of at most 16, each inverted with its own number
    (a sum of Poisson numbers is Poisson), so exp() never underflows and no count is
    cut off: the terms after r + 9 sqrt(r) + 18 together are below 2**-50, and u < 1 - 2**-49.
    """
    def one(v: Column, r: Column) -> Column:
        state = F.struct(F.exp(-r).alias("p"), F.exp(-r).alias("c"), F.lit(0).alias("k"))
        return F.aggregate(
            F.sequence(F.lit(1), F.ceil(r + 9 * F.sqrt(r) + 18).cast("int")), state,
            lambda acc, i: F.when(acc["c"] >= v, acc).otherwise(
                F.struct((acc["p"] * r / i).alias("p"), (acc["c"] + acc["p"] * r / i).alias("c"), i.alias("k"))
            ),
            lambda acc: acc["k"],
        )

    return one(u, rate)


def rates(docs: DataFrame, weights: dict[str, float], epochs: float, default_weight: float, source_col: str) -> tuple[DataFrame, int]:
    """source, rate: weight share times wished rows over rows held; and the number of sources."""
    weight = F.lit(float(default_weight))
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    held = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("held")).withColumn("weight", weight))
    total = held.agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("rows"), F.sum("weight").alias("weights")).collect()[0]
    rows, share = F.lit(total["rows"] or 0), F.lit(total["weights"] or 0.0)
    rate = F.col("weight") / share * rows * F.lit(float(epochs)) / F.col("held") if total["weights"] else F.lit(0.0)
    return held.select("source", rate.alias("rate")), total["n"]


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, identity): identity is a SHA-256 of id, text and all other columns."""
    others = [c for c in docs.columns if c not in (id_col, text_col, "copy", "mix_key")]
    parts = [F.coalesce(docs[id_col].cast("string"), F.lit("null")), F.coalesce(F.sha2(docs[text_col].cast("string"), 256), F.lit("null"))]
    if others:  # null fields are left out of the JSON text, so they differ from empty ones
        parts.append(F.sha2(F.to_json(F.struct(*[docs[c] for c in others])), 256))
    return docs.select(F.struct("*").alias("doc"), F.sha2(F.concat_ws("|", *parts), 256).alias("identity"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """(doc, identity) with the row's number among equals in the identity, from the second on."""
    equal = written(rows.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "equal")
    if equal.isEmpty():
        return rows
    single = rows.join(equal.select("identity"), "identity", "left_anti").select("doc", "identity")
    first = rows.join(equal.select("identity"), "identity", "left_semi").groupBy("identity").agg(F.first("doc").alias("doc"))
    blocks = equal.select("identity", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK_ROWS))).alias("block"))
    blocks = join_grouped(blocks, first, ["identity"]).repartition("identity", "block")
    start = F.col("block") * BLOCK_ROWS
    many = blocks.select("doc", "identity", F.explode(F.sequence(start, F.least(start + BLOCK_ROWS, F.col("n")) - 1)).alias("nth"))
    return single.unionByName(many.select("doc", F.when(F.col("nth") == 0, F.col("identity")).otherwise(F.concat_ws("|", "identity", F.col("nth").cast("string"))).alias("identity")))


def copies(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, default_weight: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc, rate, identity, n_copies): each row of docs as a struct, its source's rate, what its draws hash and its number of copies."""
    table, n_sources = rates(docs, WEIGHTS if weights is None else weights, epochs, default_weight, source_col)
    r = table.select(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().cast("int").alias("n"), "rate")
    base = _told_apart(_identified(docs, id_col, text_col)).select(
        "doc", "identity", F.coalesce(F.col("doc")[source_col], F.lit("")).alias("k"), F.col("doc")[source_col].isNull().cast("int").alias("n")
    )
    joined = base.join(F.broadcast(r), ["k", "n"]) if n_sources <= BROADCAST_SOURCES else join_grouped(base, r, ["k", "n"])
    # slices of at most 16; a document's slice i draws its own number
    slices = F.greatest(F.lit(1), F.ceil(F.col("rate") / 16).cast("int"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), slices), F.lit(0),
        lambda acc, i: acc + poisson_quantile(uniform(F.lit(seed), F.col("identity"), i.cast("string")), F.col("rate") / slices),
    )
    return joined.select("doc", "rate", "identity", drawn.alias("n_copies"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, default_weight: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed and globally shuffled table: input columns, ``copy``, ``mix_key``.

    Partitions follow each other in order of ``mix_key`` and are sorted by it.
    """
    drawn = copies(docs, weights, epochs, default_weight, seed, id_col, source_col, text_col)
    out = (
        drawn.where("n_copies > 0").select("doc", "identity", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
        .select("doc", "copy", F.sha2(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("identity"), F.col("copy").cast("string")), 256).alias("mix_key"))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("bigint") * parts / F.lit(1 << 32)).cast("int")
    dealt = out.repartitionById(parts, F.least(place, F.lit(parts - 1))).sortWithinPartitions("mix_key")
    return dealt.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("copy", "mix_key")], "copy", "mix_key")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", "mix_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_WEIGHT_SQL = "case source " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items()) + " else 1.0 end"
OP7_SQL = f"""
with recursive held as (select source, count(*) as held, cast(any_value({_WEIGHT_SQL}) as double) as weight from documents group by source),
rates as (select source, weight / (select sum(weight) from held) * (select sum(held) from held) * 1.0 / held as rate from held),
hashed as (select doc_id, source, text,
  sha256(coalesce(cast(doc_id as varchar), 'null') || '|' || coalesce(sha256(text), 'null') || '|'
    || sha256(case when source is null then '{{}}' else cast(json_object('source', source) as varchar) end)) as hash from documents),
named as (select *, row_number() over (partition by hash) - 1 as nth from hashed),
sliced as (select d.doc_id, d.source, d.text, case when nth = 0 then hash else hash || '|' || nth end as identity, rate, greatest(1, cast(ceil(rate / 16) as int)) as slices
  from named d join rates r on d.source is not distinct from r.source),
draws as (select identity, rate / slices as r, i,
  (cast(('0x' || substr(sha256('{SEED}|' || identity || '|' || i), 1, 12)) as bigint) + 0.5) / 281474976710656.0 as u
  from sliced, unnest(range(1, slices + 1)) t(i)),
walk as (
  select identity, i, u, r, 0 as k, exp(-r) as p, exp(-r) as c from draws
  union all select identity, i, u, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) from walk where c < u and k < 100
),
counts as (select identity, sum(k) as n_copies from (select identity, i, max(k) as k from walk group by identity, i) group by identity)
select doc_id, source, copy, sha256('{SEED}|order|' || identity || '|' || copy) as mix_key, sha256(coalesce(text, '')) as text_sha256
from (select doc_id, source, text, identity, cast(unnest(range(0, cast(n_copies as bigint))) as int) as copy from sliced join counts using (identity))
"""
