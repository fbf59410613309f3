"""Importance resampling towards a target distribution of hashed word features.

Features are the runs of 1 to ``n`` consecutive words, with repeats, hashed into ``buckets``.  The first pass counts buckets: every
partition of the documents gives one numpy vector (``bincount`` over Arrow batches), and ``treeReduce`` merges the vectors on the
executors, so the driver receives a few vectors of fixed length however many partitions there are.  The same is done for the
target texts.  A bucket's gain is the scaled log ratio of its smoothed shares in target and source.  The second pass broadcasts
the gains (one vector of ``buckets`` numbers) and sums them per document with weighted ``bincount``.

A document's score is its weight plus Gumbel noise from a hash of its id, so the highest scores are a draw without replacement in
proportion to exp(weight / 1000).  Documents with at least ``min_words`` words stand for the draw; ranks come from a range partition of
their narrow rows, so no task sorts them all.

Defined results: null texts and texts without words have no features and weight 0; a null doc_id draws with the noise of the text
``2024:`` and comes after all ids in ties; rows that repeat a doc_id draw each with the same noise, those that are equal in score
in an arbitrary order; long texts are summed like others; empty tables give an empty table, and without target texts all
shares of the target are equal.  Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import terms
from quarry.llm import text as tx
from quarry.llm.common import written
from quarry.operators.lineage import numbered

BUCKETS, SEED = 10_000, "2024"


def features(column: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each feature, and the words of each text."""
    words, bounds = terms.tokens(column, terms.ALNUM, lower=True)
    owner = terms.owners(bounds)
    found, whose = [], []
    for k in range(1, n + 1):
        size = len(words) - k + 1
        if size <= 0:
            break
        runs = words if k == 1 else pc.binary_join_element_wise(*(words.slice(i, size) for i in range(k)), pa.scalar(b" ", pa.large_binary()))
        coded = runs.dictionary_encode()  # each distinct run of the chunk is hashed once
        hashed = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        whole = owner[:size] == owner[k - 1 :]
        found.append(hashed[np.asarray(coded.indices)][whole])
        whose.append(owner[:size][whole])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *whose]), np.diff(bounds)


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for chunk in tx.chunks(batches, text_col):
            counts += np.bincount(features(chunk.column(text_col), n, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    context = texts.sparkSession.sparkContext
    parts = texts.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    # a vector of zeros stands for tables without partitions
    return parts.union(context.parallelize([np.zeros(buckets, np.int64)], 1)).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the buckets' smoothed shares."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(t + 1) * all_source) / (float(s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches):
        value = held.value.astype(np.float64)  # sums stay below 2**53
        for chunk in tx.chunks(batches, "text"):
            found, whose, n_words = features(chunk.column("text"), n, buckets)
            size = chunk.num_rows
            n_features = np.bincount(whose, minlength=size)
            weight = np.bincount(whose, weights=value[found], minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"]
            )

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(seed: str, doc_id: str = "doc_id"):
    """floor(1000 * Gumbel noise) from 32 hash bits of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = BUCKETS, min_words: int = 20, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; rank is null for rows that are not drawn."""
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    scored = weighted(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + noise(seed))
    held = written(scored, "importance")  # narrow rows, read for the count, the ranks and the rest
    stands = F.col("n_words") >= min_words
    drawn = held.where(stands).count() * percent // 100
    # the row number keeps rows that repeat an id and its text from one range
    order = {"_low": -F.col("score"), "_unnamed": F.col("doc_id").isNull(), "_id": F.col("doc_id"), "_row": F.monotonically_increasing_id()}
    placed = numbered(held.where(stands).withColumns(order), list(order), "_pos")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(F.col("_pos") < drawn, F.col("_pos") + 1).alias("rank"))
    return ranked.unionByName(held.where(~stands).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's words, and the tenth of them that is drawn."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
with recursive steps(i, k, c) as (
  select range, 0, range from range(256)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8),
d as (select doc_id, {_WORDS.format("text")} as w from documents),
b as (select {_WORDS.format("text")} as w from benchmark),
sw as (select w, count(*) as n from (select unnest(w) as w from d) group by w),
tw as (select w, count(*) as n from (select unnest(w) as w from b) group by w),
hexed as (select w, hex(encode(w)) as h from (select w from sw union select w from tw)),
bytes as (select w, list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as bigint)) as x from hexed),
hashed as (select w, xor(list_reduce(list_prepend(4294967295, x), lambda a, c: xor(a >> 8, t[1 + (xor(a, c) & 255)])), 4294967295) % 10000 as k from bytes, crc),
s as (select k, sum(n) as n from sw join hashed using (w) group by k),
t as (select k, sum(n) as n from tw join hashed using (w) group by k),
totals as (select coalesce((select sum(n) from s), 0) as alls, coalesce((select sum(n) from t), 0) as allt),
gain as (select k, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (alls + 10000)::double / ((coalesce(s.n, 0) + 1)::double * (allt + 10000)::double))) as bigint) as g
  from s full join t using (k), totals),
weights as (select doc_id, count(*) as n_features, sum(g) as weight from (select doc_id, unnest(w) as w from d) join hashed using (w) join gain using (k) group by doc_id),
scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
  cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || left(sha256('2024:' || doc_id), 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from d left join weights using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n_words >= 20)
select doc_id, cast(n_features as bigint) as n_features, weight, score,
  cast(case when r <= (select 10 * count(*) // 100 from ranked) then r end as bigint) as rank
from scored left join ranked using (doc_id)
"""
