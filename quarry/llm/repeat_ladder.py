"""The doubling carried on beyond the window: how long repeated passages are.

Level 0 are the windows of ``window`` words that occur in two documents or more (found as in
``substring_dedup``: shorter lengths first).  A window of twice the length can repeat only if both its halves
do, so the starts whose partner one length further repeats too are extended, hashed and grouped
again, until no candidates survive.  Each level's starts are cut and are at most the level's before.

Defined results are those of ``substring_dedup``; an empty table has no levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import substring_dedup as sd
from quarry.llm import text as tx
from quarry.llm.common import cut, join_grouped

_WINDOWS = "did long, text_key long, pos int, h long, h2 short"


def _extended(n: int):
    """Windows of 2n words whose two halves of n words both repeat."""

    def run(batches):
        for batch in tx.chunks(batches, "text"):
            w = tx.words(batch.column("text"))
            starts = batch.column("starts")
            at = np.asarray(starts.flatten()).astype(np.int64) + np.repeat(w.bounds[:-1], np.asarray(starts.value_lengths()))
            good = tx.inside(w, 2 * n)
            at = at[np.isin(at + n, at)]  # the second half has less room, so halves are matched before
            at = at[at < len(good)]
            at = at[good[at]]
            if not len(at):
                continue
            owner = w.owner[at]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("did").take(rows), batch.column("text_key").take(rows), pa.array((at - w.bounds[owner]).astype(np.int32)), tx.as_long(tx.grams(w, 2 * n)[at]),
                    pa.array((tx.grams(w, 2 * n, second=True)[at] >> np.uint64(48)).astype(np.uint16).view(np.int16)),
                ],
                ["did", "text_key", "pos", "h", "h2"],
            )

    return run


def _repeated(windows: DataFrame) -> DataFrame:
    """(did, text_key, pos) of windows that two documents have."""
    groups = windows.groupBy("h", "h2").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("h", "h2")
    return cut(join_grouped(windows, groups, ["h", "h2"]).select("did", "text_key", "pos"))


def ladder(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, length, pos): starts of repeated windows at every length window * 2**k that has any."""
    base = sd._keyed(docs, id_col, text_col, [])
    candidates = sd.survivors(base, window)
    first = base.join(candidates.withColumn("late_anchors", F.col("anchors")), ["did", "text_key"]).select("did", "text_key", "text", "rest", "anchors", "late_anchors").mapInArrow(sd._windows(window), _WINDOWS + ", late boolean").drop("late")
    level, n, out = _repeated(first), window, None
    while level.limit(1).count():
        part = level.withColumn("length", F.lit(n))
        out = part if out is None else out.union(part)
        starts = level.groupBy("did", "text_key").agg(F.collect_set("pos").alias("starts"))
        level = _repeated(base.join(starts, ["did", "text_key"]).select("did", "text_key", "text", "starts").mapInArrow(_extended(n), _WINDOWS))
        n *= 2
    out = level.withColumn("length", F.lit(n)) if out is None else out
    return out.select(F.col("did").alias("doc_id"), "text_key", "length", "pos")


def longest_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, longest): the largest level at which a document repeats anything; documents that repeat nothing are left out."""
    return ladder(docs, window, id_col, text_col).groupBy("doc_id", "text_key").agg(F.max("length").alias("longest"))


def spans(starts: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, first_word, end_word): maximal stretches covered by windows; starts as ``ladder`` gives for one length."""
    w = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    marked = starts.select("doc_id", "text_key", "pos").distinct().withColumn("fresh", (F.col("pos") > F.lag("pos").over(w) + window) | F.lag("pos").over(w).isNull())
    numbered = marked.withColumn("k", F.sum(F.col("fresh").cast("int")).over(w))
    return numbered.groupBy("doc_id", "text_key", "k").agg(F.min("pos").alias("first_word"), (F.max("pos") + window).alias("end_word")).drop("k")
