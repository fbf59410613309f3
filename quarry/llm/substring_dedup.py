"""Substring deduplication by level-wise doubling.

Windows of n words are judged by doubling lengths, n/4, n/2 and n (13, 25 and 50 words; halves are
rounded up, so two of them cover a window).  At each length below n a window offers only its
anchor, the smallest hash of the runs of that length inside it.  Equal windows have equal anchors at every length, so a window
whose anchor occurs in one document alone cannot repeat; only windows whose anchor repeats are extended to
the next length.  At n words the survivors are hashed in full; those that start in an earlier document
too are marked, and the words they cover are removed.  The doubling ends there, or where no candidates
survive; ``repeat_ladder`` carries it on, to know how long repeats are.

Equality rests on 80 bits of hash, of which 64 come from one function of the words' bytes and 16 from a second.

Scale: anchors of the first length are about 2/(3n/4+2) of the words, so the first exchange is a small
part of the text, and the next has survivors only.  Hot passages are pre-aggregated (min and max of the document
ids), and the joins that mark occurrences have plain exchanges on both sides, so
adaptive execution can split a hot key.  A document's marks are collected per
document only.

Defined results: null text has no words; rows with a null id take no part in the
comparison and keep all words; rows that repeat an id are judged each by its own
text, and an equal id is not a smaller one; documents shorter than the window
keep all words.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import text as tx
from quarry.llm.common import join_grouped


#: Stands for a null id in join keys, which are never null; the lowest bit of the text's key tells it from an id of that value.
NO_ID = -(1 << 63)


def lengths(n: int) -> list[int]:
    """The lengths below n whose anchors are compared, shortest first."""
    half = (n + 1) // 2
    return [(half + 1) // 2, half]


def _anchor_hashes(w: tx.Words, n: int, length: int) -> np.ndarray:
    """Anchor of each window of n words: the smallest hash of the runs of a length inside it."""
    return tx.sliding_min(tx.grams(w, length), n - length + 1)


class _Held:
    """Hashes listed for each row of a batch, to be looked up by (row, hash)."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.tag = tx.mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))

    def has(self, column: str, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        listed = self.batch.column(column)
        of = np.repeat(np.arange(self.batch.num_rows), np.asarray(pa.compute.fill_null(listed.value_lengths(), 0)))
        held = np.asarray(listed.flatten()).astype(np.int64).view(np.uint64) ^ self.tag[of]
        return np.isin(hashes ^ self.tag[owner], held)


def _offers(n: int, length: int, before: int | None):
    """Anchors of a length, of all windows or of those whose anchor of the length before is listed."""

    def run(batches):
        for batch in tx.chunks(batches, "text"):
            w = tx.words(batch.column("text"))
            good = tx.inside(w, n)
            at = np.flatnonzero(good)
            if before is not None and len(at):
                at = at[_Held(batch).has("anchors", w.owner[at], _anchor_hashes(w, n, before)[at])]
            if not len(at):
                continue
            pairs = np.stack([w.owner[at].astype(np.uint64), _anchor_hashes(w, n, length)[at]], 1)
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
            rows = pa.array(pairs[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").take(rows), batch.column("text_key").take(rows), tx.as_long(pairs[:, 1])],
                ["did", "text_key", "anchor"],
            )

    return run


def _windows(n: int):
    def run(batches):
        for batch in tx.chunks(batches, "text"):
            w = tx.words(batch.column("text"))
            at = np.flatnonzero(tx.inside(w, n))
            if not len(at):
                continue
            held, hashes, owner = _Held(batch), _anchor_hashes(w, n, lengths(n)[-1]), w.owner[at]
            keep = held.has("anchors", owner, hashes[at])
            at, owner = at[keep], owner[keep]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("did").take(rows),
                    batch.column("text_key").take(rows),
                    pa.array((at - w.bounds[owner]).astype(np.int32)),
                    tx.as_long(tx.grams(w, n)[at]),
                    pa.array((tx.grams(w, n, second=True)[at] >> np.uint64(48)).astype(np.uint16).view(np.int16)),
                    pa.array(held.has("late_anchors", owner, hashes[at])),
                ],
                ["did", "text_key", "pos", "h", "h2", "late"],
            )

    return run


def _rewritten(n: int, with_text: bool):
    def run(batches):
        for batch in tx.chunks(batches, "text"):
            w = tx.words(batch.column("text"))
            starts = batch.column("marks")
            marks = np.asarray(starts.flatten()).astype(np.int64)
            lengths = np.asarray(pa.compute.fill_null(starts.value_lengths(), 0), np.int64)
            first = np.repeat(w.bounds[:-1], lengths) + marks
            cover = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, np.minimum(first + n, len(w.hashes)), -1)
            gone = np.cumsum(cover[:-1]) > 0
            raw = w.data.tobytes()
            kept, digests = [], []
            lost = np.concatenate([[0], np.cumsum(gone)])
            lost = lost[w.bounds[1:]] - lost[w.bounds[:-1]]
            for row in range(batch.num_rows):
                a, b = w.bounds[row], w.bounds[row + 1]
                index = np.flatnonzero(~gone[a:b]) + a
                text = b" ".join([raw[i:j] for i, j in zip(w.starts[index].tolist(), w.ends[index].tolist(), strict=True)])
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text.decode() if lost[row] else batch.column("text")[row].as_py())
            columns = [batch.column("did"), batch.column("text_key"), pa.array(w.counts.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(digests)]
            names = ["did", "text_key", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns += [pa.array(kept, pa.string()), batch.column("rest")]
                names += ["kept_text", "rest"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Both joins with the texts use this one plan, so its exchange is written once and read twice.  The keys are never null; other columns travel in ``rest``."""
    rest = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None).cast("int")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(id_col).cast("long").isNull().cast("long")).alias("text_key"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"),
    )


def _named():
    return F.col("text_key").bitwiseAND(F.lit(1)) == 0


def survivors(base: DataFrame, window: int) -> DataFrame:
    """(did, text_key, anchors, late_anchors): the anchors of each document that repeat, and those of them that an earlier document has."""
    found, before = None, None
    for length in lengths(window):
        # rows without an id offer nothing, so later lengths never meet them
        texts = base.where(_named()).select("did", "text_key", "text") if found is None else base.join(found, ["did", "text_key"]).select("did", "text_key", "text", "anchors")
        offered = texts.mapInArrow(_offers(window, length, before), "did long, text_key long, anchor long")
        shared = offered.groupBy("anchor").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("anchor", "lo")
        found = (
            join_grouped(offered, shared, ["anchor"])
            .groupBy("did", "text_key").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("lo") < F.col("did"), F.col("anchor"))).alias("late_anchors"))
        )
        before = length
    return found


def repeated_starts(base: DataFrame, window: int = 50) -> DataFrame:
    """(did, text_key, pos): words at which a window starts that also starts in a document with a smaller id."""
    windows = base.join(survivors(base, window), ["did", "text_key"]).select("did", "text_key", "text", "rest", "anchors", "late_anchors").mapInArrow(
        _windows(window), "did long, text_key long, pos int, h long, h2 short, late boolean"
    )
    repeats = (
        windows.groupBy("h", "h2").agg(F.min("did").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("h", "h2", "first_id")
    )
    later = windows.where("late").drop("late")  # the others start in the first document of their anchor
    return join_grouped(later, repeats, ["h", "h2"]).where("did > first_id").select("did", "text_key", "pos")


def _deduped(docs: DataFrame, window: int, id_col: str, text_col: str, with_text: bool, carried: list[str]) -> DataFrame:
    base = _keyed(docs, id_col, text_col, carried)
    marks = repeated_starts(base, window).groupBy("did", "text_key").agg(F.collect_set("pos").alias("marks"))
    kinds = [("did", "bigint"), ("text_key", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    schema = T.StructType([T.StructField(n, T.LongType() if k == "bigint" else T.StringType()) for n, k in kinds])
    if with_text:
        schema = schema.add("kept_text", T.StringType()).add(base.schema["rest"])
    return base.join(marks, ["did", "text_key"], "left").mapInArrow(_rewritten(window, with_text), schema)


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove the words of every repeated window.

    Returns doc_id, text_key, n_words, n_removed, kept_sha256 and, on request,
    kept_text: the kept words joined by one space, or the text as it was where
    nothing is removed (null stays null).
    """
    out = _deduped(docs, window, id_col, text_col, with_text, [])
    return out.select(F.when(_named(), F.col("did")).alias("doc_id"), *[c for c in out.columns[1:] if c != "rest"])


def rewrite_documents(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, n_removed): each row of docs as a struct, with the kept text in place of the text."""
    carried = [c for c in docs.columns if c != text_col]
    out = _deduped(docs, window, id_col, text_col, True, carried)
    doc = F.struct(*[F.col("kept_text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
    return out.select(doc.alias("doc"), "n_words", "n_removed")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs, 50, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
