"""Ranked lexical search on inverted treaps.

A term's postings form a treap: in search order by document, in heap order by impact, equal impacts by random numbers (so
that copies do not make chains).  A query walks the treaps of its terms together.  A state is an interval of documents with the
root of each term's treap inside it; the roots hold the largest impacts of the interval, so the sum of their weighted impacts
bounds every score in it.  Expanding a state takes the document of the root that adds most, scores it exactly and splits all
treaps at it into the intervals before and after.  States whose bound is below the k-th best score, or equal to it with only
larger ids, are pruned.  States are expanded best first, in batches, so numpy works on many states and all terms at once.

On Spark: one pass over the documents writes a forward index (per document, its number of terms and the counts of those terms that any
item of the slice has).  Counts of documents and terms come from the index by aggregation.  Then every task builds treaps over
blocks of at most ``BLOCK_POSTINGS`` postings and searches all items in them.  A first round searches the documents of one hash
bucket in ``SEED_BUCKETS``; each item's k-th score there is a lower bound of its k-th score overall, which the second round starts with
on all documents, so later blocks prune from the start and few rows that cannot win are exchanged.  Items are held by the
driver in slices of at most ``SLICE_BYTES``; each further slice is another pass.

Defined results: null texts have no terms; items without terms, or whose terms no document has, get no rows; rows with a null item_id
or a null doc_id cannot be named and are not ranked, but null ids' texts count in the statistics; a repeated item_id is answered
once, for the least of its texts; rows that repeat a doc_id are ranked each, equal ones in any order; long texts are indexed
whole; empty tables give no rows.  Columns other than ids and texts are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import terms
from quarry.llm import text as tx
from quarry.llm.common import written

BLOCK_POSTINGS, SLICE_BYTES, SEED_BUCKETS, BATCH = 2_000_000, 4 << 20, 64, 512


# ---- treaps -----------------------------------------------------------------


class Treaps:
    """Inverted treaps of a block: one node a posting, all terms in shared arrays; the last node stands for none."""

    def __init__(self, doc_ids: np.ndarray, docs: np.ndarray, words: np.ndarray, impacts: np.ndarray, n_terms: int):
        """doc_ids of the block, and one posting each of docs (their number in the block), words and impacts."""
        order = np.argsort(doc_ids, kind="stable")
        self.ids = doc_ids[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = place[docs]
        self.keys = words * len(order) + docs
        order = np.argsort(self.keys)
        self.keys, docs, impacts, n = self.keys[order], docs[order], impacts[order], len(order)
        self.none = n
        self.doc = np.append(docs, -1).astype(np.int32)
        self.impact = np.append(impacts, 0)
        self.left, self.right, self.root = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32), np.full(n_terms, n, np.int32)
        self._grow(np.searchsorted(words[order], np.arange(n_terms + 1)).tolist(), n)

    def _grow(self, first: list[int], n: int) -> None:
        heaps = self.impact[:n] << 31 | np.random.Generator(np.random.PCG64(n)).integers(0, 1 << 31, n)
        for term, (a, b) in enumerate(itertools.pairwise(first)):
            left, right = [n] * (b - a), [n] * (b - a)
            heap, spine = heaps[a:b].tolist(), []  # the spine: nodes on the right edge of the treap so far
            for i, mine in enumerate(heap):
                below = n
                while spine and heap[spine[-1]] < mine:
                    below = a + spine.pop()
                left[i] = below
                if spine:
                    right[spine[-1]] = a + i
                spine.append(i)
            if spine:
                self.left[a:b], self.right[a:b], self.root[term] = left, right, a + spine[0]

    def _within(self, roots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Roots of the parts of subtrees that lie between the documents low and high, both included."""
        now = roots.copy()
        active = np.flatnonzero(now != self.none)
        while len(active):
            doc = self.doc[now[active]]
            under = doc < low[active]
            out = under | (doc > high[active])
            active, under = active[out], under[out]
            below = np.where(under, self.right[now[active]], self.left[now[active]])
            now[active] = below
            active = active[below != self.none]
        return now

    def scores(self, docs: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents."""
        keys = words[None, :] * len(self.ids) + docs[:, None]
        at = np.searchsorted(self.keys, keys)
        at[at == self.none] = 0
        return np.where(self.keys[at] == keys, self.impact[at] * weights, 0).sum(1)

    def search(self, words: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best documents with a score of ``least`` or more, and how many were scored."""
        here = self.root[words] != self.none
        words, weights = words[here], weights[here]
        best, found, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        nodes, lowest, highest = self.root[words][None, :], np.zeros(1, np.int64), np.full(1, len(self.ids), np.int64)
        bounds = (self.impact[nodes] * weights).sum(1)
        while True:
            if len(best) == k:
                least = max(least, int(best[-1]))
                keep = (bounds > least) | ((bounds == least) & ((bounds > best[-1]) | (lowest < found[-1])))
            else:
                keep = bounds >= least
            if not keep.any():
                break
            nodes, lowest, highest, bounds = nodes[keep], lowest[keep], highest[keep], bounds[keep]
            if len(bounds) > BATCH:
                order = np.argpartition(-bounds, BATCH)
                now, rest = order[:BATCH], order[BATCH:]
            else:
                now, rest = np.arange(len(bounds)), np.zeros(0, np.int64)
            state = nodes[now]
            heaviest = (self.impact[state] * weights).argmax(1)
            doc = self.doc[state[np.arange(len(now)), heaviest]].astype(np.int64)
            score = self.scores(doc, words, weights)
            scored += len(doc)
            best, found = np.append(best, score), np.append(found, doc)
            good = best >= least
            top = np.lexsort((found[good], -best[good]))[:k]
            best, found = best[good][top], found[good][top]
            low, high = np.concatenate([lowest[now], doc + 1]), np.concatenate([doc - 1, highest[now]])
            flat = np.concatenate([state.ravel()] * 2)
            grown = self._within(flat, np.repeat(low, len(words)), np.repeat(high, len(words))).reshape(-1, len(words))
            bound = (self.impact[grown] * weights).sum(1)
            alive = bound >= least
            nodes, bounds = np.concatenate([nodes[rest], grown[alive]]), np.concatenate([bounds[rest], bound[alive]])
            lowest, highest = np.concatenate([lowest[rest], low[alive]]), np.concatenate([highest[rest], high[alive]])
        return self.ids[found], best, scored


# ---- tables -----------------------------------------------------------------


def item_slices(items: DataFrame, item_col: str, text_col: str):
    """Lists of (item_id, text) of SLICE_BYTES at most, about; one text for each id."""
    one = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    total = one.agg(F.sum(F.octet_length("text") + 16)).collect()[0][0] or 0
    n = 1 if total <= SLICE_BYTES else 2 * -(-total // SLICE_BYTES)
    for i in range(n):
        yield [tuple(r) for r in one.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()]


def forward_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and counts of those terms that are in the vocabulary, of every text with terms."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = base.sparkSession.sparkContext.broadcast(vocabulary)  # the words of one slice of items

    def run(batches):
        value_set = pa.array(known.value, pa.large_binary())
        for chunk in tx.chunks(batches, "text"):
            words, bounds = terms.tokens(chunk.column("text"), terms.ALNUM, lower=True)
            coded = words.dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, value_set=value_set), -1)
            number = np.asarray(number).astype(np.int64)[np.asarray(coded.indices)]
            owner, n = terms.owners(bounds), np.diff(bounds)
            pairs, counts = np.unique((owner * len(known.value) + number)[number >= 0], return_counts=True)
            doc, word = np.divmod(pairs, max(1, len(known.value)))
            ends = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (word, counts)]
            out = pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def _lengths(n: np.ndarray, n_docs: int, n_terms: int, b: int) -> np.ndarray:
    """100 - b + (b * n * N) div L, in Python integers where 64 bits could overflow."""
    if len(n) and int(n.max()) * n_docs * b >= 1 << 62:
        return np.array([100 - b + (b * x * n_docs) // n_terms for x in n.tolist()], np.int64)
    return 100 - b + (b * n * n_docs) // n_terms


def _searched(queries, weights, k: int, n_docs: int, n_terms: int, b: int, c: int):
    """Blocks of the forward index: the k best documents of each block for each item."""
    names = ["query", "doc_id", "score"]

    def run(batches):
        asked, weight, bound = queries.value[0], weights.value, queries.value[1]

        def block(parts):
            part = pa.Table.from_batches(parts).combine_chunks()
            ids, n, lists = np.asarray(part.column("doc_id")), np.asarray(part.column("n")), part.column("terms").combine_chunks()
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            words, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(part.column("tfs").combine_chunks().flatten()).astype(np.int64)
            docs = np.repeat(np.arange(len(ids)), sizes)
            impacts = (1_000_000_000 * tf) // (1000 * tf + c * _lengths(n, n_docs, n_terms, b)[docs])
            treaps = Treaps(ids, docs, words, impacts, len(weight))
            for q, mine in enumerate(asked):
                found, score, _ = treaps.search(mine, weight[mine], k, max(1, bound[q]))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q)), pa.array(found), pa.array(score)], names)

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= BLOCK_POSTINGS:
                yield from block(waiting)
                waiting, size = [], 0
        if size:
            yield from block(waiting)

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 50, b: int = 50, c: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for rows in item_slices(items, item_col, item_text_col):
        words, bounds = terms.tokens(pa.array([t for _, t in rows], pa.string()), terms.ALNUM, lower=True)
        coded = words.dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        if not vocabulary:
            continue
        index = written(forward_index(docs, vocabulary, id_col, text_col), "forward")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
        if not n_docs:
            continue
        # a row for each word of the slice
        df = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) if w in df else 0 for w in range(len(vocabulary))], np.int64)
        codes = np.asarray(coded.indices)
        asked = [np.unique(codes[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        asked = [q[weight[q] > 0] for q in asked]
        weights = spark.sparkContext.broadcast(weight)
        named = index.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tfs")

        def best(part, bound, asked=asked, weights=weights, n_docs=n_docs, n_terms=n_terms):
            queries = spark.sparkContext.broadcast((asked, bound))
            found = part.mapInArrow(_searched(queries, weights, k, n_docs, n_terms, b, c), "query long, doc_id long, score long")
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
            # at most k rows of each block and query; the limit also prunes before the exchange
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        seed = best(named.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_BUCKETS)) == 0), [1] * len(rows))
        kth = dict(seed.where(F.col("rank") == k).select("query", "score").collect())  # a row an item of the slice
        found = best(named, [kth.get(q, 1) for q in range(len(rows))])
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(rows)], f"query long, item_id {item_type}")
        out = out.union(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = rf"""
with d as (select doc_id, t, len(t) as n from (select doc_id, {_TERMS} as t from documents) where len(t) > 0),
i as (select item_id, unnest(list_distinct({_TERMS})) as term from benchmark),
totals as (select count(*) as alln, cast(sum(n) as bigint) as alll from d),
postings as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(t) as term from d) group by doc_id, n, term),
w as (select term, cast(floor(1000 * ln((2 * alln + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from postings, totals group by term, alln),
scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * alln) // alll)))) as bigint) as score
  from i join postings using (term) join w using (term), totals group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 50
"""
