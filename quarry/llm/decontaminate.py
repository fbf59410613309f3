"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Distances are edits of words (insert, delete, replace) between a benchmark item and the
nearest stretch of a document, words being runs of letters, digits and non-ASCII
characters, lower-cased A-Z.  A document is contaminated by an item of L words if at
most ``(1 - similarity) * L`` edits separate them; the default similarity is 0.8.

1. Seeds.  With e edits allowed, an item keeps an unbroken run of ceil((L - e) / (e + 1)) words.
   Only windows aligned with such a run of some item are embedded; no other window can be near.
2. CGK.  Each item-sized window walks its words with a pointer that advances by a random bit of
   (walk, step, word), writing the word under the pointer at every step: windows at a small
   edit distance write strings at a small Hamming distance.
3. LSH.  Each of ``WALKS`` walks is sampled at ``BITS`` random steps, as often as a target recall asks for; a window is a
   candidate for the items whose samples agree at least once.  How often follows from the recall: for each class of
   lengths, random pairs at the edit bound are embedded, and the smallest number of samples
   at which the share of pairs that agree somewhere reaches the target is taken.  Agreement falls with length, so an item of
   more than ``PIECE_WORDS`` words is cut into even pieces, each a window of its own: one of them at least has no more than its share of the edits.
4. Every candidate is verified with Myers' bit-parallel edit distance, the ends of the stretch free.
   So nothing false is reported; recall against brute force is measured in the tests.

Everything happens in the scan: no exchange, no join, whole texts in chunks of bounded size.  Items and windows are
embedded by classes of lengths (powers of two), so many rows at once that a part takes ``PART_BYTES``, however long the longest item is.
The benchmark reaches executors in slices of at most ``SLICE_BYTES`` of text, one pass over the
documents each; one slice is enough up to that size.

Defined results: null and empty texts match nothing; null or wordless items match nothing;
items of fewer than five words must occur exactly; repeated items are reported each; rows with
null or repeated ids are judged each; other columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx

WALKS, BITS = 6, 2
#: Samples of a walk that may be chosen (more raise), target recall, and words of the longest window.
SAMPLES, RECALL, PIECE_WORDS = tuple(2**k for k in range(1, 13)), 0.99, 256
SLICE_BYTES = 4 << 20
#: Bytes of text whose windows are embedded together.
TOGETHER = 1 << 20
#: Bytes that embedded windows take at once.
PART_BYTES = 16 << 20
_CONST = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, (WALKS, 4096), dtype=np.uint64)
#: Bytes as words see them: A-Z lower-cased, other ASCII than letters and digits a space.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def _clean(column: pa.Array) -> pa.Array:
    texts = [b"" if t is None else t.translate(_CLEAN) for t in column.cast(pa.large_binary()).to_pylist()]
    return pa.array(texts, pa.large_binary())


def allowed_edits(length: int, similarity: float) -> int:
    return int((1 - similarity) * length + 1e-9)


def seed_words(length: int, edits: int) -> int:
    """Words of the longest run that surely is unbroken."""
    return max(1, -(-(length - edits) // (edits + 1)))


@dataclass
class Index:
    """Seeds and LSH buckets of a slice of the benchmark."""

    ids: list
    words: list[np.ndarray]  # word hashes of each item
    edits: list[int]
    pieces: np.ndarray  # rows of (item, first word, words)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # run length: sorted hashes, pieces, offsets
    filters: dict[int, np.ndarray]
    buckets: tuple[np.ndarray, np.ndarray]  # sorted keys of all pieces' samples, pieces
    samples: dict[int, int]  # class of lengths: samples of a walk
    similarity: float


FILTER_BITS = 20


def _windows(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` words from each start; 0 beyond the length."""
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < lengths[:, None]
    return np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))


def embed(windows: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """The CGK string of each row, three times as long as the row; 0 once the words are used up."""
    rows, width = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], 1)
    pointer = np.zeros(rows, np.int64)
    steps = 3 * width
    out = np.zeros((rows, steps), np.uint64)
    each = np.arange(rows)
    for j in range(steps):
        now = padded[each, np.minimum(pointer, width)]
        now = np.where(pointer < lengths, now, np.uint64(0))
        out[:, j] = now
        pointer += (tx.mix(now ^ _CONST[walk, j % 4096]) & np.uint64(1)).astype(np.int64)
    return out


def _sample_steps(length: int, walk: int, sample: int) -> np.ndarray:
    """Steps sampled for windows of a length; the walk leaves a word every two steps, so steps up to twice the length matter."""
    rng = np.random.Generator(np.random.PCG64([length, walk, sample]))
    return rng.integers(0, max(1, 2 * length), BITS)


def length_class(n: np.ndarray) -> np.ndarray:
    """The exponent of the power of two that holds a length."""
    return np.maximum(2, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


@lru_cache(maxsize=64)
def samples_for(kind: int, similarity: float, recall: float) -> int:
    """Samples of a walk that items of a class of lengths need for the recall at the edit bound."""
    n = min(1 << kind, PIECE_WORDS)
    rng = np.random.Generator(np.random.PCG64([n, 5]))
    pairs = 100
    left = rng.integers(1, 2**62, (pairs, n), dtype=np.uint64)
    right = np.zeros((pairs, n), np.uint64)
    for row in range(pairs):
        w = left[row].tolist()
        for move, at, word in zip(rng.integers(0, 3, k := allowed_edits(n, similarity)), rng.random(k), rng.integers(1, 2**62, k).tolist(), strict=True):
            i = int(at * len(w))
            w[i : i + (move < 2)] = [] if move == 0 and len(w) > 1 else [word]
        right[row, : min(n, len(w))] = w[:n]
    lengths = np.full(pairs, n)
    strings = [(embed(left, lengths, k)[:, : 2 * n], embed(right, lengths, k)[:, : 2 * n]) for k in range(WALKS)]
    agree = np.stack([((a == b) & (a != 0)).mean(1) for a, b in strings])
    for s in SAMPLES:
        if ((1 - agree**BITS) ** s).prod(0).mean() <= 1 - recall:
            return s
    raise ValueError(f"a recall of {recall} at similarity {similarity} needs more than {SAMPLES[-1]} samples a walk for items of {n} words")


def bucket_keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, held: np.ndarray, samples: dict[int, int]):
    """Parts (rows, keys): the keys of some windows' samples, a row each; the window's size is part of a key.  A sample beyond the window's words says nothing: 0.

    A window has ``sizes`` words, of which ``held`` are there from its start on.
    """
    kinds = length_class(sizes)
    for kind in np.unique(kinds).tolist():
        of_kind = np.flatnonzero(kinds == kind)
        width = int(sizes[of_kind].max())
        step = max(1, PART_BYTES // (24 * width))
        for start in range(0, len(of_kind), step):
            rows = of_kind[start : start + step]
            windows = _windows(words, starts[rows], held[rows], width)
            groups = [(int(n), np.flatnonzero(sizes[rows] == n)) for n in np.unique(sizes[rows])]
            keys = np.zeros((len(rows), WALKS * samples[kind]), np.uint64)
            for walk in range(WALKS):
                string = embed(windows, held[rows], walk)
                for n, mine in groups:
                    for sample in range(samples[kind]):
                        key = np.full(len(mine), np.uint64(n * 1000003 + walk * SAMPLES[-1] + sample))
                        used = np.ones(len(mine), bool)
                        for at in _sample_steps(n, walk, sample):
                            symbol = string[mine, at]
                            key = tx.mix(key ^ symbol)
                            used &= symbol != 0
                        keys[mine, walk * samples[kind] + sample] = np.where(used, key, 0)
            yield rows, keys


def build_index(items: list[tuple], similarity: float, recall: float = RECALL) -> Index | None:
    """Index of (item_id, text) pairs; None if no item has words."""
    items = [(i, t) for i, t in items if t is not None]
    w = tx.words(_clean(pa.array([t for _, t in items], pa.string()))) if items else None
    if w is None or not len(w.hashes):
        return None
    ids, words = [], []
    for k, (i, _) in enumerate(items):
        mine = w.hashes[w.bounds[k] : w.bounds[k + 1]]
        if len(mine):
            ids.append(i)
            words.append(mine)
    edits = [allowed_edits(len(x), similarity) for x in words]
    pieces = []
    for k, mine in enumerate(words):
        cuts = np.linspace(0, len(mine), -(-len(mine) // PIECE_WORDS) + 1).astype(np.int64)
        pieces += [(k, int(a), int(b - a)) for a, b in itertools.pairwise(cuts)]
    pieces = np.array(pieces, np.int64)
    found: dict[int, list] = {}
    for number, (k, first, n) in enumerate(pieces.tolist()):
        mine = words[k][first : first + n]
        run = seed_words(n, allowed_edits(n, similarity))
        one = tx.Words(np.zeros(0, np.uint8), np.zeros(0), np.zeros(0), mine, np.array([0, n]))
        found.setdefault(run, []).append((tx.grams(one, run), np.full(n - run + 1, number), np.arange(n - run + 1)))
    seeds, filters = {}, {}
    for run, parts in found.items():
        hashes, owners, offsets = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(hashes, kind="stable")
        seeds[run] = hashes[order], owners[order], offsets[order]
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
        filters[run] = bits
    lengths = pieces[:, 2]
    samples = {int(k): samples_for(int(k), similarity, recall) for k in np.unique(length_class(lengths))}
    begins = np.concatenate([[0], np.cumsum([len(x) for x in words])[:-1]])[pieces[:, 0]] + pieces[:, 1]
    keys, owners = [], []
    for rows, found_keys in bucket_keys(np.concatenate(words), begins, lengths, lengths, samples):
        keys.append(found_keys.ravel())
        owners.append(np.repeat(rows, found_keys.shape[1]))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    keys, owners = keys[keys != 0], owners[keys != 0]
    order = np.argsort(keys, kind="stable")
    return Index(ids, words, edits, pieces, seeds, filters, (keys[order], owners[order]), samples, similarity)


def _pairs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in values, in sorted keys) of equal entries."""
    a, b = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
    n = b - a
    left = np.repeat(np.arange(len(values)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return left, np.repeat(a, n) + within


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any part of the stretch, and the end of the first such part (Myers, 1999)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, x in enumerate(stretch.tolist()):
        eq = masks.get(x, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = minus | (full & ~(d0 | plus))
        hm = plus & d0
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1) & full
        hm = (hm << 1) & full
        plus = hm | (full & ~(d0 | hp))
        minus = hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


def matches(column: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, edits, first word, end word): the best match of each row and item."""
    w = tx.words(_clean(column))
    if not len(w.hashes):
        return []
    owner = w.owner
    lengths = index.pieces[:, 2]
    starts, sizes, rows = [], [], []
    for run, (hashes, owners, offsets) in index.seeds.items():
        grams = tx.grams(w, run)
        at = np.flatnonzero(index.filters[run][grams & np.uint64((1 << FILTER_BITS) - 1)] & tx.inside(w, run)) if len(grams) else np.zeros(0, np.int64)
        if not len(at):
            continue
        which, seed = _pairs(hashes, grams[at])
        starts.append(at[which] - offsets[seed])
        sizes.append(lengths[owners[seed]])
        rows.append(owner[at[which]])
    if not starts:
        return []
    starts, sizes, rows = np.concatenate(starts), np.concatenate(sizes), np.concatenate(rows)
    # windows of one document and size, cut to the document
    low, high = w.bounds[rows], w.bounds[rows + 1]
    starts = np.maximum(np.minimum(starts, high - sizes), low)
    held = np.minimum(sizes, high - low)
    table = np.unique(np.stack([rows, starts, sizes, held], 1), axis=0)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    sorted_keys, owners = index.buckets
    for part, keys in bucket_keys(w.hashes, table[:, 1], table[:, 2], table[:, 3], index.samples):
        # a document shorter than the item is padded: its window still has the item's size
        which, k = _pairs(sorted_keys, keys.ravel())
        which = part[which // keys.shape[1]]
        found = np.stack([table[which, 0], owners[k], table[which, 1]], 1)
        for row, number, start in np.unique(found, axis=0).tolist():
            item, offset, size = index.pieces[number].tolist()
            e = index.edits[item]
            n = len(index.words[item])
            known = best.get((row, item))
            if known is not None and known[0] == 0:
                continue
            if size < n:
                # a piece is verified first, and once the item is found, other pieces of the match point to starts that differ by its edits
                if known is not None and abs(int(w.bounds[row]) + known[1] - start + offset) <= e:
                    continue
                own = allowed_edits(size, index.similarity)
                a, b = max(int(w.bounds[row]), start - own), min(int(w.bounds[row + 1]), start + size + own)
                if edit_distance(index.words[item][offset : offset + size], w.hashes[a:b])[0] > own:
                    continue
                start -= offset
            a, b = max(int(w.bounds[row]), start - e), min(int(w.bounds[row + 1]), start + n + e)
            edits, end = edit_distance(index.words[item], w.hashes[a:b])
            if edits > e:
                continue
            back, length = edit_distance(index.words[item][::-1], w.hashes[a : a + end][::-1])
            first = a + end - length - int(w.bounds[row])
            new = (edits, first, a + end - int(w.bounds[row]))
            if known is None or new < known:
                best[row, item] = new
    return [(r, i, *m) for (r, i), m in sorted(best.items())]


def _slices(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (item_id, text), each of about SLICE_BYTES at most."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 8)).collect()[0][0] or 0
    n = 1 if total <= SLICE_BYTES else 2 * -(-total // SLICE_BYTES)
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word, item_words: the best match of each document and item within the similarity."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = base.schema["doc_id"].dataType.simpleString()
    b = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {d}, item_id {b}, edits int, first_word int, end_word int, item_words int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _slices(benchmark, item_col, "text"):
        index = build_index(items, similarity, recall)
        if index is not None:
            out = out.union(base.mapInArrow(_report(index), schema))
    return out


def _report(index: Index):
    def run(batches):
        ids = pa.array(index.ids)
        for batch in tx.chunks(batches, "text", TOGETHER):
            found = matches(batch.column("text"), index)
            rows = np.array(found, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows[:, 0])), ids.take(pa.array(rows[:, 1])), *(pa.array(rows[:, k].astype(np.int32)) for k in (2, 3, 4)), pa.array(np.array([len(index.words[i]) for i in rows[:, 1]], np.int32))],
                ["doc_id", "item_id", "edits", "first_word", "end_word", "item_words"],
            )

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = RECALL, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that match no item, unchanged."""
    out = docs
    for items in _slices(benchmark, item_col, "text"):
        index = build_index(items, similarity, recall)
        if index is None:
            continue

        def run(batches, index=index):
            for batch in tx.chunks(batches, text_col, TOGETHER):
                hit = {m[0] for m in matches(batch.column(text_col), index)}
                yield batch.filter(pa.array([r not in hit for r in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
