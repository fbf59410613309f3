"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents and marks, maps homoglyphs of other scripts, styled letters and digit
substitutions to Latin letters, drops invisible characters and turns everything else
that is no letter, whatever its code point, into spaces.  One automaton pass finds whole words (`` idiot ``) and word
beginnings (`` lowei``); exception phrases around a match take its weight back.  The summed
weight, and the weight per word of the text, enter a logistic function.

Lexicon, exceptions and the logistic's three numbers are fitted on labelled rows: at most
``sample_rows`` of each class, the first in order of a hash of their id.  That bound is the one
limit of the fit: every word, beginning and phrase of the sampled rows that passes the thresholds enters, so what is
sent to executors is bounded by the sample.  Scoring reads every whole text.  Near copies count once in the fit, so words of a copied toxic document
are not taken for toxic words: sampled rows whose minimum hashes of five-word shingles agree in one of ``BANDS`` bands are a group,
transitively, and a group's smallest id of each class stays.

Defined results: null and empty texts score as texts without matches; rows with null ids or
without labels are scored like others; a document with contradicting labels counts as toxic in
the fit, and of several texts of an id the least is read; without labels of both classes every score is 0.  Repeated rows are scored each;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx

#: Labelled rows of each class that the fit may read.
SAMPLE_ROWS = 5000
#: Bands of minimum hashes and hashes of a band, by which near copies in the sample are known.
BANDS, BAND_ROWS = 6, 2
#: Word beginnings of these lengths may enter the lexicon.
PREFIXES = (4, 5, 6, 7)
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pathetic fallacy")

#: Letters of other scripts that look like Latin ones, and what they are read as.
_LOOKALIKES = dict(zip("аеорсхуіјѕһԁɡνκτιοαρυвмнкт", "aeopcxyijshdgvktioapybmhkt", strict=True))
_DIGITS = dict(zip("0134578@", "oieastba", strict=True))


class _Folds(dict):
    """Folds of code points, each worked out when it is first met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me"):
            out = None
        elif kind == "Mc":
            out = c  # vowel signs that stand beside their letter
        else:
            base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(x) != "Mn")
            read = "".join(_LOOKALIKES.get(x, _DIGITS.get(x, x)) for x in base)
            out = "".join(x if x.isalpha() else " " for x in read) or " "
        self[code] = out
        return out


_TABLE = _Folds()


def fold(text: str | None) -> str:
    """Folded text, with a space before and after."""
    return " " + (text or "").translate(_TABLE) + " "


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # pattern, as matched in folded text, to weight
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    per_sum: float = 0.0
    per_density: float = 0.0
    fitted: bool = False
    rows: tuple[int, int] = (0, 0)  # clean and toxic rows that the fit used

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.lexicon.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            folded = fold(phrase)
            if any(p in folded for p in self.lexicon):
                found.add_word(folded, (len(folded), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(total))
        z = self.bias + self.per_sum * np.log1p(total) + self.per_density * np.log1p(100 * total / (words + 20))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def uncovered(found: list[tuple[int, tuple[int, float | None]]]) -> float:
    """Summed weight of the matches that lie in no exception; each match counts once, however many exceptions overlap there."""
    exceptions = sorted((end - size, end) for end, (size, weight) in found if weight is None)
    if not exceptions:
        return sum(weight for _, (_, weight) in found)
    starts, furthest = [s for s, _ in exceptions], list(itertools.accumulate((e for _, e in exceptions), max))
    total = 0.0
    for end, (size, weight) in found:
        if weight is not None:
            k = bisect.bisect_right(starts, end - size)
            total += weight if not k or furthest[k - 1] < end else 0.0
    return total


def weigh(automaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Summed weight and number of words of each text."""
    totals, words = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text:
            continue
        folded = fold(text)
        # the automaton sees one space between words
        words[i] = len(pieces := folded.split())
        if len(automaton):
            totals[i] = max(0.0, uncovered(list(automaton.iter(" " + " ".join(pieces) + " "))))
    return totals, words


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def _band_keys(text: str) -> list[int]:
    """Keys of the bands of minimum hashes of the text's five-word shingles (fewer words: the whole)."""
    import xxhash

    words = fold(text).split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
    least = [tx.mix(hashes ^ tx.mix(np.array([k + 1], np.uint64))).min() for k in range(BANDS * BAND_ROWS)]
    return [xxhash.xxh64_intdigest(np.array([b, *least[b * BAND_ROWS : (b + 1) * BAND_ROWS]], np.uint64).tobytes()) - (1 << 63) for b in range(BANDS)]


def _banded(batches):
    for batch in tx.chunks(batches, "text"):
        keys = [_band_keys(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "toxic", "bands"])


def _representatives(rows: list) -> list:
    """The smallest id of each class in each group of rows (doc_id, toxic, bands) that share a band."""
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        for key in r.bands:
            root[find(i)] = find(first.setdefault(key, i))
    kept: dict[tuple[int, int], object] = {}
    for i, r in enumerate(rows):
        at = find(i), r.toxic
        kept[at] = min(kept.get(at, r.doc_id), r.doc_id)
    return sorted(kept.values())


#: Features a worker counts before it sends them on.
HELD_FEATURES = 50_000


def _features(batches):
    counts: dict[str, list[int]] = {}
    seen = [0, 0]

    def sent() -> pa.RecordBatch:
        # rare words of one stretch may add up elsewhere, so all are sent
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "clean", "toxic"]
        )
        counts.clear()
        return batch

    for batch in tx.chunks(batches, "text"):
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[toxic] += 1
            own = set()
            for w in set(fold(text).split()):
                if len(w) >= 3:
                    own.add(f" {w} ")
                for n in PREFIXES:
                    if len(w) > n:
                        own.add(f" {w[:n]}")
            for f in own:
                counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) >= HELD_FEATURES:
                yield sent()
    counts[""] = seen
    yield sent()


def _around(lexicon: dict[str, float]):
    def run(batches):
        automaton = Model(lexicon=lexicon).automaton()
        counts: dict[str, list[int]] = {}
        for batch in tx.chunks(batches, "text"):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pieces = fold(text).split()
                own = set()
                for i, w in enumerate(pieces):
                    if len(automaton) and any(True for _ in automaton.iter(f" {w} ")):
                        if i:
                            own.add(f"{pieces[i - 1]} {w}")
                        if i + 1 < len(pieces):
                            own.add(f"{w} {pieces[i + 1]}")
                for f in own:
                    counts.setdefault(f, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["phrase", "clean", "toxic"])

    return run


def _totals(model: Model):
    def run(batches):
        automaton = model.automaton()
        for batch in tx.chunks(batches, "text"):
            totals, words = weigh(automaton, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(totals), pa.array(words)], ["toxic", "total", "words"])

    return run


def _pruned(rows: list) -> dict[str, float]:
    """A word beginning replaces its extensions where it covers clearly more; else the extensions stay."""
    by = {r.feature: r for r in rows}
    prefixes = sorted((f for f in by if not f.endswith(" ")), key=len)
    out: dict[str, float] = {}
    taken: set[str] = set()
    covered = lambda f: any(f[:n] in taken for n in range(2, len(f) + 1))
    best_extension: dict[str, int] = {}
    for f, r in by.items():
        w = f.strip()
        for n in range(3, len(w) + (1 if f.endswith(" ") else 0)):
            p = f" {w[:n]}"
            best_extension[p] = max(best_extension.get(p, 0), r.toxic)
    for p in prefixes:
        if not covered(p) and by[p].toxic > 1.25 * best_extension.get(p, 0):
            taken.add(p)
            out[p] = by[p].weight
    for f, r in by.items():
        if f.endswith(" ") and not covered(f):
            out[f] = r.weight
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a logistic regression with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, min_documents: int = 3, min_weight: float = 1.2, exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Fit on labelled rows that are not held out; the sample is bounded by ``sample_rows`` of each class."""
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(sample_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample_rows))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most 2 * sample_rows ids, so this side is broadcast whatever the corpus
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sampled = rows.select("doc_id", "toxic", "text").persist()
    try:
        id_type = sampled.schema["doc_id"].dataType.simpleString()
        # at most 2 * sample_rows rows of a few hashes
        banded = sampled.mapInArrow(_banded, f"doc_id {id_type}, toxic int, bands array<bigint>").collect()
        kept = docs.sparkSession.createDataFrame([(i,) for i in _representatives(banded)], f"kept_id {id_type}")
        single = sampled.join(F.broadcast(kept), F.col("doc_id") == F.col("kept_id")).select("toxic", "text")
        parts = single.mapInArrow(_features, "feature string, clean long, toxic long")
        counts = parts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        seen = counts.where("feature = ''").collect()
        if not seen or not seen[0].clean or not seen[0].toxic:
            return Model()
        n_clean, n_toxic = seen[0].clean, seen[0].toxic
        # log odds, less 1.96 standard errors: words seen in a few documents prove little
        weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1)) - 1.96 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        chosen = (
            counts.where((F.col("feature") != "") & (F.col("toxic") >= min_documents)).withColumn("weight", weight).where(F.col("weight") >= min_weight)
            .collect()
        )
        lexicon = dict(sorted(_pruned(chosen).items(), key=lambda x: (-x[1], x[0])))
        phrases = (
            single.mapInArrow(_around(lexicon), "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .where(F.col("clean") >= F.lit(3) + 4 * F.col("toxic")).orderBy(F.desc("clean"), "phrase").collect()
        )
        model = Model(lexicon, [*exceptions, *(r.phrase for r in phrases)], rows=(n_clean, n_toxic))
        points = single.mapInArrow(_totals(model), "toxic int, total double, words double").collect()  # at most 2 * sample_rows
    finally:
        sampled.unpersist()
    y = np.array([p.toxic for p in points], float)
    x = np.array([[math.log1p(p.total), math.log1p(100 * p.total / (p.words + 20))] for p in points])
    beta = _logistic(x, y)
    model.bias, model.per_sum, model.per_density, model.fitted = float(beta[0]), float(beta[1]), float(beta[2]), True
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""

    def run(batches):
        automaton = model.automaton()
        for batch in tx.chunks(batches, "text"):
            totals, words = weigh(automaton, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(totals, words))], ["doc_id", "score"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, unchanged."""

    def run(batches):
        automaton = model.automaton()
        for batch in tx.chunks(batches, text_col):
            totals, words = weigh(automaton, batch.column(text_col).to_pylist())
            yield batch.filter(pa.array(model.score(totals, words) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
