"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers, floor(scale * x), and cut into blocks of rows
ordered by id.  A block keeps, per dimension, one bitmap per bit of the shifted
value (value - minimum), held as Python integers, so one operation handles the
whole block.  For a query the slices of each dimension are added with the weight of
that dimension by carry-save bitmap adders; a negative weight adds complemented
slices, which changes the sum by a constant.  The rows with the k largest sums are
selected from the most significant result slice downward.

``drop_bits`` low slices of the attributes are left out of the sum, which makes it a
quantised score; the Cauchy-Schwarz bound of what was left out gives each block a
margin, every row within the margin of the k-th quantised score is a boundary
row, and boundary rows are scored exactly from the integers.  Among equal scores the
smaller id wins.

Blocks: rows are dealt to blocks by a hash of id and vector; each block's bitmaps are built once,
and all queries stream past it in the order of the sort, so a task holds one block and one
Arrow batch of queries, and rows are exchanged once, however many queries there are.  Rows that repeat
both id and vector are counted before they are dealt, and k of them stand for all, which
loses nothing.  A block returns at most k rows a query; the k best of all blocks remain.

Wide vectors, whose scaled squares sum to 2**62 or more, travel unscaled and are multiplied in Python integers, which
never wrap; all others are scored in 64 bits, where they cannot.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part, neither as queries nor as candidates; nor do rows without a vec_id, as they could not be
named in a result; vectors of another length than the query's are not its candidates; with
fewer than k candidates all are returned; rows that repeat a vec_id are candidates each, except
those with the query's own id; a repeated query id is searched once, with the least of its
vectors (of those that are not wide, if it has any); scores beyond 64 bits rank by their exact values and are given as the
nearest 64-bit integer.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most, about, and at least where fewer blocks would leave cores idle.
BLOCK_ROWS, LEAST_ROWS = 32768, 1024
#: Bytes of the key that orders scores beyond 64 bits: twice a double's exponent range, the scale and the sum.
_KEY_BYTES = 288


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the vector of the rows that take part: ``v`` (scaled, array of long), or ``wide`` (as it was) where 64 bits could overflow."""
    x, by = F.col("x"), F.lit(float(scale))
    fine = F.col("x").isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    squares = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + by * c * by * c)
    narrow = squares < F.lit(2.0**62)
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull())
        .where(fine).select("vec_id", F.when(narrow, F.transform("x", lambda c: F.floor(by * c))).alias("v"), F.when(~narrow, x).alias("wide"))
    )


def _scaled(vector: list[float], scale: int) -> list[int]:
    """floor(scale * x) in Python integers; doubles from 2**52 on are integers."""
    return [int(c) * scale if abs(c) >= 2.0**52 else math.floor(scale * c) for c in vector]


class BitSlicedBlock:
    """Bit slices of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, drop_bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        wide = self.vectors.dtype == object  # Python integers
        self.n, self.d = self.vectors.shape
        self.low = int(self.vectors.min()) if self.n and self.d else 0
        span = int(self.vectors.max()) - self.low if self.n and self.d else 0
        self.drop = 0 if wide else min(drop_bits, max(0, span.bit_length() - 1))
        shifted = self.vectors - self.low
        top = shifted >> self.drop
        self.bits = max(1, (span >> self.drop).bit_length())
        self.full = (1 << self.n) - 1
        self.slices = [[self._bitmap((top[:, j] >> b) & 1) for b in range(self.bits)] for j in range(self.d)]
        self.rest = 0.0
        if self.drop and self.n:
            rest = (shifted - (top << self.drop)).astype(np.float64) - ((1 << self.drop) - 1) / 2
            self.rest = float(np.sqrt((rest**2).sum(1).max()))

    @staticmethod
    def _bitmap(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "little")

    def _sum(self, query: list[int]) -> list[int]:
        """Result slices, least significant first, of sum |q_j| * (top_j, or its complement where q_j < 0)."""
        columns: list[list[int]] = []
        for j, q in enumerate(query):
            if not q:
                continue
            slices = self.slices[j] if q > 0 else [s ^ self.full for s in self.slices[j]]
            q, shift = abs(q), 0
            while q:
                if q & 1:
                    while len(columns) < shift + self.bits:
                        columns.append([])
                    for b, s in enumerate(slices):
                        columns[shift + b].append(s)
                q >>= 1
                shift += 1
        out = []
        at = 0
        while at < len(columns):
            column = columns[at]
            carries = []
            while len(column) >= 3:  # a full adder turns three slices of a weight into one, and one of twice the weight
                kept = []
                m = len(column) - len(column) % 3
                for i in range(0, m, 3):
                    a, b, c = column[i], column[i + 1], column[i + 2]
                    x = a ^ b
                    kept.append(x ^ c)
                    carries.append((a & b) | (x & c))
                column = kept + column[m:]
            if len(column) == 2:
                a, b = column
                carries.append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else 0)
            if carries:
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1] += carries
            at += 1
        return out

    def _top(self, slices: list[int], k: int, among: int) -> tuple[int, int]:
        """Rows surely in the top k, and the rows tied at the boundary, from the most significant slice down."""
        sure, tied = 0, among
        for s in reversed(slices):
            both = sure | (tied & s)
            if (n := both.bit_count()) > k:
                tied &= s
            else:
                if n <= k:
                    sure = both
                tied &= ~s & self.full
                if n == k:
                    tied = 0
                    break
        return sure, tied

    def _at_least(self, slices: list[int], bound: int, among: int) -> int:
        """Rows whose sum is at least the bound."""
        if bound <= 0:
            return among
        if bound >> len(slices):
            return 0
        above, equal = 0, among
        for b in range(len(slices) - 1, -1, -1):
            if bound >> b & 1:
                equal &= slices[b]
            else:
                above |= equal & slices[b]
                equal &= ~slices[b] & self.full
        return above | equal

    def _rows(self, bitmap: int) -> np.ndarray:
        raw = np.frombuffer(bitmap.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")[: self.n])

    def _value(self, slices: list[int], row: int) -> int:
        return sum(1 << b for b, s in enumerate(slices) if s >> row & 1)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the block."""
        if len(query) != self.d:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        among = self.full
        a, b = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        if b > a:
            among &= ~(((1 << int(b - a)) - 1) << int(a))
        slices = self._sum(query.tolist())
        if self.drop:
            sure, tied = self._top(slices, k, among)
            chosen = sure | tied
            if chosen.bit_count() > k:
                kth_row = (tied & -tied).bit_length() - 1 if tied else None
                kth = self._value(slices, kth_row) if kth_row is not None else None
            else:
                kth = None
            if chosen.bit_count() >= k and chosen:
                if kth is None:
                    kth = min(self._value(slices, int(r)) for r in self._rows(chosen))
                # |left out| <= |q| * rest on either side, in units of 2**drop
                if query.dtype == object:
                    norm = math.isqrt(sum(q * q for q in query.tolist())) + 1
                    margin = 2 * norm * math.ceil(self.rest) // (1 << self.drop) + 3
                else:
                    margin = int(np.ceil(2 * float(np.sqrt((query.astype(np.float64) ** 2).sum())) * self.rest / (1 << self.drop))) + 2
                rows = self._rows(self._at_least(slices, kth - margin, among))
            else:
                rows = self._rows(among)
        else:
            sure, tied = self._top(slices, k, among)
            left = k - sure.bit_count()
            rows = self._rows(sure)
            picked = []
            while tied and left > 0:  # rows are in order of id
                bit = tied & -tied
                picked.append(bit.bit_length() - 1)
                tied ^= bit
                left -= 1
            rows = np.concatenate([rows, np.array(picked, np.int64)]).astype(np.int64)
        scores = self.vectors[rows] @ query
        if scores.dtype == object:
            best = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        else:
            best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def _matrices(batch: pa.RecordBatch, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors, by vector length; those of wide vectors hold Python integers."""
    out = []
    ids = np.asarray(batch.column("vec_id"))
    lists = batch.column("v")
    valid = np.asarray(lists.is_valid())
    lengths = np.asarray(pa.compute.fill_null(lists.value_lengths(), 0))
    values = np.asarray(lists.flatten()).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == d))
        out.append((ids[rows], values[starts[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0), np.int64)))
    by_length: dict[int, list[int]] = {}
    for row in np.flatnonzero(~valid).tolist():
        by_length.setdefault(len(batch.column("wide")[row]), []).append(row)
    for d, rows in by_length.items():
        vectors = np.empty((len(rows), d), object)
        for i, row in enumerate(rows):
            vectors[i] = _scaled(batch.column("wide")[row].as_py(), scale)
        out.append((ids[rows], vectors))
    return out


def _found(query_id: int, ids: np.ndarray, scores: np.ndarray, out: list) -> None:
    for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
        far = abs(s) >= 1 << 62
        key = (s + (1 << (8 * _KEY_BYTES - 1))).to_bytes(_KEY_BYTES, "big") if far else None
        out.append((query_id, i, max(-(1 << 63), min((1 << 63) - 1, s)), key))


def _searched(k: int, scale: int, drop_bits: int):
    """Rows and queries in order of (block, is_query): the k best rows of each block for each query."""
    names = ["query_id", "vec_id", "score", "score_key"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("score_key", pa.binary())])

    def built(parts: list[pa.RecordBatch]) -> list[BitSlicedBlock]:
        if not parts:
            return []
        held = pa.Table.from_batches(parts).combine_chunks().to_batches()
        return [BitSlicedBlock(ids, vectors, drop_bits) for b in held for ids, vectors in _matrices(b, scale)]

    def run(batches):
        block, pending, indexes = None, [], None
        for batch in batches:
            keys = np.asarray(batch.column("block")) * 2 + np.asarray(batch.column("is_query").cast(pa.int8()))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
            for a, b in itertools.pairwise(cuts):
                part = batch.slice(a, b - a)
                now, asked = divmod(int(keys[a]), 2)
                if now != block:
                    block, pending, indexes = now, [], None
                if not asked:
                    pending.append(part)
                    continue
                if indexes is None:
                    indexes, pending = built(pending), []
                out: list = []
                for ids, vectors in _matrices(part, scale):
                    for q, vector in zip(ids.tolist(), vectors, strict=True):
                        for index in indexes:
                            wide = index.vectors.dtype == object or vector.dtype == object
                            _found(q, *index.search(q, vector.astype(object) if wide else vector, k), out)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(4)], names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", drop_bits: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for every query, exactly."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vector_col)
    asked = quantised(queries, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"), F.min("wide").alias("wide"))
    asked = asked.select("vec_id", "v", F.when(F.col("v").isNull(), F.col("wide")).alias("wide"))
    n_rows = rows.count()
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-n_rows // BLOCK_ROWS), min(cores, n_rows // LEAST_ROWS))
    # k rows of one id and vector stand for any number of them
    single = rows.groupBy("vec_id", "v", "wide").agg(F.count(F.lit(1)).alias("n"))
    left = single.select(
        F.pmod(F.xxhash64("vec_id", "v", "wide"), F.lit(blocks)).alias("block"), F.lit(False).alias("is_query"), "vec_id", "v", "wide",
        F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(k)).cast("int"))).alias("copy"),
    ).drop("copy")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"), F.lit(True).alias("is_query"), "vec_id", "v", "wide")
    parts = min(blocks, cores)
    dealt = left.unionByName(right).repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "is_query")
    found = dealt.mapInArrow(_searched(k, scale, drop_bits), "query_id long, vec_id long, score long, score_key binary")
    # a block gives at most k rows a query; the rank limit also prunes before the exchange
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("score_key"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5
"""
