"""Token ids of a corpus as binary blocks: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Files.  A corpus is a folder with two Parquet tables, which Spark commits as a whole and reads from any store:

* ``ranks``: the token id of each rank.  The most frequent id has rank 0; ids equally frequent rank by id, and ids that do not
  occur have no rank.
* ``blocks``: whole documents in ascending order of doc_id, about ``BLOCK_IDS`` ids a row.  ``shard`` and ``before`` (ids of the shard before
  the block) order the blocks; ``doc_ids`` and ``lengths`` are the block's index; ``control`` and ``data`` hold the ranks.  A rank takes one to
  four bytes, little-endian, in ``data``; its two bits in ``control`` (four ranks a byte, lowest bits first) hold that number less one, so the 256
  frequent ids take ten bits.  A numpy table of the 256 control bytes gives four lengths at a time, and no loop goes over ids.

Writing: documents are encoded once into a narrow table; its ids are counted; rows are exchanged by ranges of doc_id, and
each task writes the blocks of its range.  The driver receives one number a shard, and one row for each id of the vocabulary.

Encoding: where a tokenizer drops white space, words between ASCII white space are encoded apart and remembered, so that a worker
encodes each distinct part once (see ``parts``); ``words_apart`` tries whether a tokenizer is of this kind, and whole texts are encoded by
one that is not.

Defined results: null and empty texts have the end id alone; rows that repeat a doc_id are written each, ordered by their
ids' checksum; null ids come first; a long text is one block of its own; an empty table gives empty tables.  Ids of texts are below
2**32.  Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import terms
from quarry.llm import text as tx
from quarry.operators.lineage import scratch

BLOCK_IDS, END = 1 << 16, 2
#: Distinct words whose ids a worker remembers, and bytes of text it encodes at once.
REMEMBER, CHUNK_BYTES = 600_000, 2 << 20

#: For each control byte, the bytes that its four ranks take.
_LENGTHS = (((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1).astype(np.uint8)
_BLOCKS = "shard int, before long, doc_ids array<{0}>, lengths array<long>, control binary, data binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- the code ---------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = (ranks >= 1 << 8).view(np.uint8) + (ranks >= 1 << 16).view(np.uint8) + (ranks >= 1 << 24).view(np.uint8)
    lengths = codes[: len(ranks)] + np.uint8(1)
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    width = _width(lengths)
    data = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def _width(lengths: np.ndarray) -> int:
    """2 or 4 bytes that hold every rank of a block, whatever the code: half the work for vocabularies of up to 65,536 ids."""
    return 2 if not len(lengths) or lengths.max() <= 2 else 4


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    if len(raw) != (ends[-1] if n else 0):
        raise ValueError("control and data bytes do not fit")
    width = _width(lengths)
    out = np.zeros((n, width), np.uint8)
    out[np.arange(width) < lengths[:, None]] = raw
    return out.view(f"<u{width}").ravel()


# ---- encoding ---------------------------------------------------------------

_PROBES = ["Two words", "a\tb\nc", "don't  stop", " lead and trail ", "\u0301x \u0301y", "x 1 23 !? ...", "ΑΣ ΟΔΟΣ Σ", "日本 語", "end. (of) \"it\", so: 'quoted'; été? don't,'s a.b_c×d, ÷e!", "The END, THE end."]
_PLAIN = ["é", "éêeux", "größe", "àþÿñç", "a", "the", "abcdefghijklmnopqrstuvwxyz", "zqxjk", "tokenizer", "aaaaaaaaaaaaaaaa"]
_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
#: Words of a-z and the lower-case letters of U+00E0..U+00FF, which stay as they are and are one pre-token; their bytes as a byte-level model spells them.
_LOWER_LATIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+").fullmatch
_VISIBLE = dict(zip([b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)], range(256, 512)))
_SIGN = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~_LETTER & ~((_BYTES >= 0x30) & (_BYTES <= 0x39))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, and the part at which each text begins, and the end.

    Parts are words between ASCII white space, cut before an ASCII sign that follows a Latin letter, A-Z in lower case where a part is
    ASCII.  Words with ``<`` stay whole, as special tokens hold letters and signs.
    """
    data, offsets = tx._utf8(column)
    solid = terms.SOLID[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    opens[edges] = solid[edges]
    letter = _LETTER[data]
    # the second byte of U+00C0..U+017F but for the two signs among them and U+0130, whose lower case ends in a mark
    letter[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & (data[1:] >= 0x80) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))) & ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))
    cuts = np.zeros(len(data), bool)
    cuts[1:] = _SIGN[data[1:]] & letter[:-1]
    cuts[edges] = False
    if (data == 0x3C).any():
        word = np.cumsum(opens)
        special = np.zeros(word[-1] + 1, bool)
        special[word[data == 0x3C]] = True
        special = special[word]
        cuts &= ~special
    else:
        special = None
    opens |= cuts
    starts = np.flatnonzero(opens)
    kept = data[solid]
    at = np.append(np.cumsum(solid, dtype=np.int64)[starts] - 1, len(kept))
    high = np.append(0, np.cumsum((kept >= 0x80) | (False if special is None else special[solid]), dtype=np.int64))
    kept = np.where(np.repeat(high[at[1:]] == high[at[:-1]], np.diff(at)), terms.LOWER[kept], kept)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))])
    return words, np.searchsorted(starts, offsets)


def words_apart(tokenizer) -> bool:
    """Whether texts have the ids of their parts, one after the other, and words of lower-case Latin letters those that the model alone gives them; as far as the probes tell."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    apart = all(ids(t) == [i for p in parts(pa.array([t]))[0].to_pylist() for i in ids(p.decode())] for t in _PROBES)
    return apart and all(ids(w) == [t.id for t in tokenizer.model.tokenize(w.encode().decode("latin-1").translate(_VISIBLE))] for w in _PLAIN)


class Encoder:
    """Ids of the texts of Arrow columns; remembers the ids of parts."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.apart = words_apart(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}  # of parts, in the order in which they came
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        lists: list = [None] * len(new)
        alone, rest = self.tokenizer.model.tokenize, []
        for k, w in enumerate(new):
            if _LOWER_LATIN(w):
                lists[k] = [t.id for t in alone(w.decode("latin-1").translate(_VISIBLE))]
            else:
                rest.append(k)
        for k, ids in zip(rest, self._ids([new[k].decode() for k in rest]), strict=True):
            lists[k] = ids
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        self.flat = np.append(self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.uint32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if not self.apart:
            found = self._ids([t or "" for t in column.to_pylist()])
            return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        words, bounds = parts(column)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = np.fromiter(map(self.codes.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(code < 0)
        if len(self.codes) + len(new) > REMEMBER:
            self._forget()
            new = np.arange(len(distinct))
        if len(new):
            code[new] = np.arange(len(self.codes), len(self.codes) + len(new))
            self._learn([distinct[k] for k in new.tolist()])
        first, size = self.ends[code], np.diff(self.ends)[code]
        which = np.asarray(coded.indices)
        each = size[which]
        ends = np.cumsum(each)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - each), each)]
        return ids, np.diff(np.append(0, ends)[bounds])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, ids (little-endian, of ``width`` bytes each) and the checksum of the 32-bit ids; ``end`` closes every document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode = _encoder(tokenizer)
        for chunk in tx.chunks(batches, "text", CHUNK_BYTES):
            ids, sizes = encode(chunk.column("text"))
            if end is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
            ends = np.append(0, np.cumsum(sizes))
            little = ids.astype("<u4")
            sums = [zlib.crc32(little[a:b]) for a, b in itertools.pairwise(ends.tolist())]
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends * width), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), rows.cast(pa.binary()), pa.array(sums, pa.int64())], ["doc_id", "ids", "sum"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids binary, sum long")


def id_width(tokenizer: str, end: int | None = END) -> int:
    """Bytes that hold every id."""
    known = _tokenizer(tokenizer)
    return 2 if max([end or 0, *known.get_vocab(with_added_tokens=True).values()]) < 1 << 16 else 4


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of bytes, and how many each row has."""
    data, offsets = tx._utf8(column)
    return np.frombuffer(np.ascontiguousarray(data), f"<u{width}"), np.diff(offsets) // width


def counted(rows: DataFrame, width: int = 4) -> np.ndarray:
    """The ids that occur, most frequent first; the driver receives a row for each."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            counts = np.bincount(_numbers(batch.column("ids"), width)[0], minlength=len(total))
            counts[: len(total)] += total
            total = counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(found, key=lambda r: (-r["n"], r["id"]))], np.uint32)


# ---- files ------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the documents' ids under path."""
    spark = docs.sparkSession
    width = id_width(tokenizer, end)
    narrow = encoded(docs, tokenizer, end, id_col, text_col, width)
    narrow.write.option("compression", "zstd").parquet(at := scratch(spark, "ids"))
    rows = spark.read.schema(narrow.schema).parquet(at)
    order = counted(rows, width)
    # one row an id of the vocabulary
    spark.createDataFrame(pa.table({"rank": np.arange(len(order), dtype=np.int64), "id": order.astype(np.int64)})).coalesce(1).write.parquet(f"{path}/ranks")
    ranks = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    ranks[order] = np.arange(len(order))
    held = spark.sparkContext.broadcast(ranks)

    def run(batches):
        shard, before, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            part = pa.Table.from_batches(waiting).combine_chunks()
            ids, lengths = _numbers(part.column("ids").combine_chunks(), width)
            control, data = pack(held.value[ids])
            one = [pa.array([shard], pa.int32()), pa.array([before], pa.int64())]
            lists = [pa.ListArray.from_arrays([0, len(part)], x) for x in (part.column("doc_id").combine_chunks(), pa.array(lengths))]
            return pa.RecordBatch.from_arrays([*one, *lists, pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "before", "doc_ids", "lengths", "control", "data"]), len(ids)

        for batch in batches:
            sizes = np.asarray(pa.compute.binary_length(batch.column("ids")), np.int64) // width
            a = 0
            for b, n in enumerate(sizes.tolist()):
                if size and size + n > block_ids:
                    if b > a:
                        waiting.append(batch.slice(a, b - a))
                    made, n_ids = block()
                    yield made
                    before, waiting, size, a = before + n_ids, [], 0, b
                size += n
            if len(sizes) > a:
                waiting.append(batch.slice(a))
        if waiting:
            yield block()[0]

    kind = rows.schema["doc_id"].dataType.simpleString()
    # the row number keeps rows that repeat an id and its text from one range
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("doc_id", "sum", "_row").sortWithinPartitions("doc_id", "sum", "_row").select("doc_id", "ids")
    ranged.mapInArrow(run, _BLOCKS.format(kind)).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, of every document of the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # a number a shard: the ids of its last block and before it
    ends = blocks.groupBy("shard").agg(F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    firsts = dict(zip([r["shard"] for r in ends], itertools.accumulate([r["n"] for r in ends], initial=0)))
    # at most one row an id of the vocabulary
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    held = spark.sparkContext.broadcast((firsts, np.array([r["id"] for r in table], "<u4")))
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        first, id_of = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before, control, data = (batch.column(c)[k].as_py() for c in ("shard", "before", "control", "data"))
                lengths = np.asarray(batch.column("lengths")[k].values, np.int64)
                ends = np.append(0, np.cumsum(lengths))
                ids = id_of[unpack(control, data, int(ends[-1]))]
                sums = [zlib.crc32(ids[a:b]) for a, b in itertools.pairwise(ends)]
                out = [batch.column("doc_ids")[k].values, pa.array(first[shard] + before + ends[:-1]), pa.array(lengths), pa.array(sums, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.mapInArrow(run, schema)


def op13_token_output(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the files that hold the ids of all documents."""
    path = scratch(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return read(spark, path, with_ids=False)
