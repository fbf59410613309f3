import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_output as to
from quarry.operators.lineage import scratch

WORDS = Tokenizer.from_file(to.tokenizer_path())
PIECES = ["The", "don't", "END.", "(of)", "ÉTÉ,", "a×b", "J̌,", "J\u030c.", "<b>X.</b>", "a<|startoftext|>B.", ",'s", "'", "a.b-c", "été", "é", "́", "ΟΔΟΣ", "İI", "日本語", "12", "3.5", "!?", "…", " ", " ", "\u0085", "\x1c", "<|endoftext|>", "</w>", "x" * 300, "😀", "​", "ﬁ", "가", "가"]


def sample(rng, n):
    return "".join(rng.choice(PIECES) + rng.choice(["", " ", "\n", "\t ", "  "]) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, data = to.pack(ranks)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in ranks)
    assert (to.unpack(control, data, n) == ranks).all()
    assert to.unpack(*to.pack(np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1])), 8).tolist() == [0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]


def test_words_encoded_apart_are_the_texts_ids():
    import public_tokenizers
    import pyarrow as pa

    encode = to.Encoder(to.tokenizer_path())
    assert encode.apart
    rng = random.Random(3)
    for _ in range(60):
        texts = [rng.choice([None, "", " \n", sample(rng, rng.randint(0, 30))]) for _ in range(8)]
        ids, sizes = encode(pa.array(texts, pa.string()))
        want = [WORDS.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    # a tokenizer that keeps white space encodes whole texts
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = to.Encoder(path)
    assert not other.apart
    ids, _ = other(pa.array(["two words", None, " x\n"]))
    assert ids.tolist() == [i for t in ("two words", " x\n") for i in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids]


def test_every_lower_case_latin_letter():
    import pyarrow as pa

    encode = to.Encoder(to.tokenizer_path())
    letters = [chr(c) for c in range(0x61, 0x180)]
    texts = [f"a{c}b {c} {c}{c}, x{c}" for c in letters] + ["".join(letters)]
    assert encode(pa.array(texts))[0].tolist() == [i for t in texts for i in WORDS.encode(t, add_special_tokens=False).ids]


def brute(rows, end=2):
    out, at = [], 0
    table = []
    for i, t in rows:
        ids = [*WORDS.encode(t or "", add_special_tokens=False).ids, end]
        table.append((i, zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    for i, crc, ids in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.append((i, at, len(ids), crc, ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("block", [1, 50, 1 << 16])
def test_files_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, sample(rng, rng.randint(0, 40))) for i in rng.sample(range(-50, 5000), 120)]
    rows += [(6000, None), (6001, ""), (6002, "long text, " * 30_000), (7, "again"), (7, "again"), (7, "and again"), (None, "no id"), (None, None)]
    rng.shuffle(rows)
    path = scratch(spark, "test")
    to.write(spark.createDataFrame([(*r, [1], 5) for r in rows], "doc_id long, text string, ids array<int>, shard int").repartition(4), path, to.tokenizer_path(), block_ids=block)
    got = sorted((tuple(r) for r in to.read(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    ranks = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    counts = np.bincount([i for r in got for i in r[4]])
    assert ranks == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_empty_table(spark):
    path = scratch(spark, "test")
    to.write(spark.createDataFrame([], "doc_id long, text string"), path, to.tokenizer_path())
    assert to.read(spark, path).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in to.op13_token_output(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == [r[:4] for r in brute(rows)]
