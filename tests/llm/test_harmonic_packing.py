import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from intervalis.llm.harmonic_packing import Bins, Encoder, cut, pack_documents
from intervalis.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizer_file(whole):
    rnd = random.Random(3)
    texts = ["", " ", "a<|endoftext|>b", "  x\n\n y \n", "tab\tx\x0b", "x\r\ny", "don't 's", "東京 été 😀", "a b c"]
    texts += ["".join(rnd.choice("ab '1.\n\té!Ω") for _ in range(40)) for _ in range(300)]
    encoder = Encoder(tokenizer_path())
    assert encoder.fast is not None
    assert [encoder.encode(t).tolist() for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_cut():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        assert sum(cut(n)) == n and all(x < 128 or x & (x - 1) == 0 for x in cut(n)) and cut(n) == sorted(cut(n), reverse=True)
        assert len(cut(n)) <= n // 2048 + 5


def test_bins_take_a_fixed_count_of_their_class():
    rnd, bins, sizes = random.Random(1), Bins(0), {}
    placed = []
    for k in range(20_000):
        sizes[k] = rnd.choice([2048, 1024, 256, rnd.randrange(1, 128)])
        placed += bins.add(sizes[k], (k,))
    count, of_bin = len(placed), defaultdict(list)
    for (k,), number, offset in [*placed, *bins.rest()]:
        of_bin[number].append((offset, k))
    full = {number for _, number, _ in placed}
    assert sorted(k for v in of_bin.values() for _, k in v) == list(range(20_000)) and count > 18_000
    for number, parts in of_bin.items():
        kinds = {min(2048 // sizes[k], 256) for _, k in parts}
        assert sum(sizes[k] for _, k in parts) <= 2048 and (number not in full or kinds == {len(parts)})


def test_a_very_long_run_of_blanks(whole):
    text = " " * 2_000_000 + "x"
    assert Encoder(tokenizer_path()).encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_cover_documents_and_fill_sequences(spark, whole):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma,", "δέλτα"]) for _ in range(rnd.choice([0, 1, 5, 100, 900, 5000])))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (202, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    pieces = pack_documents(docs, tokenizer_path(), with_ids=True).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    seen, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        assert any(d[p.start : p.start + p.length] == p.ids and len(d) == p.doc_tokens for d in ids[p.doc_id])
        seen[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert seen == {i: sum(map(len, d)) for i, d in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = [sum(n for _, n in parts) for parts in sequences.values()]
    padded = sum(2048 - n for n in used if n & (n - 1))
    assert padded < 0.1 * sum(used)  # of three small splits; see the next test


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_padding_and_pieces_of_whole_table(spark):
    pieces = pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path())
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).selectExpr("sum(n) as n", "sum(if(n & (n - 1) = 0, 0, 2048 - n)) as pad").first()
    assert used.pad < 0.02 * used.n and pieces.filter("length < 2048").count() < 3.5 * 1000


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
