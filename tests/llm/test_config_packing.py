import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from intervalis.llm import config_packing as C
from intervalis.llm import word_bpe
from intervalis.llm.queries import word_tokenizer_path


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(word_tokenizer_path())


def ids_of(encoder, text):
    return np.concatenate(list(encoder.parts(text))).tolist()


def test_ids_equal_the_tokenizer_file(whole, monkeypatch):
    rnd = random.Random(4)
    encoder = word_bpe.WordEncoder(word_tokenizer_path())
    texts = ["", " ", "a<|endoftext|>b", "Don't 'S 'll ''s", "ÉTÉ été é Å ﬁ", "ΣΑΣ σας", "İstanbul", "東京 x", "a\x1cb\x85c\xa0d", "½²3 x_y __", "😀!", "​ x"]
    texts += ["".join(rnd.choice("aB '1.\n\té!Ωж_²’") for _ in range(60)) for _ in range(300)]
    texts += [chr(c) + "a" + chr(c) + "1" for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert ids_of(encoder, t) == whole.encode(t, add_special_tokens=False).ids, repr(t)
    monkeypatch.setattr(word_bpe, "SEGMENT", 50)
    monkeypatch.setattr(word_bpe, "REMEMBERED", 3)
    for t in (" ".join(texts[4:30]), "x" * 500, " ".join(["é", "one", "'s", "Two"] * 60)):
        assert ids_of(encoder, t) == whole.encode(t, add_special_tokens=False).ids


def placed(plan):
    got = Counter()
    for config, n in plan:
        for length, copies in config:
            got[length] += n * copies
    return got


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_exact_and_near_the_bound(seed):
    rnd = np.random.default_rng(seed)
    sizes = [rnd.integers(1, 4097, 700), rnd.geometric(1 / 600, 1500).clip(1, 4096), rnd.choice([1366, 1367, 2049, 2047, 1000, 1500, 100], 4000), rnd.integers(700, 2100, 3000)][seed]
    histogram = dict(Counter(sizes.tolist()))
    plan = C.plan(histogram)
    assert placed(plan) == Counter(histogram) and all(sum(n * c for n, c in config) <= 4096 for config, _ in plan)
    lengths = np.array(sorted(histogram, reverse=True))
    plain = sum(n for _, n in C.best_fit_decreasing(lengths, np.array([histogram[n] for n in lengths]), 4096))
    assert sum(n for _, n in plan) <= plain


def test_the_program_beats_best_fit_where_lengths_must_be_matched():
    """Three of 1365 and less fill a sequence that best fit decreasing wastes on pairs of long ones."""
    rnd = np.random.default_rng(0)
    sizes = rnd.integers(700, 2100, 6000)
    histogram = dict(Counter(sizes.tolist()))
    lengths = np.array(sorted(histogram, reverse=True))
    plain = sum(n for _, n in C.best_fit_decreasing(lengths, np.array([histogram[n] for n in lengths]), 4096))
    assert sum(n for _, n in C.plan(histogram)) < plain


def test_large_counts_take_no_longer():
    """A histogram of billions: configurations are used many times at once."""
    histogram = {n: 10**7 + n for n in range(50, 4000, 97)} | {4096: 10**9, 1: 5}
    plan = C.plan(histogram)
    total = sum(n * c for n, c in histogram.items())
    assert placed(plan) == Counter(histogram) and len(plan) < 5000
    assert sum(n for _, n in plan) < 1.02 * total / 4096


def test_knapsack_against_all_fillings():
    rnd = random.Random(1)
    for _ in range(30):
        lengths = np.array(rnd.sample(range(1, 12), 4))
        most, prices = np.array([rnd.randrange(1, 4) for _ in lengths]), np.array([rnd.random() for _ in lengths])
        best = max(sum(p * c for p, c in zip(prices, cs, strict=True)) for cs in np.ndindex(*(most + 1)) if lengths @ np.array(cs) <= 20)
        table = C.Knapsack(lengths, most, prices, 20)
        config = table.within(20)
        assert all(c <= most[k] for k, c in config.items()) and sum(lengths[k] * c for k, c in config.items()) <= 20
        assert abs(sum(prices[k] * c for k, c in config.items()) - best) < 1e-9 and table.best == pytest.approx(best)


def check(rows, pieces, whole, capacity=4096):
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    seen, sequences = Counter(), defaultdict(list)
    for p in pieces:
        assert p.start == p.piece * capacity
        assert any(zlib.crc32(np.array(d[p.start : p.start + capacity], "<u4").tobytes()) == p.ids_crc32 and len(d[p.start : p.start + capacity]) == p.length for d in ids[p.doc_id])
        seen[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert seen == Counter({i: sum(map(len, d)) for i, d in ids.items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_cover_documents_and_fill_sequences(spark, whole):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["alpha", "Beta", "gamma,", "δέλτα"]) for _ in range(rnd.choice([0, 1, 5, 100, 900, 5000])))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (202, "x y " * 50_000), (203, "a " * 4095), (204, "a " * 4096)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, task int").repartition(3)
    check(rows, C.pack_best(docs, word_tokenizer_path()).collect(), whole)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_whole_table_meets_the_bound(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = C.pack_best(docs, word_tokenizer_path()).collect()
    used = check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], pieces, whole)
    assert used == -(-sum(p.length for p in pieces) // 4096)


def test_empty_table(spark):
    assert C.pack_best(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer_path()).count() == 0
