import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.llm import hyper_language

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "str ing ble ned orth", "cc": "été eau que oux ment", "δδ": "αβ γδ ληκ ος τις"}


def sentence(rnd, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = [(i, sentence(rnd, lang, rnd.choice([3, 8, 40, 400])), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    return [*out, (900, None, "aa"), (901, "", "bb"), (902, "12 34 -- !", "cc"), (903, sentence(rnd, "bb", 20_000), "bb"), (None, "kalo mitu", "aa"), (3, out[3][1], "δδ"), (904, "kalo mitu relo", None)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_edges(spark, rows):
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    found = hyper_language.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == held(r.doc_id) for r in found)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[904].lang_pred == "aa"
    tested = [(by_id[i].lang_pred, lang) for i, t, lang in rows if held(i) and i < 900]
    assert len(tested) > 30 and np.mean([a == b for a, b in tested]) > 0.97


def brute_vector(profiles, text):
    letters = [profiles.codes[ord(c)] for c in text.lower()]
    seq = [0]
    for c in [*letters, 0]:
        if c or seq[-1]:
            seq.append(int(c))
    total = np.zeros(profiles.letters.shape[1])
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        if b:
            total += np.roll(profiles.letters[a], 2) * np.roll(profiles.letters[b], 1) * profiles.letters[c]
    return total


def test_vectors_equal_brute_force():
    profiles = hyper_language.Profiles(256)
    texts = ["Hello, wörld", "", "a", "...", "aé  ñ!! ß", "x" * 50, "İstanbul ΑΣ"]
    bundles, letters = profiles.bundles(texts)
    assert letters.tolist() == [True, False, True, False, True, True, True]
    for row, text in zip(bundles, texts, strict=True):
        assert np.array_equal(row, brute_vector(profiles, text))


def test_slices_and_pieces_change_nothing(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) if rnd.random() < 0.97 else "。" for _ in range(3000)), sentence(rnd, "cc", 900), "x" * 500]
    whole, _ = hyper_language.Profiles(256).bundles(texts)
    monkeypatch.setattr(hyper_language, "_SLICE", 50)
    monkeypatch.setattr(hyper_language, "_MOST_GRAMS", 120)
    monkeypatch.setattr(hyper_language, "_CHUNK_CHARS", 400)
    cut, _ = hyper_language.Profiles(256).bundles(texts)
    assert np.array_equal(whole, cut)


def test_memory_of_a_text_of_many_letters_is_bounded():
    rnd = np.random.default_rng(0)
    text = "".join(map(chr, rnd.integers(0x4E00, 0x9FFF, 200_000)))
    profiles = hyper_language.Profiles(1024)
    tracemalloc.start()
    profiles.bundles([text] * 3)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in hyper_language.identify(docs, F.lit(False)).collect()] == [(1, False, "und", 0.0)]
    assert hyper_language.identify(docs.filter("doc_id < 0"), F.lit(False)).count() == 0
