import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from intervalis.plans.scratch import materialize
from tests.llm.test_bootstrap_pii import brute as pii_spans
from tests.llm.test_parity_join import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rnd = random.Random(9)
    words = {"en": ["the", "house", "stone", "walking", "brother"], "fr": ["été", "maison", "quel", "frère", "marche"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rnd.choice(words[lang]) + rnd.choice(["", "s", "er"]) for _ in range(rnd.choice([4, 40, 200])))
        rows.append([i, text, lang, rnd.choice(["a", "a", "b", "c", None])])
        if i % 10 == 0:
            rows.append([1000 + i, text + " Extra" * (i % 20 // 10), lang, "b"])
    rows[3][1] += " bob@example.org or +1 555 123 4567 or 10.1.2.3"
    rows += [[500, None, "en", "a"], [501, "12 -- 34", "fr", "a"], [7, rows[8][1], "en", "z"], [502, "...", None, None], [*rows[5]], [*rows[5]]]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, str(folder)), "stage")
    return [*out, docs], str(folder)


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_language_stage(stages):
    before, after = rows_of(stages[0][0]), rows_of(stages[0][1])
    assert Counter(after) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))


def test_near_copies_stage(stages):
    before, after = rows_of(stages[0][1]), rows_of(stages[0][2])
    found = components([(k, r[1]) for k, r in enumerate(before)])
    groups = defaultdict(list)
    for k, _, c in found:
        groups[c].append(before[k])
    assert len(after) == len(groups) and len(after) < len(before)
    assert all(sum(r in g for r in after) == 1 and min(r[0] for r in g) in {r[0] for r in after} for g in groups.values())


def test_personal_data_stage(stages):
    before, after = rows_of(stages[0][2]), {r[0]: r for r in rows_of(stages[0][3])}
    assert len(after) == len(before)
    for r in before:
        if not pii_spans(r[1]):
            assert after[r[0]] == r
    assert all(not pii_spans(r[1]) and r[4] == len(r[1]) for r in after.values()) and any("[EMAIL] or [PHONE] or [IP]" in r[1] for r in after.values())


def test_mixing_stage(stages):
    before, after = Counter(rows_of(stages[0][3])), Counter(rows_of(stages[0][4]))
    assert set(after) <= set(before) and max(after.values()) <= 3


def test_packing_stage(stages):
    docs, pieces = stages[0][4], stages[0][5]
    assert pieces.filter("start = 0").count() == docs.count()
    assert pieces.agg({"length": "sum"}).first()[0] == pieces.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0]


def test_run(spark, stages):
    assert P.run(spark, stages[1]).count() == stages[0][5].count()


def test_clashing_columns_null_texts_and_empty_tables_pass_every_stage(spark, tmp_path):
    rows = [(i, t, s, 1, 0.5, "x", "y", "z") for i, t, s in [(1, "the cat sat on the mat and saw it all", "a"), (2, None, "a"), (3, "", None), (1, "the cat sat on the mat and saw it all", "a"), (4, "the dog lay on the rug near the old door", "b"), (None, "call me at a.b@example.org or so", "b")]]
    kind = "doc_id long, text string, source string, n_chars long, score double, row_key string, mix_row string, pii_extra string, lang string"
    docs = spark.createDataFrame([(*r, "en") for r in rows], kind)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.filter("n_chars < 0")):
        for _, stage in P.STAGES[:-1]:
            before = table.count()
            table = stage(spark, table, str(tmp_path))
            assert table.columns == docs.columns and (before or not table.count())
        assert (P.STAGES[-1][1](spark, table, str(tmp_path)).count() > 0) == (table.count() > 0)
