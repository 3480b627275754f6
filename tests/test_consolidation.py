import random

import pyarrow as pa
import pytest

from intervalis.operators import intervals, table_functions
from intervalis.operators.consolidation import ArrowConsolidation

SCHEMA = "video_id string, index int, start_time double, end_time double, duration double, score double, tier string, shot_type string, is_garbage boolean, is_key_moment boolean, is_best_take boolean, is_repeated_take boolean, face_count int, tags array<string>, metrics struct<a:double,b:double>"
TYPES = {
    "video_id": pa.string(), "index": pa.int32(), **dict.fromkeys(("start_time", "end_time", "duration", "score"), pa.float64()), "tier": pa.string(), "shot_type": pa.string(),
    **dict.fromkeys(("is_garbage", "is_key_moment", "is_best_take", "is_repeated_take"), pa.bool_()), "face_count": pa.int32(), "tags": pa.list_(pa.string()), "metrics": pa.struct([("a", pa.float64()), ("b", pa.float64())]),
}


def clips(seed, n):
    rnd, at, out = random.Random(seed), {}, []
    short = rnd.choice([0.1, 0.5, 0.9])
    for k in range(n):
        v = rnd.choice(["hot", "hot", "a", "b", None, f"v{k // 3}"])
        start = at.get(v, 0.0) + rnd.choice([0.0, 0.0, 0.0, 0.05, -0.12, 3.0])
        at[v] = start + rnd.choice([0.25, 0.5, 0.9] if rnd.random() < short else [1.2, 2.0, 4.0])
        out.append(
            {"video_id": v, "index": k, "start_time": start, "end_time": at[v], "duration": 77.0, "score": rnd.choice([None, 4.0, 5.0, 8.0]), "tier": rnd.choice(["gold", "silver", "silver", "bronze", "garbage", None]),
             "shot_type": rnd.choice(["TILT", "PANEO", "LOCKED", "SHAKY", None]), "is_garbage": rnd.choice([None, False, False]), "is_key_moment": rnd.random() < 0.1, "is_best_take": rnd.choice([None, False, rnd.random() < 0.2]),
             "is_repeated_take": rnd.random() < 0.3, "face_count": rnd.choice([None, 0, 2]), "tags": rnd.choice([None, ["x"], ["z", "y"]]), "metrics": rnd.choice([None, {"a": rnd.random(), "b": None}, {"a": 1.0, "b": rnd.random()}])}
        )
    return sorted(out, key=lambda r: (r["video_id"] is not None, r["video_id"] or "", r["start_time"], r["index"]))


def plain(rows):
    return sorted(repr(sorted((k, sorted(v.items()) if isinstance(v, dict) else v) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_batches_equal_the_fold_by_rows(seed, size):
    rows = clips(seed, 240)
    micro = [0.4, 1.5, 5.0][seed % 3]
    want = []
    for v in {r["video_id"] for r in rows}:
        want += intervals.consolidated([r for r in rows if r["video_id"] == v], micro)
    fold, got = ArrowConsolidation(micro), []
    schema, most = pa.schema(list(TYPES.items())), 0
    for k in range(0, len(rows), size):
        got += fold.push(pa.RecordBatch.from_pylist(rows[k : k + size], schema=schema))
        most = max(most, fold.held.num_rows)
    got += fold.finish()
    assert plain(r for b in got for r in b.to_pylist()) == plain(want) and most <= 3


def test_table_function_over_batches_equals_the_one_by_rows(spark):
    table_functions.register(spark)
    data = spark.createDataFrame(clips(3, 900), SCHEMA)
    data.repartition(5).createOrReplaceTempView("clips_to_fold")
    dealt = table_functions.register_consolidation(spark, "folded_clips", data.schema)
    got = spark.sql(f"SELECT * FROM folded_clips(TABLE(clips_to_fold) {dealt}, 1.5D)")
    want = spark.sql("SELECT * FROM consolidated_segments(TABLE(clips_to_fold), 1.5)")
    assert got.columns == want.columns
    assert plain(r.asDict(recursive=True) for r in got.collect()) == plain(r.asDict(recursive=True) for r in want.collect())
