import json
import os
import time

from intervalis.sources import documents
from intervalis.streaming.streams import drained


def write(folder, name, project, scores, success=True):
    segments = [{"start_time": float(k), "end_time": k + 1.0, "duration": 1.0, "tier": "GOLD", "score": s} for k, s in enumerate(scores)]
    doc = {"timestamp": "t", "project_id": project, "analyses": [{"success": success, "filename": f"{name}.mp4", "duration": 9.0, "segments": segments}]}
    with open(os.path.join(folder, f"{name}.json"), "w") as f:
        f.write(json.dumps(doc, indent=2))


def test_each_document_is_read_once_across_restarts(spark, tmp_path):
    """Three rounds of files, each a restart from the checkpoint; a failed video and a corrupt document add nothing."""
    folder, seen = str(tmp_path / "docs"), []
    os.makedirs(f"{folder}/below")
    for turn in range(3):
        for k in range(3):
            write(folder if k else f"{folder}/below", f"d{turn}{k}", f"p{k}", [turn + k / 10, 5.0])
            seen += [(f"d{turn}{k}", f"p{k}", turn + k / 10), (f"d{turn}{k}", f"p{k}", 5.0)]
        write(folder, f"failed{turn}", "p9", [1.0], success=False)
        with open(f"{folder}/broken{turn}.json", "w") as f:
            f.write('{"project_id": "p8", "analyses": [{')
        stream = documents.exploded(documents.stream_analyses(spark, folder, per_trigger=2))
        rows = drained(stream.select("analysis_id", "project_id", "score", "tier"), str(tmp_path / "state"), "append").collect()
        assert sorted(tuple(r)[:3] for r in rows) == sorted(seen) and {r.tier for r in rows} == {"gold"}
        time.sleep(1.1)
    again = drained(stream.select("analysis_id", "project_id", "score", "tier"), str(tmp_path / "state"), "append")
    assert again.count() == len(seen)


def test_the_stream_equals_the_batch(spark, tmp_path):
    for k in range(4):
        write(str(tmp_path), f"d{k}", "p", [k / 2, 3.0, 4.0])
    batch = documents.segments_of(documents.read_analyses(spark, str(tmp_path))).drop("index")
    stream = documents.exploded(documents.stream_analyses(spark, str(tmp_path))).drop("pos")
    got = drained(stream, str(tmp_path / "state"), "append")
    assert sorted(map(str, got.select("segment_id", "start_time", "score", "file_duration").collect())) == sorted(map(str, batch.select("segment_id", "start_time", "score", "file_duration").collect()))


def test_rounds_by_bytes_hold_many_small_documents(spark, tmp_path):
    """300 documents of some hundred bytes are one round, not three of a hundred; with a small bound they are many."""
    folder = str(tmp_path / "docs")
    os.makedirs(folder)
    for k in range(300):
        write(folder, f"d{k}", "p", [k / 2, 3.0])
    for bound, rounds in ((1 << 30, range(1, 2)), (20_000, range(4, 301))):
        state = str(tmp_path / f"state-{bound}")
        rows = drained(documents.exploded(documents.stream_analyses(spark, folder, bytes_per_trigger=bound)).select("analysis_id", "score"), state, "append")
        assert rows.count() == 600 and rows.select("analysis_id").distinct().count() == 300
        assert len([n for n in os.listdir(f"{state}/commits") if n.isdigit()]) in rounds
