import gzip
import json
import os
import time
import xml.etree.ElementTree as tree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from intervalis.operators import timeline
from intervalis.plans import catalogue, scratch
from intervalis.sources import timeline_files as T


def placed(spark, n=400):
    """A third of all clips are one project's; names hold quotes, slashes, a line break, and nothing."""
    names = ["hot", 'a "b"/<c>', "", None, "z" * 400, "two\nlines"]
    rows = [(names[0] if i % 3 == 0 else names[1 + i % 5], f"f{i % 7}&.mp4", f"/x/f{i % 7}&.mp4", float(i), float(i) + 1 + i % 5, ("gold", "silver", "bronze", "discard")[i % 4], 5.0, i, 0.0) for i in range(n)]
    clips = spark.createDataFrame(rows, "project_id string, filename string, path string, start_time double, end_time double, tier string, score double, clip_no int, file_duration double").withColumn("shot_type", F.lit("TILT"))
    return timeline.layout(timeline.with_handles(clips.repartition(7), 0.5), "by_tier")


def read_files(path):
    found = {}
    for folder in T.committed(path):
        for name in os.listdir(f"{path}/{folder}"):
            if name.endswith(".xml"):
                assert name not in found
                found[name] = tree.parse(f"{path}/{folder}/{name}").getroot()
    return found


def test_round_trip(spark, tmp_path):
    path, rows = str(tmp_path / "out"), placed(spark)
    T.write_timelines(rows, path)
    want = {}
    for r in timeline.clip_items(rows).orderBy("track", "timeline_start", "position").collect():
        want.setdefault(T.file_name(r.project_id), {}).setdefault(r.track, []).append(r["item"])
    found = read_files(path)
    assert set(found) == set(want) and len(found) == 6
    for name, root in found.items():
        tracks = {int(t.get("id")): [tree.tostring(c).strip() for c in t] for t in root.iter("track")}
        assert list(tracks) == sorted(tracks)
        assert tracks == {k: [tree.tostring(tree.fromstring(x)) for x in v] for k, v in want[name].items()}
        assert int(root.find("sequence/duration").text) >= max(int(e.text) for e in root.iter("end"))
    lines = T.read_timelines(spark, path)
    assert {(r.kind, r["count"]) for r in lines.groupBy("kind").count().collect()} >= {("clip", 400), ("head", 6)}


def test_a_line_break_in_a_name_stays_in_its_line(spark, tmp_path):
    path = str(tmp_path / "out")
    T.write_timelines(placed(spark, 12).withColumn("filename", F.lit("a\nb.mp4")), path)
    assert T.read_timelines(spark, path).filter("kind = 'clip'").count() == 12
    assert {c.text for root in read_files(path).values() for c in root.iter("name")} == {"a\nb.mp4"}


def test_overwrite_append_and_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "out"), placed(spark, 30)
    clips = lambda: T.read_timelines(spark, path).filter("kind = 'clip'").count()
    T.write_timelines(rows, path)
    T.write_timelines(rows.filter("project_id = 'hot'"), path)
    assert clips() == 10 and len([f for f in os.listdir(path) if f.startswith("part-")]) == len(T.committed(path))
    T.write_timelines(rows.filter("project_id <> 'hot'"), path, mode="append")
    assert clips() == rows.filter("project_id is not null").count()
    T.write_timelines(rows.limit(0), path)
    assert clips() == 0 and T.committed(path) == []


def test_a_failed_job_leaves_what_was_committed(spark, tmp_path):
    path, rows = str(tmp_path / "out"), placed(spark, 60)
    T.write_timelines(rows, path)
    before = json.loads(open(f"{path}/{T.MANIFEST}").read())
    with pytest.raises(Exception, match="a clip without a track"):
        T.write_timelines(rows.withColumn("track", F.when(F.col("clip_no") != 59, F.col("track"))), path, mode="append")
    assert json.loads(open(f"{path}/{T.MANIFEST}").read()) == before
    assert sorted(f for f in os.listdir(path) if f.startswith("part-")) == sorted(before["folders"])


def test_a_lost_attempt_is_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    T.write_timelines(placed(spark, 30), path)
    stray = f"{path}/part-lost-attempt"
    os.makedirs(stray)
    open(f"{stray}/p-hot.xml", "w").write('<clipitem id="clip_1"></clipitem>\n')
    assert T.read_timelines(spark, path).filter("kind = 'clip'").count() == 30


def test_a_project_is_rendered_in_many_tasks(spark, tmp_path, monkeypatch):
    """Ranges of 50 clips: the third of all that is one project's lies in several, and no clip or place is lost."""
    monkeypatch.setattr(T, "TASK_ROWS", 50)
    seen = []
    whole = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: seen.append((name, whole(df, name))) or seen[-1][1])
    path, rows = str(tmp_path / "out"), placed(spark)
    T.write_timelines(rows, path)
    blocks = dict(seen)["timeline-blocks"]
    assert blocks.filter("project = 'hot'").select(F.input_file_name()).distinct().count() >= 2
    want = [r["item"] for r in timeline.clip_items(rows).filter("project_id = 'hot'").orderBy("track", "timeline_start", "position").collect()]
    found = [r.text for r in T.read_timelines(spark, path).filter("file = 'p-hot.xml'").collect()]
    assert [x for x in found if x.startswith("<clipitem")] == want and len(want) == 134
    manifest = json.loads(open(f"{path}/{T.MANIFEST}").read())
    assert manifest["clips"] == 400 and manifest["projects"] == 6


def test_a_timeline_beyond_two_billion_frames(spark, tmp_path):
    path = str(tmp_path / "out")
    late = placed(spark, 12).withColumns({c: F.col(c) + 1e8 for c in ("timeline_start", "timeline_end")})
    T.write_timelines(late, path)
    assert min(int(e.text) for root in read_files(path).values() for e in root.iter("start")) >= 3_000_000_000


def test_packed_documents_are_the_same(spark, tmp_path):
    plain, packed, rows = str(tmp_path / "plain"), str(tmp_path / "packed"), placed(spark)
    T.write_timelines(rows, plain)
    T.write_timelines(rows, packed, compression="gzip")
    text = lambda path, read: {name.removesuffix(".gz"): read(f"{path}/{f}/{name}", "rb").read() for f in T.committed(path) for name in os.listdir(f"{path}/{f}") if name.startswith(("p-", "null.")) and not name.endswith(T.MEMBERS)}
    assert text(plain, open) == text(packed, gzip.open) and len(text(plain, open)) == 6
    assert all(name.endswith((".xml.gz", T.MEMBERS)) for f in T.committed(packed) for name in os.listdir(f"{packed}/{f}") if not name.startswith("."))
    assert sorted(T.read_timelines(spark, plain).collect()) == sorted(T.read_timelines(spark, packed).collect())
    with pytest.raises(Exception, match="unknown compression"):
        T.write_timelines(rows, packed, compression="lzo")


def test_a_packed_document_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Plain and packed documents lie side by side, and a third of all clips in one of them is read in several tasks."""
    monkeypatch.setattr(T, "TASK_ROWS", 50)
    path, rows = str(tmp_path / "out"), placed(spark)
    T.write_timelines(rows.filter("project_id = 'hot'"), path, compression="gzip")
    T.write_timelines(rows.filter("project_id <> 'hot' or project_id is null"), path, mode="append")
    read = T.read_timelines(spark, path)
    assert read.filter("kind = 'clip'").count() == 400 and read.filter("kind = 'head'").count() == 6
    assert read.filter("file = 'p-hot.xml' and kind = 'clip'").select(F.spark_partition_id()).distinct().count() >= 2
    want = {r["item"] for r in timeline.clip_items(rows).filter("project_id = 'hot'").collect()}
    assert {r.text for r in read.filter("file = 'p-hot.xml' and kind = 'clip'").collect()} == want and len(want) == 134


def test_the_text_of_the_documents_lies_nowhere_on_disk(spark):
    """All that the query leaves, and its documents, are a fraction of the lines it returns."""
    root = scratch.shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{top}/{name}") for top, _, names in os.walk(root) for name in names)
    before, rows = size(), lambda: {name for name in os.listdir(root) if name.startswith("timeline-rows-")}
    left = rows()
    found = catalogue.QUERIES["timeline_files"](spark, "/root/testdata/sf0.01")
    kept = size() - before
    assert kept < found.agg(F.sum(F.length("item"))).first()[0] / 2
    assert rows() == left


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}
    before, setting = shuffled(), {k: v for k, v in spark.conf.getAll.items() if "fileCleanup" in k}
    table = scratch.materialize(spark.range(20_000).withColumn("x", F.rand(3)).repartitionByRange(5, "x"), "shuffled")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 20_000
    assert {k: v for k, v in spark.conf.getAll.items() if "fileCleanup" in k} == setting


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("least", [1, 40, 1 << 20])
def test_blocks_hold_every_line_in_order_however_batches_fall(size, least, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", least)
    rows = [(p, t, k) for p in (None, "a", "b") for t in (1, 2) for k in range(7)]
    table = pa.table({"project": [p for p, _, _ in rows], "ends": pa.array([(k * 5) % 7 for *_, k in rows], pa.int64()), "track": pa.array([t for _, t, _ in rows], pa.int64()), "timeline_start": [float(k) for *_, k in rows], "position": pa.array([k for *_, k in rows], pa.int64()), "item": [f"<{p} {t} {k}>" for p, t, k in rows]})
    blocks = [r for b in T._blocks(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert [(b["project"], b["track"], line) for b in blocks for line in gzip.decompress(b["lines"]).decode().splitlines()] == [(p, t, f"<{p} {t} {k}>") for p, t, k in rows]
    assert sum(b["clips"] for b in blocks) == len(rows) and max(b["ends"] for b in blocks) == 6
    assert all(gzip.decompress(b["lines"]).decode().startswith(f"<{b['project']} {b['track']} {b['position']}>") and b["timeline_start"] == b["position"] for b in blocks)
    if least == 1 << 20:
        assert len(blocks) == 6
    elif least == 1:
        assert len(blocks) == len(rows) if size == 1 else len(blocks) > 6 or size == 1000
