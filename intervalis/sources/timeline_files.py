"""Timelines as files: a data source that writes one XML document a project, and a reader of what was committed.

Clips are put in order and joined to blocks of lines in ranges of the order, so a project is many tasks; the one that
writes its file only copies blocks. Lines are made after the clips' last move and leave their task as gzip members, so that
no text lies on disk between, and a document written with gzip is its blocks as they are. Beside such documents lies a list of
their members, so that many tasks read one.
Each task writes into a folder of its own attempt; only the driver's commit names that folder in the manifest, so
files of failed, repeated or speculative attempts are never read. A commit message is a folder's name and two counts.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import RecordBatch
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from intervalis.functions.scalars import frames, plain_id
from intervalis.operators.ranking import _begins
from intervalis.operators.timeline import clip_element, file_definitions
from intervalis.plans.scratch import TASK_ROWS, materialize, shuffles_dropped

MANIFEST, MEMBERS = "_committed.json", ".members"
LINES = ("project", "ends", "track", "clips", "lines")
_NAME_BYTES = 180
#: Bytes of text that a block has at least, but for the last of a track or range.
BLOCK_BYTES = 1 << 20


def _at(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def file_name(project: str | None) -> str:
    """A project's file: its name percent-encoded; long ones are cut and carry their hash."""
    if project is None:
        return "null.xml"
    safe = quote(project, safe="")
    return f"p-{safe}.xml" if len(safe) <= _NAME_BYTES else f"p-{safe[:_NAME_BYTES]}-{hashlib.sha256(project.encode()).hexdigest()}.xml"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    projects: int
    clips: int


def _deflate() -> zlib._Compress:
    return zlib.compressobj(3, zlib.DEFLATED, 31)


class _Documents:
    """The open document of blocks that come by project and track, each project's after its head."""

    def __init__(self, store: files.FileSystem, folder: str, timebase: int, zipped: bool):
        self.store, self.folder, self.timebase, self.zipped = store, folder, timebase, zipped
        self.members = store.open_output_stream(f"{folder}/documents{MEMBERS}") if zipped else None
        self.out, self.name, self.track, self.projects, self.clips = None, None, None, 0, 0

    def line(self, text: str) -> None:
        packed = _deflate()
        self.block(0, packed.compress(f"{text}\n".encode()) + packed.flush())

    def block(self, clips: int, lines: bytes) -> None:
        if self.zipped:
            self.members.write(f"{self.name} {self.out.tell()} {len(lines)} {clips}\n".encode())
        self.out.write(lines if self.zipped else gzip.decompress(lines))
        self.clips += clips

    def add(self, project: str | None, ends: int, track: int | None, clips: int | None, lines: bytes | None) -> None:
        if track is None:  # a head
            self.close()
            self.name, self.projects = file_name(project) + ".gz" * self.zipped, self.projects + 1
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None, buffer_size=1 << 20)
            name = quote(project or "", safe="")
            self.line(f'<xmeml version="4"><sequence id="{name}"><duration>{ends}</duration><rate><timebase>{self.timebase}</timebase></rate><media><video>')
            return
        if track != self.track:
            if self.track is not None:
                self.line("</track>")
            self.line(f'<track id="{track}">')
            self.track = track
        self.block(clips, lines)

    def close(self) -> None:
        if self.out is not None:
            self.line("</track>")
            self.line("</video></media></sequence></xmeml>")
            self.out.close()
        self.out, self.track = None, None

    def finish(self) -> None:
        self.close()
        if self.members is not None:
            self.members.close()


class TimelineWriter(DataSourceArrowWriter):
    def __init__(self, path: str, timebase: int, zipped: bool, overwrite: bool):
        self.path, self.timebase, self.zipped, self.overwrite = path, timebase, zipped, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        store, root = _at(self.path)
        folder, made = f"part-{self.job}-{uuid.uuid4().hex}", None
        for batch in iterator:
            for row in zip(*(batch.column(name).to_pylist() for name in LINES), strict=True):
                if made is None:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    made = _Documents(store, f"{root}/{folder}", self.timebase, self.zipped)
                made.add(*row)
        if made is None:
            return Written("", 0, 0)
        made.finish()
        return Written(folder, made.projects, made.clips)

    def _folders(self, store: files.FileSystem, root: str) -> list[str]:
        found = store.get_file_info(files.FileSelector(root, allow_not_found=True))
        return [f.base_name for f in found if f.type == files.FileType.Directory and f.base_name.startswith("part-")]

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _at(self.path)
        store.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None and m.folder]
        kept = [] if self.overwrite else committed(self.path)
        manifest = {"folders": kept + [m.folder for m in done], "projects": sum(m.projects for m in done), "clips": sum(m.clips for m in done)}
        draft = f"{root}/{MANIFEST}.{self.job}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(manifest).encode())
        store.move(draft, f"{root}/{MANIFEST}")
        if self.overwrite:
            self._drop(store, root, [f for f in self._folders(store, root) if f not in set(manifest["folders"])])
        else:  # what lost attempts of this job left
            self._drop(store, root, [f for f in self._folders(store, root) if f.startswith(f"part-{self.job}") and f not in set(manifest["folders"])])

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _at(self.path)
        self._drop(store, root, [f for f in self._folders(store, root) if f.startswith(f"part-{self.job}")])

    def _drop(self, store: files.FileSystem, root: str, folders: list[str]) -> None:
        for folder in folders:
            store.delete_dir(f"{root}/{folder}")


class TimelineFiles(DataSource):
    """``format("timeline_xml")``: rows (project, ends, track, clips, lines), each task's by project and track, become one document a project.

    A project's first row has no track and is its head; of the others, lines is a gzip member of so many lines, a clip each.
    With the option compression gzip the documents are members of gzip too, and their names end in .gz.
    """

    @classmethod
    def name(cls) -> str:
        return "timeline_xml"

    def schema(self) -> str:
        return "project string, ends long, track long, clips long, lines binary"

    def writer(self, schema: StructType, overwrite: bool) -> TimelineWriter:
        if missing := set(LINES) - set(schema.names):
            raise ValueError(f"missing columns: {sorted(missing)}")
        if (compression := self.options.get("compression", "none")) not in ("none", "gzip"):
            raise ValueError(f"unknown compression: {compression}")
        return TimelineWriter(self.options["path"], int(self.options.get("timebase", "30")), compression == "gzip", overwrite)


def committed(path: str) -> list[str]:
    """Folders of the files that a commit has named."""
    store, root = _at(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type != files.FileType.File:
        return []
    with store.open_input_stream(f"{root}/{MANIFEST}") as found:
        return json.loads(found.read())["folders"]


_BLOCK = pa.schema([("project", pa.string()), ("ends", pa.int64()), ("track", pa.int64()), ("timeline_start", pa.float64()), ("position", pa.int64()), ("clips", pa.int64()), ("lines", pa.binary())])


def _blocks(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
    """Ordered clips as blocks of packed lines of one project and track, with the last end of their clips, the place of the first, and their number."""
    row, packed, size, made = {}, None, 0, []

    def done() -> RecordBatch:
        return RecordBatch.from_pylist([row | {"lines": b"".join(made) + packed.flush()}], schema=_BLOCK)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _begins(batch.column("project"), row.get("project")) | _begins(batch.column("track"), row.get("track"))
        new[0] |= not row
        first = np.union1d(0, np.flatnonzero(new))
        offsets = pa.array(np.append(first, batch.num_rows), pa.int32())
        items = pc.binary_join(pa.ListArray.from_arrays(offsets, batch.column("item").cast(pa.string())), "\n")
        ends = np.maximum.reduceat(batch.column("ends").to_numpy(zero_copy_only=False), first).tolist()
        clips = np.diff(np.append(first, batch.num_rows)).tolist()
        for k, at in enumerate(first.tolist()):
            if row and (new[at] or size >= BLOCK_BYTES):
                yield done()
                row = {}
            if not row:
                row = {c: batch.column(c)[at].as_py() for c in ("project", "track", "timeline_start", "position")} | {"ends": ends[k], "clips": 0}
                packed, size, made = _deflate(), 0, []
            text = items[k].as_buffer()
            made += [packed.compress(text), packed.compress(b"\n")]
            row |= {"ends": max(row["ends"], ends[k]), "clips": row["clips"] + clips[k]}
            size += text.size + 1
    if row:
        yield done()


def _discard(table: DataFrame) -> None:
    """Delete a scratch table that nothing will read again."""
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        store, root = _at(folder)
        store.delete_dir(root)


def write_timelines(placed: DataFrame, path: str, fps: float = 30.0, key: str = "project_id", mode: str = "overwrite", compression: str = "none") -> None:
    """Write each project's placed clips as one XML file below ``path``, in order of track, time and position.

    A project's clips are sorted in ranges, whose blocks of lines one task copies into the file, in order; no project
    is held whole. ``mode`` append adds files to those committed, so a project written twice has two. A null project
    has a file; a clip on no track is left out of tracks and so refused by an error; no clips, no files and an empty manifest.
    ``compression`` gzip writes .xml.gz, about a ninth of the text, and beside them the places of their members.
    """
    spark = placed.sparkSession
    spark.dataSource.register(TimelineFiles)
    rows = file_definitions(placed, key).select(
        F.col(key).cast("string").alias("project"), F.coalesce("track", F.raise_error(F.lit("a clip without a track"))).cast("long").alias("track"), "timeline_start", F.col("position").cast("long").alias("position"),
        "timeline_end", "clip_in", "clip_out", "filename", F.when(F.col("defines_file"), F.col("path")).alias("path"), "defines_file", "tier",
    )
    rows = materialize(rows, "timeline-rows")
    n = rows.count()
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * n // TASK_ROWS), -(-n // TASK_ROWS))
    place = ("project", "track", "timeline_start", "position")
    ordered = rows.repartitionByRange(ranges, *place).sortWithinPartitions(*place).withColumn("file_id", plain_id(F.col("filename")))  # numbers and names move; lines are made where they lie
    line = F.replace(F.replace(clip_element(fps), F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    lines = ordered.select("project", F.coalesce(frames(F.col("timeline_end"), fps, "long"), F.lit(0)).alias("ends"), "track", "timeline_start", "position", line.alias("item"))
    blocks = materialize(lines.mapInArrow(_blocks, "project string, ends long, track long, timeline_start double, position long, clips long, lines binary"), "timeline-blocks")
    _discard(rows)
    heads = blocks.groupBy("project").agg(F.max("ends").alias("ends"))
    parts = blocks.unionByName(heads, allowMissingColumns=True).repartition("project").sortWithinPartitions(*place).select(*LINES)
    with shuffles_dropped(spark):
        parts.write.format("timeline_xml").option("path", path).option("timebase", str(int(round(fps)))).option("compression", compression).mode(mode).save()


def _unpacked(path: str):
    """Lines of the members (file, folder, name, start, size) of packed documents below ``path``."""

    def run(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, root = _at(path)
                with store.open_input_file(f"{root}/{r['folder']}/{r['name']}") as document:
                    lines = gzip.decompress(document.read_at(r["size"], r["start"])).removesuffix(b"\n").split(b"\n")
                yield RecordBatch.from_arrays([pa.repeat(r["file"], len(lines)), pa.array(lines, pa.binary()).cast(pa.string())], names=["file", "text"])

    return run


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, text): every line of the committed files, packed or not; kind is head, track, clip or end."""
    folders = committed(path)
    if not folders:
        return spark.createDataFrame([], "file string, kind string, text string")
    read = lambda which: spark.read.option("pathGlobFilter", which).text([f"{path.rstrip('/')}/{f}" for f in folders])
    part = lambda k: F.element_at(F.split(F.input_file_name(), "/"), -k)
    lines = read("*.xml").select(part(1).alias("file"), F.col("value").alias("text"))
    place = F.split("value", " ")
    members = read(f"*{MEMBERS}").select(F.replace(F.regexp_replace(place[0], r"\.gz$", ""), F.lit("%"), F.lit("%25")).alias("file"), part(2).alias("folder"), place[0].alias("name"), *(place[k].cast("long").alias(c) for k, c in ((1, "start"), (2, "size"), (3, "clips"))))
    clips = members.agg(F.sum("clips")).first()[0]
    if clips is not None:
        lines = lines.unionByName(members.repartition(-(-clips // TASK_ROWS) or 1).mapInArrow(_unpacked(path), "file string, text string"))
    starts = lambda s: F.col("text").startswith(s)
    return lines.select("file", F.when(starts("<clipitem "), "clip").when(starts("<xmeml "), "head").when(starts("<track "), "track").otherwise("end").alias("kind"), "text")
