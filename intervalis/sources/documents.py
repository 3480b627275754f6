"""Analysis documents, project registries and probe output: JSON in, flat tables out, and back."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from intervalis.functions.scalars import frame_rate
from intervalis.schemas import ANALYSIS_DOCUMENT, PROJECT

VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mxf", "mkv", "m4v")


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of the video files of a folder; their content is not read."""
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in VIDEO_EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


PROBE = T.StructType.fromJson(
    {"type": "struct", "fields": [
        {"name": "streams", "nullable": True, "metadata": {}, "type": {"type": "array", "containsNull": True, "elementType": {"type": "struct", "fields": [
            {"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("codec_type", "string"), ("codec_name", "string"), ("r_frame_rate", "string"), ("avg_frame_rate", "string"), ("width", "integer"), ("height", "integer"))]}}},
        {"name": "format", "nullable": True, "metadata": {}, "type": {"type": "struct", "fields": [{"name": "duration", "type": "string", "nullable": True, "metadata": {}}]}}]}
)


def probed(df: DataFrame, column: str = "probe") -> DataFrame:
    """``df`` with fps, snapped_fps, duration, width, height and codec from the JSON of a container probe."""
    rows = df.withColumn("probe_struct", F.from_json(column, PROBE))
    rows = rows.withColumn("video_stream", F.try_element_at(F.filter("probe_struct.streams", lambda s: s["codec_type"] == "video"), F.lit(1)))
    part = lambda i: F.try_element_at(F.split("video_stream.r_frame_rate", "/"), F.lit(i)).try_cast("double")
    return (
        rows.withColumn("fps", F.coalesce(F.try_divide(part(1), F.coalesce(part(2), F.lit(1.0))), F.lit(30.0)))
        .withColumn("snapped_fps", frame_rate(F.col("video_stream.avg_frame_rate"), F.col("video_stream.r_frame_rate")))
        .withColumn("duration", F.coalesce(F.col("probe_struct.format.duration").try_cast("double"), F.lit(0.0)))
        .withColumn("width", F.coalesce("video_stream.width", F.lit(1920))).withColumn("height", F.coalesce("video_stream.height", F.lit(1080))).withColumn("codec", F.col("video_stream.codec_name"))
        .drop("probe_struct", "video_stream")
    )


def read_analyses(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per analysis document: analysis_id, modified, and its fields; corrupt ones have nulls."""
    docs = spark.read.schema(ANALYSIS_DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1)
    return docs.select(name.alias("analysis_id"), F.col("_metadata.file_modification_time").alias("modified"), "*")


def stream_analyses(spark: SparkSession, path: str, per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """``read_analyses`` as a stream: every document is read once, in the order of modification, across restarts too.

    The checkpoint keeps which files (by path) were read up to which round; folders below ``path`` are read as
    well. A document that is written anew under its old name isn't read again. A round takes ``per_trigger``
    documents, or, where ``bytes_per_trigger`` is given, as many as have that size together: rounds have fixed
    costs, so for many small documents their number should follow the bytes.
    """
    limit = ("maxFilesPerTrigger", per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    docs = spark.readStream.schema(ANALYSIS_DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option(*limit).json(path)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1)
    return docs.select(name.alias("analysis_id"), F.col("_metadata.file_modification_time").alias("modified"), "*")


def videos_of(documents: DataFrame) -> DataFrame:
    rows = documents.select("analysis_id", "project_id", F.explode("analyses").alias("v")).filter("v.success")
    return rows.select("analysis_id", "project_id", F.concat_ws("/", "analysis_id", "v.filename").alias("video_id"), "v.*").drop("success")


def segments_of(documents: DataFrame) -> DataFrame:
    """The segments of all successful videos, with their video's columns, an immutable segment_id and the index within all of a document's."""
    rows = exploded(documents)
    along = Window.partitionBy("analysis_id").orderBy("video_id", "start_time", "pos")
    return rows.withColumn("index", F.row_number().over(along) - 1).drop("pos")


def exploded(documents: DataFrame) -> DataFrame:
    """``segments_of`` without the index, which needs all of a document's rows: for streams."""
    videos = videos_of(documents).select("analysis_id", "project_id", "video_id", "filename", "path", F.col("duration").alias("file_duration"), F.posexplode("segments").alias("pos", "s"))
    rows = videos.select("*", "s.*").drop("s").withColumn("tier", F.lower("tier"))
    return rows.withColumn("segment_id", F.concat_ws("#", "video_id", "pos"))


def decorated(segments: DataFrame) -> DataFrame:
    """Rows as lists show them: the middle as thumbnail time."""
    return segments.withColumn("video_filename", F.col("filename")).withColumn("video_path", F.col("path")).withColumn("thumbnail_time", F.col("start_time") + F.col("duration") / 2)


def latest(documents: DataFrame) -> DataFrame:
    return documents.groupBy().agg(F.max_by("analysis_id", F.struct("modified", "analysis_id")).alias("analysis_id"), F.max("modified").alias("modified"))


def history(documents: DataFrame, k: int = 10) -> DataFrame:
    return documents.select("analysis_id", "modified", "stats").orderBy(F.desc("modified"), F.desc("analysis_id")).limit(k)


def write_analyses(documents: DataFrame, path: str) -> None:
    """Nested documents as JSON lines, partitioned by project."""
    documents.write.partitionBy("project_id").json(path)


def nested(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Flat tables back to documents: segments within videos within analyses."""
    columns = [F.col(c) for c in segments.columns if c not in ("analysis_id", "video_id")]
    inner = segments.groupBy("analysis_id", "video_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("segments"))
    rows = videos.join(inner, ["analysis_id", "video_id"], "left")
    return rows.groupBy("project_id", "analysis_id").agg(F.collect_list(F.struct("video_id", "filename", "duration", "segments")).alias("analyses"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The registry, a JSON object of projects by id or a list of them."""
    raw = spark.read.text(path, wholetext=True)
    as_map = F.map_values(F.from_json("value", T.MapType(T.StringType(), PROJECT)))
    as_list = F.from_json("value", T.ArrayType(PROJECT))
    rows = F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_map)
    return raw.select(F.explode(rows).alias("p")).select("p.*")


def without_comments(config: str) -> dict:
    """A JSON configuration without the keys that begin with //, at any depth."""
    return json.loads(config, object_pairs_hook=lambda pairs: {k: v for k, v in pairs if not re.match("//", k)})


def pending(uploads: DataFrame, analysed: DataFrame) -> DataFrame:
    """Uploaded and analysed videos in one list, with their state."""
    waiting = uploads.join(analysed.select("filename"), "filename", "left_anti").withColumn("state", F.lit("pending"))
    return analysed.withColumn("state", F.lit("analyzed")).unionByName(waiting, allowMissingColumns=True)


def field(raw: Column, path: str) -> Column:
    """A value of a JSON text by dotted path."""
    return F.get_json_object(raw, f"$.{path}")
