"""Sources and sinks: one reader by extension, explicit result schemas, rank files, and a task catalogue."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text

RESULT_SCHEMAS = {
    "vsi": "id bigint, dataset string, scene_name string, question string, ground_truth string, predicted_answer string, question_type string, promt string, frame_timestamps array<int>, video_duration int",
    "sti": "id bigint, question string, ground_truth string, predicted_answer string, task string, promt string, frame_timestamps array<int>, video_duration int",
    "spar": "id string, question string, ground_truth string, predicted_answer string, task string, image_type string, promt string",
    "videomme": "id string, question string, ground_truth string, predicted_answer string, task string, promt string, duration string",
    "longvideo": "id string, question string, ground_truth string, predicted_answer string, question_category string, topic_category string, promt string, duration double",
    "tempcompass": "question string, answer string, prediction string, promt string",
}
MAP_SCHEMA = "video_id string, cognitive_map map<string,array<array<int>>>, object_list array<string>"
_KINDS = {".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".tsv": "tsv", ".pkl": "pickle", ".pickle": "pickle"}


def _holds_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """The first line that is not blank is an object by itself."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not first or not first[0].value.strip().startswith("{"):
        return False
    try:
        return isinstance(json.loads(first[0].value), dict)
    except ValueError:
        return False


def read_media(spark: SparkSession, path: str | list[str], kind: str = "image") -> DataFrame:
    """(path, url) of media files, their bytes as data URLs."""
    return spark.read.format("binaryFile").load(path).select("path", text.data_url(F.col("content"), kind).alias("url"))


def read_table(spark: SparkSession, path: str | list[str], fmt: str | None = None, schema: str | T.StructType | None = None, infer: bool = False) -> DataFrame:
    """A table by its extension or `fmt`: parquet, json (an array, one object, or lines, told apart by the first line), jsonl, csv and tsv (strings unless `infer`).

    Pickle is refused, as reading it runs code; unknown kinds raise ValueError.
    """
    first = path if isinstance(path, str) else path[0]
    kind = fmt or _KINDS.get(os.path.splitext(first.rstrip("/"))[1].lower())
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json" and not _holds_lines(spark, path)).json(path)
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("inferSchema", infer).option("sep", "," if kind == "csv" else "\t").option("multiLine", True).option("escape", '"').csv(path)
    raise ValueError(f"refused: {first}" if kind == "pickle" else f"unknown kind of table: {first}")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, on any file system Spark knows; none is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if not found:
        raise FileNotFoundError(f"none of {len(paths)} files exists: {paths[:3]}")
    return found


def union_tables(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order: an aggregate with a map-side part, no window."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def load_maps(spark: SparkSession, path: str) -> DataFrame:
    """Object maps by video, later lines of a file winning over earlier ones."""
    raw = spark.read.schema(MAP_SCHEMA).json(path)
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return last_per_key(raw.withColumn("_o", line), "video_id", "_o")


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result rows as JSON lines, one file per partition."""
    df.write.mode(mode).json(path)


def merge_ranks(df: DataFrame, rank: str, seq: str) -> DataFrame:
    """Rows of all ranks in rank order."""
    return df.orderBy(rank, seq)


def write_metrics(report_json: DataFrame, path: str, mode: str = "append") -> None:
    report_json.coalesce(1).write.mode(mode).text(path)


# Benchmark -> its data files and the folder of its media, relative to a data root.
CATALOGUE = {
    "VSI-Bench": (["VSI_bench/test-00000-of-00001.parquet"], "VSI_bench"),
    "STI-Bench": (["STI-Bench/qa.parquet"], "STI-Bench/video"),
    "SPAR-Bench": ([f"SPAR-Bench/data/test-{i:05d}-of-00004.parquet" for i in range(4)], "SPAR-7M/spar/structured3d/images"),
    "Video-MME": (["Video-MME/videomme/test-00000-of-00001.parquet"], "Video-MME/data"),
    "LongVideoBench": (["LongVideoBench/lvb_val.json"], "LongVideoBench/videos"),
    "TempCompass": (["TempCompass/eval_tempcompass.json"], "TempCompass/videos"),
}


def catalogued(task: str) -> tuple[list[str], str]:
    """(data files, media folder) of a benchmark; an unknown one raises ValueError."""
    try:
        return CATALOGUE[task]
    except KeyError:
        raise ValueError(f"unknown task: {task}") from None


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, files, media) for t, (files, media) in CATALOGUE.items()], "task string, files array<string>, media string")
