"""Readers and writers of the formats that timelines and evaluations come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QA_SCHEMA = """
  id string, episode_id string, source_episode_id string, episode_path string, split string, target string, prompt_type string,
  center_window struct<start_frame: bigint, end_frame: bigint, num_frames: int>,
  media struct<video_paths: array<struct<name: string, path: string>>, context_start_frame: bigint, context_end_frame: bigint,
               max_video_frames: int, mosaic_video_path: string, audio_path: string>,
  sensor_feature_path string, sensor_feature_index bigint, sensor_feature_dim int, question string,
  answer_json struct<action: string, subtask: string, objects: array<string>, contact: string, transition: string, next_action: string,
                     evidence_window: struct<start_frame: bigint, end_frame: bigint>>,
  label string, action_options array<string>, subtask_options array<string>, label_options array<string>
"""
CAPTION_SCHEMA = """
  config string, segments array<struct<`Sub Task`: string, `Current Action`: array<struct<label: string, description: string>>,
  objects: map<string, array<string>>, interaction: map<string, string>>>
"""


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped. ``tolerant`` drops broken lines, else one stops
    the read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_jsonl_kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Broken lines kept, whole, in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the header."""
    return spark.read.option("header", True).option("multiLine", False).csv(path)


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of largest ``order`` of each key, by an aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[f"`{c}`" for c in rows.columns]), F.struct(order)).alias("_b")).select("_b.*")


def read_features(spark: SparkSession, path: str, blocks: list[str] | None = None, keys: tuple[str, ...] = ("episode_id", "window_index")) -> DataFrame:
    """Feature blocks, an array column each, of a Parquet table; other blocks are not read."""
    table = spark.read.parquet(path)
    return table.select(*keys, *blocks) if blocks else table


def block_names(names: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Blocks that equal or begin with one of ``include`` (all if empty) and none of ``exclude``."""
    hit = lambda n, xs: any(n == x or n.startswith(x) for x in xs)
    return [n for n in names if (not include or hit(n, include)) and not hit(n, exclude or [])]


def cached_features(make, path: str, spark: SparkSession, **parameters: object) -> DataFrame:
    """The table of ``make()`` kept under a folder named by its parameters, made once."""
    folder = "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in sorted(parameters.items())]])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, name, extension, modified) of files under ``root``, contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", F.col("length").alias("bytes"), name.alias("name"), F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("extension"), F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.sha2("content", 256).alias("sha256"))


def first_source(counts: dict[str, Column], least: int) -> Column:
    """The first of the ordered sources with at least ``least`` usable episodes, else null."""
    found = None
    for name, count in counts.items():
        found = F.when(count >= least, name) if found is None else found.when(count >= least, name)
    return found


def caption_frames(captions: DataFrame) -> DataFrame:
    """Caption documents (episode_id, segments) to frame rows with objects and interaction."""
    segment = captions.select("episode_id", F.explode("segments").alias("s"))
    label = F.col("s.`Current Action`")[0]["label"]
    held = segment.select("episode_id", F.col("s.`Sub Task`").alias("theme"), label.alias("action_label"), F.col("s.interaction").alias("_i"), F.explode("s.objects").alias("frame", "objects"))
    return held.select("episode_id", F.col("frame").cast("long").alias("frame_idx"), "theme", "action_label", "objects", F.try_element_at("_i", F.col("frame")).alias("interaction"))


def write_csv(rows: DataFrame, path: str, single: bool = False, overwrite: bool = False) -> None:
    """``single`` is for small reports: one file, so one task."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "errorifexists").json(path)


def union_of_columns(*parts: DataFrame) -> DataFrame:
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p, allowMissingColumns=True)
    return made


def merge_components(parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """The rows of several parts, keys prefixed by their part's name."""
    return union_of_columns(*[p.withColumn(key, F.concat(F.lit(f"{n}:"), F.col(key).cast("string"))).withColumn("component", F.lit(n)) for n, p in parts.items()])


def sanitized(rows: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """Text replaced in every string column, also inside structs and arrays, through their JSON."""
    made = rows
    for f in rows.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if "string" not in kind:
            continue
        plain = kind == "string"
        text = c if plain else F.to_json(c)
        for old, new in replacements.items():
            text = F.replace(text, F.lit(old), F.lit(new))
        made = made.withColumn(f.name, text if plain else F.from_json(text, f.dataType))
    return made


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; more than ``most`` rows are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, found)])
