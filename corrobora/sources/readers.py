"""Reading tables, drifting files and log trees with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | str, date_format: str | None = None, timestamp_format: str | None = None
) -> DataFrame:
    """CSV with header and declared schema: no inference pass, bad fields become NULL, '' is NULL."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    if date_format:
        reader = reader.option("dateFormat", date_format)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    return reader.csv(path)


def read_csv_kept(
    spark: SparkSession, path: str | list[str], schema: str, date_format: str | None = None, timestamp_format: str | None = None
) -> DataFrame:
    """As ``read_csv``, with the whole line of a record that does not fit the schema in ``bad_record``; null where it fits."""
    rows = spark.read.schema(f"{schema}, bad_record string").options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_record")
    if date_format:
        rows = rows.option("dateFormat", date_format)
    if timestamp_format:
        rows = rows.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    return rows.csv(path)


def read_csv_text(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV with every column as text, for sources whose types drift; cast in the canonical projection."""
    return read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns))


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str, below: bool = False) -> DataFrame:
    """One JSON document per file, with its path; with ``below`` all files of the folder's tree.

    A pattern has the driver look up folder after folder; the folders of a tree are listed by tasks.
    """
    docs = spark.read.schema(schema).options(multiLine=True, recursiveFileLookup=below).json(path)
    return docs.withColumn("file_path", F.col("_metadata.file_path"))


def read_text_tree(spark: SparkSession, glob: str, keys: Mapping[str, str], below: bool = False) -> DataFrame:
    """Whole small files of a tree: key columns cut out of each path by the given patterns, plus ``text``.

    With ``below`` the path is a folder and all files of its tree are read, as in ``read_json_documents``.
    """
    files = spark.read.options(wholetext=True, recursiveFileLookup=below).text(glob).withColumn("file_path", F.col("_metadata.file_path"))
    return files.select(*[F.regexp_extract("file_path", p, 1).alias(k) for k, p in keys.items()], F.col("value").alias("text"))


TRIAL_KEYS = {"task": r"/([^/]+)/trial[^/]*/", "trial": r"/(trial[^/]*)/"}


def read_rewards(spark: SparkSession, root: str) -> DataFrame:
    """(task, trial, reward) from <root>/<task>/trial*/verifier/reward.txt."""
    raw = read_text_tree(spark, f"{root}/*/trial*/verifier/reward.txt", TRIAL_KEYS)
    return raw.select("task", "trial", F.trim("text").try_cast("double").alias("reward"))


def read_trials(spark: SparkSession, root: str) -> DataFrame:
    """(task, trial) of every trial folder that holds at least its config."""
    found = spark.read.format("binaryFile").load(f"{root}/*/trial*/config.json").select("path")
    return found.select(*[F.regexp_extract("path", p, 1).alias(k) for k, p in TRIAL_KEYS.items()]).distinct()


TRAJECTORY_SCHEMA = (
    "session_id string, steps array<struct<step_id: int, timestamp: string, source: string, message: string, "
    "tool_calls: array<struct<tool_call_id: string, function_name: string>>, "
    "metrics: struct<prompt_tokens: bigint, completion_tokens: bigint, cost_usd: double>>>"
)


def read_trajectories(spark: SparkSession, root: str) -> DataFrame:
    """(task, trial, session_id, steps) from <root>/<task>/trial*/agent/trajectory.json."""
    docs = read_json_documents(spark, f"{root}/*/trial*/agent/trajectory.json", TRAJECTORY_SCHEMA)
    return docs.select(*[F.regexp_extract("file_path", p, 1).alias(k) for k, p in TRIAL_KEYS.items()], "session_id", "steps")
