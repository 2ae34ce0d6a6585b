"""Writing results: CSV, JSON reports, Markdown tables of summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import as_col
from ..session import parallelism, staged


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(
    df: DataFrame, path: str, keys: Sequence[str], text: Column | str, file_keys: Sequence[str] = (), single: bool = False
) -> None:
    """Text files in a tree of folders ``<key>=<value>``, a file per row of equal ``keys`` and ``file_keys``.

    A file holds the lines of its rows in no stated order; rows of one file meet in one task. With ``single`` every row is a
    file of its own, spread by ``file_keys``: the files lie side by side in the folder of their ``keys``, without a folder each,
    and tasks put their files in place themselves instead of leaving all of them to the driver.
    """
    rows = df.select(*keys, *file_keys, as_col(text).cast("string").alias("value"))
    if single:
        files = rows.repartition(parallelism(df.sparkSession), *keys, *file_keys).select(*keys, "value").write.partitionBy(*keys)
        files.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
        return
    name = [F.concat_ws("-", *[F.col(k).cast("string") for k in file_keys]).alias("file")] if file_keys else []
    parts = [*keys, *(["file"] if file_keys else [])]
    rows.select(*keys, *name, "value").repartition(parallelism(df.sparkSession), *parts).write.partitionBy(*parts).text(path)


def report_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nested structs, maps and arrays included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("report"))


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def keyed_map(key: str, value: Column | str) -> Column:
    """Aggregate {key: value} in key order; for summaries with one row per key."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), as_col(value).alias("v"))))
    return F.map_from_entries(pairs)


def markdown_lines(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(line, text): a Markdown table of any length, one row per line; the head is lines 0 and 1.

    ``order`` has to end in a unique column and to begin with one that ``with_row_index`` can bucket, or with text.
    """
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    rows = df.select(*order, cells.alias("text"))
    # sorted by ranges, so a partition's lines follow those of the partitions before it
    ranged = rows.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = staged(ranged.select("text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    body = placed.join(offsets, "part").select((F.col("at") - F.col("first") + F.col("before") + 2).cast("bigint").alias("line"), "text")
    top = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(head.split("\n"))], "line bigint, text string")
    return top.union(body)
