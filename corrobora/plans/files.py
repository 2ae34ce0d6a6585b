"""Tables written as CSV, JSON documents and log trees in the shared folder, and read back with declared schemas."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession, functions as F

from ..session import shared_dir, staged
from ..sources import readers as R
from ..sources import sinks as W
from ..sources.readers import table
from .registry import query


def _folder(spark: SparkSession) -> str:
    """A new folder next to the staged tables, which ``drop_staged`` removes with them."""
    return os.path.join(shared_dir(spark), "staged", spark.sparkContext.applicationId, f"files-{uuid.uuid4().hex}")


@query(
    "csv_typed",
    """SELECT o_orderkey AS order_key, o_custkey AS customer, o_orderstatus AS status,
       CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS total, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority,
       o_orderkey % 10 = 0 AS bad FROM orders""",
)
def csv_typed(spark, d):
    """A price in ten is written as text that is no number; its record is kept as it stands and only that field is null."""
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    day = F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")
    path = _folder(spark)
    W.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("total"), day, "o_orderpriority"), path)
    schema = "order_key bigint, customer bigint, status string, total double, day date, priority string"
    rows = R.read_csv_kept(spark, path, schema, date_format="dd/MM/yyyy")
    return rows.select("order_key", "customer", "status", "total", F.date_format("day", "yyyy-MM-dd").alias("day"), "priority", F.col("bad_record").isNotNull().alias("bad"))


@query(
    "csv_text",
    """SELECT lpad(c_custkey::VARCHAR, 8, '0') AS code, CASE WHEN c_custkey % 7 <> 0 THEN c_name || ', "' || c_mktsegment || '"' END AS label, c_nationkey::VARCHAR AS nation FROM customer""",
)
def csv_text(spark, d):
    """Codes with leading zeros stay text; delimiters and quotes in a field come back; an empty field is null."""
    label = F.when(F.col("c_custkey") % 7 != 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    path = _folder(spark)
    W.write_csv(table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), label.alias("label"), F.col("c_nationkey").alias("nation")), path)
    return R.read_csv_text(spark, path, ["code", "label", "nation"])


@query(
    "json_documents",
    """SELECT s_suppkey AS supplier, n_name AS nation, s_nationkey * 10 + i AS code, round(s_acctbal, 2) AS balance, 1::BIGINT AS files
       FROM supplier JOIN nation ON n_nationkey = s_nationkey, (SELECT unnest([1, 2, 3]) AS i)""",
)
def json_documents(spark, d):
    """A document per supplier; nested values come back by the declared schema, a line per code."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    codes = F.array(*[F.col("s_nationkey") * 10 + i for i in (1, 2, 3)])
    rows = table(spark, d, "supplier").join(nation, "s_nationkey")
    doc = F.to_json(F.struct(F.col("s_suppkey").alias("supplier"), F.struct("name", codes.alias("codes")).alias("nation"), F.col("s_acctbal").alias("balance")))
    path = _folder(spark)
    W.write_documents(rows.select(F.floor(F.col("s_suppkey") / 100).alias("shelf"), "s_suppkey", doc.alias("text")), path, ["shelf"], "text", ["s_suppkey"], single=True)
    read = staged(
        R.read_json_documents(spark, path, "supplier bigint, nation struct<name: string, codes: array<int>>, balance double", below=True), ["supplier"]
    )  # every file is opened once
    files = read.groupBy("supplier").agg(F.countDistinct("file_path").alias("files"))
    lines = read.select("supplier", F.col("nation.name").alias("nation"), F.explode("nation.codes").alias("code"), F.round("balance", 2).alias("balance"))
    return lines.join(files, "supplier")


@query(
    "log_tree",
    """SELECT 'u' || (user_id % 10) AS task, 'trial' || (event_id % 3) AS trial, count(*) AS lines, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def log_tree(spark, d):
    """Logs by task and trial, at most ten thousand events in a file; keys come from a file's path, its lines from the whole text."""
    numbered = [("u", F.col("user_id") % 10, "task"), ("trial", F.col("event_id") % 3, "trial")]
    keys = [F.concat(F.lit(word), number.cast("string")).alias(name) for word, number, name in numbered]
    path = _folder(spark)
    lines = table(spark, d, "events").select(*keys, F.floor(F.col("event_id") / 10_000).alias("part"), F.concat_ws(" ", "event_type", "value").alias("line"))
    W.write_documents(lines, path, ["task", "trial"], "line", ["part"])
    logs = R.read_text_tree(spark, path, {"task": r"/task=([^/]+)/", "trial": r"/trial=([^/]+)/"}, below=True)
    read = logs.select("task", "trial", F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line"))
    parts = F.split("line", " ")
    return read.groupBy("task", "trial").agg(
        F.count("*").alias("lines"), F.count_if(parts[0] == "purchase").alias("purchases"), F.round(F.sum(parts[1].cast("double")), 4).alias("total")
    )
