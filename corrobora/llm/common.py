"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import os
import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any, AnyStr

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (null ids: fold of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds).cast("int")


def unit(*parts: Column) -> Column:
    """Uniform number in (0, 1), a function of the parts alone (md5, so SQL can repeat it)."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return os.path.join(shared_dir(spark), "llm", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """The same rows as a written table: read often, computed once, safe when executors are lost. ``by``: the last column, with files of its own per value."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a ``stage``; nothing may read its rows any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made within leave no shuffle files when they have run, where this Spark can be told so; else the files stay until they are collected.

    Such a frame is run once: what is returned to others is made outside.
    """
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not conf.isModifiable(key) or conf.get(key) == "true":
        yield
        return
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, "false")


def slices(text: AnyStr, edge: re.Pattern, size: int = 1 << 20) -> Iterator[AnyStr]:
    """The text in slices of about ``size``, each cut before a match of ``edge``, so that a long text is never one list of words."""
    at = 0
    while len(text) - at > size:
        found = edge.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, ``limit`` at most: all above a count found from a histogram of fixed size."""
    place = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    sizes = {r["b"]: r["n"] for r in df.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()}
    least, held = None, 0
    for b in sorted(sizes, reverse=True):
        held += sizes[b]
        if held > limit:
            break
        least = b
    return df.filter(F.lit(False) if least is None else place >= least)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """A value of this Python process, made once for all tasks that it runs one after another.

    The library travels with the tasks by value, so globals of its own modules are new in every task.
    """
    store = vars(sys.modules.setdefault("corrobora_kept", types.ModuleType("corrobora_kept")))
    if name not in store:
        store[name] = make()
    return store[name]
