"""From raw documents to token ids: quality, language, near copies, mix, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and reads it again for the next stage, so a lost executor costs at most a task of one stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.llm import language, mixing, near_copies, pieces, quality
from corrobora.llm.common import stage, table, text_of
from corrobora.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language with a smaller share of the probability is no answer.
LEAST_SHARE = 0.5
MODEL = "piece_bpe_32k.model"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees' verdict."""
    trees = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees, carry=COLUMNS).filter("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang becomes the predicted one. Texts without a letter go."""
    tables = language.learn(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs, tables, carry=COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; null ids last, then by the text's digest."""
    chosen = near_copies.survivors(docs).toDF("chosen", "node")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("chosen")) & (F.md5(text_of()) == F.col("node"))
    return docs.join(chosen, same, "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def _row_key(text_print: Column) -> Column:
    """One text for a row's id, source and text, never null."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("doc_id", "source")]
    return F.md5(F.concat_ws("|", *parts, text_print))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice (a repeated row each time it is there)."""
    taken = mixing.mix(docs).filter("copies > 0").groupBy(_row_key(F.col("print")).alias("key")).agg(F.sum("copies").alias("copies"))
    # repeated rows are one row with their copies together; the join needs no further shuffle of the texts
    rows = docs.select(*COLUMNS, _row_key(F.md5(text_of())).alias("key")).dropDuplicates(["key"])
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return rows.join(taken, "key").withColumn("copy", each).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the piece ids of every document that is left."""
    encoded = pieces.encode(docs, tokenizer_path(MODEL), carry=("doc_id", "lang", "source"))
    return encoded.withColumn("n_pieces", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixed), ("SentencePiece encoding", tokens),
]
#: The first two stages are models and the last a lattice: no SQL says what they keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + re.sub(r"\W+", "-", name).lower())
    return docs
