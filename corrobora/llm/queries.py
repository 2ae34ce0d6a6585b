"""The named queries of this subpackage over the standard tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import html_text, language, lexical, mixing, near_copies, packing, pieces, pitman_yor, quality, sharding, spelling, token_files, weighted_prints
from .common import id_fold, table, text_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


@query("op2_pieces")
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    # a literal space mark in a text cannot be told from a space after encoding
    text = F.replace(text_of(), F.lit(pieces.SPACE), F.lit(" "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5(text).alias("text_md5"))
    encoded = pieces.encode(docs, model, carry=("doc_id", "text_md5"))
    back = pieces.decode(encoded, model, carry=("doc_id", "text_md5"))
    same = F.md5(F.replace("text", F.lit(pieces.SPACE), F.lit(" "))) == F.col("text_md5")
    return back.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_pieces"), same.alias("round_trip"))


@query(
    "op3_mixing",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS print
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0 * source_size AS ceiling FROM s),
fill AS (  -- the sources that are full, round by round, until no further one is
  SELECT 0 AS round, CAST([] AS VARCHAR[]) AS names, 1.5 * sum(source_size) / sum(weight) AS level FROM w
  UNION ALL
  SELECT round + 1,
    (SELECT list(coalesce(source, chr(1))) FROM w WHERE level * weight > ceiling),
    (SELECT (1.5 * sum(source_size) - coalesce(sum(ceiling) FILTER (WHERE level * weight > ceiling), 0)) / nullif(sum(weight) FILTER (WHERE level * weight <= ceiling), 0) FROM w)
  FROM fill WHERE level IS NOT NULL AND round < 200
    AND len(names) < (SELECT count(*) FROM w WHERE level * weight > ceiling)),
t AS (
  SELECT w.source, w.source_size, CASE WHEN f.level IS NULL THEN ceiling ELSE least(ceiling, f.level * weight) END AS target
  FROM w, (SELECT level FROM fill ORDER BY round DESC LIMIT 1) f),
e AS (
  SELECT d.doc_id, d.source, d.size, d.print, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0 END AS expected,
    (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.print), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(expected + 1e-9) AS BIGINT) AS certain FROM e),
q AS (
  SELECT *, target - sum(size * certain) OVER (PARTITION BY source) AS lacking,
    row_number() OVER (PARTITION BY source ORDER BY (u / (1 - u)) * (1 - (expected - certain)) / nullif(expected - certain, 0), doc_id, print) AS place
  FROM c WHERE certain < 2 AND expected - certain > 1e-9),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT c.doc_id, c.size, c.source_size, c.target,
  CAST(c.size * (c.certain + CASE WHEN r.size > 0 AND round((r.lacking - r.before) / r.size) >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c LEFT JOIN r ON c.doc_id IS NOT DISTINCT FROM r.doc_id AND c.print = r.print
""",
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_weighted_prints")
def op4_weighted_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_prints.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_pitman_yor")
def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_fold(F.col("doc_id"), 5) == 1
    model, totals, tokens = pitman_yor.train(docs.filter(~held_out))
    found = pitman_yor.score(docs, model, totals, tokens)
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


@query("op6_near_copies")
def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = language.learn(docs.filter(id_fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), tables)
    return found.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query(
    "op11_lexical_search",
    r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), total
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10
""",
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_spelling",
    r"""
WITH RECURSIVE steps AS MATERIALIZED (  -- the table of the checksum: eight shifts of every byte
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b
  FROM counted),
sums AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS h
  FROM bytes, steps),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM sums),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gone AS MATERIALIZED (  -- every word with one letter left out: next to it, or behind a mark of its place
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT DISTINCT g.word, g.n, v.word AS near, v.n AS near_n FROM gone g JOIN v ON v.word = g.rest
  UNION ALL SELECT DISTINCT v.word, v.n, g.word, g.n FROM gone g JOIN v ON v.word = g.rest
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, min(row(-near_n, near)) AS b FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * v.n THEN -b[1] END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word) r USING (word)
""",
)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))
