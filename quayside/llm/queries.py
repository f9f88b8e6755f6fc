"""The queries of the numbered operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated_documents
from .exact_topk import largest_products
from .language_id import predict_languages
from .line_dedup import drop_frequent_lines
from .mixing import Targets, mix
from .near_dedup import near_duplicates
from .nearest import nearest
from .quality import quality_scores
from .span_dedup import drop_repeated_spans
from .token_counts import line_sections, section_tokens
from .token_files import token_output
from .vector_codes import code_digests
from .whitening import whiten

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Equal shares for all sources and learned topics, named shares for languages, of the tokens that are written.
MIX_TARGETS = Targets(source=None, lang={"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, topic=None, vocabulary=public_tokenizers.path("byte_bpe_50k.json"), learned_topics=8)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIX_TARGETS, budget=0.5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), rule="most", sectioner=line_sections)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"), min_documents=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, i, ls[i] AS line,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.k) AS BIGINT) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
      FROM l LEFT JOIN f ON f.k = l.k GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN g ON d.r = g.r
"""


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_spans(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS t
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, p, n, item_id FROM dwin JOIN win USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=32)


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "embeddings"))


def _round(r: int) -> str:
    """Assignment by the codebooks of round r, and the codebooks that follow from it."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT p.r, p.part, any_value(y) AS y, min(list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + entry) AS best
  FROM p JOIN c{r} ON c{r}.part = p.part GROUP BY p.r, p.part),
m{r} AS (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS e
  FROM (SELECT part, entry, i, sum(v) AS s, count(*) AS n
        FROM (SELECT part, best % 16 AS entry, unnest(y) AS v, unnest(range(len(y))) AS i FROM a{r}) GROUP BY part, entry, i)
  GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c{r}.part, c{r}.entry, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} ON m{r}.part = c{r}.part AND m{r}.entry = c{r}.entry)"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT r, vec_id, part, x[part * (len(x) // 8) + 1:(part + 1) * (len(x) // 8)] AS y FROM (SELECT r, vec_id, x, unnest(range(8)) AS part FROM v)),
c0 AS MATERIALIZED (SELECT part, entry, y AS e FROM (SELECT part, y, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 16),
{",".join(_round(r) for r in range(7))},
t AS (SELECT r, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a6 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN t ON t.r = v.r CROSS JOIN h
"""


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_products(table(spark, sf_dir, "embeddings"), every=100, k=10)


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_token_counts,
        op3_line_dedup,
        op4_span_dedup,
        op5_decontaminate,
        op6_quality,
        op7_nearest,
        op8_minhash_near_dedup,
        op9_token_output,
        op10_language_id,
        op11_whitening,
        op12_vector_codes,
        op13_exact_topk,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_decontaminate": OP5_SQL, "op12_vector_codes": OP12_SQL, "op13_exact_topk": OP13_SQL}
