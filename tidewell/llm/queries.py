"""The ten operators over their whole tables, with production parameters, and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.curriculum import mix
from tidewell.llm.line_dedup import dedup_lines
from tidewell.llm.media import text_media
from tidewell.llm.packing import pack
from tidewell.llm.pii import find_personal
from tidewell.llm.quality import fit, held_out, score
from tidewell.llm.shingle_join import shingle_components
from tidewell.llm.token_counts import count_tokens
from tidewell.llm.top_k import top_k
from tidewell.llm.url_filters import decide, hosts_with_word
from tidewell.sources.tables import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SPAM_WORDS = ["casino", "free", "ads", "spam", "cheap", "adult"]


def op1_shingle_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(table(spark, folder, "documents"), words=3, num=9, den=10)


def op2_jpeg_media(spark: SparkSession, folder: str) -> DataFrame:
    return text_media(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=4096, closing=1)


def op5_subword_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit(documents, labels.where(~held_out(F.col("doc_id"))))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return decide(pages, URL_RULES, hosts_with_word(pages, SPAM_WORDS))


def op7_line_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), every=50, k=5)


def op9_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), weights=(5, 2, 1), budget=1.5, most=2.0)


def op10_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal(table(spark, folder, "documents")).drop("base", "added")


QUERIES = {
    "op1_shingle_jaccard": op1_shingle_jaccard,
    "op2_jpeg_media": op2_jpeg_media,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit": op4_best_fit,
    "op5_subword_quality": op5_subword_quality,
    "op6_url_cascade": op6_url_cascade,
    "op7_line_neighbourhood": op7_line_neighbourhood,
    "op8_uniform_threshold": op8_uniform_threshold,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_contextual_pii": op10_contextual_pii,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_shingle_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
d AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a
""",
    "op7_line_neighbourhood": r"""
WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (
  SELECT doc_id, pos, trim(regexp_replace(lower(line), '[\x20\t\x0B\f\r]+', ' ', 'g'), ' ') AS s
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM x)),
l AS (
  SELECT doc_id, pos, s, len(string_split(s, ' ')) >= 5 AS by_word, CASE WHEN len(string_split(s, ' ')) >= 5 THEN string_split(s, ' ') ELSE string_split(s, '') END AS w
  FROM t WHERE len(string_split(s, ' ')) >= 5 OR length(s) >= 20),
f AS (SELECT s, any_value(by_word) AS by_word, any_value(w) AS w, any_value(len(w)) AS n, min({'doc_id': doc_id, 'pos': pos}) AS first FROM l GROUP BY s),
h AS (
  SELECT s, by_word, w, first, m, unnest([array_to_string(w[1:m // 2], ' ') || ' <', '> ' || array_to_string(w[n - m + m // 2 + 1:n], ' ')]) AS half
  FROM (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 8)),
c AS (SELECT DISTINCT a.s AS s, a.w AS a, b.w AS b FROM h a JOIN h b ON a.by_word = b.by_word AND a.m = b.m AND a.half = b.half AND b.first < a.first),
k AS (
  SELECT s, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) AS head,
         coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[-i] = b[-i]), false) - 1, least(len(a), len(b))) AS tail, greatest(len(a), len(b)) AS n FROM c),
near AS (SELECT DISTINCT s FROM k WHERE head + tail >= n - 1),
gone AS (
  SELECT doc_id, list(pos) AS gone FROM l JOIN f ON l.s = f.s LEFT JOIN near ON near.s = l.s
  WHERE near.s IS NOT NULL OR first <> {'doc_id': doc_id, 'pos': pos} GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda v, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id
""",
    "op8_uniform_threshold": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.r AS o, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, o) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op6_url_cascade": r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
l AS (SELECT DISTINCT host AS listed FROM u WHERE len(list_filter(string_split(host, '.'), lambda x: len(list_filter(['casino-', 'free-', 'ads-', 'spam-', 'cheap-', 'adult-'], lambda w: starts_with(x, w))) > 0)) > 0),
b AS (SELECT DISTINCT host AS refused FROM (SELECT DISTINCT host FROM u) JOIN l ON host = listed OR ends_with(host, '.' || listed)),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule,
       coalesce(v, CASE WHEN refused IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id) LEFT JOIN b ON host = refused
""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
