"""The numbered queries over the whole given tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from burrow.llm import (
    bm25, bpe, extraction, fertility, forest_join, item_search, packing, quality, resampling, secret_scan, token_counts, toxicity, url_filter,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return fertility.judged(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_main_text")
def op4_main_text(spark, sf_dir):
    return extraction.extracted(table(spark, sf_dir, "pages"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


_TOP_K = 10


@query(
    "op1_bm25_top_k",
    f"""
WITH words AS (SELECT place, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-/:-@\\[-`{{-\\x7f]+')) AS word
               FROM (SELECT row_number() OVER () AS place, doc_id, text FROM documents)),
  tf AS (SELECT place, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
  len AS (SELECT place, sum(n) AS length FROM tf GROUP BY ALL),
  whole AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(length) FROM len) AS length),
  df AS (SELECT word, count(*) AS n FROM tf GROUP BY word),
  q AS (SELECT DISTINCT doc_id AS query_id, word, ln((docs - df.n + 0.5) / (df.n + 0.5) + 1) AS idf
        FROM tf JOIN df USING (word), whole WHERE doc_id % 100 = 0),
  gains AS (SELECT query_id, place, tf.doc_id, CAST(round(idf * (tf.n * 2.2 / (tf.n + 1.2 * (0.25 + 0.75 * len.length / (whole.length / docs)))) * 1000000) AS BIGINT) AS gain
            FROM q JOIN tf USING (word) JOIN len USING (place), whole),
  best AS (SELECT query_id, place, doc_id, sum(gain) AS units FROM gains GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank FROM best)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(units AS DOUBLE) / 1000000 AS score FROM ranked WHERE rank <= {_TOP_K}""",
)
def op1_bm25_top_k(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = bm25.top_k(docs, docs.where("doc_id % 100 = 0"), _TOP_K)
    return found.select("query_id", "rank", "doc_id", "score")


_ADDRESS = """CASE WHEN {0} LIKE '%://%' AND translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'x', 'x') <> ''
  THEN translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN regexp_extract(regexp_replace({0}, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*(.*)$', 1) = '' THEN '/'
       ELSE regexp_extract(regexp_replace({0}, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*(.*)$', 1) END END"""
_HOST = "coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _rules_sql(what: int) -> str:
    """CASE for the longest fitting rule: its name (0) or verdict (1)."""
    whens = []
    for host, path, verdict in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1])):
        value = (host + path, verdict)[what]
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value}'")
    return "CASE " + " ".join(whens) + " END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_URL_SQL = f"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, {_quoted(url_filter._HIDDEN)}, '', 'g'), {_quoted(url_filter._TAGS)})) AS tag
    FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh') AND url IS NOT NULL),
  links AS (SELECT url, replace(trim(CASE WHEN regexp_matches(tag, {_quoted(url_filter._CANONICAL)})
      THEN regexp_extract(tag, {_quoted(url_filter._HREF)}, 1) || regexp_extract(tag, {_quoted(url_filter._HREF)}, 2) || regexp_extract(tag, {_quoted(url_filter._HREF)}, 3)
      ELSE regexp_extract(tag, {_quoted(url_filter._TARGET)}, 1) END), '&amp;', '&') AS link
    FROM tags WHERE regexp_matches(tag, {_quoted(url_filter._CANONICAL)}) OR regexp_matches(tag, {_quoted(url_filter._REFRESH)})),
  whole AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
      WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
      WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || link
      WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') THEN NULL
      ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || link END AS target FROM links),
  edges AS (SELECT {_ADDRESS.format("url")} AS u, {_ADDRESS.format("target")} AS v FROM whole),
  arcs AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
  reach AS (SELECT u, v FROM arcs UNION SELECT r.u, a.v FROM reach r JOIN arcs a ON r.v = a.u),
  spoken AS (SELECT u, bool_or(said = 'allow') AS allowed, bool_or(said = 'block') AS blocked FROM (
      SELECT u, {_rules_sql(1)} AS said FROM (
        SELECT u, {_HOST.format("'x://' || v")} AS host, {_PATH.format("'x://' || v")} AS path FROM reach)) GROUP BY u),
  judged AS (SELECT page_id, {_ADDRESS.format("url")} AS u, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages)
SELECT page_id, host, path, {_rules_sql(0)} AS rule,
  coalesce({_rules_sql(1)}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN spoken USING (u)"""


@query("op5_url_filter", _URL_SQL)
def op5_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark, sf_dir):
    return forest_join.linked(table(spark, sf_dir, "documents"))


_ITEM_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op11_reversed_search",
    f"""
WITH terms AS (SELECT place, doc_id, unnest({_ITEM_TERMS}) AS term FROM (SELECT row_number() OVER () AS place, doc_id, text FROM documents)),
  tf AS (SELECT place, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
  len AS (SELECT place, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY place),
  whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM len),
  asked AS (SELECT DISTINCT item_id, unnest({_ITEM_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
  df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
  weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
  marks AS (SELECT place, 100 - 90 + (90 * n * docs) // length AS m FROM len, whole),
  scores AS (SELECT item_id, place, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
             FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN marks USING (place) WHERE doc_id IS NOT NULL GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
)
def op11_reversed_search(spark, sf_dir):
    return item_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC_TABLE = "[" + ", ".join(str(resampling.crc_of_byte(b)) for b in range(256)) + "]"


def _features_sql(name: str, rows: str) -> str:
    """CTEs ending in ``name``: place, bucket and number of each feature."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = " UNION ALL ".join(
        f"SELECT place, unnest(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' '))) AS run FROM {name}_words"
        for k in (1, 2, 3)
    )
    return f"""{name}_words AS (SELECT place, {words} AS words FROM {rows}),
  {name}_runs AS MATERIALIZED (SELECT place, run, count(*) AS n FROM ({runs}) GROUP BY ALL),
  {name}_crc AS MATERIALIZED (SELECT run, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(0, len(hex(encode(run))) // 2), lambda i: CAST('0x' || substr(hex(encode(run)), 2 * i + 1, 2) AS BIGINT))),
      lambda c, b: xor(crcs[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) % 10000 AS bucket
      FROM (SELECT DISTINCT run FROM {name}_runs), (SELECT CAST({_CRC_TABLE} AS BIGINT[]) AS crcs)),
  {name} AS MATERIALIZED (SELECT place, bucket, n FROM {name}_runs JOIN {name}_crc USING (run))"""


@query(
    "op12_importance_resampling",
    f"""
WITH placed AS MATERIALIZED (SELECT row_number() OVER () AS place, doc_id, text FROM documents),
  items AS MATERIALIZED (SELECT row_number() OVER () AS place, text FROM benchmark),
  {_features_sql("f", "placed")}, {_features_sql("g", "items")},
  s AS (SELECT bucket, sum(n) AS s FROM f GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM g GROUP BY bucket),
  whole AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t),
  gains AS (SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket), whole),
  sums AS (SELECT place, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN gains USING (bucket) GROUP BY place),
  scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) AS n_words,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM placed JOIN f_words USING (place) LEFT JOIN sums USING (place)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS may FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * may // 100 THEN place END AS rank FROM ranked""",
)
def op12_importance_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_token_counts")
def op13_token_counts(spark, sf_dir):
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
