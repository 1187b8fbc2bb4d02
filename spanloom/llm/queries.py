"""The dealt operators as queries over the test tables, with production parameters and whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import jaccard_join, language_id, permutation_index, quality_classifier, quality_rules, sentencepiece_bpe, source_mixing, substring_dedup, suffix_dedup, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = sentencepiece_bpe.encode_documents(_table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day that page_id fixes; the list's events follow from a hash of each host.

    A third of the hosts is listed at some time, some are delisted and listed again; one domain is
    listed for 40 days; every 97th page's URL is listed by itself.
    """
    pages = _table(spark, sf_dir, "pages")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(start, (F.col("page_id") * 7 % 730).cast("int")).alias("fetched"))
    hosts = captures.select(url_filters.host_of(F.col("url")).alias("host")).where("host != ''").distinct()
    x = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    hosts = hosts.select("host", x.alias("x")).where("x % 3 = 0")
    event = lambda kind, value, action, day: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), day.alias("since"))
    own = F.array(
        event("host", F.col("host"), "add", F.date_add(start, (F.col("x") % 500).cast("int"))),
        F.when(F.col("x") % 2 == 0, event("host", F.col("host"), "remove", F.date_add(start, (F.col("x") % 500 + 60).cast("int")))),
        F.when(F.col("x") % 4 == 0, event("host", F.col("host"), "add", F.date_add(start, (F.col("x") % 500 + 150).cast("int")))),
    )
    events = hosts.select(F.explode(F.filter(own, lambda e: e.isNotNull())).alias("e")).select("e.*")
    single = captures.where("page_id % 97 = 0 and url is not null").select(F.lit("url").alias("kind"), F.col("url").alias("value"), F.lit("add").alias("action"), F.lit("2024-06-01").cast("date").alias("since"))
    domain = spark.createDataFrame([("domain", "example.org", "add", "2024-03-01"), ("domain", "example.org", "remove", "2024-04-10")], "kind string, value string, action string, since string")
    events = events.unionByName(single).unionByName(domain.withColumn("since", F.to_date("since")))
    return url_filters.filter_captures(captures, events)


OP5_SQL = """
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 7 % 730 AS INTEGER) AS DATE) AS fetched,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/:?#]*)', 1)), '\\.$', '') AS host
  FROM pages
), hosts AS (
  SELECT host, x FROM (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS x FROM (SELECT DISTINCT host FROM captures WHERE host != '')) WHERE x % 3 = 0
), events AS (
  SELECT 'host' AS kind, host AS value, 'add' AS action, DATE '2024-01-01' + x % 500 AS since FROM hosts
  UNION SELECT 'host', host, 'remove', DATE '2024-01-01' + (x % 500 + 60) FROM hosts WHERE x % 2 = 0
  UNION SELECT 'host', host, 'add', DATE '2024-01-01' + (x % 500 + 150) FROM hosts WHERE x % 4 = 0
  UNION SELECT 'url', url, 'add', DATE '2024-06-01' FROM captures WHERE page_id % 97 = 0 AND url IS NOT NULL
  UNION SELECT 'domain', 'example.org', 'add', DATE '2024-03-01'
  UNION SELECT 'domain', 'example.org', 'remove', DATE '2024-04-10'
), spans AS (
  SELECT kind, value, since, until FROM (
    SELECT kind, value, action, since, coalesce(lead(since) OVER (PARTITION BY kind, value ORDER BY since, action), DATE '9999-12-31') AS until FROM events
  ) WHERE action = 'add' AND since < until
), hits AS (
  SELECT c.page_id, s.kind, s.value, s.since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY CASE s.kind WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, length(s.value) DESC, s.since DESC) AS n
  FROM captures c JOIN spans s
    ON c.fetched >= s.since AND c.fetched < s.until
   AND ((s.kind = 'url' AND s.value = c.url) OR (s.kind = 'host' AND s.value = c.host)
        OR (s.kind = 'domain' AND (s.value = c.host OR ends_with(c.host, '.' || s.value))))
)
SELECT c.page_id, c.url, c.fetched, c.host, h.page_id IS NOT NULL AS blocked,
       h.kind AS blocked_kind, h.value AS blocked_value, CAST(h.since AS DATE) AS blocked_since
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.n = 1
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.forest_join(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_permutation_index": op2_permutation_index,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_url_filters": op5_url_filters,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
}
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP7_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
x AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i+34], ' ') END AS win FROM p),
d AS (SELECT win FROM x WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
c AS (SELECT doc_id, i, word, max(CASE WHEN d.win IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN d ON d.win = x.win),
k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS sh FROM w WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8::DOUBLE * (nx.n + ny.n - c) - 1e-9),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, (SELECT min(y) FROM r WHERE r.x = w.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links,
       least(w.doc_id, coalesce(k.rep, w.doc_id)) AS rep_id, coalesce(n.n, 0) AS n_shingles
FROM w LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links, min(CASE WHEN same THEN y END) AS rep FROM l GROUP BY x) k USING (doc_id)
"""
ORACLE: dict[str, str] = {"op5_url_filters": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op10_jaccard_join": OP10_SQL}
