"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, leaderboard, media, mixing, quality, simhash, substring, tokencount, topk, urls, vectorcodes, wordtable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, limit=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def held_out(parts: int, part: int) -> Column:
    """Whether the CRC-32 of doc_id as text leaves `part` when divided by `parts`; true of a null id, which nothing learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learns=~held_out(4, 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


#: First day of the made-up list, and days and minutes of it by hexadecimal digits of a hash; op3's SQL has the same.
_DAY0 = 1_704_067_200
_HEX = "0123456789abcdef"


def _digit(name: str, place: int) -> Column:
    return F.instr(F.lit(_HEX), F.substring(F.md5(name), place, 1)) - 1


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a minute that its id gives, against three dated lists made from all pages by a rule (tables
    have neither lists nor fetch times): of hosts, of first steps of paths, and of the domains above hosts and of whole
    paths, some a step deeper and some in upper case."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.timestamp_seconds(F.lit(_DAY0) + (F.col("page_id") * 7919) % 525_600 * 60).alias("at"))
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    named = lambda p: pages.select(p.alias("p")).where("p IS NOT NULL AND NOT endswith(p, '/')").distinct()
    hosts, steps = named(host), named(F.concat(host, F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2))))
    above, whole = named(F.substring_index(host, ".", -2)), named(F.concat(host, path))

    def entry(named: DataFrame, name: str, action: Column, days: Column, pattern: Column = F.col("p")) -> DataFrame:
        return named.select(F.lit(name).alias("list"), pattern.alias("pattern"), action.alias("action"), F.timestamp_seconds(F.lit(_DAY0) + days * 86_400).alias("at"))

    half = lambda place, one, other: F.when(_digit("p", place) < 8, one).otherwise(other)
    entries = entry(hosts.where(_digit("p", 1) < 10), "hosts", F.lit("block"), _digit("p", 2) * 8)
    entries = entries.union(entry(hosts.where(_digit("p", 3) < 8), "hosts", half(4, "remove", "allow"), 130 + _digit("p", 5) * 8))
    entries = entries.union(entry(steps.where(_digit("p", 1) < 4), "paths", half(2, "block", "allow"), _digit("p", 3) * 20))
    entries = entries.union(entry(above, "domains", half(2, "block", "allow"), 60 + _digit("p", 3) * 16))
    entries = entries.union(entry(whole.where(_digit("p", 1) < 6), "whole", half(2, "block", "allow"), _digit("p", 3) * 12, F.when(_digit("p", 4) < 8, F.upper("p")).otherwise(F.concat("p", F.lit("/")))))
    entries = entries.union(entry(whole.where(_digit("p", 5) < 4), "whole", F.lit("block"), _digit("p", 6) * 12, F.concat("p", F.lit("/Deeper/still/x"))))
    return urls.judge(captures, entries).withColumnRenamed("capture_id", "page_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(table(spark, sf_dir, "documents"), window=35)


#: The vocabulary of op5 and of the pipeline's last stage.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.archive(table(spark, sf_dir, "documents"))


def page_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's sequences over all pages; an extra to op7, whose contract is about documents."""
    return media.illustrated(table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learns=~held_out(5, 0))
    return quality.score(docs, model, threshold=0.3).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), RANKS)


def op11_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_leaderboard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.change_feed(*(table(spark, sf_dir, name) for name in ("sale_lines", "items", "vendors")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


_OP3 = r"""
WITH u AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 525600 * 60 AS at_s,
         nullif(rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
         coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path
  FROM pages),
h AS (SELECT DISTINCT host AS p FROM u WHERE host IS NOT NULL),
st AS (SELECT DISTINCT host || '/' || split_part(path, '/', 2) AS p FROM u WHERE host IS NOT NULL AND split_part(path, '/', 2) <> ''),
ab AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS p FROM u WHERE host IS NOT NULL),
wh AS (SELECT DISTINCT host || path AS p FROM u WHERE host IS NOT NULL AND NOT ends_with(path, '/')),
x AS (SELECT *, list_transform(range(1, 7), lambda i: instr('0123456789abcdef', md5(p)[i]) - 1) AS d FROM (
  SELECT 'h' AS k, p FROM h UNION ALL SELECT 's', p FROM st UNION ALL SELECT 'a', p FROM ab UNION ALL SELECT 'w', p FROM wh)),
e AS (
  SELECT 'hosts' AS list, p, 'block' AS action, d[2] * 8 AS days FROM x WHERE k = 'h' AND d[1] < 10
  UNION ALL SELECT 'hosts', p, CASE WHEN d[4] < 8 THEN 'remove' ELSE 'allow' END, 130 + d[5] * 8 FROM x WHERE k = 'h' AND d[3] < 8
  UNION ALL SELECT 'paths', p, CASE WHEN d[2] < 8 THEN 'block' ELSE 'allow' END, d[3] * 20 FROM x WHERE k = 's' AND d[1] < 4
  UNION ALL SELECT 'domains', p, CASE WHEN d[2] < 8 THEN 'block' ELSE 'allow' END, 60 + d[3] * 16 FROM x WHERE k = 'a'
  UNION ALL SELECT 'whole', CASE WHEN d[4] < 8 THEN upper(p) ELSE p || '/' END, CASE WHEN d[2] < 8 THEN 'block' ELSE 'allow' END, d[3] * 12 FROM x WHERE k = 'w' AND d[1] < 6
  UNION ALL SELECT 'whole', p || '/Deeper/still/x', 'block', d[6] * 12 FROM x WHERE k = 'w' AND d[5] < 4),
n AS (SELECT list, rtrim(lower(trim(p)), '/') AS pattern, max(action) AS action, 1704067200 + days * 86400 AS since FROM e GROUP BY ALL),
i AS (SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS until FROM n),
f AS (SELECT *, host || rtrim(lower(regexp_replace(path, '/+', '/', 'g')), '/') AS address FROM u),
-- An entry names a host and all below it, or an address and all below that.
m AS (
  SELECT f.page_id, f.url, i.list, i.pattern, i.action,
         row_number() OVER (PARTITION BY f.page_id, f.url ORDER BY length(i.pattern) DESC, i.action <> 'allow', i.list) AS n
  FROM f JOIN i ON i.action <> 'remove' AND f.at_s >= i.since AND (i.until IS NULL OR f.at_s < i.until)
   AND CASE WHEN contains(i.pattern, '/') THEN starts_with(f.address || '/', i.pattern || '/')
            ELSE f.host = i.pattern OR (contains(i.pattern, '.') AND ends_with(f.host, '.' || i.pattern)) END)
SELECT u.page_id, u.host, coalesce(m.action, 'none') AS verdict, m.list, m.pattern
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.url = u.url AND m.n = 1
"""

#: Windows are held against one another as lists of words.
_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT nr, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35),
x AS (SELECT s.nr, s.pos, sha256(array_to_string(d.w[s.pos : s.pos + 34], ' ')) AS k FROM s JOIN d ON d.nr = s.nr),
y AS (SELECT nr, pos FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM x) WHERE n > 1),
g AS (SELECT DISTINCT nr, pos + o AS pos FROM y, (SELECT unnest(range(35)) AS o)),
p AS (SELECT nr, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT p.nr, string_agg(p.word, ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM p LEFT JOIN g ON g.nr = p.nr AND g.pos = p.pos WHERE g.nr IS NULL GROUP BY p.nr)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.nr = d.nr
"""

QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_language_id, op3_url_filter, op4_substring_dedup, op5_byte_bpe,
    op6_top_k, op7_media_columns, op8_source_mixing, op9_quality, op10_token_counts, op11_word_table_bpe, op12_leaderboard_feed, op13_vector_codes,
    page_media_sequences,
)}

#: DuckDB SQL where SQL can express the query.
ORACLES: dict[str, str] = {
    "op3_url_filter": _OP3,
    "op4_substring_dedup": _OP4,
    "op6_top_k": topk.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op12_leaderboard_feed": leaderboard.ORACLE,
    "op13_vector_codes": vectorcodes.ORACLE,
}
